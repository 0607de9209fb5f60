"""Personal data by weak supervision.

Candidate spans come from generous patterns.  Labelers vote on each (1 personal
data, -1 not, 0 no opinion): a strict regular expression with its checks, a
plausibility check, a gazetteer, cue words in front, counter-cues in front and
the formatting.  Spark counts the vote patterns over the whole corpus (a few
thousand rows at most, whatever its size).  Expectation-maximisation over these
counts estimates how each labeler votes on true and on false spans; the
posteriors then train a logistic span classifier on votes, kind and length,
which is compiled into a column expression and decides about the candidates.

Base spans (email, ip, card, phone by the strict rules) always stay; the
classifier adds others, but none that overlap a base span.

Candidates are extracted once, in one scan without shuffle, and stored; both
the vote counts and the final spans read the stored candidates.

Defined results: null and empty texts have no spans; repeated rows and null
doc_ids are treated like others; without candidates nothing is learned and only base
spans remain; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents, let, store, text_or_empty
from tidewell.llm.spans import CHUNK, joined, matches

KINDS = ("email", "ip", "card", "phone", "ssn", "name")
N_BASE = 4
ACCEPT = 0.9
EM_ROUNDS, FIT_ROUNDS, FIT_RATE = 40, 400, 0.5

# Fixed patterns of candidates: (kind, pattern, characters a text must hold).
# Runs are possessive and start only where a run starts, which leaves the
# matches as they are and the time linear.
LOCAL = "A-Za-z0-9._%+-"
CANDIDATES = (
    (0, rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (0, r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,64}"
        r"(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{2,64}){1,4}", "[at(]"),
    (1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    (2, r"[0-9](?:[\x20-]?[0-9])++", None),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    (3, r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", None),
    (4, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    (5, r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? "
        r"\p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?", " "),
)
STRICT = (0, 2, 3, 4)        # the candidates that the base rules test

# Fixed word lists of the gazetteers and context labelers.
TLDS = "com org net edu gov mil int info biz io co uk de fr es it nl ch at eu us ca au".split()
GIVEN_NAMES = ("james mary john anna peter paul maria jose luis carmen hans klaus petra "
               "pierre marie jean claire michael david sarah laura emma").split()
CUES = {0: "mail|contact|write to", 1: r"\bip\b|host|server|addr", 2: "card|visa|credit|karte|carte|tarjeta",
        3: r"tel|phone|call|fax|mobil|\bcell", 4: r"ssn|social|security", 5: "name|signed|from|by"}
COUNTER_CUES = r"version|\bv$|isbn|issn|order|invoice|\brev|build|chapter|section|serial"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Luhn check of a string of digits."""
    places = F.transform(F.sequence(F.lit(1), F.length(d)),
                         lambda i: F.substring(F.reverse(d), i, F.lit(1)).cast("int"))

    def add(a, x):
        return a + x
    doubled = F.transform(places, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), add) % 10 == 0


def _base_test(source: int, m: Column) -> Column:
    """The strict rule of a base candidate."""
    t, n = m["text"], F.length(_digits(m["text"]))
    if source == 2:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return t.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if source == 3:
        return F.when(n.between(14, 19), _luhn(_digits(t))).otherwise(F.lit(False))
    if source == 4:
        return n.between(10, 15)
    return F.lit(True)


def _vote(yes: Column | None, no: Column | None) -> Column:
    v = F.lit(0)
    if no is not None:
        v = F.when(no, F.lit(-1)).otherwise(v)
    return F.when(yes, F.lit(1)).otherwise(v) if yes is not None else v


def _votes(kind: int, source: int, m: Column, base: Column) -> Column:
    """Votes of the six labelers on one candidate."""
    t, near = F.lower(m["text"]), F.lower(m["before"])
    d = _digits(t)
    strict = _vote(base, ~base) if source in STRICT else F.lit(0)
    same = F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) == 0
    plausible = _vote(None, same & (F.length(d) > 0)) if kind in (1, 2, 3, 4) else F.lit(0)
    if kind == 0:
        listed = F.regexp_extract(t, r"([a-z0-9-]+)$", 1).isin(TLDS)
        known = _vote(listed, ~listed)
    elif kind == 1:
        known = _vote(None, t.rlike(r"^(?:0+|127|22[4-9]|2[3-5][0-9])\."))
    elif kind == 2:
        issuer = d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")
        known = _vote(issuer, ~issuer)
    elif kind == 3:
        known = _vote(d.rlike(r"^(?:1|3[0-9]|4[0-9])"), d.rlike("^0"))
    elif kind == 4:
        known = _vote(None, d.rlike(r"^(?:000|666|9)|^...00|0000$"))
    else:
        known = _vote(F.arrays_overlap(F.split(t, "[ .]+"), F.array(*[F.lit(x) for x in GIVEN_NAMES])), None)
    cue = _vote(near.rlike(CUES[kind]), None)
    counter = _vote(None, near.rlike(COUNTER_CUES))
    shaped = _vote(t.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$|^\+[0-9]{1,3} ?\(?[0-9]|^\(?[0-9]{3}\)?[ -][0-9]{3}-"),
                   None) if kind in (2, 3) else F.lit(0)
    return F.concat_ws("", *[F.element_at(F.array(F.lit("n"), F.lit("o"), F.lit("y")), v + 2)
                             for v in (strict, plausible, known, cue, counter, shaped)])


def _found(source: int, t: Column) -> Column:
    kind, pattern, needs = CANDIDATES[source]
    guard = None
    if needs and needs.startswith("["):
        guard = F.lower(t).rlike(r"[\[(] ?at ?[\])]")
    elif needs:
        guard = F.contains(t, F.lit(needs)) & t.rlike(pattern)

    def one(m):
        base = _base_test(source, m) if source in STRICT else F.lit(False)
        return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"),
                        base.alias("base"), _votes(kind, source, m, base).alias("votes"),
                        F.least(F.lit(9), F.length(m["text"]) / 4).cast("int").alias("size"))
    return F.transform(matches(t, pattern, guard=guard), one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``c``: every candidate span with its votes."""
    t = F.col("t")
    return docs.select("doc_id", text_or_empty("text").alias("t")).select(
        "doc_id", F.concat(*[_found(i, t) for i in range(len(CANDIDATES))]).alias("c"))


# ------------------------------------------------------------------- learning

def reliabilities(patterns: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """Posterior of each (kind, votes) pattern by expectation-maximisation.

    ``patterns`` are (kind, votes, count).  The model: a span of a kind is true
    with the kind's share; each labeler votes independently given the truth.
    It starts from the majority of votes; counts are smoothed by one.
    """
    post = {}
    for kind, votes, _ in patterns:
        lead = votes.count("y") - votes.count("n")
        post[kind, votes] = 1 / (1 + math.exp(-2.0 * lead))
    for _ in range(EM_ROUNDS):
        share, seen = {}, {}
        for kind, votes, n in patterns:
            p = post[kind, votes]
            a, b = share.get(kind, (1.0, 1.0))
            share[kind] = (a + n * p, b + n * (1 - p))
            for j, v in enumerate(votes):
                if v != "o":
                    a, b = seen.get((j, v), (1.0, 1.0))
                    seen[j, v] = (a + n * p, b + n * (1 - p))
        total = {}
        for (j, _v), (a, b) in seen.items():
            x, y = total.get(j, (0.0, 0.0))
            total[j] = (x + a, y + b)
        for kind, votes, _ in patterns:
            odds = math.log(share[kind][0] / share[kind][1])
            for j, v in enumerate(votes):
                if v != "o":
                    a, b = seen[j, v]
                    odds += math.log(a / total[j][0]) - math.log(b / total[j][1])
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def _features(kind: int, votes: str, size: int) -> list[str]:
    return ["bias", f"kind{kind}", f"size{kind}.{size}"] + [f"{j}{v}" for j, v in enumerate(votes) if v != "o"]


def fit_classifier(rows: list[tuple[int, str, int, int]], post) -> dict[str, float]:
    """Logistic weights of span features, trained on the posteriors; ``rows``
    are (kind, votes, size, count) and count no more than the patterns do."""
    cells = [(_features(k, v, s), post[k, v], math.log1p(n)) for k, v, s, n in rows]
    w: dict[str, float] = {f: 0.0 for c in cells for f in c[0]}
    whole = sum(c[2] for c in cells) or 1.0
    for _ in range(FIT_ROUNDS):
        grad = dict.fromkeys(w, 0.0)
        for feats, target, weight in cells:
            z = max(-30.0, min(30.0, sum(w[f] for f in feats)))
            err = (1 / (1 + math.exp(-z)) - target) * weight / whole
            for f in feats:
                grad[f] += err
        for f, g in grad.items():
            w[f] -= FIT_RATE * 4 * (g + 1e-4 * w[f])
    return w


def compile_classifier(w: dict[str, float]):
    """The classifier as a function of a candidate struct: accepted or not."""
    table = F.create_map(*[x for f, v in sorted(w.items()) for x in (F.lit(f), F.lit(v))]) if w else None

    def accept(c):
        if table is None:
            return F.lit(False)

        def weight(name):
            return F.coalesce(F.try_element_at(table, name), F.lit(0.0))
        kind, size = c["kind"].cast("string"), c["size"].cast("string")
        z = weight(F.lit("bias")) + weight(F.concat(F.lit("kind"), kind)) \
            + weight(F.concat(F.lit("size"), kind, F.lit("."), size))
        for j in range(6):
            z = z + weight(F.concat(F.lit(str(j)), F.substring(c["votes"], j + 1, 1)))
        return z >= math.log(ACCEPT / (1 - ACCEPT))
    return accept


def find(docs: DataFrame) -> DataFrame:
    """doc_id, ``_tw_base`` and ``_tw_all``: arrays of (start, kind, end)."""
    c = store(candidates(docs), "pii_candidates")
    counted = c.select(F.explode("c").alias("x")).groupBy("x.kind", "x.votes", "x.size") \
        .agg(F.count(F.lit(1)).alias("n"))
    # at most kinds x votes x sizes rows, whatever the corpus
    rows = sorted((r["kind"], r["votes"], r["size"], r["n"]) for r in counted.collect())
    patterns: dict[tuple[int, str], int] = {}
    for kind, votes, _, n in rows:
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    post = reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    accept = compile_classifier(fit_classifier(rows, post))

    def plain(spans):
        return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    def grouped(spans):
        """Spans by start, in groups with their first start and last end."""
        def group(part):
            return F.struct(part[0]["start"].alias("start"), F.array_max(F.transform(part, lambda y: y["end"]))
                            .alias("end"), part.alias("spans"))
        cuts = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int"))
        return F.transform(F.when(F.size(spans) > 0, cuts).otherwise(F.array().cast("array<int>")),
                           lambda k: let(F.slice(spans, k * CHUNK + 1, F.lit(CHUNK)), group))

    def meets(x, y):
        return (y["start"] < x["end"]) & (x["start"] < y["end"])
    base = F.filter("c", lambda x: x["base"])
    d = c.select("doc_id", "c", base.alias("b")).select("doc_id", "c", "b", let(
        F.array_sort("b"), grouped).alias("g"))
    # a text of very many spans is looked through group by group, not span by span
    free = F.filter("c", lambda x: ~x["base"] & accept(x) & ~F.exists(
        "g", lambda g: meets(x, g) & F.exists(g["spans"], lambda y: meets(x, y))))
    return d.select("doc_id", plain(F.col("b")).alias("_tw_base"),
                    F.concat(plain(F.col("b")), plain(free)).alias("_tw_all"))


def op6_pii_spans(spark, sf_dir) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    def number(k):
        return F.size(F.filter("_tw_base", lambda x: x["kind"] == k)).cast("bigint")
    return find(documents(spark, sf_dir)).select(
        "doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)],
        F.sha2(joined(F.col("_tw_base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("_tw_all"), KINDS).alias("spans"))
