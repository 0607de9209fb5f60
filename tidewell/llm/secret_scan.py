"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: an
OR of sets of trigrams that every match must contain.  The index lists, for each
trigram that some rule asks for, the documents whose lower-cased text holds it
(postings).  A document is a candidate of a rule when the postings of all
trigrams of one of its sets meet in it; only candidates are verified with the
expression itself.  Rules without mandatory trigrams scan every text.

The index is written once to the shared folder, sorted by trigram within its
files; queries with other rules over the same trigrams can read it again.
Postings are keyed by a hash of (doc_id, text): equal rows share a key, and a
collision could only add a candidate that verification rejects.

Defined results: null and empty texts have no spans; repeated rows and null doc_ids
are scanned like others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents, store, text_or_empty
from tidewell.llm.spans import joined, matches


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that is measured and its least length (0: any)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed patterns; the first three are the base, the others are added.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # runs shorter than 16 never count, and longer runs match whole
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
MAX_FORMS = 64


# ------------------------------------------------------------- trigram queries

def _forms(tree) -> list[list[str]] | None:
    """Literal runs that a match must contain, one list per alternative; a run
    ends where anything may follow.  None when there are too many forms."""
    forms = [[""]]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            forms = [f[:-1] + [f[-1] + chr(arg)] for f in forms]
            continue
        if name == "SUBPATTERN":
            inner = _forms(arg[3])
        elif name == "BRANCH":
            parts = [_forms(b) for b in arg[1]]
            inner = None if None in parts else [f for p in parts for f in p]
        elif name == "MAX_REPEAT":
            low, high, item = arg
            once = _forms(item)
            if (low, high) == (0, 1) and once:
                inner = [[""]] + once
            elif low and once:
                inner = [f + [""] for f in once] if int(high) > 1 else once
            else:
                inner = [["", ""]]
        elif name == "AT":
            inner = [[""]]
        else:                                   # classes and wildcards: any character
            inner = [["", ""]]
        inner = inner or [["", ""]]
        forms = [f[:-1] + [f[-1] + g[0]] + g[1:] for f in forms for g in inner]
        if len(forms) > MAX_FORMS:
            return None
    return forms


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-cased trigrams; a match holds all of at least one set.
    None when some form of a match needs no trigram."""
    forms = _forms(re._parser.parse(pattern))
    sets = {frozenset(run[i:i + 3].lower() for run in f for i in range(len(run) - 2))
            for f in forms or [[]]}
    return None if frozenset() in sets else sorted(sets, key=sorted)


# ---------------------------------------------------------------------- index

def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, trigrams) -> DataFrame:
    """Postings (trigram, doc) of the given trigrams, stored."""
    low = docs.select(row_hash().alias("doc"), F.lower(text_or_empty("text")).alias("t"))
    asked = F.array(*[F.lit(t) for t in sorted(trigrams)])
    rows = low.select("doc", F.explode(F.filter(asked, lambda g: F.contains(F.col("t"), g)))
                      .alias("trigram"))
    return store(rows.select("trigram", "doc").sortWithinPartitions("trigram"), "trigram_index")


def candidates(index: DataFrame, rules) -> DataFrame:
    """(doc, rules): the numbers of the rules whose trigram query a document meets."""
    asked = [(r, a, g, len(s)) for r, rule in enumerate(rules)
             for a, s in enumerate(trigram_query(rule.pattern) or []) for g in sorted(s)]
    # the rule table is a constant of the program, far under a broadcast's size
    table = index.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(a).alias("form"), F.lit(g).alias("trigram"),
                 F.lit(n).alias("need")) for r, a, g, n in asked])).alias("q")).select("q.*")
    met = index.join(F.broadcast(table), "trigram").groupBy("doc", "rule", "form", "need") \
        .agg(F.collect_set("trigram").alias("got")).where(F.size("got") == F.col("need"))
    return met.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def _spans(found: Column, kind: int, least: int) -> Column:
    """(start, kind, end) of the matches whose measured group is long enough."""
    long_enough = F.filter(found, lambda m: F.length(m["group"]) >= least) if least else found
    return F.transform(long_enough, lambda m: F.struct(
        m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and ``_tw_spans``: structs (start, kind, end) of every rule's matches."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = build_index(docs, {g for q in queries if q for s in q for g in s})
    d = docs.select("doc_id", text_or_empty("text").alias("_tw_t"), row_hash().alias("doc")) \
        .join(candidates(index, rules), "doc", "left")
    t = F.col("_tw_t")
    parts = []
    for i, (rule, q) in enumerate(zip(rules, queries)):
        guard = None if q is None else F.coalesce(F.array_contains("rules", i), F.lit(False))
        found = matches(t, rule.pattern, rule.group, guard)
        parts.append(_spans(found, i, rule.least))
    return d.select("doc_id", F.concat(*parts).alias("_tw_spans"))


def op7_secret_scan(spark, sf_dir) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    kinds = [r.kind for r in RULES]
    s = F.col("_tw_spans")

    def number(i):
        return F.size(F.filter(s, lambda x: x["kind"] == i)).cast("bigint")
    base = F.filter(s, lambda x: x["kind"] < len(BASE))
    return scan(documents(spark, sf_dir)).select(
        "doc_id", *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(joined(base, kinds), 256).alias("base_sha256"), joined(s, kinds).alias("spans"))
