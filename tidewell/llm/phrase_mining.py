"""Phrase collocations by stripes.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and LF to CR, and
pieces into words at spaces and tabs.  A *stripe* is an associative counter: the
key is a prefix (the first words of a phrase), the entries are its next words with
how often they follow.  Map tasks fill stripes from the text and send one row per
prefix; stripes of the same prefix are merged elementwise.  The merged stripes hold
all that is asked for:

* an entry is the frequency of the phrase prefix + word (its *extension*);
* the total of a prefix is the entry of its own last word, one word shorter; the
  empty prefix also carries the number of all words under the empty word;
* the largest entry of a phrase's stripe, and the largest entry of the stripes that
  the phrase ends (one word in front), tell whether a longer candidate covers it.

Stripes are filled by length, shortest first.  A phrase can only reach
``min_count`` if the phrases without its first and without its last word do, so
pass m reads the text again and counts only words whose two shorter phrases are in
the filter of pass m - 1: a bit set over phrase hashes of at most ``2 ** MOST_BITS``
bits (32 MB), made in Spark.  The filter may let other phrases through but never
drops one that counts; frequencies are counted on the phrases themselves, so the
result is exact at every size.

The stripe of a common prefix is split: prefixes with a thousandth of all words
(there are at most a thousand) over ``HOT_SHARDS`` by next word, the empty prefix
over ``WORD_SHARDS``.  Tasks hold at most about ``HELD`` entries before they send
them, about ``SENT`` to a record batch, and work through long texts piece by piece.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated
rows and rows with a null doc_id count like others; a table without words gives no
rows; other columns are ignored.  Ties in score and frequency are broken by phrase.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import documents, store, text_or_empty

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
CHUNK = 1 << 21                # bytes of text worked on at once
HELD = 400_000                 # entries a task holds before it sends its stripes
SENT = 1 << 16                 # entries sent at a time
HOT_PART, HOT_SHARDS, WORD_SHARDS = 1000, 64, 4096
LEAST_BITS, MOST_BITS, BITS_PER_PHRASE = 16, 28, 16
RANK_SALTS = 64
SALTS = {0: 32, 1: 16, 2: 4}   # copies of short phrases in the lookup join, which many candidates ask for

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes(ord("\n") if i in _SEPARATORS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i
                for i in range(256))
_CUT = re.compile(rb"[.,;:!?\x0a-\x0d]")
_FACTOR, _MIX, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _normal(raw: bytes) -> bytes:
    """Lower-cased bytes with pieces apart by LF and words by one space."""
    out = raw.translate(_NORMAL)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def _chunks(texts):
    """Joined texts of about CHUNK bytes; a longer text is cut between pieces."""
    held, size = [], 0
    for raw in texts:
        while len(raw) > 2 * CHUNK:
            cut = _CUT.search(raw, CHUNK)
            if cut is None:
                break
            yield raw[:cut.start()]
            raw = raw[cut.end():]
        held.append(raw)
        size += len(raw) + 1
        if size >= CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


class _Powers:
    """Powers of an odd factor and of its inverse modulo 2^64, kept per worker."""
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n):
        if len(cls.up) < n:
            n = max(n, CHUNK + 2)
            for name, x in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def _mixed(h):
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def _words(norm: bytes):
    """(starts, ends, next word follows in the piece, hashes) of the words."""
    b = np.frombuffer(norm, np.uint8)
    inside = (b != 32) & (b != 10)
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.get(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.empty(0, np.uint64)
    follows = np.zeros(len(starts), bool)
    if len(starts) > 1:
        follows[:-1] = (starts[1:] - ends[:-1] == 1) & (b[ends[:-1]] == 32)
    return starts, ends, follows, hashes


def _phrases(hashes, follows, m, seed):
    """Hash of the m words from each word on, and whether the piece has them."""
    h = hashes[:max(len(hashes) - m + 1, 0)] + seed
    whole = np.ones(len(h), bool)
    for k in range(1, m):
        h = _mixed(h * _STEP + hashes[k:k + len(h)])
        whole &= follows[k - 1:k - 1 + len(h)]
    return h, whole


def _seed(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) * 2654435761)


def _has(bits, h):
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _extensions(norm: bytes, m: int, seed, bits) -> list[bytes]:
    """Phrases of m words whose two shorter phrases are in the filter."""
    starts, ends, follows, hashes = _words(norm)
    h, whole = _phrases(hashes, follows, m - 1, seed)
    if len(h) < 2:
        return []
    good = _has(bits, h) & whole
    at = np.flatnonzero(good[:-1] & good[1:] & follows[:len(h) - 1])
    return [norm[s:e] for s, e in zip(starts[at].tolist(), ends[at + m - 1].tolist())]


STRIPES = "lang string, prefix string, shard int, words array<string>, counts array<long>"


def _stripe_batch(rows):
    """Record batch of (lang, prefix, shard, entries)."""
    ends = pa.array(np.cumsum([0, *[len(r[3]) for r in rows]]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
         pa.array([r[2] for r in rows], pa.int32()),
         pa.ListArray.from_arrays(ends, pa.array([w for r in rows for w, _ in r[3]], pa.binary()).cast(pa.string())),
         pa.ListArray.from_arrays(ends, pa.array([n for r in rows for _, n in r[3]], pa.int64()))],
        names=["lang", "prefix", "shard", "words", "counts"])


def _stripe_rows(counters, hot):
    """Record batches of stripes of a task's counters, each of about SENT entries.  Sorted
    phrases have those of a prefix side by side, so only the stripes of a batch are held."""
    rows, size = [], 0
    for lang, counter in counters.items():
        shared = {prefix.encode() for of, prefix in hot if of == lang}
        for prefix, phrases in groupby(sorted(counter), lambda phrase: phrase.rpartition(b" ")[0]):
            start = len(prefix) + 1 if prefix else 0
            entries = [(phrase[start:], counter[phrase]) for phrase in phrases]
            shards = {0: entries}
            if not prefix or prefix in shared:
                shards = defaultdict(list)
                for entry in entries:
                    shards[zlib.crc32(entry[0]) % (HOT_SHARDS if prefix else WORD_SHARDS)].append(entry)
            for shard, part in shards.items():
                rows.append((lang, prefix, shard, part))
                size += len(part)
                if size >= SENT:
                    yield _stripe_batch(rows)
                    rows, size = [], 0
    if rows:
        yield _stripe_batch(rows)


def stripes(texts: DataFrame, m: int, bits=None, hot=frozenset()) -> DataFrame:
    """Stripes of the phrases of ``m`` words of (lang, text), one row per task,
    prefix and shard.  ``bits`` is the broadcast filter of the pass before."""
    def run(batches):
        held = defaultdict(Counter)
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                by_lang[lang].append(text)
            for lang, raws in by_lang.items():
                for raw in _chunks(raws):
                    norm = _normal(raw)
                    if m == 1:
                        found = norm.split()
                        if found:
                            held[lang][b""] += len(found)
                    else:
                        found = _extensions(norm, m, _seed(lang), bits.value)
                    for i in range(0, len(found), SENT):
                        held[lang].update(found[i:i + SENT])
                        if sum(map(len, held.values())) > HELD:
                            yield from _stripe_rows(held, hot)
                            held = defaultdict(Counter)
        yield from _stripe_rows(held, hot)
    return texts.mapInArrow(run, STRIPES)


def merged(rows: DataFrame) -> DataFrame:
    """Stripes merged elementwise: lang, prefix, word, f.  The shuffle moves
    stripes, not entries; the sums need no other."""
    entry = rows.repartition("lang", "prefix", "shard").select(
        "lang", "prefix", "shard", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    return entry.groupBy("lang", "prefix", "shard", F.col("e.words").alias("word")) \
        .agg(F.sum("e.counts").alias("f")).select("lang", "prefix", "word", "f")


def _filter_of(level: DataFrame, m: int, rows: int):
    """Bit set over the hashes of a level's phrases, as broadcast bytes."""
    width = min(max((BITS_PER_PHRASE * max(rows, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches):
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang[lang].append(phrase.encode())
            for lang, phrases in by_lang.items():
                _, _, follows, hashes = _words(b"\n".join(phrases))
                h, whole = _phrases(hashes, follows, m, _seed(lang))
                at = h[whole] & np.uint64((1 << width) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> np.uint64(6)).astype(np.int64)),
                     pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])
    got = level.select("lang", "phrase").mapInArrow(run, "at long, bits long") \
        .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 6), np.int64)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return level.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> list[DataFrame]:
    """Merged stripes by length, stored: lang, phrase, f of every phrase of up to
    ``longest`` words with f >= min_count.  The first also has, as the phrase '',
    the number of all words of each lang."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        text_or_empty().alias("text"))
    levels, bits, hot, n = [], None, frozenset(), 0
    for m in range(1, longest + 1):
        level = store(merged(stripes(texts, m, bits, hot)).where(F.col("f") >= min_count)
                      .select("lang", F.when(F.col("prefix") == "", F.col("word"))
                              .otherwise(F.concat_ws(" ", "prefix", "word")).alias("phrase"), "f"),
                      f"phrases_{m}")
        levels.append(level)
        phrases = level.where("phrase != ''")
        rows = phrases.count()
        if rows == 0 or m == longest:
            break
        if m == 1:
            n = level.where("phrase = ''").agg(F.sum("f")).first()[0]
        # at most HOT_PART rows: their frequencies sum to n at most
        hot = frozenset((r["lang"], r["phrase"]) for r in
                        phrases.where(F.col("f") * HOT_PART >= n).select("lang", "phrase").collect())
        if bits is not None:
            bits.unpersist()
        bits = _filter_of(phrases, m, rows)
    return levels


def _n_words(phrase: Column) -> Column:
    return F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))


def _salts(phrase: Column) -> Column:
    out = F.lit(1)
    for words, copies in SALTS.items():
        out = F.when(_n_words(phrase) == words, copies).otherwise(out)
    return out


def collocations(levels: list[DataFrame], longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """Scored candidates of the merged stripes that no longer one covers:
    lang, rank, phrase, a, l, r, n, score, and cut, the words of the first part."""
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.union(level)
    candidates = entries.where(F.instr("phrase", " ") > 0)
    w = F.split("phrase", " ")

    def part(start, end):
        return F.array_join(F.slice(w, start + 1, end - start), " ")
    # what a candidate asks for: n, and both parts of every cut
    m = F.size(w)
    asks = F.concat(
        F.array(F.struct(F.lit(0).alias("cut"), F.lit("").alias("asked"))),
        F.flatten(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.array(
            F.struct(k.alias("cut"), part(F.lit(0), k).alias("asked")),
            F.struct((-k).alias("cut"), part(k, m).alias("asked"))))))
    asked = candidates.select("lang", "phrase", "f", F.explode(asks).alias("q")) \
        .select("lang", "phrase", F.col("f").alias("a"), "q.cut", "q.asked",
                F.pmod(F.xxhash64("phrase"), _salts(F.col("q.asked"))).cast("int").alias("salt"))
    answers = entries.select(F.col("lang"), F.col("phrase").alias("asked"), F.col("f").alias("got"),
                             F.explode(F.sequence(F.lit(0), _salts(F.col("phrase")) - 1)).alias("salt"))
    found = asked.join(answers, ["lang", "asked", "salt"]).select("lang", "phrase", "a", "cut", "got")
    # every candidate tells the two phrases one word shorter how often it occurs
    longer = candidates.where(m > 2).select("lang", "f", F.explode(F.array(
        part(F.lit(0), m - 1), part(F.lit(1), m))).alias("phrase")) \
        .select("lang", "phrase", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("int").alias("cut"),
                F.col("f").alias("got"))

    def answer(cut):
        return F.max(F.when(F.col("cut") == cut, F.col("got")))
    cuts = range(1, longest)
    one = found.union(longer).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), answer(0).alias("n"),
        F.max(F.when(F.col("cut").isNull(), F.col("got"))).alias("covered"),
        *[answer(k).alias(f"l{k}") for k in cuts], *[answer(-k).alias(f"r{k}") for k in cuts]) \
        .where(F.col("covered").isNull() | (F.col("covered") < F.col("a")))

    def exact(name):
        return F.col(name).cast("decimal(20,0)").cast("decimal(38,0)")
    one = one.withColumn("thousand", F.lit(1000).cast("decimal(38,0)") * (exact("a") * exact("n")))
    for k in cuts:
        one = one.withColumn(f"lr{k}", exact(f"l{k}") * exact(f"r{k}"))
    best = F.array_min(F.filter(F.array(*[
        F.when(F.col(f"l{k}").isNotNull(), F.struct(
            F.expr(f"thousand div lr{k}").alias("score"), F.lit(k).alias("cut"),
            F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]), lambda x: x.isNotNull()))
    scored = one.withColumn("best", best).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # each of RANK_SALTS parts of a lang keeps its first rows, so that the task that ranks
        # the lang gets RANK_SALTS * top rows at most
        scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase", F.lit(5)), F.lit(RANK_SALTS)).cast("int"))
        place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        scored = scored.withColumn("place", place).where(F.col("place") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("bigint").alias("cut"))


def op12_phrase_collocations(spark, sf_dir) -> DataFrame:
    """Each lang's first 2,000 collocations of whole ``documents`` texts."""
    return collocations(phrase_counts(documents(spark, sf_dir)))


OP12_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(
               translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), listed as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), placed as (
    select lang, w, unnest(range(1, len(w) + 1)) as i from listed where len(w) > 0
), lengths as (
    select unnest([1, 2, 3, 4, 5]) as m
), freq as (
    select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
    from placed join lengths on i + m - 1 <= len(w)
    group by all having count(*) >= 100
), total as (
    select lang, count(*) as n from placed group by lang
), cut as (
    select c.lang, c.phrase, c.m, c.f as a, t.n, x.f as l, y.f as r, k,
           (1000::hugeint * c.f * t.n) // (x.f::hugeint * y.f) as score
    from freq c
    join total t on t.lang = c.lang
    cross join (select unnest([1, 2, 3, 4]) as k) ks
    join freq x on x.lang = c.lang and x.m = k
        and x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
    join freq y on y.lang = c.lang and y.m = c.m - k
        and y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')
    where c.m > 1 and k < c.m
), best as (
    select * from cut
    qualify row_number() over (partition by lang, phrase order by score, k) = 1
), free as (
    select * from best b
    where not exists (
        select 1 from freq q
        where q.lang = b.lang and q.m > b.m and q.f >= b.a
          and contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
       phrase, a, l, r, n, score::bigint as score, k::bigint as cut
from free
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
