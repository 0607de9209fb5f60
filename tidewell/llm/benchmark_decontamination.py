"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of words of which a fixed mask looks only at some, so a hit
survives substitutions at the ignored places.  Seeds of the benchmark items
(test) are joined with seeds of every document position (training) on a hash of
the mask and its words, one 64-bit key.  Around each hit the item is laid over the document along the
hit's diagonal and compared word by word; the overlap counts when at least
``MIN_MATCH`` per cent agree
* of the whole item's words, or
* of a stretch of ``RUN`` words around the hit whose first and last word agree, or
* of the words of an item too short to hold such a stretch on both sides, when
  one word was put in or left out: the item then follows two neighbouring diagonals.
So ``RUN`` words in a row are enough of however long an item.

Words here are runs of letters and digits, lower-cased, so punctuation and line
breaks do not hide a passage; letters of scripts written without spaces are words
of their own.  The masks of four words hit every stretch of ``RUN`` words in which
at least 9 agree, the lighter ones of items under ``LIGHT_BELOW`` words every
item of three or more words of which ``MIN_MATCH`` per cent agree.  Items of two
words are matched whole; a single word is no evidence of a leak and is not searched for.

The document side never shuffles its texts: positions are exploded, probed
against a broadcast block of benchmark seeds and verified in one stage.  Spark keeps all
hits of a row until the row is done, so a document is taken in segments of ``SEGMENT``
words (half the longest item, if that is more), which hold as many words of the document on
either side as the longest item has; a hit then takes along as many words of the document
as its item has, and two, not the document.  A seed is
a hash, an item's number and a position, some 30 bytes; the items' words are
broadcast once an item, beside them, and meet only the hits.  A block holds the seeds
of whole items, about ``BLOCK_SEEDS``, so it takes some 20 MB whatever the items'
lengths; a larger benchmark is taken in as many blocks as it needs, one pass over
the documents each.

Defined results: null or empty texts and items match nothing; equal items
are compared once and each is reported; rows that agree in doc_id and text
count as one document in ``leaks`` and are all dropped by ``drop_leaks``; a null
doc_id is reported as null; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents, let, store, text_or_empty
from tidewell.sources.tables import load

# Fixed masks by the words' offsets (1: the word counts, 0: it is ignored):
# 11101, 100111 and 1101001; lighter 111, 1101 and 1011; 11.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6), (0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1))
LIGHT_BELOW = 25
LEAST_WORDS = 2
# letters that stand side by side without being one word; all lie from U+0E01 on, and the range is
# tested first, as asking for a character's script is slow
UNSPACED = r"[\x{E01}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
MIN_MATCH = 70
RUN = 13
BLOCK_SEEDS = 500_000
SEGMENT = 1024
PIECE = 65_536


def masks_of(n: int) -> list[int]:
    """Numbers of the masks that items of ``n`` words use."""
    return [0, 1, 2] if n >= LIGHT_BELOW else [3, 4, 5] if n > 2 else [6]


def norm_words(c: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits.  A long text is cut into
    words a piece at a time, as its words take some 20 times the memory of their hashes;
    a piece ends where a word does."""
    piece = f"(?s).{{1,{PIECE}}}" + r"[\p{L}\p{N}]*+"

    def spaced(low):
        return F.when(low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)

    def hashes(t):
        cut = F.when(F.length(t) > PIECE, F.regexp_extract_all(t, F.lit(piece), F.lit(0))).otherwise(F.array(t))
        return F.flatten(F.transform(cut, lambda p: F.transform(
            F.array_remove(F.split(p, r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))))
    return let(F.lower(c), lambda low: let(spaced(low), hashes))


def _segments(d: DataFrame, longest: int) -> DataFrame:
    """Replace the word hashes _tw_h of a document by those of each of its segments in turn,
    with ``longest`` words on either side: adds _tw_from, the place of the first word, and
    _tw_first and _tw_last, the positions in _tw_h at which the segment's own seeds start."""
    own, n = max(SEGMENT, longest // 2), F.size("_tw_h")

    def segment(s):
        at = F.greatest(s - longest, F.lit(0))
        return F.struct(at.alias("at"), (s - at).alias("first"),
                        (F.least(s + own, n - (LEAST_WORDS - 1)) - 1 - at).alias("last"),
                        F.slice("_tw_h", at + 1, s - at + own + longest).alias("words"))
    cut = F.when(n >= LEAST_WORDS, F.transform(F.sequence(F.lit(0), n - LEAST_WORDS, F.lit(own)), segment))
    rest = [c for c in d.columns if c != "_tw_h"]
    return d.select(*rest, F.explode(cut).alias("_tw_s")).select(
        *rest, F.col("_tw_s.at").alias("_tw_from"), F.col("_tw_s.first").alias("_tw_first"),
        F.col("_tw_s.last").alias("_tw_last"), F.col("_tw_s.words").alias("_tw_h"))


def _seeded(d: DataFrame, masks, words: str, starts: Column) -> DataFrame:
    """One row per position of ``starts`` and mask that fits the word hashes ``words``: adds
    _tw_pos and _tw_hash, which the mask's number is part of."""
    h, pos = F.col(words), F.col("_tw_pos")

    def seed(m):
        return F.xxhash64(F.lit(m), *[F.get(h, pos + o) for o in MASKS[m]])
    fits = F.array(*[F.when(pos + MASKS[m][-1] < F.size(h), seed(m)) for m in masks])
    return d.withColumn("_tw_pos", F.explode(starts)) \
        .withColumn("_tw_hash", F.explode(fits)).where("_tw_hash is not null")


def benchmark_items(bench: DataFrame, text: str = "text") -> DataFrame:
    """Distinct items: (_tw_no a number, _tw_items all ids, _tw_iw word hashes).  Two items
    that shared a number would both be laid over their hits, which compares words."""
    d = bench.select(F.col("item_id").alias("_tw_id"), norm_words(text_or_empty(text)).alias("_tw_iw"))
    return d.where(F.size("_tw_iw") > 0).groupBy("_tw_iw").agg(
        F.array_sort(F.collect_set("_tw_id")).alias("_tw_items")).withColumn("_tw_no", F.xxhash64("_tw_iw"))


def item_seeds(items: DataFrame) -> DataFrame:
    n = F.size("_tw_iw")
    starts = F.when(n >= LEAST_WORDS, F.sequence(F.lit(0), n - LEAST_WORDS))
    parts = [(n >= LIGHT_BELOW, LIGHT_BELOW), ((n > 2) & (n < LIGHT_BELOW), 3), (n == LEAST_WORDS, LEAST_WORDS)]
    return reduce(DataFrame.unionByName, [
        _seeded(items.where(which), masks_of(least), "_tw_iw", starts).withColumn("_tw_least", F.lit(least))
        for which, least in parts]) \
        .select("_tw_no", F.col("_tw_pos").alias("_tw_ipos"), "_tw_least", "_tw_hash")


def _verified(hits: DataFrame) -> DataFrame:
    """Lay the item over the document along the diagonal and count equal words.

    Of the document a hit keeps the words from the one before the item to the one after it.
    The test sits in a generator, after the join: as a filter it would move
    into the join, which would then copy a segment's words for every position.
    """
    words, at = F.col("_tw_iw"), F.col("_tw_ipos")
    n = F.size(words)
    lies = F.col("_tw_pos") - at
    left = F.greatest(lies - 1, F.lit(0))
    here = F.slice("_tw_h", left + 1, lies + 1 + n - left)
    hits = hits.withColumns({"_tw_h": here, "_tw_lead": lies - left, "_tw_at": F.col("_tw_from") + lies}) \
        .drop("_tw_pos", "_tw_from", "_tw_first", "_tw_last", "_tw_hash")
    start, lead = F.col("_tw_at"), F.col("_tw_lead")

    def agree(i, shift=0):
        return F.coalesce((lead + i + shift >= 0)
                          & (F.get(F.col("_tw_h"), lead + i + shift) == F.get(words, i)), F.lit(False))

    def enough(count, of):
        return count * 100 >= of * MIN_MATCH

    def bent(first, second):
        """Most agreeing words when the item changes the diagonal once."""
        zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, lambda s, i: F.struct(
            (s["a"] + agree(i, first).cast("int")).alias("a"),
            (F.greatest(s["a"], s["b"]) + agree(i, second).cast("int")).alias("b")),
            lambda s: F.greatest(s["a"], s["b"]))
    same = F.size(F.filter(words, lambda w, i: agree(i)))
    run = F.exists(F.sequence(F.greatest(at - (RUN - 1), F.lit(0)), F.least(at, n - RUN)), lambda lo: agree(lo) & agree(
        lo + RUN - 1) & enough(F.size(F.filter(F.sequence(lo, lo + RUN - 1), lambda i: agree(i))), F.lit(RUN)))
    either = F.when(n <= 2 * RUN, F.greatest(*[bent(*x) for x in ((0, 1), (0, -1), (1, 0), (-1, 0))])) \
        .otherwise(F.lit(0))
    laid = let(same, lambda c: F.when(enough(c, n) | F.when(n >= RUN, run).otherwise(F.lit(False)), c)
               .otherwise(let(either, lambda e: F.when(enough(e, n), e))))
    passed = F.filter(F.array(F.struct(laid.alias("same"), start.alias("start"), n.alias("len"))),
                      lambda v: v["same"].isNotNull())
    return hits.withColumn("_tw_v", F.explode(passed)).select(
        "*", F.col("_tw_v.same").alias("_tw_same"), F.col("_tw_v.start").alias("_tw_start"),
        F.col("_tw_v.len").alias("_tw_len"))


def _hits(docs: DataFrame, bench: DataFrame, cols) -> DataFrame:
    items = store(benchmark_items(bench), "items")
    seeds = store(item_seeds(items), "seeds")
    blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))
    masks = [m for r in seeds.select("_tw_least").distinct().collect() for m in masks_of(r._tw_least)]
    longest = items.select(F.max(F.size("_tw_iw"))).first()[0] or 0
    d = docs.select(*cols, norm_words(text_or_empty("text")).alias("_tw_h"))
    # no filter on the number of words: it would move down and make the words a second time
    d = _seeded(_segments(d, longest), sorted(masks) or [0], "_tw_h",
                F.sequence(F.col("_tw_first"), F.col("_tw_last")))

    def block(b):
        mine = F.pmod(F.col("_tw_no"), F.lit(blocks)) == b
        return _verified(d.join(F.broadcast(seeds.where(mine).drop("_tw_least")), "_tw_hash")
                         .join(F.broadcast(items.where(mine)), "_tw_no"))
    return reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id,
    item_words, matched_words (agreeing words of the best diagonal, which may bend
    once in a short item) and start_word."""
    best = F.max(F.struct(F.col("_tw_same"), (-F.col("_tw_start")).alias("at")))
    found = _hits(docs, bench, [F.col("doc_id"), F.xxhash64("text").alias("_tw_key")]) \
        .groupBy("doc_id", "_tw_key", "_tw_items", "_tw_len").agg(best.alias("_tw_b")) \
        .groupBy("doc_id", "_tw_items", "_tw_len").agg(F.max("_tw_b").alias("_tw_b"))
    return found.select("doc_id", F.explode("_tw_items").alias("item_id"),
                        F.col("_tw_len").cast("bigint").alias("item_words"),
                        F.col("_tw_b._tw_same").cast("bigint").alias("matched_words"),
                        (-F.col("_tw_b.at")).cast("bigint").alias("start_word"))


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents in which no benchmark item is found, columns unchanged."""
    key = [F.col("doc_id"), F.xxhash64("text").alias("_tw_key")]
    # stored, so that its size is known when the join is planned: a small one is broadcast
    # and the texts are not shuffled
    bad = store(_hits(docs, bench, key).select(F.col("doc_id").alias("_tw_bad"),
                                               F.col("_tw_key").alias("_tw_badkey")).distinct(), "leaks")
    d = docs.withColumn("_tw_key", F.xxhash64("text"))
    return d.join(bad, (F.col("doc_id").eqNullSafe(F.col("_tw_bad")))
                  & (F.col("_tw_key") == F.col("_tw_badkey")), "left_anti") \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    """Every (document, benchmark item) pair whose passage the document holds."""
    return leaks(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))
