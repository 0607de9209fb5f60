"""Source divergence audit by pair tasks over sorted count arrays.

Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased.
Each lang keeps the V terms that occur in at least ``MIN_DOCS`` of its documents.
Every group (lang, source) gives each kept term, also one it lacks, the price

    p = 1 + floor(10^9 * (count + 1) / (N + V))        N: the group's kept occurrences

and two prices p, q of a term differ by floor((p - q)^2 / q).

*Pairs.* The kept terms of a lang are dealt into blocks of about ``BLOCK`` terms and
numbered inside them; each group has one array of sorted (term number, count) per
block.  One task per unordered pair of groups and block co-groups the two arrays: a
galloping intersection (the shorter array searched in the longer, each search
going on from the last) finds the terms that both have, the rest are one-sided.
Both directions are priced in the same pass.  Terms that neither has cost the same
everywhere: they are counted, V minus the union, and priced once for a pair.  No
task sees more than two arrays of a block, however large or common a group is.

*Terms.* For each group, the ``TOP`` terms that it has more of than its lang as a
whole, by the same price difference; a window whose groups are cut to TOP rows in
the map tasks.

Counting is done in the map tasks (stripes of term counters, at most about ``HELD``
entries before they are sent), so a hot source or word arrives as one entry a task.
All arithmetic is on integers.  The tables of one row a lang or group are
broadcast only while they have at most ``SMALL_ROWS`` rows.

Defined results: null text, lang and source are ''; groups without a term, and langs
that keep none (V = 0), have pair rows (value 0 where V = 0) and no term rows; a lang
with one source has no pair rows; repeated rows and rows with a null doc_id count as
documents of their own; very long texts are counted whole; an empty table gives no
rows; other columns are ignored.  Equal values are ranked by item (UTF-8).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import documents, store

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
BLOCK = 1 << 16
HELD = 1_000_000
SHARDS = 1024
SMALL_ROWS = 50_000
LONG_SAFE = (1 << 63) // SCALE - 2          # counts whose product with SCALE fits 64 bits

_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

COUNTS = "lang string, shard int, source string, terms array<string>, counts array<long>, docs array<long>"


def _count_rows(counts, docs):
    """One record batch: a task's counters, one row per lang, shard and source."""
    langs, sources, shards, sizes, terms, n, d = [], [], [], [], [], [], []
    for (lang, source), counter in counts.items():
        keys = list(counter)
        shard = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) % SHARDS
        order = np.argsort(shard, kind="stable")
        values, seen = list(counter.values()), docs[lang, source]
        at, size = np.unique(shard, return_counts=True)
        langs += [lang] * len(at)
        sources += [source] * len(at)
        shards += at.tolist()
        sizes += size.tolist()
        for i in order.tolist():
            terms.append(keys[i])
            n.append(values[i])
            d.append(seen[keys[i]])
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    def lists(values):
        return pa.ListArray.from_arrays(ends, values)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(shards, pa.int32()), pa.array(sources, pa.string()),
         lists(pa.array(terms, pa.binary()).cast(pa.string())),
         lists(pa.array(n, pa.int64())), lists(pa.array(d, pa.int64()))],
        names=["lang", "shard", "source", "terms", "counts", "docs"])


def _count(batches):
    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    for batch in batches:
        columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                   batch.column(2).cast(pa.binary()).to_pylist())
        for lang, source, text in zip(*columns):
            counter, found = counts[lang, source], text.translate(_TERMS).split()
            held -= len(counter)
            counter.update(found)
            held += len(counter)
            docs[lang, source].update(set(found))
            if held > HELD:
                yield _count_rows(counts, docs)
                counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    if held:
        yield _count_rows(counts, docs)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, and ``held``: the (source, count) of every group that has it."""
    rows = _named(docs).mapInArrow(_count, COUNTS).repartition("lang", "shard")
    entry = rows.select("lang", "shard", "source", F.explode(F.arrays_zip("terms", "counts", "docs")).alias("e"))
    # both sums lie within the partitions of the one shuffle above
    return entry.groupBy("lang", "shard", F.col("e.terms").alias("term"), "source") \
        .agg(F.sum("e.counts").alias("count"), F.sum("e.docs").alias("docs")) \
        .groupBy("lang", "shard", "term") \
        .agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"),
             F.collect_list(F.struct("source", "count")).alias("held")) \
        .where(F.col("docs") >= min_docs).select("lang", "term", "total", "held")


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def price(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); decimals only where 64 bits are too few."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(count < LONG_SAFE, F.call_function("div", SCALE * F.when(count < LONG_SAFE, count + 1), n + v)) \
        .otherwise(F.call_function("div", wide, (n + v).cast("decimal(20,0)"))) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _prices(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    if len(counts) and int(counts.max()) >= LONG_SAFE:
        return np.array([1 + SCALE * (int(c) + 1) // (n + v) for c in counts], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + 1) // (n + v)


def _sum(p, q) -> int:
    d = p - q
    return int((d * d // q).sum())


def merge_pair(a, b, n_a: int, n_b: int, v: int) -> tuple[int, int, int]:
    """(terms in a or b, sum of a priced against b, of b against a) of two sorted
    (numbers, counts) arrays; terms in neither are left out."""
    (ids_a, c_a), (ids_b, c_b) = a, b
    flip = len(ids_a) > len(ids_b)
    short, long = (ids_b, ids_a) if flip else (ids_a, ids_b)
    at = np.searchsorted(long, short)
    both = np.zeros(len(short), bool)
    inside = at < len(long)
    both[inside] = long[at[inside]] == short[inside]
    in_short, in_long = np.flatnonzero(both), at[both]
    in_a, in_b = (in_long, in_short) if flip else (in_short, in_long)
    p_a, p_b = _prices(c_a, n_a, v), _prices(c_b, n_b, v)
    none_a, none_b = (int(_prices(np.zeros(1, np.int64), n, v)[0]) for n in (n_a, n_b))
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[in_a] = False
    only_b[in_b] = False
    ab = _sum(p_a[in_a], p_b[in_b]) + _sum(p_a[only_a], none_b) + _sum(none_a, p_b[only_b])
    ba = _sum(p_b[in_b], p_a[in_a]) + _sum(none_b, p_a[only_a]) + _sum(p_b[only_b], none_a)
    return len(ids_a) + len(ids_b) - len(in_a), ab, ba


PRICED = "lang string, a string, b string, seen long, ab long, ba long"


def _price_pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
    def array(side):
        if side.num_rows == 0:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return (side.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False),
                side.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False))
    some = left if left.num_rows else right
    lang, a, b, n_a, n_b, v = (some.column(c)[0].as_py() for c in ("lang", "a", "b", "n_a", "n_b", "v"))
    seen, ab, ba = merge_pair(array(left), array(right), n_a, n_b, v)
    return pa.table({"lang": pa.array([lang], pa.string()), "a": pa.array([a], pa.string()),
                     "b": pa.array([b], pa.string()), "seen": [seen], "ab": [ab], "ba": [ba]})


def group_arrays(kept: DataFrame, langs: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, block, ids, counts: sorted term numbers of each group by block."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / block))
    dealt = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int")) \
        .withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))) \
        .select("lang", "block", "id", F.explode("held").alias("h"))
    # the window's shuffle also serves the grouping; a list has at most a block's terms
    return dealt.groupBy("lang", "block", F.col("h.source").alias("source")) \
        .agg(F.array_sort(F.collect_list(F.struct("id", F.col("h.count").alias("count")))).alias("e")) \
        .select("lang", "source", "block", F.col("e.id").alias("ids"), F.col("e.count").alias("counts"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The audit: lang, source, part, item, value, rank."""
    kept = store(kept_terms(docs, min_docs), "divergence_terms")
    names = _named(docs).select("lang", "source").distinct()
    own = kept.select("lang", F.explode("held").alias("h")) \
        .groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.count").alias("n"))
    totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    groups = store(names.join(own, ["lang", "source"], "left").join(totals, "lang", "left")
                   .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                               for c in ("n", "v", "n_lang")]), "divergence_groups")
    langs = _small(groups.select("lang", "v", "n_lang").distinct())

    one, other = (groups.select("lang", F.col("source").alias(s), F.col("n").alias(f"n_{s}"), *extra)
                  for s, extra in (("a", ["v"]), ("b", [])))
    pairs = store(one.join(other, "lang").where("a < b"), "divergence_pairs")
    arrays = store(group_arrays(kept, langs.select("lang", "v"), block), "divergence_arrays")
    sent = _small(pairs)
    key, columns = ["lang", "a", "b", "block"], ["ids", "counts", "n_a", "n_b", "v"]
    # aliases make the columns of both sides apart
    left, right = (arrays.withColumnRenamed("source", s).join(sent, ["lang", s])
                   .select(*[F.col(c).alias(c) for c in key + columns]) for s in ("a", "b"))
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_price_pair, PRICED) \
        .groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("seen", "ab", "ba")])
    none_a, none_b = (F.when(F.col("v") > 0, price(F.lit(0).cast("bigint"), F.col(n), F.col("v")))
                      for n in ("n_a", "n_b"))

    def total(c, p, q):
        absent = (F.col("v") - F.coalesce("seen", F.lit(0))) * difference(p, q)
        return F.coalesce(F.coalesce(c, F.lit(0)) + absent, F.lit(0))
    both = pairs.join(priced, ["lang", "a", "b"], "left").select(
        "lang", F.explode(F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item"), total("ab", none_a, none_b).alias("value")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item"), total("ba", none_b, none_a).alias("value"))
        )).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "x.value")

    p = price(F.col("count"), F.col("n"), F.col("v"))
    q = price(F.col("total"), F.col("n_lang"), F.col("v"))
    terms = kept.select("lang", "term", "total", F.inline("held")) \
        .join(_small(groups), ["lang", "source"]) \
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), "item", difference(F.col("p"), F.col("q")).alias("value"))

    def ranked(df):
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return df.withColumn("rank", F.row_number().over(order))
    return ranked(both).union(ranked(terms).where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir) -> DataFrame:
    """How each (lang, source) of ``documents`` differs from the lang's others."""
    return divergence(documents(spark, sf_dir))


OP13_SQL = r"""
with docs as (
    select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
    from documents
), found as (
    select d, lang, source,
           unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from docs
), kept as (
    select lang, term, count(*)::hugeint as total from found group by all having count(distinct d) >= 3
), own as (
    select f.lang, f.source, f.term, count(*)::hugeint as c
    from found f join kept using (lang, term) group by all
), groups as (
    select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n
    from (select distinct lang, source from docs) g left join own using (lang, source) group by all
), langs as (
    select lang, count(*)::hugeint as v, sum(total)::hugeint as n from kept group by lang
), priced as (
    select g.lang, g.source, k.term, coalesce(o.c, 0) as c,
           1 + (1000000000 * (coalesce(o.c, 0) + 1)) // (g.n + l.v) as p,
           1 + (1000000000 * (k.total + 1)) // (l.n + l.v) as whole
    from groups g join langs l using (lang) join kept k using (lang)
    left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term
), pairs as (
    select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as v
    from priced x join priced y on x.lang = y.lang and x.term = y.term and x.source <> y.source
    group by all
), answers as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
    union all
    select lang, source, 'term', term, (((p - whole) * (p - whole)) // whole)::bigint
    from priced where c > 0 and p > whole
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from answers
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 200
"""
