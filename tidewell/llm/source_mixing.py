"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies,
``target / source size`` (at most 3).  The expected copies are prefix-summed in
a fixed order within the source, one offset in [0, 1) per source is added, and
a document is emitted once per whole number its interval crosses.

The prefix sum is built in two levels so that no source is ever sorted or
counted in one task: documents fall into blocks (source, bit length of the
size, salt), the small table of block counts is prefix-summed per source, and
only ranks inside a block use a window over documents.  The number of salts
grows with the number of documents, so a block stays near ``BLOCK_ROWS`` rows.
Inside a block documents are ordered by size, which keeps the words taken close
to the target.

Defined results: a null text or a text without words has size 0 (copies are
drawn like others', its words taken are 0); a null source is a source of its
own, ranked last; repeated rows are drawn one by one; when all sizes are 0
every target is 0; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import documents, pieces

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK_ROWS = 200_000
SEED = "tidewell-mix"


def _unit(c: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of a digest."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _sized(docs: DataFrame, salts: int) -> DataFrame:
    d = docs.withColumn("_tw_size", F.size(F.array_remove(pieces(F.col("text")), ""))
                        .cast("bigint"))
    d = d.withColumn("_tw_key", F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
        F.coalesce(F.col("text"), F.lit("")))))
    salt = F.conv(F.substring("_tw_key", 1, 7), 16, 10).cast("bigint") % salts
    # a key of one non-null column: joins and windows share its partitioning
    return d.withColumn("_tw_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))) \
        .withColumn("_tw_block", F.concat_ws(
            ".", F.lpad(F.length(F.bin("_tw_size")).cast("string"), 2, "0"),
            F.lpad(salt.cast("string"), 9, "0")))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(_tw_src, source_size, target) from one row per source.

    Weights 5, 2, 1 repeat over the sources in code point order.  A source
    stops at ``MAX_COPIES`` times its size; sorted by cap per weight, the level
    reached once the first sources are full is ``(total - their caps) /
    (weights left)``, and the final level is the highest of these.
    """
    order = Window.orderBy("_tw_src")
    d = sizes.withColumn("_tw_rank", F.row_number().over(order))
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]),
                     (F.col("_tw_rank") - 1) % len(WEIGHTS) + 1)
    d = d.withColumn("_tw_w", w).withColumn("_tw_cap", F.col("source_size") * MAX_COPIES)
    fill = Window.orderBy(F.col("_tw_cap") / F.col("_tw_w"), "_tw_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def left(col):
        return F.sum(col).over(every) - F.coalesce(F.sum(col).over(before), F.lit(0))
    # total of sizes less the caps of the sources before
    d = d.withColumn("_tw_level", (
        F.sum("source_size").over(every)
        - F.coalesce(F.sum("_tw_cap").over(before), F.lit(0))) / left("_tw_w"))
    level = F.max("_tw_level").over(every)
    return d.withColumn("target", F.least(F.col("_tw_cap").cast("double"), level * F.col("_tw_w"))) \
        .select("_tw_src", "source_size", "target")


def mix(docs: DataFrame) -> DataFrame:
    """The input plus ``_tw_size``, ``_tw_source_size``, ``_tw_target`` and
    ``_tw_copies`` (how often the mix takes the document)."""
    salts = 16 + docs.count() // BLOCK_ROWS
    d = _sized(docs, salts)
    blocks = d.groupBy("_tw_src", "_tw_block").agg(
        F.count(F.lit(1)).alias("_tw_n"), F.sum("_tw_size").alias("_tw_words"))
    targets = source_targets(blocks.groupBy("_tw_src").agg(F.sum("_tw_words").alias("source_size")))
    run = Window.partitionBy("_tw_src").orderBy("_tw_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    plan = blocks.withColumn("_tw_before", F.coalesce(F.sum("_tw_n").over(run), F.lit(0))) \
        .drop("_tw_n", "_tw_words").join(targets, "_tw_src") \
        .withColumnRenamed("source_size", "_tw_source_size") \
        .withColumnRenamed("target", "_tw_target")
    inside = Window.partitionBy("_tw_src", "_tw_block").orderBy("_tw_size", "_tw_key")
    each = F.when(F.col("_tw_source_size") > 0, F.col("_tw_target") / F.col("_tw_source_size")) \
        .otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(SEED + ":"), F.col("_tw_src")))

    def crossed(k):
        return F.floor(F.col("_tw_each") * k + F.col("_tw_offset"))
    return d.withColumn("_tw_k", F.row_number().over(inside)) \
        .join(plan, ["_tw_src", "_tw_block"]) \
        .withColumn("_tw_k", F.col("_tw_before") + F.col("_tw_k")) \
        .withColumn("_tw_each", each).withColumn("_tw_offset", offset) \
        .withColumn("_tw_copies", crossed(F.col("_tw_k")) - crossed(F.col("_tw_k") - 1)) \
        .drop("_tw_src", "_tw_block", "_tw_key", "_tw_before", "_tw_k", "_tw_each", "_tw_offset")


def emit(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, columns unchanged."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return mix(docs).where("_tw_copies > 0") \
        .withColumn("_tw_copy", F.explode(F.array_repeat(F.lit(1), F.col("_tw_copies").cast("int")))) \
        .select(*cols)


def op5_source_mixing(spark, sf_dir) -> DataFrame:
    """Words that the mix takes of every document of ``documents``."""
    return mix(documents(spark, sf_dir)).select(
        "doc_id", F.col("_tw_size").alias("size"), F.col("_tw_source_size").alias("source_size"),
        F.col("_tw_target").alias("target"),
        (F.col("_tw_copies") * F.col("_tw_size")).cast("bigint").alias("taken"))


OP5_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as k
  from documents),
s as (
  select source, row_number() over (order by source nulls last) as rnk, sum(size) as total
  from d group by source),
w as (
  select *, case rnk % 3 when 1 then 5 when 2 then 2 else 1 end as wt, 3 * total as cap from s),
lv as (
  select *, cast((sum(total) over ())
      - coalesce(sum(cap) over (order by cap / wt, rnk rows between unbounded preceding and 1 preceding), 0) as double)
    / cast((sum(wt) over ())
      - coalesce(sum(wt) over (order by cap / wt, rnk rows between unbounded preceding and 1 preceding), 0) as double) as lev
  from w),
t as (
  select source, total, least(cast(cap as double), (max(lev) over ()) * wt) as target,
         cast(('0x' || substr(md5('SEED:' || coalesce('s' || source, 't')), 1, 8)) as bigint) / 4294967296.0 as u
  from lv),
r as (
  select doc_id, size, source, row_number() over (partition by source order by
           length(bin(size)),
           cast(('0x' || substr(k, 1, 7)) as bigint) % (16 + (select count(*) from documents) // BLOCK),
           size, k) as n
  from d)
select doc_id, cast(size as bigint) as size, cast(total as bigint) as source_size, target,
       cast(size * (floor(case when total > 0 then target / total else 0 end * n + u)
                    - floor(case when total > 0 then target / total else 0 end * (n - 1) + u)) as bigint) as taken
from r join t on r.source is not distinct from t.source
""".replace("SEED", SEED).replace("BLOCK", str(BLOCK_ROWS))
