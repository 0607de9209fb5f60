"""Global top-N, single extreme rows and repeatable fixed-size samples.

``orderBy(...).limit(n)`` plans ``TakeOrderedAndProject``: every task keeps
its own best n rows and only those n x tasks rows reach the final merge, so
the cost is one scan with no shuffle of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F


def top_rows(df: DataFrame, order: Sequence[Column], n: int,
             cutoff_key: str | None = None, descending: bool = True) -> DataFrame:
    """Global top-N rows (TOP1, TOP2); ``order`` should be total.

    For large ``n`` give ``cutoff_key``: the leading sort column, best one with few
    distinct values (a date, a year).  The counts of its first values pick the exact
    cutoff that keeps at least ``n`` rows, so the final merge sees about ``n`` rows
    rather than ``n`` from every input split.  The first ``n`` values hold at least
    ``n`` rows, so no more counts reach the driver, whatever the key.  Rows with a NULL key sort last and
    are only needed when fewer than ``n`` others exist.
    """
    if cutoff_key is None:
        return df.orderBy(*order).limit(n)
    first = F.desc(cutoff_key) if descending else F.asc(cutoff_key)
    hist = (df.filter(F.col(cutoff_key).isNotNull())
              .groupBy(cutoff_key).count().orderBy(first).limit(n).collect())
    total, cut = 0, None
    for r in hist:
        total += r["count"]
        cut = r[0]
        if total >= n:
            break
    if cut is None or total < n:
        return df.orderBy(*order).limit(n)
    k = F.col(cutoff_key)
    cand = df.filter(k >= F.lit(cut) if descending else k <= F.lit(cut))
    return cand.orderBy(*order).limit(n)


@dataclass(frozen=True)
class Extreme:
    """One record row: the row with the largest or smallest ``value``."""
    sort_order: int
    label: str
    value: str
    largest: bool
    display: Callable[[Column], Column]


def extremes(df: DataFrame, date_col: str, specs: Sequence[Extreme],
             label_name: str = "record_type", value_name: str = "value") -> DataFrame:
    """All record rows in one pass (TOP3 + SET1).

    Each record is a ``max_by``/``min_by`` over a (value, date) key, with the
    earliest date winning ties and NULL values never winning; the picked
    rows are then unfolded with ``inline``.  One scan instead of one per
    record, and no sort.  A record whose column is all NULL yields no row.
    """
    aggs = []
    for s in specs:
        v = F.col(s.value)
        day = F.unix_date(F.to_date(F.col(date_col)))
        key = F.when(v.isNotNull(),
                     F.struct(v, F.lit(0) - day) if s.largest else F.struct(v, day))
        pick = F.struct(F.to_date(F.col(date_col)).alias("d"), v.alias("v"))
        agg = F.max_by(pick, key) if s.largest else F.min_by(pick, key)
        aggs.append(agg.alias(f"r{s.sort_order}"))
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(s.sort_order).alias("sort_order"),
                 F.lit(s.label).alias(label_name),
                 F.col(f"r{s.sort_order}.d").alias(date_col),
                 s.display(F.col(f"r{s.sort_order}.v")).alias(value_name))
        for s in specs])
    return (one.select(F.inline(rows))
               .filter(F.col(date_col).isNotNull()))


# fixed text markers of the row hash: unit separator between values, the
# visible NULL symbol (U+2400) for a missing value
ROW_SEPARATOR = "\u001f"
ROW_NULL = "\u2400"


def row_text(cols) -> Column:
    """Every column as text, NULL-safe, joined with a separator no feed uses."""
    return F.concat_ws(ROW_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(ROW_NULL))
                                        for c in cols])


MERGE_TASKS = 64
_ROW_BITS = 33          # monotonically_increasing_id counts a partition's rows in its low bits


def _first_of_partition(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of every partition."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return df.sortWithinPartitions(*order).withColumn("__place", place).where(F.col("__place") < n).drop("__place")


def hash_sample(df: DataFrame, n: int, key: str | None, seed: str = "42") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the ones with the smallest
    ``md5(key || seed)`` (SMP1).

    Repeatable for a given seed and independent of partitioning.  ``key``
    should be unique; with ``key=None`` the whole row is hashed, so only
    identical rows can tie (and any of them is the same row).

    One pass, each row hashed once: every partition keeps its first ``n`` rows by digest
    (a local sort, which spills), ``MERGE_TASKS`` tasks keep the first ``n`` of those
    they get, and the last step merges at most ``MERGE_TASKS * n`` rows, however
    many partitions there are.
    """
    base = F.col(key).cast("string") if key else row_text(df.columns)
    hashed = df.withColumn("__h", F.md5(F.concat(base, F.lit(seed))))
    order = [F.asc("__h")] + ([F.asc(key)] if key else [])
    merged = _first_of_partition(hashed, n, order).repartition(MERGE_TASKS, "__h")
    return _first_of_partition(merged, n, order).orderBy(*order).limit(n).drop("__h")
