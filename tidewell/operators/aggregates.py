"""Grouped rollups: frequency tables, calendar rollups, grids, collapses,
summary rows, trends and first/last comparisons.

All of them are ``groupBy().agg()`` with built-in aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle: a key holding a third of the
rows is reduced to one row per map task before it reaches a reducer.  No
function here sorts unless the caller asks for an ordered result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.numeric import fixed


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def frequency(df: DataFrame, key, count_name: str = "n",
              drop_null: bool = True, drop_blank: bool = False,
              ordered: bool = False) -> DataFrame:
    """Rows per key, most common first when ``ordered`` (AGG1 + FLT1)."""
    k = _c(key)
    name = key if isinstance(key, str) else None
    if drop_null:
        df = df.filter(k.isNotNull())
    if drop_blank:
        df = df.filter(k != "")
    out = df.groupBy(k.alias(name) if name else k).agg(F.count(F.lit(1)).alias(count_name))
    if ordered:
        out = out.orderBy(F.desc(count_name), F.asc_nulls_last(out.columns[0]))
    return out


def total_by(df: DataFrame, key, measures: dict[str, Column]) -> DataFrame:
    """Sum (or any aggregate) per key; measures maps output name -> aggregate."""
    return df.groupBy(key).agg(*[m.alias(n) for n, m in measures.items()])


def month_start(d) -> Column:
    """First day of the calendar month as DATE (never a timestamp)."""
    return F.trunc(F.to_date(_c(d)), "month")


def month_rollup(df: DataFrame, date_col, month_name: str,
                 measures: dict[str, Column]) -> DataFrame:
    """Calendar-month rollup (AGG2); rows with a NULL date are dropped."""
    return (df.filter(_c(date_col).isNotNull())
              .groupBy(month_start(date_col).alias(month_name))
              .agg(*[m.alias(n) for n, m in measures.items()]))


def year_rollup(df: DataFrame, date_col, year_name: str,
                measures: dict[str, Column]) -> DataFrame:
    """Calendar-year rollup (AGG3)."""
    return (df.filter(_c(date_col).isNotNull())
              .groupBy(F.year(_c(date_col)).cast("int").alias(year_name))
              .agg(*[m.alias(n) for n, m in measures.items()]))


def month_of_year_rollup(df: DataFrame, date_col, measures: dict[str, Column],
                         month_name: str = "month_num") -> DataFrame:
    """Climatology: one row per month of the year over all years (AGG4)."""
    return (df.filter(_c(date_col).isNotNull())
              .groupBy(F.month(_c(date_col)).cast("int").alias(month_name))
              .agg(*[m.alias(n) for n, m in measures.items()]))


def monthly_totals(df: DataFrame, date_col, value: Column,
                   month_name: str = "month", total_name: str = "total") -> DataFrame:
    """First level of a two-level rollup: the sum per calendar month."""
    return month_rollup(df, date_col, month_name, {total_name: value})


def seasonal_profile(monthly: DataFrame, month_col: str = "month",
                     total_col: str = "total", out: str = "avg_total") -> DataFrame:
    """Second level (AGG5): mean over years of each month-of-year's total.

    Means are taken over monthly sums, never over daily means, so a month
    with more rows is not under-weighted.
    """
    return (monthly.groupBy(F.month(month_col).cast("int").alias("month_of_year"))
                   .agg(F.avg(total_col).alias(out)))


def annual_from_monthly(monthly: DataFrame, month_col: str = "month",
                        total_col: str = "total", out: str = "total",
                        complete_only: bool = False) -> DataFrame:
    """Second level (AGG5): yearly sum of monthly totals plus the number of
    months present; ``complete_only`` keeps years with all 12 (FLT9)."""
    res = (monthly.groupBy(F.year(month_col).cast("int").alias("year"))
                  .agg(F.sum(total_col).alias(out),
                       F.count(F.lit(1)).alias("months_reported")))
    if complete_only:
        res = res.filter(F.col("months_reported") == 12)
    return res


def grid(df: DataFrame, row_key: Column, col_key: Column,
         count_name: str = "n") -> DataFrame:
    """Two-key count grid (AGG6); only observed cells, no zero fill."""
    return (df.filter(row_key.isNotNull() & col_key.isNotNull())
              .groupBy(row_key, col_key).agg(F.count(F.lit(1)).alias(count_name)))


def collapse(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Many detail rows -> one row per natural key (AGG7, AGG8)."""
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def having(df: DataFrame, keys: Sequence[str], measures: dict[str, Column],
           condition: Column) -> DataFrame:
    """Aggregate then keep groups meeting ``condition`` (AGG12)."""
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()]).filter(condition)


def summary_row(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One global row of several aggregates (AGG10, AGG11, AGG15)."""
    return df.agg(*[m.alias(n) for n, m in measures.items()])


def distinct_row(df: DataFrame, distinct: dict[str, Column | str], sums: dict[str, Column] | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Several exact distinct counts, and sums, of a table in one pass (AGG11).

    Whole numbers (and dates, booleans) go into bit words: value >> 6 names a word,
    value & 63 its bit, and words are merged by ``bit_or``, so up to 64 neighbouring
    values are one row of the shuffle and one key of the hash table.  Other values are
    words of their own.  A row makes one entry per distinct column (counting distinct
    values of several columns directly makes one more) and the shuffle moves words
    instead of values.  ``sums`` are row values to add up; NULLs count for nothing.
    ``by`` gives one row a group, without it there is one row in all.
    """
    sums = sums or {}
    kinds = dict(df.select(*[_c(c).alias(n) for n, c in distinct.items()]).dtypes)
    entries = []
    for i, (name, c) in enumerate(distinct.items()):
        value, word, text = _c(c), F.lit(0).cast("bigint"), F.lit(None).cast("string")
        number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kinds[name], lambda x: x)
        if kinds[name] in ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "boolean"):
            n = number(value).cast("bigint")
            word, bit = F.shiftright(n, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                                            n.bitwiseAND(F.lit(63)).cast("int"))
        else:
            # 0.0 added: both zeros are one value
            same = value + F.lit(0.0) if kinds[name] in ("float", "double") else value
            text, bit = same.cast("string"), F.lit(1).cast("bigint")
        there = value.isNotNull()
        entries.append(F.struct(F.lit(i).alias("i"), F.when(there, word).alias("word"), F.when(there, text).alias("text"),
                                F.when(there, bit).otherwise(F.lit(0).cast("bigint")).alias("bits"),
                                *[(x if i == 0 else F.lit(None)).cast("bigint").alias(f"s{k}")
                                  for k, x in enumerate(sums.values())]))
    parts = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(sums))]
    words = df.select(*by, F.inline(F.array(*entries))).groupBy(*by, "i", "word", "text") \
        .agg(F.bit_or("bits").alias("bits"), *parts)
    return words.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("i") == i, F.bit_count("bits"))), F.lit(0)).cast("bigint").alias(name)
          for i, name in enumerate(distinct)],
        *[F.sum(f"s{k}").alias(name) for k, name in enumerate(sums)])


def count_true(b) -> Column:
    """Sum of a boolean; NULL counts as 0 (AGG10)."""
    return F.sum(F.when(_c(b), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def count_where(cond: Column) -> Column:
    """count(*) filter (where cond) (AGG9)."""
    return F.count_if(cond).cast("bigint")


def sum_where(value, cond: Column) -> Column:
    return F.sum(F.when(cond, _c(value)))


def trend_line(df: DataFrame, x: str, y: str, digits: int = 4) -> DataFrame:
    """Least-squares line of y on x (AGG18): slope, intercept, r2, n."""
    return df.agg(fixed(F.regr_slope(y, x), digits).alias("slope"),
                  fixed(F.regr_intercept(y, x), digits).alias("intercept"),
                  fixed(F.regr_r2(y, x), digits).alias("r2"),
                  F.regr_count(y, x).alias("n_points"))


def first_last(order_col: str, value: str) -> tuple[Column, Column]:
    """Value at the smallest and at the largest ``order_col`` (AGG19)."""
    return F.min_by(value, order_col), F.max_by(value, order_col)


def arg_extreme(value, by, tie, largest: bool = True) -> Column:
    """The ``value`` of the row with the largest (or smallest) ``by``; ties go
    to the smallest ``tie`` (a number; pass ``unix_date(d)`` for dates); rows
    with NULL ``by`` never win (AGG20).  One aggregate with a partial step, no
    window and no sort."""
    b, t = _c(by), _c(tie)
    key = F.when(b.isNotNull(), F.struct(b, (F.lit(0) - t) if largest else t))
    return F.max_by(_c(value), key) if largest else F.min_by(_c(value), key)
