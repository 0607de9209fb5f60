"""Top-k per group (WIN1, WIN2, HEX2).

``row_number() <= k`` over a partitioned window is planned with a
``WindowGroupLimit`` on both sides of the shuffle: each map task keeps at most
k rows per group before anything moves, so a hot group costs k rows per map
task, not a third of the table in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  k: int = 1, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order``.

    ``order`` must be total (end it with a unique tie-break) so the result is
    the same on every run.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank_col or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def top_categories(df: DataFrame, cell_cols: Sequence[str], category: str,
                   k: int = 8, count_name: str = "n",
                   rank_col: str = "rank") -> DataFrame:
    """Most common ``k`` categories inside every cell at once (WIN2).

    Counting happens first (partial aggregate), so the window only sees one
    row per (cell, category).
    """
    counts = (df.filter(F.col(category).isNotNull())
                .groupBy(*cell_cols, category).agg(F.count(F.lit(1)).alias(count_name)))
    return top_per_group(counts, cell_cols,
                         [F.desc(count_name), F.asc(category)], k, rank_col)


def sample_per_group(df: DataFrame, cell_cols: Sequence[str], key: str,
                     k: int = 12, seed: str = "42") -> DataFrame:
    """``k`` repeatable example rows per cell (HEX2), chosen by a hash of the
    row key and a seed, not by file order."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return top_per_group(df.withColumn("__h", h), cell_cols,
                         [F.asc("__h"), F.asc(key)], k).drop("__h")
