"""Spans of regular expression matches as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.llm.common import let

EMPTY = "array<struct<start:bigint,end:bigint,text:string,group:string,before:string>>"
CHUNK = 256                  # values summed one by one at a time


def _sums_before(values: Column, first: Column) -> Column:
    """``first`` plus the sum of the values in front of each value of a short array."""
    start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(
        (acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def sums_before(values: Column) -> Column:
    """The sum of the values in front of each value, in two steps: by chunks, then in
    each.  An array that grows by one value a step is copied each time, so only short
    ones grow; a million values cost about a second.  ``values`` must be bound (a
    variable of a function), as it is looked at more than once."""
    zero = F.lit(0).cast("bigint")

    def run(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda x, y: x + y))
        return let(_sums_before(totals, zero), lambda before: F.flatten(F.transform(
            chunks, lambda c, k: _sums_before(c, F.get(before, k)))))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
                       lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(values) > 0, let(cuts, run)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, group: int = 0, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with code point offsets (end exclusive),
    the text of ``group`` and up to 30 characters in front.

    Spark returns matched texts but not their places, so the text is also cut
    at the same matches: the lengths of the pieces between give the places.
    ``guard`` skips texts that cannot match.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    named = F.regexp_extract_all(text, p, F.lit(group)) if group else F.array().cast("array<string>")
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), found.alias("text"), named.alias("group"))

    def spans(v):
        sizes = F.transform(v["text"], lambda t, i: (F.length(F.get(v["gap"], i)) + F.length(t)).cast("bigint"))
        # the piece in front of a match starts where the match before it ended
        return let(sizes, lambda s: let(sums_before(s), lambda at: F.transform(v["text"], lambda t, i: F.struct(
            (F.get(at, i) + F.length(F.get(v["gap"], i))).alias("start"),
            (F.get(at, i) + F.get(s, i)).alias("end"), t.alias("text"),
            (F.get(v["group"], i) if group else t).alias("group"),
            F.right(F.get(v["gap"], i), F.lit(30)).alias("before")))))
    seen = text.rlike(pattern) if guard is None else guard
    return F.when(seen, let(parts, spans).cast(EMPTY)).otherwise(F.array().cast(EMPTY))


def joined(spans: Column, kinds) -> Column:
    """kind:start:end, comma-joined, by start and then kind as listed; ``spans``
    holds structs whose fields are start, kind (its number) and end."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
