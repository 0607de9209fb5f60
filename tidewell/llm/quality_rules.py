"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` rows are (name, numerator, denominator, low, high): a text passes a
rule when ``low * denominator <= 100 * numerator <= high * denominator`` (low
and high in per cent; None leaves a side open).  All measures are whole
numbers, so a verdict never depends on floating-point rounding.  Measures come
from ``measures`` and the verdict from ``compile_rules``; both are plain
columns, so the whole operator is one scan and one projection without shuffle,
whatever the size or skew of the input.

Defined results: a null text is an empty text (no words, base fails);
empty tables give empty results; other columns pass through
untouched; repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACES, documents, let, pieces, text_or_empty, with_windows

REPEAT_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the four languages of the documents.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au aux dans de des du en est et la le les par pas pour que qui un une avec sur "
    "auf das dem den der die ein eine im ist mit nicht sich und von zu für auch "
    "al como con del el las los no para por se su una y lo más").split()

# name, numerator, denominator, low %, high %
RULES = (
    ("word_length", "word_chars", "n_words", 200, 2000),
    ("symbols_per_word", "n_symbols", "n_words", None, 20),
    ("shouting", "n_upper", "n_chars", None, 40),
    ("exclamations_per_word", "n_exclaim", "n_words", None, 30),
    ("stop_words", "n_stop", "n_words", 1, None),
    ("echoed_words", "n_echo", "n_words", None, 40),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    ("bullet_lines", "n_bullets", "n_lines", None, 90),
    ("ellipsis_lines", "n_ellipses", "n_lines", None, 30),
)


def _repeat_words(w: Column, h: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.  Windows are
    compared by 64-bit hash within one text; sorted (hash, start) pairs give
    the repeated starts, and each start adds the words not already covered by
    the next one.  Texts without a repeated window skip the sort."""
    n = REPEAT_WORDS

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p):
            def same(x, k):
                return ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) \
                    | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(p, same), lambda x: x["i"]))

        def total(s):
            gaps = F.transform(s, lambda x, k: F.coalesce(
                F.least(F.lit(n), F.get(s, k + 1) - x), F.lit(n)))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)
        return let(let(pairs, starts), total)
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")) \
        .otherwise(covered(h))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """The input plus a struct column ``_tw_m`` with every measure."""
    t = F.col("_tw_t")
    d = df.withColumn("_tw_t", text_or_empty(text)).withColumn("_tw_p", pieces(F.col("_tw_t")))
    d = d.withColumn("_tw_w", F.array_remove("_tw_p", "")).withColumn(
        "_tw_l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    w, lines, x = F.col("_tw_w"), F.col("_tw_l"), F.col("_tw_x")
    d = d.withColumn("_tw_x", F.transform(w, lambda v: F.xxhash64(v)))
    d = with_windows(d.withColumn("_tw_h", x), "_tw_h", REPEAT_WORDS)

    def times(pattern):
        return F.regexp_count(t, F.lit(pattern)).cast("bigint")

    def count(c):
        return F.size(c).cast("bigint")
    head = F.transform(lines, lambda v: F.substring(F.btrim(v, F.lit(SPACES)), 1, 1))
    m = F.struct(
        count(w).alias("n_words"),
        (F.length(t) - (F.size("_tw_p") - 1)).cast("bigint").alias("word_chars"),
        F.length(t).cast("bigint").alias("n_chars"),
        times("[#*$%&|<>]").alias("n_symbols"), times("!").alias("n_exclaim"),
        times(r"\p{Lu}").alias("n_upper"),
        count(F.filter(w, lambda v: v.isin(STOP_WORDS))).alias("n_stop"),
        count(F.filter(x, lambda v, i: (i > 0) & (F.get(x, i - 1) == v))).alias("n_echo"),
        count(lines).alias("n_lines"),
        (count(lines) - count(F.array_distinct(lines))).alias("n_dup_lines"),
        count(F.filter(head, lambda v: v.isin("-", "*", "•"))).alias("n_bullets"),
        count(F.filter(lines, lambda v: F.rtrim(v).endswith("...") | F.rtrim(v).endswith("…")))
        .alias("n_ellipses"),
        _repeat_words(w, F.col("_tw_h")).alias("n_repeat_words"))
    return d.withColumn("_tw_m", m)\
        .drop("_tw_t", "_tw_p", "_tw_w", "_tw_l", "_tw_x", "_tw_h")


def compile_rules(m: Column, rules=RULES) -> Column:
    """Names of the rules that a measure struct breaks, as one array column."""
    def broken(name, num, den, low, high):
        bad = F.lit(False)
        if low is not None:
            bad = bad | (m[num] * 100 < m[den] * low)
        if high is not None:
            bad = bad | (m[num] * 100 > m[den] * high)
        return F.when(bad, F.lit(name))
    return F.array_compact(F.array(*[broken(*r) for r in rules]))


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The input plus ``_tw_m`` (measures), ``_tw_base`` (base verdict failed),
    ``_tw_broken`` (rules broken) and ``_tw_keep``."""
    m = F.col("_tw_m")
    return measures(df, text).withColumn(
        "_tw_base", (m["n_words"] < MIN_WORDS)
        | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)) \
        .withColumn("_tw_broken", compile_rules(m, rules)) \
        .withColumn("_tw_keep", ~F.col("_tw_base") & (F.size("_tw_broken") == 0))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass the base and every rule, columns unchanged.

    The verdict drops rows in a generator: a plain filter would be pushed below
    the measures and repeat each of them for every rule that names it.
    """
    passed = F.filter(F.array(F.col("_tw_keep")), lambda k: k)
    return judge(docs).withColumn("_tw_one", F.explode(passed)) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_rules(spark, sf_dir) -> DataFrame:
    """Quality measures and verdict of every whole text of ``documents``."""
    m = F.col("_tw_m")
    return judge(documents(spark, sf_dir)).select(
        "doc_id", *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols",
                                            "n_dup_lines", "n_repeat_words")],
        F.col("_tw_base").alias("base_failed"), F.col("_tw_keep").alias("kept"),
        F.array_join("_tw_broken", ",").alias("broken_rules"))


def _rule_sql(name, num, den, low, high):
    parts = []
    if low is not None:
        parts.append(f"{num} * 100 < {den} * {low}")
    if high is not None:
        parts.append(f"{num} * 100 > {den} * {high}")
    return f"case when {' or '.join(parts)} then '{name}' end"


OP1_SQL = r"""
with base as (
  select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents),
toks as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from base),
wins as (
  select rid, i, array_to_string(w[i:i + 7], ' ') as win
  from (select rid, w, unnest(range(1, len(w) - 6)) as i from toks where len(w) >= 8)),
rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from wins)
  where c > 1),
cover as (
  select rid, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
  from (select rid, i, lead(i) over (partition by rid order by i) as nxt from rep) group by rid),
m as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(t) as n_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g')) as n_exclaim,
         length(regexp_replace(t, '\P{Lu}', '', 'g')) as n_upper,
         len(list_filter(w, lambda x: list_contains(STOPS, x))) as n_stop,
         len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1])) as n_echo,
         len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) as n_ellipses,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from toks left join cover using (rid)),
v as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         concat_ws(',', CASES) as broken_rules from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and broken_rules = '' as kept, broken_rules
from v
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]") \
   .replace("CASES", ", ".join(_rule_sql(*r) for r in RULES))
