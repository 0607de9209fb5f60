"""Column rules: lenient casts, dates, units, labels, bands, flags, filters.

Every function takes and returns ``Column`` expressions built from
``pyspark.sql.functions`` only, so they stay inside whole-stage codegen and
push down where Catalyst can push them.  None of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# fixed values (these must equal the published rules of the civic feeds)
# --------------------------------------------------------------------------

# Air quality index bands: upper limit (inclusive) -> label; above the last
# limit, and a missing value, fall into the final label.
AQI_LIMITS = (50, 100, 150, 200, 300)
AQI_LABELS = ("Good", "Moderate", "Unhealthy for Sensitive Groups",
              "Unhealthy", "Very Unhealthy", "Hazardous")

# Park acreage bands: upper limit (exclusive) -> label, sort key 1..5.
PARK_SIZE_LIMITS = (0.5, 5, 20, 100)
PARK_SIZE_LABELS = ("Pocket (<0.5 ac)", "Small (0.5-5 ac)", "Medium (5-20 ac)",
                    "Large (20-100 ac)", "Flagship (100+ ac)")

# Transit mode code -> label.
TRANSIT_MODE_LABELS = {
    "MB": "Bus",
    "CB": "Commuter Bus",
    "RB": "Bus Rapid Transit",
    "TB": "Trolleybus",
    "LR": "Light Rail",
    "SR": "Streetcar",
    "CR": "Commuter Rail",
    "MG": "Monorail / Automated Guideway",
    "MO": "Monorail",
    "FB": "Ferryboat",
    "DR": "Demand Response",
    "DT": "Demand Response Taxi",
    "VP": "Vanpool",
}
FERRY_MODE = "FB"

# Transit agency (as published) -> friendly label; anything else has no label.
TRANSIT_AGENCIES = {
    "King County": "King County Metro",
    "Central Puget Sound Regional Transit Authority": "Sound Transit",
    "Snohomish County Public Transportation Benefit Area Corporation": "Community Transit",
    "Pierce County Transportation Benefit Area Authority": "Pierce Transit",
    "City of Everett": "Everett Transit",
    "City of Seattle": "Seattle Streetcar",
    "Washington State Ferries": "Washington State Ferries",
    "King County Ferry District": "King County Water Taxi",
}

# Words that mark a water-related park name when they start a word.
PARK_WATER_KEYWORDS = (
    "beach", "lake", "pond", "bay", "cove", "waterfront", "lagoon", "creek",
    "river", "falls", "spring", "inlet", "harbor", "marina", "boat", "tidelands",
    "wading", "spray", "waterway", "shore",
)

# Botanical name rules: leading hybrid markers and names that mean "no genus".
HYBRID_MARKERS = ("x", "×")
GENUS_PLACEHOLDERS = ("unknown", "vacant", "stump", "")

# Bounding boxes used by the map tables (lat range, lon range).
METRO_BOX = ((47.0, 48.5), (-122.6, -121.5))
TREES_BOX = ((47.4, 47.8), (-122.5, -122.2))


# --------------------------------------------------------------------------
# lenient casts (PRJ2-PRJ5)
# --------------------------------------------------------------------------

# Text shapes a number can take.  Casting only text of these shapes keeps
# dirty values off Spark's failed-parse path, which costs tens of
# microseconds per bad value; the results are unchanged.
_INT_TEXT = r"^\s*[+-]?\d+\s*$"
_NUM_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DOUBLE_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def lenient_double(c: ColumnOrName) -> Column:
    """Text -> double; unparseable text -> NULL (surrounding blanks allowed)."""
    c = _c(c)
    return F.when(c.rlike(_DOUBLE_TEXT), c.try_cast("double"))


def lenient_int(c: ColumnOrName, type_: str = "int") -> Column:
    """Text -> integer; '12.0' -> 12 and '1.5' -> 2 (half away from zero),
    out-of-range or garbage -> NULL.

    Plain integers are cast directly so values beyond 2**53 stay exact.
    """
    c = _c(c)
    return (F.when(c.rlike(_INT_TEXT), c.try_cast(type_))
             .when(c.rlike(_NUM_TEXT), F.round(c.try_cast("double")).try_cast(type_)))


def lenient_bigint(c: ColumnOrName) -> Column:
    return lenient_int(c, "bigint")


_ISO_DATE = r"^\s*\d{4}([-/])\d{1,2}\1\d{1,2}"


def _dashed(c: Column) -> Column:
    """'2024/01/02...' -> '2024-01-02...'; text without a slash is not searched."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, r"^(\s*\d{4})/(\d{1,2})/", "$1-$2-")).otherwise(c)


def text_to_timestamp(c: ColumnOrName) -> Column:
    """ISO (or y/m/d) timestamp text -> timestamp; text without a full y-m-d -> NULL."""
    c = _c(c)
    return F.when(c.rlike(_ISO_DATE), _dashed(c).try_cast("timestamp"))


def text_to_date(c: ColumnOrName) -> Column:
    """ISO date or timestamp text -> date (PRJ3)."""
    return text_to_timestamp(c).cast("date")


def text_prefix_date(c: ColumnOrName) -> Column:
    """First ten characters as an ISO date (PRJ4)."""
    head = F.substring(_c(c), 1, 10)
    return F.when(head.rlike(_ISO_DATE), _dashed(head).try_cast("date"))


def compact_date(c: ColumnOrName) -> Column:
    """'yyyyMMdd' text -> date; '' and NULL -> NULL (PRJ5)."""
    return F.try_to_date(F.nullif(_c(c), F.lit("")), "yyyyMMdd")


def unparsed(text: ColumnOrName, parsed: ColumnOrName) -> Column:
    """True where non-blank text failed to parse: feeds a quality count."""
    t = _c(text)
    return (F.nullif(F.trim(t), F.lit("")).isNotNull() & _c(parsed).isNull())


def epoch_ms_to_date(c: ColumnOrName, floor: str = "1900-01-01") -> Column:
    """Epoch milliseconds (text or number) -> UTC date; before ``floor`` -> NULL."""
    ms = lenient_bigint(_c(c).cast("string"))
    ts = F.timestamp_millis(ms)
    return F.when(ts >= F.lit(floor).cast("timestamp"), ts.cast("date"))


def date_from_parts(year: ColumnOrName, month: ColumnOrName, day: int = 1) -> Column:
    """make_date with out-of-range months mapped to NULL instead of an error."""
    y, m = lenient_int(year), lenient_int(month)
    return F.when(m.between(1, 12) & y.isNotNull(),
                  F.make_date(y, m, F.lit(day)))


# --------------------------------------------------------------------------
# units (PRJ8, PRJ23)
# --------------------------------------------------------------------------

def tenths_mm_to_in(c: ColumnOrName) -> Column:
    return lenient_double(F.trim(_c(c).cast("string"))) / 10.0 / 25.4


def mm_to_in(c: ColumnOrName) -> Column:
    return lenient_double(F.trim(_c(c).cast("string"))) / 25.4


def tenths_c_to_f(c: ColumnOrName) -> Column:
    return lenient_double(F.trim(_c(c).cast("string"))) / 10.0 * 9 / 5 + 32


def sqft_to_acres(c: ColumnOrName) -> Column:
    return _c(c).cast("double") / 43560.0


def clamped_radius(c: ColumnOrName, lo: float = 1, hi: float = 300,
                   scale: float = 40) -> Column:
    """sqrt(clip(x, lo, hi)) * scale, for point sizes on a map."""
    return F.sqrt(F.greatest(F.least(_c(c).cast("double"), F.lit(hi)), F.lit(lo))) * scale


# --------------------------------------------------------------------------
# labels, bands, flags (PRJ9-PRJ22)
# --------------------------------------------------------------------------

def strip_all(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace of every kind (tabs, newlines);
    SQL ``trim`` removes spaces only."""
    return F.regexp_replace(_c(c), r"\A\s+|\s+\z", "")


def label_or_unknown(c: ColumnOrName, blank_is_null: bool = True,
                     default: str = "Unknown") -> Column:
    """coalesce(nullif(trim(x), ''), 'Unknown'); without trimming only NULL maps."""
    c = _c(c)
    if blank_is_null:
        c = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(c, F.lit(default))


def blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(_c(c), F.lit(""))


def yn_flag(c: ColumnOrName, yes: str = "Y") -> Column:
    """'Y' -> true, anything else -> false, NULL stays NULL."""
    return _c(c) == F.lit(yes)


def weekday_name(ts: ColumnOrName) -> Column:
    """Full English weekday name ('Monday')."""
    return F.date_format(_c(ts), "EEEE")


def hour_of_day(ts: ColumnOrName) -> Column:
    return F.hour(_c(ts)).cast("int")


def water_year(d: ColumnOrName) -> Column:
    """October-September year: months from October count to the next year."""
    d = _c(d)
    return F.when(F.month(d) >= 10, F.year(d) + 1).otherwise(F.year(d)).cast("int")


def band(c: ColumnOrName, limits: Sequence[float], labels: Sequence[str],
         inclusive: bool = True) -> Column:
    """Ordered banding: first limit the value is under (or at) wins.

    ``len(labels) == len(limits) + 1``; values above the last limit and NULL
    get the last label, as in a SQL ``case ... else`` chain.
    """
    if len(labels) != len(limits) + 1:
        raise ValueError("need one more label than limits")
    c = _c(c)
    expr = None
    for lim, lab in zip(limits, labels):
        cond = (c <= lim) if inclusive else (c < lim)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def band_rank(c: ColumnOrName, limits: Sequence[float], inclusive: bool = True) -> Column:
    """Sort key 1..n of :func:`band`."""
    return band(c, limits, [str(i + 1) for i in range(len(limits) + 1)],
                inclusive).cast("int")


def aqi_category(c: ColumnOrName) -> Column:
    return band(c, AQI_LIMITS, AQI_LABELS)


def label_rank(c: ColumnOrName, labels: Sequence[str]) -> Column:
    """Position (1-based) of a label in ``labels``; unknown label -> NULL."""
    c = _c(c)
    expr = None
    for i, lab in enumerate(labels, start=1):
        expr = F.when(c == lab, F.lit(i)) if expr is None else expr.when(c == lab, F.lit(i))
    return expr.cast("int")


def two_way(c: ColumnOrName, value: str, then: str, otherwise: str) -> Column:
    """case when c = value then ... else ... (NULL takes the else branch)."""
    return F.when(_c(c) == value, F.lit(then)).otherwise(F.lit(otherwise))


def map_literal(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def code_label(c: ColumnOrName, mapping: Mapping[str, str] = TRANSIT_MODE_LABELS,
               unknown: str = "Unknown") -> Column:
    """Code -> label after trim+upper; an unmapped code returns itself
    (trimmed, upper); NULL or '' -> 'Unknown' (a blank code stays '')."""
    c = _c(c)
    key = F.upper(strip_all(c))
    looked = F.try_element_at(map_literal(mapping), key)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(unknown)) \
            .otherwise(F.coalesce(looked, key))


def lookup(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Exact dictionary lookup; unknown -> NULL."""
    return F.try_element_at(map_literal(mapping), _c(c))


def keyword_flag(c: ColumnOrName, keywords: Sequence[str] = PARK_WATER_KEYWORDS) -> Column:
    """True if any keyword starts a word, case-insensitive; NULL/'' -> false."""
    pattern = r"(?i)\b(" + "|".join(keywords) + ")"
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def first_token(c: ColumnOrName, markers: Sequence[str] = HYBRID_MARKERS,
                placeholders: Sequence[str] = GENUS_PLACEHOLDERS) -> Column:
    """First word, capitalised; a leading marker word is skipped when more
    words follow; placeholder words and blanks give NULL."""
    def pick(toks):
        skip = F.lower(F.get(toks, 0)).isin(*markers) & (F.size(toks) > 1)
        return F.when(skip, F.get(toks, 1)).otherwise(F.get(toks, 0))

    def word(tok):
        whole = F.concat(F.upper(F.substring(tok, 1, 1)), F.lower(F.substr(tok, F.lit(2))))
        return F.when(~F.lower(tok).isin(*placeholders), whole)
    # each step sees the value of the one before, evaluated once
    split = F.array(F.split(strip_all(_c(c)), r"\s+"))
    return F.element_at(F.transform(F.transform(split, pick), word), 1)


def month_abbrev(month: ColumnOrName) -> Column:
    """1..12 -> 'Jan'..'Dec'."""
    m = _c(month).cast("int")
    return F.when(m.between(1, 12), F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMM"))


def display_int(c: ColumnOrName, suffix: str) -> Column:
    """round to an integer, then append a unit: 103 -> '103 °F'."""
    return F.concat(F.round(_c(c), 0).cast("int").cast("string"), F.lit(suffix))


def display_round(c: ColumnOrName, digits: int, suffix: str) -> Column:
    """round(x, d) as text plus a unit: 1.25 -> '1.25 in', 5.0 -> '5.0 in'.

    Shortest round-trip text of the rounded double (values from 1e7 up or
    below 1e-3 print in scientific form)."""
    return F.concat(F.round(_c(c), digits).cast("string"), F.lit(suffix))


def display_fixed(c: ColumnOrName, digits: int, suffix: str) -> Column:
    """Fixed decimals, then a unit: 1.2345 -> '1.23 in' (never scientific)."""
    return F.concat(F.format_string(f"%.{digits}f", F.round(_c(c), digits)), F.lit(suffix))


def title_case(c: ColumnOrName) -> Column:
    """Capital at the start of every run of letters: "o'neil 2nd" -> "O'Neil 2Nd"."""
    split = F.regexp_replace(F.lower(_c(c)), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(split), F.lit("\u0001 "), F.lit(""))


# --------------------------------------------------------------------------
# predicates (FLT*)
# --------------------------------------------------------------------------

def in_box(lat: ColumnOrName, lon: ColumnOrName, box=METRO_BOX) -> Column:
    """Inclusive bounding box; NULL and out-of-box sentinels fail."""
    (la0, la1), (lo0, lo1) = box
    return _c(lat).between(la0, la1) & _c(lon).between(lo0, lo1)


def contains_ci(cols: Sequence[ColumnOrName], term: str) -> Column:
    """Literal, case-insensitive substring in any column; NULL never matches."""
    t = F.lit(term.lower())
    hits = [F.coalesce(F.contains(F.lower(_c(x)), t), F.lit(False)) for x in cols]
    return reduce(lambda a, b: a | b, hits)


def not_blank(c: ColumnOrName) -> Column:
    c = _c(c)
    return c.isNotNull() & (c != "")
