"""Column functions over numbers, codes, dates and text. All of them are built-in expressions; none needs Python workers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no figure" in published tables.
MISSING_TEXTS = ("", "NA", "N/A", "N/D", "NC", "ND", "C", "*")
# Body-mass classes (upper bounds are exclusive).
BMI_EDGES = (18.5, 25.0, 30.0)
BMI_CLASSES = ("underweight", "normal", "overweight", "obese")
# Fixed value: the last quarter of the classic survey stage.
LAST_CLASSIC_QUARTER = "2020T1"

_SPLITTER = 134217729.0  # 2**27 + 1 splits a double into two halves whose products are exact


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x: Column | str, digits: int) -> Column:
    """Round the exact binary value, ties to even (2.675 → 2.67, 0.125 → 0.12), for |x|·10^digits below 2^52.

    ``bround`` looks at the decimal text of the double; here the rounding error of ``x * 10^digits`` is recovered with an
    error-free product, so that a product that only looks like a tie is told from a real one.
    """
    x = _col(x).cast("double")
    scale = float(10**digits)
    big = scale * _SPLITTER
    scale_hi = big - (big - scale)
    scale_lo = scale - scale_hi
    size = F.abs(x)
    product = size * F.lit(scale)
    size_hi = size * F.lit(_SPLITTER) - (size * F.lit(_SPLITTER) - size)
    size_lo = size - size_hi
    error = (
        ((size_hi * F.lit(scale_hi) - product) + size_hi * F.lit(scale_lo)) + size_lo * F.lit(scale_hi)
    ) + size_lo * F.lit(scale_lo)
    base = F.floor(product).cast("double")
    rest = product - base
    up = (
        F.when((rest == 0.0) & (error < 0.0), F.lit(0.0))  # just below an integer that the product rounded to
        .when(rest != 0.5, F.when(rest > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(error != 0.0, F.when(error > 0.0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(base % F.lit(2.0))
    )
    rounded = (base + up) / F.lit(scale)
    return F.when(x < 0, -rounded).otherwise(rounded)


def round_half_up(x: Column | str, digits: int) -> Column:
    """Half up with a guard of 1e-9, as the air-quality norm asks."""
    scale = F.lit(float(10**digits))
    return F.floor(_col(x) * scale + F.lit(0.5) + F.lit(1e-9)).cast("double") / scale


def cents(x: Column | str) -> Column:
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.round(_col(x) * 100).cast("bigint")


def zero_pad(code: Column | str, width: int) -> Column:
    """Left-pad with zeros; a longer code is left alone (``lpad`` would cut it)."""
    text = _col(code).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def code_prefix(code: Column | str, length: int) -> Column:
    return F.substring(_col(code), 1, length)


def concat_key(*parts: Column | str, separator: str = "|") -> Column:
    return F.concat_ws(separator, *[_col(p).cast("string") for p in parts])


def bucketize(x: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``labels[i]`` for values below ``edges[i]``; the last label takes the rest. NULL stays NULL."""
    if len(labels) != len(edges) + 1 or list(edges) != sorted(edges):
        raise ValueError("edges must rise and there must be one label more than edges")
    x = _col(x)
    ladder = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        ladder = ladder.when(x < F.lit(edge), F.lit(label))
    return ladder.otherwise(F.lit(labels[-1]))


def map_code(x: Column | str, mapping: Mapping[str, str]) -> Column:
    """Static code → label; unknown codes give NULL."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), _col(x))


def recode(x: Column | str, mapping: Mapping[str, str], default: str) -> Column:
    """Static code → label with a sentinel for unknown and missing codes."""
    return F.coalesce(map_code(x, mapping), F.lit(default))


def normalize_year(year: Column | str, reference: Column | str, pivot: int = 85) -> Column:
    """Two-digit years to four digits; 99, 999 and 9999 mean "not stated"."""
    year, reference = _col(year), _col(reference)
    century = F.when((year >= pivot) | (year > reference % 100), 1900).otherwise(2000)
    return (
        F.when(year.isin(99, 999, 9999), F.lit(None).cast("int"))
        .when(year < 100, (century + year).cast("int"))
        .otherwise(year.cast("int"))
    )


def completed_years(start: Column | str, as_of: Column | str) -> Column:
    start, as_of = _col(start), _col(as_of)
    before_birthday = F.date_format(as_of, "MM-dd") < F.date_format(start, "MM-dd")
    return F.year(as_of) - F.year(start) - before_birthday.cast("int")


def civil_date(instant: Column | str, offset: str = "-06:00") -> Column:
    """The calendar date of a UTC instant in a fixed zone."""
    return F.to_date(F.from_utc_timestamp(_col(instant).cast("timestamp"), offset))


def civil_day_start(date: Column | str, offset: str = "-06:00") -> Column:
    """The UTC instant at which a civil date begins."""
    return F.to_utc_timestamp(_col(date).cast("timestamp"), offset)


def floor_minute(instant: Column | str) -> Column:
    return F.date_trunc("minute", _col(instant))


def parse_quarter(period: Column | str) -> Column:
    """'2005/01' → '2005T1'; other shapes give NULL."""
    period = _col(period)
    shape = r"^(\d{4})/0([1-4])$"
    return F.when(
        period.rlike(shape),
        F.concat(F.regexp_extract(period, shape, 1), F.lit("T"), F.regexp_extract(period, shape, 2)),
    )


def parse_month(period: Column | str) -> Column:
    """'YYYY-MM' or 'YYYY-MM-01' → the first of that month; other days give NULL."""
    period = _col(period)
    text = F.when(F.length(period) == 7, F.concat(period, F.lit("-01"))).otherwise(period)
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.dayofmonth(date) == 1, date)


def parse_local_stamp(text: Column | str) -> Column:
    """'31/01/2024 1:05:00 p. m.' → timestamp without zone."""
    shape = r"^(\d{2})/(\d{2})/(\d{4}) (\d{1,2}):(\d{2}):(\d{2}) (a|p)\. m\.$"
    text = F.trim(_col(text))

    def part(index: int) -> Column:
        return F.regexp_extract(text, shape, index)

    hour = F.try_to_number(part(4), F.lit("99")).cast("int") % 12 + F.when(part(7) == "p", 12).otherwise(0)
    iso = F.concat(
        part(3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit(" "),
        F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(5), F.lit(":"), part(6),
    )
    return F.when(text.rlike(shape), iso.try_cast("timestamp_ntz"))


def trim_decimal_text(text: Column | str) -> Column:
    """'12.5000' → '12.5', '7.' → '7'; text without a point is left alone."""
    text = _col(text)
    trimmed = F.regexp_replace(text, r"\.?0*$", "")
    value = F.when(text.contains("."), trimmed).otherwise(text)
    return F.when(value.isin("", "-"), F.lit("0")).otherwise(value)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL instead of an error when the denominator is zero."""
    return F.try_divide(_col(numerator), _col(denominator))


def pct_change(new: Column | str, old: Column | str) -> Column:
    new, old = _col(new), _col(old)
    return F.when(old > 0, (new - old) / old * 100)


def bmi(weight_kg: Column | str, height_m: Column | str) -> Column:
    height = _col(height_m)
    return F.try_divide(_col(weight_kg), height * height)


def bmi_class(index: Column | str) -> Column:
    return bucketize(index, BMI_EDGES, BMI_CLASSES)


def relative_humidity(temp_c: Column | str, dew_c: Column | str) -> Column:
    """Magnus formula of the WMO guide, in percent."""
    t, td = _col(temp_c), _col(dew_c)
    return 100 * F.exp(17.62 * td / (243.12 + td) - 17.62 * t / (243.12 + t))


def json_field(text: Column | str, field: str, kind: str = "string") -> Column:
    return F.get_json_object(_col(text), f"$.{field}").try_cast(kind)


def leftovers_json(columns: Sequence[str]) -> Column:
    """All given columns as one JSON object without its NULL fields."""
    return F.to_json(F.struct(*columns))


def percentile_rank_from_grid(grid: Column | str, value: Column | str, step: int = 5) -> Column:
    """Rank 0–100 of a value in a distribution given by its percentiles 0, 5, …, 100; the first interval that holds it wins."""
    grid, value = _col(grid), _col(value)
    last = 100 // step
    places = F.transform(
        F.sequence(F.lit(0), F.lit(last - 1)),
        lambda i: F.struct(i.alias("i"), F.get(grid, i).alias("low"), F.get(grid, i + 1).alias("high")),
    )
    hit = F.get(F.filter(places, lambda p: (value >= p["low"]) & (value <= p["high"])), 0)
    inside = F.when(
        hit["low"] == hit["high"], (hit["i"] * step + (hit["i"] + 1) * step) / 2
    ).otherwise(hit["i"] * step + (value - hit["low"]) / (hit["high"] - hit["low"]) * step)
    return (
        F.when(value <= F.get(grid, F.lit(0)), F.lit(0.0))
        .when(value >= F.get(grid, F.lit(last)), F.lit(100.0))
        .otherwise(inside.cast("double"))
    )


def stage_of(quarter: Column | str) -> Column:
    return F.when(_col(quarter) <= LAST_CLASSIC_QUARTER, "clasica").otherwise("enoe_n")


def clean_number_text(text: Column | str) -> Column:
    """Published number text → double: thousands separators only where the whole value has that shape, marks → NULL."""
    text = F.trim(_col(text))
    grouped = text.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
    plain = F.when(grouped, F.regexp_replace(text, ",", "")).otherwise(text)
    return F.when(text.isin(*MISSING_TEXTS), F.lit(None).cast("double")).otherwise(plain.try_cast("double"))


def number_flag(text: Column | str) -> Column:
    """The mark itself where a figure is withheld or not available."""
    text = F.trim(_col(text))
    return F.when(text.isin(*MISSING_TEXTS) & (text != ""), text)


def level_from_key(key: Column | str) -> Column:
    """Geographic level told by the shape of the key."""
    key = _col(key)
    size = F.length(key)
    return (
        F.when(key == "00", "nation").when(size == 2, "state").when(size == 4, "country").when(size == 5, "municipality")
    ).otherwise("other")


def deepest_code(*codes: Column | str) -> tuple[Column, Column]:
    """(level, code) of the deepest non-empty code; ``codes`` go from the top level down. (0, '0') when all are empty."""
    filled = [F.nullif(F.trim(_col(c)), F.lit("")) for c in codes]
    level = F.coalesce(*[F.when(c.isNotNull(), i) for i, c in reversed(list(enumerate(filled, 1)))], F.lit(0))
    return level, F.coalesce(*reversed(filled), F.lit("0"))
