"""Column functions that clean text, numbers, categories, dates and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
PSEUDO_NULLS = ("n/a", "na", "-", "null", "none", "nan")
# Accepted spellings of categories.
CATEGORIES = {
    "foliage_color": {"green": "Green", "yellow": "Yellow", "yelow": "Yellow", "mixed": "Mixed", "brown": "Brown", "brwn": "Brown"},
    "soil_type": {"acidic": "Acidic", "standard": "Standard", "std": "Standard"},
    "sunlight_level": {"bright indirect": "bright_indirect", "bright": "bright", "medium": "medium", "low": "low"},
    "shade_level": {"light": "light", "moderate": "moderate", "partial": "partial", "heavy": "heavy"},
    "watering_status": {"keep moist": "Keep moist", "partially dry": "Partially dry", "dry out": "Dry out", "high humidity": "High humidity"},
}
# Ranges of valid measurements, for cleaning and for audits.
CLEAN_RANGES = {"soil_ph": (4.5, 8.0), "soil_ec": (0.0, 1.0), "moisture": (1, 10), "temperature": (18, 32), "humidity": (40, 100), "vine_height_cm": (1, 1500)}
AUDIT_RANGES = CLEAN_RANGES | {"soil_ec": (0.0, 2.0), "moisture": (1, 30)}


def lookup(key: Column, values: Mapping[str, object], default: object = None) -> Column:
    """The value of ``key`` in a small fixed mapping."""
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def pseudo_null(text: Column, words: Sequence[str] = PSEUDO_NULLS) -> Column:
    """Null where the trimmed text in lower case stands for a missing value."""
    return F.when(~F.lower(F.trim(text)).isin(*words), text)


def plant_id(text: Column) -> Column:
    """Upper case, dashes, zone number of two digits and plant number of three; null if it has another form."""
    t = F.regexp_replace(F.upper(F.trim(text)), "_", "-")
    part = lambda i: F.regexp_extract(t, r"^([A-D])(\d{1,2})-P(\d{1,3})-G(\d+)$", i)
    made = F.concat(part(1), F.lpad(part(2), 2, "0"), F.lit("-P"), F.lpad(part(3), 3, "0"), F.lit("-G"), part(4))
    return F.when(part(1) != "", made)


def slot_id(plant: Column) -> Column:
    """The place of a plant: its id without the generation."""
    return F.regexp_replace(plant, r"-G\d+$", "")


def number(text: Column) -> Column:
    """A decimal comma is a point, anything but digits, points and minus signs goes; null if no number is left."""
    t = F.regexp_replace(F.regexp_replace(text, ",", "."), r"[^0-9.\-]", "")
    return F.when(t.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))


def is_number(text: Column) -> Column:
    """Whether the text as it stands is a finite decimal number."""
    return F.coalesce(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def category(text: Column, spellings: Mapping[str, str]) -> Column:
    """Known spellings to their category, anything else to null (P5)."""
    return lookup(F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", " "), spellings)


def date_candidates(text: Column) -> Column:
    """Dates that a text can mean, in order of preference."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))))
    slashes = [F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit(f)))) for f in ("d/M/yyyy", "M/d/yyyy")]
    named = F.when(t.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("d-MMM-yyyy"))))
    return F.array_compact(F.array(iso, *slashes, named))


def reconciled_date(text: Column, created: Column, start: Column, end: Column) -> Column:
    """(date, status): the creation date if the text can mean it, else its first meaning in the window, else the creation date."""
    candidates = date_candidates(text)
    inside = F.filter(candidates, lambda d: (d >= start) & (d <= end))
    ok = F.coalesce(F.array_contains(candidates, created), F.lit(False))
    return F.struct(
        F.when(ok, created).when(F.size(inside) > 0, F.try_element_at(inside, F.lit(1))).otherwise(created).alias("date"),
        F.when(ok, "ok").when(F.size(inside) > 0, "parsed").otherwise("reconciled_from_created_at").alias("status"),
    )


def within(value: Column, limits: tuple[float, float]) -> Column:
    """The value if it is inside the limits, else null."""
    return F.when(value.between(*limits), value)


def sunlight_lux(level: Column) -> Column:
    """Light levels to lux."""
    return lookup(F.lower(level), {"low": 2500, "medium": 7500, "bright": 15000, "bright_indirect": 10000})


def celsius(value: Column) -> Column:
    """Readings over 50 are Fahrenheit (P20)."""
    return F.when(value > 50, (value - 32) * 5 / 9).otherwise(value)


def milli_siemens(text: Column) -> Column:
    """Whole numbers over 10 are micro-siemens (P20)."""
    v = number(text)
    return F.when((v > 10) & ~F.contains(text, F.lit(".")), v / 1000).otherwise(v)


def slug(text: Column) -> Column:
    """Lower case with runs of other characters as one underscore."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def stress_points(moisture: Column, ph: Column, ec: Column, humidity: Column) -> Column:
    """How many of four readings are out of bounds; nulls are not."""
    rules = [(moisture <= 3) | (moisture >= 10), ~ph.between(5.5, 7.0), ec < 0.03, humidity > 85]
    return sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))


def stress_class(points: Column) -> Column:
    return F.when(points == 0, "Healthy").when(points == 1, "Moderate").otherwise("Poor")


def risk_score(curvature: Column, gap: Column, width: Column, contrast: Column) -> Column:
    """Weighted risk of a traced segment, 0 to 1."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return clip(0.42 * clip(curvature) + 0.35 * clip(gap) + 0.15 * clip(width) + 0.08 * clip(contrast))
