"""Column functions: coordinates, floors, codes, labels, journey estimates, route URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EARTH_RADIUS_M = 6_378_137.0
FLOOR_HEIGHT_M = 5.0
WALKING_M_PER_S = 1.2
# Fixed seconds of a floor change by movement.
TRANSITION_SECONDS = {"stairs": 15, "escalator": 20, "elevator": 45}
# Fixed source codes.
DIRECTIONS = {"1": "both", "2": "forward", "3": "reverse"}
MOVEMENTS = {"4": "elevator", "5": "escalator", "6": "stairs"}
IN_OUT = {"1": "outside", "2": "boundary", "3": "inside"}


def round_mm(x: Column) -> Column:
    """Millimetres, halves upward."""
    return F.floor(x * 1000 + 0.5) / 1000


def millimetres(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5).cast("long")


def lonlat_to_local(lon: Column, lat: Column, lon0: float, lat0: float, elevation: Column) -> Column:
    """struct(x east, y up, z south) in metres from an origin (equirectangular)."""
    x = F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(F.lit(lat0)))
    z = -(F.radians(lat - lat0) * EARTH_RADIUS_M)
    return F.struct(round_mm(x).alias("x"), round_mm(elevation).alias("y"), round_mm(z).alias("z"))


def normalize_floor(raw: Column) -> Column:
    """B1, -1 -> B1, 2OUT -> 2out; other text in upper case."""
    v = F.upper(F.trim(raw))
    return F.when(v.rlike(r"^-\d+$"), F.concat(F.lit("B"), F.substring(v, 2, 99).cast("int").cast("string"))).when(v.rlike(r"^\d+OUT$"), F.lower(v)).otherwise(v)


def floor_elevation(floor: Column) -> Column:
    f = normalize_floor(floor)
    below = -FLOOR_HEIGHT_M * F.regexp_extract(f, r"^B(\d+(?:\.\d+)?)$", 1).try_cast("double")
    above = FLOOR_HEIGHT_M * F.regexp_extract(f, r"(?i)^(\d+(?:\.\d+)?)(?:OUT)?$", 1).try_cast("double")
    return F.coalesce(below, above, F.lit(0.0))


def visual_floor(floor: Column) -> Column:
    return F.regexp_replace(normalize_floor(floor), "out$", "")


def floor_of_ordinal(ordinal: Column) -> Column:
    """-1 -> B1, -2.5 -> B2.5, 3 -> 3."""
    size = F.abs(ordinal)
    text = F.when(size == F.floor(size), size.cast("long").cast("string")).otherwise(size.cast("string"))
    return F.when(ordinal < 0, F.concat(F.lit("B"), text)).otherwise(text)


def in_reading_order(c: str) -> list[Column]:
    """Sort keys of ids: first the order in which readers look for them (punctuation, digits, letters), then bytes."""
    return [F.collate(F.col(c), "UNICODE").alias("__reads"), F.col(c)]


def decode(code: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The code's name; unknown codes give ``default`` (null: to be reported)."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code], F.lit(default))


def clear_label(label: Column) -> Column:
    """The trimmed label, or null where it names nothing: empty, unknown, digits, one or two letters with digits."""
    v = F.trim(label)
    vague = (v == "") | v.rlike(r"(?i)^(?:不明|unknown|null)$") | v.rlike(r"^\d+$") | v.rlike(r"(?i)^[A-Z]{1,2}\d*(?:[´']|（[^）]*）)?$")
    return F.when(~vague, v)


def confidence(distance: Column) -> Column:
    return F.when(distance <= 5, "high").when(distance <= 15, "medium").otherwise("low")


def heading(dx: Column, dz: Column) -> Column:
    return F.degrees(F.atan2(dz, dx))


def signed_turn(before: Column, after: Column) -> Column:
    """Degrees in (-180, 180]."""
    t = F.pmod(after - before + 180, F.lit(360.0)) - 180
    return F.when(t == -180, F.lit(180.0)).otherwise(t)


def turn_between(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Degrees in (-180, 180] from direction a to direction b, right positive; a null vector points east."""
    still = lambda x, z: (x == 0) & (z == 0)
    ax, bx = F.when(still(ax, az), F.lit(1.0)).otherwise(ax), F.when(still(bx, bz), F.lit(1.0)).otherwise(bx)
    t = F.degrees(F.atan2(ax * bz - az * bx, ax * bx + az * bz))
    return F.when(t == -180, F.lit(180.0)).otherwise(t)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t), na_action="ignore")


def search_text(text: Column) -> Column:
    """NFKC, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(_nfkc(text)), r"\s+", " "))


def journey_seconds(distance: Column, movements: Column) -> Column:
    """movements: array of the floor changes' kinds."""
    allowance = F.create_map(*[F.lit(x) for kv in TRANSITION_SECONDS.items() for x in kv])
    extra = F.aggregate(movements, F.lit(0), lambda a, m: a + F.coalesce(allowance[m], F.lit(0)))
    return F.ceil(distance / WALKING_M_PER_S + extra)


def journey_minutes(seconds: Column) -> Column:
    return F.when(seconds == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(seconds / 60)))


def space_category(name: Column) -> Column:
    """The place category that a space's name tells, or null."""
    return F.when(name.contains("トイレ"), "toilet").when(name.rlike(r"(?i)^(EV[_-]|エレベーター)"), "elevator").when(name.rlike(r"(?i)^(ESC[_-]|エスカレーター)"), "escalator")


def category_code(raw: Column) -> Column:
    return F.upper(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))


def sorted_properties(properties: Column) -> Column:
    """A map with its keys in order, so that equal properties print alike."""
    return F.map_from_entries(F.array_sort(F.map_entries(properties)))


def stacked_elevation(y: Column, gap: float = 30.0) -> Column:
    """Display height of floors drawn apart."""
    return y * (gap / FLOOR_HEIGHT_M)


def route_url(start: Column, destination: Column, profile: Column) -> Column:
    """The query part of a route's address; the shortest profile is the default and left out."""
    part = lambda name, v: F.concat(F.lit(f"{name}="), F.url_encode(v))
    return F.concat_ws("&", part("from", start), part("to", destination), F.when(profile != "shortest", part("profile", profile)))


def url_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
