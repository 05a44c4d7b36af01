"""Column functions of the domain: distances, weights, labels. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Weights and tables that results depend on.
THREAT_WEIGHTS = {"LC": 1, "NT": 2, "VU": 4, "EN": 8, "CR": 16, "EW": 16, "EX": 16, "DD": 1, "NE": 1}
STATUS_WEIGHTS = {"Endangered": 3, "Threatened": 2, "Special Concern": 1}
RANK_DEPTH = {
    "subspecies": 7, "variety": 7, "form": 7, "hybrid": 6, "species": 6, "subgenus": 5, "genus": 5, "subfamily": 4,
    "family": 4, "superfamily": 4, "suborder": 3, "order": 3, "subclass": 2, "class": 2, "phylum": 1, "kingdom": 0,
}
SPECIES_RANKS = ("species", "subspecies", "variety", "form", "hybrid")
RAMP = ((255, 255, 217), (237, 248, 177), (199, 233, 180), (127, 205, 187), (65, 182, 196), (29, 145, 192), (34, 94, 168), (37, 52, 148), (8, 29, 88))
MODES = {"Walk": (5.0, 0.0), "Cycle": (14.0, 0.0), "Drive": (60.0, 0.18)}  # km/h, kg of CO2 a km
ROAD_FACTOR = 1.35


def _haversine_h(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a + b))


def haversine_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * F.asin(F.sqrt(_haversine_h(lat1, lon1, lat2, lon2)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_KM * haversine_angle(lat1, lon1, lat2, lon2)


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot(lat2 - lat1, lon2 - lon1)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cell_area_km2(lat: Column, res: float = 0.25) -> Column:
    side = 111.32 * res
    return side * side * F.cos(F.radians(lat))


def implied_records(density: Column, lat: Column, res: float = 0.25) -> Column:
    """Half-even, as the records of a cell are counted."""
    return F.rint(density * cell_area_km2(lat, res)).cast("bigint")


def staleness_score(n_all: Column, n_recent: Column, least: int = 20) -> Column:
    """(1 - recent share) * ln(1 + all), where there are enough records to say."""
    share = F.try_divide(F.least(n_recent, n_all).cast("double"), n_all.cast("double"))
    return F.when(n_all >= least, (1 - share) * F.log1p(n_all.cast("double")))


def inverse_density(density: Column, floor: float = 1e-3) -> Column:
    return 1 / (density + floor)


def return_on_travel(value: Column, minutes: Column) -> Column:
    return value / (1 + minutes / 60)


def rate(events: Column, effort: Column) -> Column:
    """Null where there was no effort."""
    return F.try_divide(events.cast("double"), F.nullif(effort, F.lit(0)).cast("double"))


def wait_days(since: Column, until: Column) -> Column:
    return (F.unix_micros(until) - F.unix_micros(since)) / 8.64e10


def unengaged(identifications: Column) -> Column:
    return F.coalesce(identifications, F.lit(0)) <= 1


def lookup(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def coarseness(rank: Column) -> Column:
    return -lookup(rank, RANK_DEPTH)


def epsg(crs: Column) -> Column:
    return F.split_part(crs, F.lit(":"), F.lit(2)).try_cast("int")


def stem_of_url(url: Column) -> Column:
    """The last path segment without its suffix, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+?)(\.[^./]*)?$", 1))


def lut_index(value: Column, ceiling: float, size: int = 256) -> Column:
    """Index into a colour table; null and non-positive values are transparent (null)."""
    return F.when(value > 0, F.least(F.lit(size - 1), F.floor(value / ceiling * (size - 1))).cast("int"))


def ramp_colour(t: Column) -> Column:
    """Colour at t in [0, 1] by interpolation between the stops of the ramp."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (len(RAMP) - 1)
    i, stops = F.floor(x).cast("int"), F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in RAMP])
    a, b = F.get(stops, i), F.get(stops, F.least(i + 1, F.lit(len(RAMP) - 1)))
    part = [F.floor(F.get(a, F.lit(k)) + (F.get(b, F.lit(k)) - F.get(a, F.lit(k))) * (x - i) + 0.5).cast("int").cast("string") for k in range(3)]
    return F.concat(F.lit("rgb("), part[0], F.lit(","), part[1], F.lit(","), part[2], F.lit(")"))


def duration_label(hours: Column) -> Column:
    days, rest, minutes = F.floor(hours / 24), F.floor(hours - 24 * F.floor(hours / 24) + 0.5), F.floor(hours * 60 + 0.5)
    long = F.concat(days.cast("string"), F.lit("d"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("h"))).otherwise(""))
    middle = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.when(hours >= 24, long).when(minutes >= 60, middle).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))


def co2_label(kg: Column) -> Column:
    return F.when(kg <= 0, "car-free").when(kg < 10, F.format_string("~%.1f kg CO2", kg)).otherwise(F.concat(F.lit("~"), F.floor(kg + 0.5).cast("string"), F.lit(" kg CO2")))


def cell_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.3f,%.3f", lat, lon)


def coverage_label(share: Column) -> Column:
    return F.when(share < 0.2, "gap").when(share < 0.6, "partial").otherwise("ok")


def dominant_index(weights: Column) -> Column:
    """Zero-based place of the first largest weight."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def https_only(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("https://")), html_escape(url)).otherwise("")


def small_photo(url: Column) -> Column:
    return F.regexp_replace(url, r"/square\.", "/small.")


def p_label(p: Column, floor: float) -> Column:
    return F.when(p < floor, F.lit(f"<{floor:g}")).otherwise(F.format_string("%.4f", p))


def score_label(score: Column) -> Column:
    return F.concat(F.floor(score * 100).cast("string"), F.lit("/100"))


def parse_place(text: Column, box: tuple[float, float, float, float] = (41.0, 84.0, -141.0, -52.0)) -> Column:
    """(lat, lon) of ``lat,lon`` inside the box, else null."""
    lat, lon = F.split_part(text, F.lit(","), F.lit(1)).try_cast("double"), F.split_part(text, F.lit(","), F.lit(2)).try_cast("double")
    return F.when(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.struct(lat.alias("lat"), lon.alias("lon")))


def tile_of(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-map tile numbers of a point."""
    n = 1 << zoom
    phi = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    return x.cast("bigint"), y.cast("bigint")
