"""Column expressions: spectral indices, radar conversion, validity, tiers, classification, requests, grids."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the change rules and of the request language: classes, thresholds, tiers, words, labels and prompt.
VALID_SCL = (2, 4, 5, 6, 7)
OPTICAL_THRESHOLD, SAR_THRESHOLD_DB = 0.20, 3.0
VEG, WATER, BUILT = 0.15, 0.15, 0.05
SAR_RISE, SAR_FALL, WATER_FALL, ROAD_ELONGATION = 1.5, -1.5, -3.0, 4.0
TIERS = ("confirmed", "optical", "sar_only", "sar_gap")
PREPOSITIONS = ("near", "around", "in", "at", "on", "along", "by", "next to", "close to", "surrounding", "beside", "within")
INDEX_WORDS = {
    "ndbi": ("construction", "building", "urban", "built", "development", "settlement", "housing", "industrial", "road", "infrastructure"),
    "ndwi": ("water", "flood", "river", "lake", "reservoir", "inundation", "wetland", "coast", "dam"),
}
LABELS = {
    "construction": "Construction / new built-up",
    "clearance": "Clearing / vegetation removal",
    "vegetation_loss": "Vegetation loss (cause unresolved)",
    "vegetation_growth": "Vegetation growth / regrowth",
    "flooding": "Flooding / water expansion",
    "water_recession": "Water recession",
    "road_development": "Road / linear infrastructure",
    "surface_change": "Bare surface / material change",
    "structural_change": "Structural change (radar only)",
    "other": "Unclassified change",
}

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def absent(x: Col) -> Column:
    """NaN and infinities become NULL: an absent measurement. Spark orders NaN above all numbers, so a threshold would pass it."""
    v = _c(x)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0, NULL where a side is absent."""
    return F.when(den == 0, F.when(num.isNotNull(), 0.0)).otherwise(num / den)


def norm_diff(a: Col, b: Col) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0, NULL where a band is absent."""
    a, b = absent(a), absent(b)
    return _ratio(a - b, a + b)


def vari(green: Col, red: Col, blue: Col) -> Column:
    g, r, b = absent(green), absent(red), absent(blue)
    return _ratio(g - r, g + r - b)


INDICES = {"ndvi": ("nir", "red"), "ndwi": ("green", "nir"), "ndbi": ("swir16", "nir")}


def named_index(name: str) -> Column:
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; choose from {sorted(INDICES)}")
    return norm_diff(*INDICES[name])


def to_db(gamma0: Col) -> Column:
    """10 log10, NULL (absent) for non-positive or non-finite values."""
    g = _c(gamma0).cast("double")
    return F.when((g > 0) & (g < F.lit(float("inf"))), 10 * F.log10(g))


def scl_valid(scl: Col) -> Column:
    return F.coalesce(_c(scl).isin(*VALID_SCL), F.lit(False))


def crossing(diff: Col, valid: Col, threshold: float) -> Column:
    return F.coalesce(_c(valid), F.lit(False)) & (F.abs(F.coalesce(absent(diff), F.lit(0.0))) >= threshold)


def direction(diff: Col, valid: Col, threshold: float) -> Column:
    if threshold <= 0:
        raise ValueError(f"threshold must be positive, got {threshold}")
    d = F.when(_c(valid), F.coalesce(absent(diff), F.lit(0.0)))
    return F.when(d <= -threshold, "loss").when(d >= threshold, "gain")


def tier(d2: Col, v2: Col, d1: Col, v1: Col, t2: float = OPTICAL_THRESHOLD, t1: float = SAR_THRESHOLD_DB) -> Column:
    """One of the four evidence tiers, or NULL; exclusive by construction."""
    opt, sar = F.coalesce(_c(v2), F.lit(False)), F.coalesce(_c(v1), F.lit(False))
    c2, c1 = crossing(d2, v2, t2), crossing(d1, v1, t1)
    return (
        F.when(c2 & c1, "confirmed").when(c2, "optical").when(opt & c1, "sar_only").when(~opt & c1, "sar_gap")
    )


def tier_direction(tier_: Col, d2: Col, d1: Col) -> Column:
    """Optical sign for confirmed and optical, radar sign otherwise."""
    driver = F.when(_c(tier_).isin("confirmed", "optical"), _c(d2)).otherwise(_c(d1))
    return F.when(_c(tier_).isNull(), F.lit(None)).when(driver < 0, "loss").otherwise("gain")


def hectares(pixels: Col, pixel_area_m2: float = 100.0) -> Column:
    return _c(pixels).cast("double") * pixel_area_m2 / 10_000.0


def classify(ndvi="ndvi", ndwi="ndwi", ndbi="ndbi", db="sar_db", elongation="elongation", opt="has_optical", sar="has_sar") -> Column:
    """struct(change_type, confidence): the first rule that holds."""
    v, w, b, s, e, o, r = map(_c, (ndvi, ndwi, ndbi, db, elongation, opt, sar))

    def kind(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("change_type"), F.lit(confidence).alias("confidence"))

    wet, loss = o & (w >= WATER), o & (v <= -VEG)
    rules = [
        (wet & r & (s <= WATER_FALL), kind("flooding", 0.9)),
        (wet, kind("flooding", 0.6)),
        (r & ~o & (s <= WATER_FALL), kind("flooding", 0.7)),
        (o & (w <= -WATER), kind("water_recession", 0.7)),
        (loss & ~r, kind("vegetation_loss", 0.5)),
        (loss & (s >= SAR_RISE) & (b >= BUILT), kind("construction", 0.85)),
        (loss & (s >= SAR_RISE), kind("construction", 0.65)),
        (loss & (s <= SAR_FALL), kind("clearance", 0.85)),
        (loss, kind("vegetation_loss", 0.55)),
        (o & (v >= VEG), kind("vegetation_growth", 0.75)),
        ((e >= ROAD_ELONGATION) & ((b >= 0) | (s >= SAR_RISE)), kind("road_development", 0.6)),
        (o & (b >= 2 * BUILT), kind("surface_change", 0.55)),
        (r & (F.abs(s) >= 3.0), kind("structural_change", 0.6)),
    ]
    return reduce(lambda acc, rule: acc.when(*rule), rules[1:], F.when(*rules[0])).otherwise(kind("other", 0.3))


def label(change_type: Col) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), _c(change_type))


REASONS = {
    "flooding|0.9": "water index up, backscatter collapsed: open water",
    "flooding|0.6": "water index up, not confirmed by radar",
    "flooding|0.7": "backscatter collapsed without an optical view: water under cloud",
    "water_recession|0.7": "water index down",
    "vegetation_loss|0.5": "vegetation down; without radar, clearing and building look alike",
    "vegetation_loss|0.55": "vegetation down, radar ambiguous",
    "construction|0.85": "vegetation down, built-up index and backscatter up",
    "construction|0.65": "vegetation down, backscatter up",
    "clearance|0.85": "vegetation and backscatter down",
    "vegetation_growth|0.75": "vegetation up",
    "road_development|0.6": "long and narrow",
    "surface_change|0.55": "built-up index up, vegetation kept",
    "structural_change|0.6": "backscatter changed without a spectral change",
    "other|0.3": "no rule matched",
}


def reason(change_type: Col, confidence: Col) -> Column:
    """Why a rule gave this type with this confidence, which names the rule."""
    names = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.element_at(names, F.concat(_c(change_type), F.lit("|"), _c(confidence).cast("string")))


def evidence(ndvi: Col, ndwi: Col, ndbi: Col, db: Col, has_optical: Col, has_sar: Col, why: Col) -> Column:
    """The readings of the sensors that saw the region, and the reason."""
    optical = F.format_string("NDVI %+.2f, NDWI %+.2f, NDBI %+.2f", *[_c(x).cast("double") for x in (ndvi, ndwi, ndbi)])
    radar = F.format_string("SAR %+.1f dB", _c(db).cast("double"))
    return F.concat_ws("; ", F.when(_c(has_optical), optical), F.when(_c(has_sar), radar), _c(why))


def split_request(text: Col) -> tuple[Column, Column]:
    """(what, where): split at the last preposition; without one, or with nothing behind it, all is the place."""
    whole = F.btrim(F.regexp_replace(_c(text), r"\s+", " "))
    pattern = r"(?i)^(.*)\b(?:" + "|".join(PREPOSITIONS) + r")\b(.*)$"
    what = F.btrim(F.regexp_extract(whole, pattern, 1), F.lit(" ,"))
    where = F.regexp_replace(F.btrim(F.regexp_extract(whole, pattern, 2), F.lit(" ,")), r"(?i)^(?:the|a|an)\s+", "")
    split = where != ""
    return F.when(split, what).otherwise(""), F.when(split, where).otherwise(F.btrim(whole, F.lit(" ,")))


def index_hint(what: Col) -> Column:
    low = F.lower(_c(what))
    out = F.when(low.rlike("|".join(INDEX_WORDS["ndbi"])), "ndbi")
    return out.when(low.rlike("|".join(INDEX_WORDS["ndwi"])), "ndwi").otherwise("ndvi")


def aoi(lat: Col, lon: Col, west: Col, south: Col, east: Col, north: Col, span: float = 0.10) -> Column:
    """struct(west, south, east, north, windowed): the box itself, or a square window where it is too large or too small."""
    la, lo, w, s, e, n = map(_c, (lat, lon, west, south, east, north))
    size = F.greatest(e - w, n - s)
    odd = (size > 0.25) | (size < 0.02)
    half_lon = F.lit(span / 2) / F.greatest(F.cos(F.radians(la)), F.lit(0.1))
    pick = lambda a, b: F.round(F.when(odd, a).otherwise(b), 5)
    return F.struct(
        pick(lo - half_lon, w).alias("west"), pick(la - span / 2, s).alias("south"), pick(lo + half_lon, e).alias("east"), pick(la + span / 2, n).alias("north"), odd.alias("windowed")
    )


def build_prompt(query: Col, template: str = "a satellite image of {}") -> Column:
    """The query as a caption; an empty one raises when read."""
    q = F.btrim(_c(query))
    before, after = template.split("{}")
    formed = F.when(F.lower(q).rlike(r"^(a|an|the) "), q).otherwise(F.concat(F.lit(before), q, F.lit(after)))
    return F.when(q == "", F.raise_error(F.lit("the query is empty")).cast("string")).otherwise(formed)


def public_error(message: Col, limit: int = 400) -> Column:
    """URL query strings are taken out, as they carry tokens; at most ``limit`` characters, the last a mark of what is cut."""
    m = F.regexp_replace(_c(message), r"\?[^\s'\"<>]*", "?…")
    return F.when(F.length(m) > limit, F.concat(F.left(m, F.lit(limit - 1)), F.lit("…"))).otherwise(m)


def format_hectares(ha: Col) -> Column:
    """From 100 whole hectares with thousands marks, else one place."""
    h = _c(ha)
    return F.when(h >= 100, F.format_number(F.floor(h + 0.5), 0)).otherwise(F.format_string("%.1f", h))


def escape_html(text: Col) -> Column:
    out = _c(text)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def place_label(name: Col) -> Column:
    return F.substring_index(_c(name), ",", 3)


def cache_key(scene: Col, bbox: list[Col], layer: Col) -> Column:
    """20 digits that name a layer of a scene over a box; the box counts to six places."""
    box = F.concat_ws(", ", *[F.round(_c(b).cast("double"), 6).cast("string") for b in bbox])
    text = F.concat(F.lit('{"bbox": ['), box, F.lit('], "layer": "'), _c(layer), F.lit('", "scene": "'), _c(scene), F.lit('"}'))
    return F.left(F.sha1(text), F.lit(20))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over a tree's files (path, content), by path, line ends alike. A tree of sources is small: its files meet in one row."""
    entry = F.struct("path", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    whole = F.aggregate(F.sort_array(F.collect_list(entry)), F.lit(""), lambda acc, x: F.concat(acc, x["path"], F.lit("\0"), x["content"], F.lit("\0")))
    return files.agg(F.sha2(whole, 256).alias("fingerprint"))


def utm_epsg(lon: Col, lat: Col) -> Column:
    zone = (F.floor((_c(lon) + 180) / 6) + 1).cast("int")
    return zone + F.when(_c(lat) >= 0, 32600).otherwise(32700)


def parse_bbox(raw: Col) -> Column:
    """ARRAY<DOUBLE> west, south, east, north; NULL where malformed or out of range."""
    b = F.transform(F.split(_c(raw), ","), lambda x: x.try_cast("double"))
    ok = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull())
    w, s, e, n = (F.get(b, k) for k in range(4))
    return F.when(ok & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90) & (w < e) & (s < n), b)


# WGS84 ellipsoid and the third flattening's series for the transverse Mercator projection.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def utm_forward(lon: Col, lat: Col, epsg: Col) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    central = F.radians((_c(epsg) % 100) * 6 - 183)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon)) - central
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(_c(epsg) >= 32700, 10_000_000.0).otherwise(0.0)
    return 500_000 + _K0 * _RADIUS * x, south + _K0 * _RADIUS * y


def utm_inverse(easting: Col, northing: Col, epsg: Col) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    south = F.when(_c(epsg) >= 32700, 10_000_000.0).otherwise(0.0)
    xi, eta = (_c(northing) - south) / (_K0 * _RADIUS), (_c(easting) - 500_000) / (_K0 * _RADIUS)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (_c(epsg) % 100) * 6 - 183
    return lon, F.degrees(phi)
