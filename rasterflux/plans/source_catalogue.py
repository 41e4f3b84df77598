"""Registered queries over files that Spark derives from the tables (rasters, catalogues), over warped grids and over joins of areas with scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflux.functions import grids as G
from rasterflux.operators import change as CH
from rasterflux.operators import crops as CR
from rasterflux.operators import regions as R
from rasterflux.operators import ring_links, spatial
from rasterflux.operators import scenes as S
from rasterflux.operators import warp as WP
from rasterflux.plans import catalogue as K
from rasterflux.plans.catalogue import N, query
from rasterflux.plans.pipeline import load_radar
from rasterflux.plans import pipeline as P
from rasterflux.plans import run_catalogue as RC
from rasterflux.plans.run_catalogue import _sql_utm
from rasterflux.sources import items, tiff
from rasterflux.sources import tables as T
from rasterflux.storage import scratch_path

#: Side of the tiles that the queries write: a small grid has several.
TILE = 16
BANDS = ["red", "nir", "scl"]


def _rasters(spark: SparkSession, d: str) -> str:
    """The optical pixels as one raster per step, in a new folder."""
    folder = scratch_path(spark, "rasters")
    px = T.pixels(spark, d).where("sensor = 'S2'")
    tiff.write(px, folder, F.concat(F.lit("S2-"), F.col("step")), BANDS, N, N, TILE, (500_000.0, 4_000_000.0), (10.0, 10.0), 32643)
    return folder


def _step() -> Column:
    return F.regexp_extract("path", r"S2-(\d+)\.tif$", 1).cast("int").alias("step")


@query(f"WITH {K._PX} SELECT r,c,step,red,nir,scl FROM px WHERE sensor='S2'")
def raster_round_trip(spark, d):
    """Pixels written to tiled rasters and read back."""
    read = tiff.read(spark, _rasters(spark, d)).where("b3 is not null")
    return read.select("r", "c", _step(), F.col("b1").alias("red"), F.col("b2").alias("nir"), F.col("b3").cast("int").alias("scl"))


@query(f"WITH {K._PX} SELECT r,c,step,nir FROM px WHERE sensor='S2' AND r BETWEEN 20 AND 40 AND c<10")
def raster_window(spark, d):
    """One band of a window: only the tiles that it meets are planned."""
    read = tiff.read(spark, _rasters(spark, d), bands=[2], window=(20, 0, 41, 10))
    return read.where("b2 is not null").select("r", "c", _step(), F.col("b2").alias("nir"))


_DB = f"""{K._PX}, s AS (SELECT r,c,CASE WHEN gamma0>0 THEN 10*log10(gamma0) END AS db FROM px WHERE sensor='S1' AND step=0), g AS (SELECT CAST(i // {N} AS INT) AS r, CAST(i % {N} AS INT) AS c FROM range({N * N}) t(i)),
o AS (SELECT a AS dr, b AS dc FROM range(-2,3) x(a), range(-2,3) y(b)), near AS (SELECT g.r,g.c,s.db FROM g CROSS JOIN o LEFT JOIN s ON s.r=least(greatest(g.r+dr,0),{N - 1}) AND s.c=least(greatest(g.c+dc,0),{N - 1}))"""


@query(f"WITH {_DB} SELECT r,c,0::INT AS step,round(avg(db),9) AS db,avg(db) IS NOT NULL AS ok FROM near GROUP BY 1,2")
def radar_load(spark, d):
    """One radar date in dB after the speckle filter; what it could fill is valid."""
    px = T.pixels(spark, d).where("sensor = 'S1'").withColumnRenamed("gamma0", "gamma0_vv")
    return load_radar(px, T.grid(spark), N, N, 0).select("r", "c", "step", F.round("db", 9).alias("db"), "ok")


@query(f"""WITH {K._SCENES} SELECT CAST(id AS VARCHAR) AS id, CAST(date AS VARCHAR) AS date, cloud_cover, west FROM sc
 WHERE sensor='S2' AND date BETWEEN DATE '{K.START}' AND DATE '{K.END}' AND cloud_cover<40 AND west<=20 AND east>=-40 AND south<=30 AND north>=-30""")
def catalogue_search(spark, d):
    """The scene catalogue written to files of items and searched by sensor, dates, cloud and box."""
    folder = scratch_path(spark, "catalogue")
    items.write(T.scenes(spark, d), folder, 200)
    found = items.search(spark, folder, "S2", K.START, K.END, 40.0, (-40.0, -30.0, 20.0, 30.0))
    return found.select("id", F.col("date").cast("string").alias("date"), "cloud_cover", "west")


_FIRST = "DATE '2024-01-01'+CAST(place_id%20 AS INT)"


@query(f"""WITH {K._SCENES}, {K._GAZ}, ar AS (SELECT place_id, lon-span*4 AS west, lat-span*4 AS south, lon+span*4 AS east, lat+span*4 AS north, {_FIRST} AS d0, {_FIRST}+40 AS d1 FROM gz)
SELECT place_id, id AS scene_id, CAST(date AS VARCHAR) AS date FROM ar JOIN sc ON date BETWEEN d0 AND d1 AND ar.west<=sc.east AND ar.east>=sc.west AND ar.south<=sc.north AND ar.north>=sc.south""")
def area_scenes(spark, d):
    """All scenes over all places within each place's dates, in one join."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("place_id") % 20).cast("int"))
    half = 4 * F.element_at(F.array(F.lit(0.001), F.lit(0.08), F.lit(3.0)), F.col("place_id") % 3 + 1)
    box = [(F.col("lon") - half).alias("west"), (F.col("lat") - half).alias("south"), (F.col("lon") + half).alias("east"), (F.col("lat") + half).alias("north")]
    areas = T.gazetteer(spark, d).select("place_id", *box, start.alias("start"), F.date_add(start, 40).alias("end"))
    found = spatial.join(areas, T.scenes(spark, d).select("id", "date", "west", "south", "east", "north"))
    return found.select(F.col("a_place_id").alias("place_id"), F.col("s_id").alias("scene_id"), F.col("s_date").cast("string").alias("date"))


#: A target of SIDE x SIDE pixels, turned by about 20 degrees; and one in degrees over the same source, in zone 43.
SIDE, TURN = 48, (3.0, 0.94, 0.34, 12.0, -0.31, 1.02)
WEST, NORTH, STEP = 75.0004, 36.1424, (0.00009, 0.00008)
_TARGET = f"t AS (SELECT CAST(i // {SIDE} AS INT) AS r, CAST(i % {SIDE} AS INT) AS c FROM range({SIDE * SIDE}) z(i))"
_AFFINE = "p AS (SELECT r,c,{0}+{1}*(r+0.5)+{2}*(c+0.5) AS y,{3}+{4}*(r+0.5)+{5}*(c+0.5) AS x FROM t)".format(*[f"{v}::DOUBLE" for v in TURN])
_LON, _LAT = f"({WEST}::DOUBLE+(c+0.5)*{STEP[0]}::DOUBLE)", f"({NORTH}::DOUBLE-(r+0.5)*{STEP[1]}::DOUBLE)"
_E, _N = _sql_utm(_LON, _LAT, "32643")
_DEGREES = f"p AS (SELECT r,c,(4000000-({_N}))/10.0::DOUBLE-0.5 AS y,(({_E})-500000)/10.0::DOUBLE-0.5 AS x FROM t)"
_FOUR = """n AS (SELECT p.r,p.c,src.v, (CASE WHEN a=1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE WHEN b=1 THEN x-floor(x) ELSE 1-(x-floor(x)) END) AS w
 FROM p CROSS JOIN range(2) i(a) CROSS JOIN range(2) j(b) JOIN src ON src.r=floor(y)+a AND src.c=floor(x)+b)
SELECT r,c,round(sum(v*w)/sum(w),9) AS nir FROM n WHERE w>0 GROUP BY 1,2"""
_SOURCE = f"{K._PX}, src AS (SELECT r,c,nir AS v,scl FROM px WHERE sensor='S2' AND step=0)"


def _source(spark: SparkSession, d: str) -> DataFrame:
    return T.pixels(spark, d).where("sensor = 'S2' and step = 0")


@query(f"WITH {_SOURCE}, {_TARGET}, {_AFFINE}, {_FOUR}")
def warp_rotated(spark, d):
    """A band on a rotated grid, bilinear."""
    return WP.warp(_source(spark, d), T.grid(spark, SIDE), "nir", WP.affine(*TURN)).select("r", "c", F.round("nir", 9).alias("nir"))


@query(f"WITH {_SOURCE}, {_TARGET}, {_DEGREES}, {_FOUR}")
def warp_to_degrees(spark, d):
    """A band in metres on a grid in degrees, bilinear."""
    place = WP.degrees_to_utm((WEST, NORTH), STEP, (500_000.0, 4_000_000.0), 10.0, 32643)
    return WP.warp(_source(spark, d), T.grid(spark, SIDE), "nir", place).select("r", "c", F.round("nir", 9).alias("nir"))


@query(f"WITH {_SOURCE}, {_TARGET}, {_DEGREES} SELECT p.r,p.c,src.scl FROM p JOIN src ON src.r=floor(y+0.5) AND src.c=floor(x+0.5)")
def warp_classes(spark, d):
    """Classes on the grid in degrees: the nearest pixel's."""
    place = WP.degrees_to_utm((WEST, NORTH), STEP, (500_000.0, 4_000_000.0), 10.0, 32643)
    return WP.warp(_source(spark, d), T.grid(spark, SIDE), "scl", place, nearest=True)


_SIDES = "(VALUES (-1,0),(0,1),(1,0),(0,-1)) d(dr,dc)"
_LOSS_LAB = f"{K._BASE}, {K._LOSS}, {K._reach('lab', 'm', False)}"


@query(f"""{_LOSS_LAB}, ed AS (SELECT a.label, count(*) AS edges FROM lab a CROSS JOIN {_SIDES} WHERE NOT EXISTS (SELECT 1 FROM lab b WHERE b.label=a.label AND b.r=a.r+dr AND b.c=a.c+dc) GROUP BY 1),
qq AS (SELECT label, r+i AS r, c+j AS c, count(*) AS n, max(i*2+j) AS hi, min(i*2+j) AS lo FROM lab CROSS JOIN range(2) x(i) CROSS JOIN range(2) y(j) GROUP BY 1,2,3),
kk AS (SELECT label, sum(CASE WHEN n IN (1,3) THEN 1 WHEN n=2 AND hi+lo=3 THEN 2 ELSE 0 END) AS corners FROM qq GROUP BY 1), ss AS (SELECT label, count(*) AS pixels FROM lab GROUP BY 1)
SELECT ss.label, CAST(ed.edges AS BIGINT) AS edges, CAST(kk.corners AS BIGINT) AS corners, CAST(pixels AS DOUBLE) AS area, 1::BIGINT AS outer_rings FROM ss JOIN ed USING (label) JOIN kk USING (label)""")
def linked_rings(spark, d):
    """Rings of the loss patches by list ranking: their edges, corners, the area that they enclose (holes taken off), and outer rings."""
    lab = R.components(K._loss(spark, d), N, N, eight=False)
    corners = ring_links.ring_corners(lab, [], N)
    nxt = corners.select("ring", F.col("position").alias("p"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    order = F.row_number().over(K.W.partitionBy("ring").orderBy("p")) - 1
    # Corners are few per ring here; each is joined with the one that follows.
    a = corners.withColumn("i", F.row_number().over(K.W.partitionBy("ring").orderBy("position")) - 1).withColumn("n", F.count(F.lit(1)).over(K.W.partitionBy("ring")))
    both = a.withColumn("j", (F.col("i") + 1) % F.col("n")).join(nxt.withColumn("j", order), ["ring", "j"])
    length = F.sum(F.abs(F.col("r2") - F.col("r")) + F.abs(F.col("c2") - F.col("c"))).cast("long").alias("edges")
    area = (F.sum(F.col("c") * F.col("r2") - F.col("c2") * F.col("r")) / 2.0).alias("area")
    return both.groupBy("label").agg(length, F.count(F.lit(1)).alias("corners"), area, F.count_distinct(F.when(F.col("outer"), F.col("ring"))).alias("outer_rings"))


_LEVEL = "CAST(coalesce(floor(least(1,{0}*{1})*255),0) AS INT)"


@query(f"""{_LOSS_LAB}, bb AS (SELECT label, min(r) AS r0, max(r)+1 AS r1, min(c) AS c0, max(c)+1 AS c1, count(*) AS n FROM lab GROUP BY 1 HAVING n>=3),
hh AS (SELECT label, (r0+r1)/2.0::DOUBLE AS cy, (c0+c1)/2.0::DOUBLE AS cx, greatest(2*(c1-c0),2*(r1-r0),16)/2.0::DOUBLE AS half FROM bb),
w0 AS (SELECT *, CAST(floor(greatest(0,least(cx-half,{N - 1}))) AS INT) AS x0, CAST(floor(greatest(0,least(cy-half,{N - 1}))) AS INT) AS y0 FROM hh),
ww AS (SELECT label, x0, y0, CAST(floor(least({N},greatest(x0+1,cx+half))) AS INT) AS x1, CAST(floor(least({N},greatest(y0+1,cy+half))) AS INT) AS y1 FROM w0),
ll AS (SELECT r,c,{_LEVEL.format("red", 10)} AS red,{_LEVEL.format("nir", 10)} AS nir,{_LEVEL.format("green", 10)} AS green FROM px WHERE sensor='S2' AND step=0)
SELECT ww.label AS feature_index, CAST(y1-y0 AS INT) AS height, CAST(x1-x0 AS INT) AS width, CAST(coalesce(sum(red+nir+green),0) AS BIGINT) AS total, CAST(coalesce(sum(red*((r-y0)*(x1-x0)+c-x0+1)),0) AS BIGINT) AS weighted
FROM ww LEFT JOIN ll ON ll.r>=y0 AND ll.r<y1 AND ll.c>=x0 AND ll.c<x1 GROUP BY ww.label,y0,y1,x0,x1""")
def region_crops(spark, d):
    """Context crops of the loss patches of at least three pixels from a rendering of the first date: size, sum of all levels, and the sum of the first band's by place."""
    lab = R.components(K._loss(spark, d), N, N, eight=False)
    box = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[f(k).cast("double").alias(f"{k}_{f.__name__}") for k in "rc" for f in (F.min, F.max)]).where("n >= 3")
    bounds = F.struct(F.col("c_min").alias("west"), (F.col("c_max") + 1).alias("east"), (-F.col("r_min")).alias("north"), (-F.col("r_max") - 1).alias("south"))
    frame = F.struct(F.lit(0.0).alias("west"), F.lit(float(N)).alias("east"), F.lit(0.0).alias("north"), F.lit(-float(N)).alias("south"))
    windows = box.select(F.col("label").alias("feature_index"), G.context_crop(bounds, frame, N, N, 16).alias("w")).select("feature_index", "w.*")
    level = lambda k: F.coalesce(F.floor(F.least(F.lit(1.0), F.col(k) * 10) * 255), F.lit(0)).alias(k)
    bands = ["red", "nir", "green"]
    chip = T.pixels(spark, d).where("sensor = 'S2' and step = 0").select("r", "c", *[level(k) for k in bands])
    found = CR.crops(windows, chip, bands, tile=16)
    # Every third byte is of the first band.
    levels = F.transform(F.sequence(F.lit(1), F.length("crop")), lambda i: F.conv(F.hex(F.substring("crop", i, F.lit(1))), 16, 10).cast("long"))
    found = found.withColumn("v", levels)
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("v", lambda x, i: F.when(i % 3 == 0, x * (F.floor(i / 3) + 1)).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("feature_index", "height", "width", total.alias("total"), weighted.alias("weighted"))


@query("""WITH q AS (SELECT vec_id AS prompt, embedding AS e FROM embeddings WHERE vec_id%50=0), s AS (SELECT prompt, vec_id AS feature_index, list_sum(list_transform(list_zip(embedding, q.e), lambda x: CAST(x[1] AS DOUBLE)*CAST(x[2] AS DOUBLE))) AS score FROM embeddings, q)
SELECT prompt, feature_index, round(score,4) AS score, CAST(row_number() OVER (PARTITION BY prompt ORDER BY score DESC, feature_index) AS INT) AS rank FROM s QUALIFY rank<=20""")
def prompt_ranks(spark, d):
    """Every fiftieth vector as a prompt, ranked against all."""
    vectors = T.table(spark, d, "embeddings")
    return S.rank_by_prompts(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("prompt"), "embedding"), 20)


def _limits(k: str) -> str:
    return f"(SELECT quantile_cont({k},0.02) FROM b WHERE {k}>0) AS lo_{k}, (SELECT quantile_cont({k},0.98) FROM b WHERE {k}>0) AS hi_{k}"


@query(f"""WITH {K._PX}, b AS (SELECT * FROM px WHERE sensor='S2'), q AS (SELECT {", ".join(map(_limits, ("red", "nir", "green", "swir16")))})
SELECT r,c,step,{", ".join(f"CAST(floor(greatest(0,least(1,({k}-lo_{k})/(CASE WHEN hi_{k}<=lo_{k} THEN 1 ELSE hi_{k}-lo_{k} END)))*255) AS INT) AS {k}" for k in ("red", "nir", "green", "swir16"))} FROM b, q""")
def stretched_bands(spark, d):
    """Four bands of all dates stretched between their exact percentiles, which are refined together."""
    px = T.pixels(spark, d).where("sensor = 'S2'")
    return px.select("r", "c", "step", *[v.alias(k) for k, v in CH.stretched(px, ["red", "nir", "green", "swir16"]).items()])


_FILTERED = f"""sraw AS (SELECT r,c,step,CASE WHEN gamma0>0 THEN 10*log10(gamma0) END AS db FROM px WHERE sensor='S1' AND step IN (0,{K.LAST})),
sgrid AS (SELECT CAST(i // {N} AS INT) AS r, CAST(i % {N} AS INT) AS c, st AS step FROM range({N * N}) t(i), (VALUES (0),({K.LAST})) z(st)), soff AS (SELECT a AS dr, b AS dc FROM range(-2,3) x(a), range(-2,3) y(b)),
s1 AS (SELECT sgrid.r,sgrid.c,sgrid.step,round(avg(db),6) AS db FROM sgrid CROSS JOIN soff LEFT JOIN sraw ON sraw.step=sgrid.step AND sraw.r=least(greatest(sgrid.r+dr,0),{N - 1}) AND sraw.c=least(greatest(sgrid.c+dc,0),{N - 1}) GROUP BY 1,2,3)"""


@query(f"{RC._PAIR_ALL} SELECT {RC._FIELDS} FROM top".replace(K._S1, _FILTERED))
def run_pair_loaded(spark, d):
    """A pair run whose radar dates pass through the loader: one polarization, dB, speckle filter, validity after it."""
    px = T.pixels(spark, d).where("sensor = 'S1'").withColumnRenamed("gamma0", "gamma0_vv")
    radar = P.load_radar_pair(px, T.grid(spark), N, N, 0, K.LAST, RC.RUN).withColumn("db", F.round("db", 6))
    return RC._shown(P.run_pair(T.grid(spark), RC._ends(RC._seen(spark, d)), radar, N, N, RC.RUN, limit=RC.CAP).regions)


_PAIR_SPANS = ("DATE '2024-01-01' AND DATE '2024-01-15'", "DATE '2024-01-16' AND DATE '2024-01-31'")


@query(f"""WITH {K._SCENES}, o AS (SELECT 'S2' AS sensor, k AS step, id, date, relative_orbit, row_number() OVER (PARTITION BY k ORDER BY cloud_cover, id) AS n FROM sc JOIN (VALUES (0),(1)) z(k) ON (k=0 AND date BETWEEN {_PAIR_SPANS[0]}) OR (k=1 AND date BETWEEN {_PAIR_SPANS[1]}) WHERE sensor='S2' AND cloud_cover<80),
b AS (SELECT *, row_number() OVER (PARTITION BY relative_orbit ORDER BY date DESC, id DESC) AS n FROM sc WHERE sensor='S1' AND orbit_state='descending' AND date BETWEEN {_PAIR_SPANS[0]}), a AS (SELECT *, row_number() OVER (PARTITION BY relative_orbit ORDER BY date DESC, id DESC) AS n FROM sc WHERE sensor='S1' AND orbit_state='descending' AND date BETWEEN {_PAIR_SPANS[1]}),
p AS (SELECT b.id AS b, a.id AS a, b.date AS bd, a.date AS ad, b.relative_orbit AS ro FROM b JOIN a ON a.relative_orbit=b.relative_orbit WHERE b.n=1 AND a.n=1 ORDER BY b.date DESC, b.id DESC LIMIT 1)
SELECT sensor, CAST(step AS INT) AS step, id, CAST(date AS VARCHAR) AS date, relative_orbit FROM o WHERE n=1 UNION ALL SELECT 'S1', 0, b, CAST(bd AS VARCHAR), ro FROM p UNION ALL SELECT 'S1', 1, a, CAST(ad AS VARCHAR), ro FROM p""")
def pair_run_scenes(spark, d):
    """The scenes of a pair run whose radar scenes share an orbit."""
    p = P.Params(match_orbit=True)
    found = P.pair_scenes(T.scenes(spark, d), ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31"), p)
    return found.select("sensor", "step", "id", F.col("date").cast("string").alias("date"), "relative_orbit")
