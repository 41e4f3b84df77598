"""Registered queries of whole runs, scene lists, boxes, texts and run tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E
from rasterflux.functions import grids as G
from rasterflux.operators import change as C
from rasterflux.operators import regions as R
from rasterflux.operators import scenes as S
from rasterflux.plans import catalogue as K
from rasterflux.plans import pipeline as P
from rasterflux.plans.catalogue import END, LAST, SIEVE, START, N, query
from rasterflux.plans.params import Params
from rasterflux.sources import tables as T
from rasterflux.storage import shared_dir

CAP = 60
RUN = Params(start=START, end=END, sieve=SIEVE)
#: The grid's place for geometry.
LEFT, TOP, RES, EPSG = 500_000.0, 1_000_000.0, 10.0, 32643
DAY = "2024-01-16"
BOX = (-60.0, -40.0, 60.0, 40.0)

# ---------------------------------------------------------------- SQL pieces
_CLASS = """CASE WHEN o AND ndwi>=0.15 AND s AND sar_db<=-3 THEN 'flooding|0.9' WHEN o AND ndwi>=0.15 THEN 'flooding|0.6'
 WHEN s AND NOT o AND sar_db<=-3 THEN 'flooding|0.7' WHEN o AND ndwi<=-0.15 THEN 'water_recession|0.7'
 WHEN o AND ndvi<=-0.15 THEN CASE WHEN NOT s THEN 'vegetation_loss|0.5' WHEN sar_db>=1.5 AND ndbi>=0.05 THEN 'construction|0.85' WHEN sar_db>=1.5 THEN 'construction|0.65' WHEN sar_db<=-1.5 THEN 'clearance|0.85' ELSE 'vegetation_loss|0.55' END
 WHEN o AND ndvi>=0.15 THEN 'vegetation_growth|0.75' WHEN elongation>=4 AND (ndbi>=0 OR sar_db>=1.5) THEN 'road_development|0.6'
 WHEN o AND ndbi>=0.1 THEN 'surface_change|0.55' WHEN s AND abs(sar_db)>=3 THEN 'structural_change|0.6' ELSE 'other|0.3' END"""
_GRID = f"g AS (SELECT CAST(i // {N} AS INT) AS r, CAST(i % {N} AS INT) AS c FROM range({N * N}) t(i))"
#: Optical pixels of which one in eleven was never imaged, and radar from its second window on.
_SEEN = f"""{K._PX}, e2 AS (SELECT * REPLACE (CASE WHEN (r*7+c)%11=0 THEN 0 ELSE scl END AS scl) FROM px WHERE sensor='S2'),
s2r AS (SELECT r,c,step,{K._NDVI} AS ndvi,{K._NDWI} AS ndwi,{K._NDBI} AS ndbi, scl IN (2,4,5,6,7) AS ok, scl=0 AS never FROM e2), {K._S1}"""
_PAIR = f"""{_SEEN}, {_GRID},
o AS (SELECT a.r,a.c,b.ndvi-a.ndvi AS ndvi,b.ndwi-a.ndwi AS ndwi,b.ndbi-a.ndbi AS ndbi,b.ndvi-a.ndvi AS d,(a.ok AND b.ok) AS ok,(a.never OR b.never) AS never FROM s2r a JOIN s2r b ON a.r=b.r AND a.c=b.c WHERE a.step=0 AND b.step=3),
s AS (SELECT a.r,a.c,b.db-a.db AS d,(a.db IS NOT NULL AND b.db IS NOT NULL) AS ok FROM s1 a JOIN s1 b ON a.r=b.r AND a.c=b.c WHERE a.step=0 AND b.step=3)"""
_FUSE = """f0 AS (SELECT g.r,g.c,o.d AS d2,ndvi,ndwi,ndbi,coalesce(o.ok,false) AS v2,coalesce(never,false) AS never,s.d AS d1,coalesce(s.ok,false) AS v1 FROM g LEFT JOIN o ON g.r=o.r AND g.c=o.c LEFT JOIN s ON g.r=s.r AND g.c=s.c),
f1 AS (SELECT *, v2 AND coalesce(abs(d2),0)>=0.2 AS c2, v1 AND coalesce(abs(d1),0)>=3 AS c1 FROM f0),
f2 AS (SELECT *, CASE WHEN c2 AND c1 THEN 'confirmed' WHEN c2 THEN 'optical' WHEN v2 AND c1 THEN 'sar_only' WHEN NOT v2 AND c1 THEN 'sar_gap' END AS tier FROM f1),
fused AS (SELECT *, CASE WHEN tier IS NULL THEN NULL WHEN (CASE WHEN tier IN ('confirmed','optical') THEN d2 ELSE d1 END)<0 THEN 'loss' ELSE 'gain' END AS direction FROM f2)"""
_PIECES = f"""m AS (SELECT tier||':'||direction AS k, r, c FROM fused WHERE tier IS NOT NULL), {K._reach("p4", "m", False)},
pc AS (SELECT * FROM p4 WHERE (k,label) IN (SELECT (k,label) FROM p4 GROUP BY k,label HAVING count(*)>={SIEVE})), m8 AS (SELECT k,r,c FROM pc), {K._reach("l8", "m8", True)}"""
_FEATURES = f"""reg AS (SELECT l8.k, l8.label, count(*) AS region_pixels, round(avg(coalesce(ndvi,0)),9) AS ndvi, round(avg(coalesce(ndwi,0)),9) AS ndwi, round(avg(coalesce(ndbi,0)),9) AS ndbi, round(avg(coalesce(d1,0)),9) AS sar_db,
 CAST(greatest(max(l8.r)-min(l8.r)+1, max(l8.c)-min(l8.c)+1) AS DOUBLE)/least(max(l8.r)-min(l8.r)+1, max(l8.c)-min(l8.c)+1) AS elongation, split_part(l8.k,':',1) AS tier, split_part(l8.k,':',2) AS direction FROM l8 JOIN fused ON l8.r=fused.r AND l8.c=fused.c GROUP BY l8.k, l8.label),
rk AS (SELECT *, rank() OVER (ORDER BY region_pixels DESC) AS q, tier IN ('confirmed','optical','sar_only') AS o, tier IN ('confirmed','sar_only','sar_gap') AS s FROM reg),
kt AS (SELECT *, {_CLASS} AS kind FROM rk WHERE q<={CAP}),
pp AS (SELECT l8.k, l8.label, pc.label AS piece, count(*) AS pixels FROM l8 JOIN pc ON l8.k=pc.k AND l8.r=pc.r AND l8.c=pc.c GROUP BY 1,2,3),
ft AS (SELECT kt.*, pp.piece, pp.pixels, round(pp.pixels*CAST(100.0 AS DOUBLE)/CAST(10000.0 AS DOUBLE),4) AS area_ha, split_part(kind,'|',1) AS change_type, CAST(split_part(kind,'|',2) AS DOUBLE) AS confidence,
 row_number() OVER (ORDER BY list_position(['confirmed','optical','sar_only','sar_gap'],tier), direction DESC, kt.label, pp.piece)-1 AS id FROM kt JOIN pp ON kt.k=pp.k AND kt.label=pp.label),
top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY area_ha DESC, id) AS place FROM ft) WHERE place<={CAP})"""
_USED = f"""{K._SCENES}, {K._WIN}, pl AS (SELECT *, row_number() OVER (PARTITION BY sensor,"window" ORDER BY CASE WHEN sensor='S2' THEN cloud_cover ELSE -date_diff('day',DATE '1970-01-01',date) END, CASE WHEN sensor='S2' THEN id ELSE -id END) AS k
 FROM sc JOIN w ON date BETWEEN window_start AND window_end WHERE (sensor='S2' AND cloud_cover<80) OR (sensor='S1' AND orbit_state='descending')),
best AS (SELECT sensor,"window" AS step,id,date,cloud_cover,relative_orbit FROM pl WHERE k=1)"""


def _dense(where: str) -> str:
    return f"us AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY step)-1 AS ordinal FROM best WHERE {where})"


def _persist(name: str, src: str, threshold: float) -> str:
    """CTEs from (r, c, t, d, valid) to the persistence of each pixel."""
    return f"""{name}0 AS (SELECT *, valid AND coalesce(abs(d),0)>={threshold} AS x FROM {src}),
{name}1 AS (SELECT *, coalesce(sum(valid::INT) OVER w,0) AS nv, CASE WHEN d>0 THEN coalesce(sum((x AND d>0)::INT) OVER w,0) ELSE coalesce(sum((x AND d<0)::INT) OVER w,0) END AS na FROM {name}0 WINDOW w AS (PARTITION BY r,c ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{name}2 AS (SELECT *, x AND nv>=1 AND na=nv AS conf, x AND nv=0 AS late FROM {name}1),
{name}3 AS (SELECT r,c,min(t) FILTER (WHERE conf OR late) AS ft, bool_or(x) AS ever, bool_or(valid) AS observed FROM {name}2 GROUP BY 1,2),
{name} AS (SELECT a.r,a.c,observed,ft IS NOT NULL AS changed,coalesce(b.conf,false) AS persistent,coalesce(b.late,false) AS latest,(ever AND ft IS NULL) AS transient,CAST(coalesce(ft,-1) AS INT) AS ci,CAST(coalesce(b.na,0) AS INT) AS n,coalesce(b.d,0.0) AS signed FROM {name}3 a LEFT JOIN {name}2 b ON a.r=b.r AND a.c=b.c AND a.ft=b.t)"""


#: Optical over windows 0 to 3, radar over 1 to 3: its ordinals are its own.
_SERIES = f"""{_SEEN}, {_GRID},
od AS (SELECT b.r,b.c,b.step-1 AS t,b.ndvi-a.ndvi AS d,b.ndwi-a.ndwi AS dw,b.ndbi-a.ndbi AS dn,(a.ok AND b.ok) AS valid FROM s2r a JOIN s2r b ON a.r=b.r AND a.c=b.c WHERE a.step=0 AND b.step>0), {_persist("oser", "od", 0.2)},
rd AS (SELECT b.r,b.c,b.step-2 AS t,b.db-a.db AS d,(a.db IS NOT NULL AND b.db IS NOT NULL) AS valid FROM s1 a JOIN s1 b ON a.r=b.r AND a.c=b.c WHERE a.step=1 AND b.step>1), {_persist("rser", "rd", 3)},
nv AS (SELECT r,c,bool_or(never) AS never FROM s2r GROUP BY 1,2),
o AS (SELECT u.r,u.c,u.signed AS d,observed AS ok,never,coalesce(od.d,0) AS ndvi,coalesce(dw,0) AS ndwi,coalesce(dn,0) AS ndbi FROM oser u LEFT JOIN od ON od.r=u.r AND od.c=u.c AND od.t=u.ci LEFT JOIN nv ON nv.r=u.r AND nv.c=u.c),
s AS (SELECT v.r,v.c,CASE WHEN u.ci>=0 THEN coalesce(rd.d,0) ELSE v.signed END AS d,v.observed AS ok FROM rser v LEFT JOIN oser u ON u.r=v.r AND u.c=v.c LEFT JOIN rd ON rd.r=v.r AND rd.c=v.c AND rd.t=least(u.ci,1))"""


def _modal(name: str, ser: str) -> str:
    return f"""{name}j AS (SELECT l8.k, l8.label, x.ci, x.n FROM l8 LEFT JOIN {ser} x ON x.r=l8.r AND x.c=l8.c),
{name}m AS (SELECT k, label, ci, row_number() OVER (PARTITION BY k, label ORDER BY count(*) DESC, ci) AS q FROM {name}j WHERE ci>=0 GROUP BY k, label, ci),
{name} AS (SELECT a.k, a.label, any_value(m.ci) AS ci, CAST(round_even(avg(coalesce(a.n,0)),0) AS INT) AS n FROM {name}j a LEFT JOIN {name}m m ON m.k=a.k AND m.label=a.label AND m.q=1 GROUP BY a.k, a.label)"""


_DATED = f"""{_modal("dto", "oser")}, {_modal("dtr", "rser")},
dt AS (SELECT top.*, coalesce(uo.date, ur.date) AS change_date, CASE WHEN uo.date IS NOT NULL THEN 'optical' WHEN ur.date IS NOT NULL THEN 'radar' END AS dated_by, CASE WHEN uo.date IS NOT NULL THEN dto.n WHEN ur.date IS NOT NULL THEN dtr.n END AS confirmed_by
 FROM top LEFT JOIN dto ON dto.k=top.k AND dto.label=top.label LEFT JOIN dtr ON dtr.k=top.k AND dtr.label=top.label LEFT JOIN us uo ON uo.sensor='S2' AND uo.ordinal=dto.ci+1 LEFT JOIN us ur ON ur.sensor='S1' AND ur.ordinal=dtr.ci+1)"""
_AFTER = """en AS (SELECT sensor, min_by(id,(date,id)) AS fi, min(date) AS fd, max_by(id,(date,id)) AS li, max(date) AS ld, min_by(relative_orbit,(date,id)) AS orbit FROM us GROUP BY 1),
pv AS (SELECT dt.id, e2.fi AS scene_before, e2.fd AS date_before, coalesce(a2.id,e2.li) AS scene_after, coalesce(a2.date,e2.ld) AS date_after, e1.fi AS sar_scene_before, e1.fd AS sar_date_before, coalesce(a1.id,e1.li) AS sar_scene_after, coalesce(a1.date,e1.ld) AS sar_date_after, e1.orbit AS relative_orbit
 FROM dt LEFT JOIN en e2 ON e2.sensor='S2' LEFT JOIN en e1 ON e1.sensor='S1' LEFT JOIN (SELECT sensor,date,min(id) AS id FROM us GROUP BY 1,2) a2 ON a2.sensor='S2' AND dt.dated_by='optical' AND a2.date=dt.change_date LEFT JOIN (SELECT sensor,date,min(id) AS id FROM us GROUP BY 1,2) a1 ON a1.sensor='S1' AND dt.dated_by='radar' AND a1.date=dt.change_date)"""
_STATS = f"""cv AS (SELECT round(avg(v2::INT)*100,1) AS s2_usable, round(avg(v1::INT)*100,1) AS s1_usable, round(avg((NOT v2 AND v1)::INT)*100,1) AS optical_gap, round(avg((NOT v2 AND v1 AND never)::INT)*100,1) AS never_imaged, round(avg((NOT v2 AND v1)::INT)*100-avg((NOT v2 AND v1 AND never)::INT)*100,1) AS cloud_gap, round(avg((NOT v2 AND NOT v1)::INT)*100,1) AS not_observed FROM fused),
ha AS (SELECT {", ".join(f"round(count(*) FILTER (WHERE split_part(k,':',1)='{t}')*CAST(100.0 AS DOUBLE)/CAST(10000.0 AS DOUBLE),2) AS {t}_ha" for t in E.TIERS)} FROM pc),
dr AS (SELECT (SELECT count(*) FROM rk WHERE q>{CAP})+greatest((SELECT count(*) FROM ft)-{CAP},0) AS dropped)"""
_PAIR_ALL = f"WITH RECURSIVE {_PAIR}, {_FUSE}, {_PIECES}, {_FEATURES}"
_SERIES_ALL = f"WITH RECURSIVE {_SERIES}, {_FUSE}, {_PIECES}, {_FEATURES}, {_USED}, {_dense('''sensor='S2' OR step>0''')}, {_DATED}"
_FIELDS = "id, tier, direction, label, piece, pixels, region_pixels, area_ha, round(elongation,6) AS elongation, change_type, confidence, CASE WHEN o THEN round(ndvi,3) END AS ndvi_delta, CASE WHEN o THEN round(ndwi,3) END AS ndwi_delta, CASE WHEN o THEN round(ndbi,3) END AS ndbi_delta, CASE WHEN s THEN round(sar_db,2) END AS sar_db_delta"
_COVER = "s2_usable, s1_usable, optical_gap, never_imaged, cloud_gap, not_observed"


# ---------------------------------------------------------------- shared plans
def _seen(spark: SparkSession, d: str) -> DataFrame:
    px = T.pixels(spark, d).where("sensor = 'S2'")
    scl = F.when((F.col("r") * 7 + F.col("c")) % 11 == 0, 0).otherwise(F.col("scl"))
    return P.load_optical(px.withColumn("scl", scl))


def _echo(spark: SparkSession, d: str) -> DataFrame:
    return K._radar(spark, d).withColumn("ok", F.col("db").isNotNull())


def _ends(df: DataFrame) -> DataFrame:
    return df.where(F.col("step").isin(0, LAST)).withColumn("step", (F.col("step") / LAST).cast("int"))


def _used(spark: SparkSession, d: str) -> DataFrame:
    return P.used_scenes(T.scenes(spark, d), K._windows(spark), RUN)


def _pair(spark: SparkSession, d: str) -> P.Run:
    return P.run_pair(T.grid(spark), _ends(_seen(spark, d)), _ends(_echo(spark, d)), N, N, RUN, limit=CAP)


def _series(spark: SparkSession, d: str) -> P.Run:
    used = _used(spark, d).where("sensor = 'S2' or step > 0")
    used = used.withColumn("ordinal", F.row_number().over(W.partitionBy("sensor").orderBy("step")) - 1)
    return P.run_series(T.grid(spark), _seen(spark, d), _echo(spark, d).where("step > 0"), N, N, RUN, used, CAP)


def _shown(features: DataFrame) -> DataFrame:
    kept = ("id", "tier", "direction", "label", "piece", "pixels", "region_pixels", "area_ha")
    return features.select(*kept, F.round("elongation", 6).alias("elongation"), "change_type", "confidence", "ndvi_delta", "ndwi_delta", "ndbi_delta", "sar_db_delta")


def _flat(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.col("hectares")[t].alias(f"{t}_ha") for t in E.TIERS], F.size("warnings").cast("long").alias("n_warnings")).drop("hectares", "warnings")


_WARN = "((not_observed>10)::INT+(optical_gap>20)::INT+(dropped>0)::INT)::BIGINT AS n_warnings"


# ---------------------------------------------------------------- runs
@query(f"WITH RECURSIVE {_PAIR}, {_FUSE} SELECT round(avg(v2::INT)*100,1) AS s2_usable, round(avg(v1::INT)*100,1) AS s1_usable, round(avg((NOT v2 AND v1)::INT)*100,1) AS optical_gap, round(avg((NOT v2 AND v1 AND never)::INT)*100,1) AS never_imaged, round(avg((NOT v2 AND v1)::INT)*100-avg((NOT v2 AND v1 AND never)::INT)*100,1) AS cloud_gap, round(avg((NOT v2 AND NOT v1)::INT)*100,1) AS not_observed FROM fused")
def coverage_stats(spark, d):
    o = C.pair_diff(_ends(_seen(spark, d)), {"diff": F.col("ndvi")}, F.col("ok"), 0, 1, F.col("never"))
    s = C.pair_diff(_ends(_echo(spark, d)), {"diff": F.col("db")}, F.col("ok"), 0, 1)
    return C.coverage(C.fuse(T.grid(spark), o, s), F.coalesce("never", F.lit(False)))


@query(f"{_PAIR_ALL} SELECT {_FIELDS} FROM top")
def run_pair_features(spark, d):
    return _shown(_pair(spark, d).regions)


@query(f"{_PAIR_ALL}, {_STATS} SELECT {_COVER}, confirmed_ha, optical_ha, sar_only_ha, sar_gap_ha, dropped, {_WARN} FROM cv, ha, dr")
def run_pair_stats(spark, d):
    return _flat(_pair(spark, d).stats)


@query(f"{_SERIES_ALL} SELECT {_FIELDS}, CAST(change_date AS VARCHAR) AS change_date, dated_by, confirmed_by, CASE WHEN confirmed_by>0 THEN 'confirmed' WHEN confirmed_by IS NOT NULL THEN 'unconfirmed (latest observation)' END AS persistence FROM dt")
def run_series_features(spark, d):
    f = _series(spark, d).regions
    return K._texts(_shown(f).join(f.select("id", "change_date", "dated_by", "confirmed_by", "persistence"), "id"))


@query(f"{_SERIES_ALL}, {_STATS} SELECT {_COVER}, confirmed_ha, optical_ha, sar_only_ha, sar_gap_ha, dropped, {_WARN}, changed, persistent, latest, transient, round(transient*CAST(100.0 AS DOUBLE)/CAST(10000.0 AS DOUBLE),2) AS transient_ha FROM cv, ha, dr, (SELECT count_if(changed) AS changed, count_if(persistent) AS persistent, count_if(latest) AS latest, count_if(transient) AS transient FROM oser)")
def run_series_stats(spark, d):
    return _flat(_series(spark, d).stats)


@query(f"{_SERIES_ALL}, {_AFTER} SELECT id, scene_before, CAST(date_before AS VARCHAR) AS date_before, scene_after, CAST(date_after AS VARCHAR) AS date_after, sar_scene_before, CAST(sar_date_before AS VARCHAR) AS sar_date_before, sar_scene_after, CAST(sar_date_after AS VARCHAR) AS sar_date_after, relative_orbit FROM pv")
def provenance(spark, d):
    f = _series(spark, d).regions
    names = [f"{p}{k}_{e}" for p in ("", "sar_") for k in ("scene", "date") for e in ("before", "after")]
    return K._texts(f.select("id", *names, "relative_orbit"))


_READ = "printf('NDVI %+.2f, NDWI %+.2f, NDBI %+.2f', ndvi, ndwi, ndbi)"
_WHY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.REASONS.items()) + " END"
_NAME = "CASE change_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.LABELS.items()) + " END"


@query(f"{_PAIR_ALL} SELECT id, {_NAME} AS change_label, concat_ws('; ', CASE WHEN o THEN {_READ} END, CASE WHEN s THEN printf('SAR %+.1f dB', sar_db) END, {_WHY}) AS evidence FROM top")
def region_evidence(spark, d):
    return _pair(spark, d).regions.select("id", "change_label", "evidence")


@query(f"{_SERIES_ALL} SELECT id, CAST(change_date AS VARCHAR) AS change_date FROM dt WHERE change_date IS NULL OR change_date<=DATE '{DAY}'")
def regions_until(spark, d):
    return K._texts(P.until(_series(spark, d).regions, F.lit(DAY).cast("date")).select("id", "change_date"))


@query(f"{_SERIES_ALL}, sd AS (SELECT sensor, list(date ORDER BY date) AS dates FROM us GROUP BY 1), st AS (SELECT dt.id, dt.confirmed_by, sd.dates, list_position(sd.dates, dt.change_date)-1 AS k FROM dt JOIN sd ON sd.sensor=CASE WHEN dated_by='radar' THEN 'S1' ELSE 'S2' END WHERE change_date IS NOT NULL), i AS (SELECT *, unnest(range(0,len(dates))) AS i FROM st WHERE k>=1) SELECT id, CAST(i AS INT) AS i, CAST(dates[i+1] AS VARCHAR) AS date, i BETWEEN k AND k+confirmed_by AS held FROM i")
def persistence_strip(spark, d):
    used = _used(spark, d).where("sensor = 'S2' or step > 0")
    dates = used.groupBy("sensor").agg(F.sort_array(F.collect_list("date")).alias("dates"))
    sensor = F.when(F.col("dated_by") == "radar", "S1").otherwise("S2")
    f = _series(spark, d).regions.where("change_date is not null").withColumn("sensor", sensor).join(F.broadcast(dates), "sensor")
    return K._texts(S.persistence_strip(f.select("id", "dates", "change_date", "confirmed_by")).select("id", "i", "date", "held"))


@query(f"WITH RECURSIVE {_PAIR}, {_FUSE}, {_PIECES} SELECT split_part(k,':',1) AS tier, split_part(k,':',2) AS direction, r, c FROM pc")
def sieved_tiers(spark, d):
    f = _pair(spark, d)
    return f.pieces.select("tier", "direction", "r", "c")


@query(f"{_PAIR_ALL}, {_STATS} SELECT tier, ha FROM (UNPIVOT ha ON confirmed_ha, optical_ha, sar_only_ha, sar_gap_ha INTO NAME tier VALUE ha) WHERE ha>0")
def tier_rows(spark, d):
    stats = _pair(spark, d).stats.select(F.explode("hectares").alias("name", "ha"))
    return stats.where("ha > 0").select(F.concat("name", F.lit("_ha")).alias("tier"), "ha")


@query(f"WITH RECURSIVE {_PAIR.replace('o AS (SELECT', 'oo AS (SELECT')}, o AS (SELECT * FROM oo WHERE false), {_FUSE}, {_PIECES}, {_FEATURES} SELECT {_FIELDS} FROM top")
def radar_only_run(spark, d):
    return _shown(P.run_pair(T.grid(spark), None, _ends(_echo(spark, d)), N, N, RUN, limit=CAP).regions)


@query(f"WITH RECURSIVE {_SERIES} SELECT r, c, round(d,6) AS d1, ok AS v1 FROM s")
def radar_at_optical_date(spark, d):
    return _series(spark, d).pixels.where("d1 is not null").select("r", "c", F.round("d1", 6).alias("d1"), "v1")


@query(f"WITH {_SEEN}, b AS (SELECT r,c,min(step) AS z FROM s1 WHERE step>0 GROUP BY 1,2), x AS (SELECT * FROM s1 WHERE step>0) SELECT y.r, y.c, y.step, CAST(y.step-2 AS INT) AS t, round(y.db-a.db,6) AS diff, (a.db IS NOT NULL AND y.db IS NOT NULL) AS valid FROM x y JOIN x a ON a.r=y.r AND a.c=y.c WHERE a.step=1 AND y.step>1")
def series_gaps(spark, d):
    """A series whose first window has no scene: the baseline is the first date that there is."""
    out = C.baseline_diff(_echo(spark, d).where("step > 0"), "db", "ok")
    return out.select("r", "c", "step", "t", F.round("diff", 6).alias("diff"), "valid")


@query(f"WITH {_SERIES} SELECT r, c, changed, observed FROM oser")
def changed_pixels(spark, d):
    out = C.persistence(C.baseline_diff(_seen(spark, d), "ndvi", "ok"), E.OPTICAL_THRESHOLD)
    return out.select("r", "c", "changed", "observed")


@query(f"WITH {_USED} SELECT sensor, count(*) AS dates, count(*)>=2 AS usable FROM best GROUP BY 1")
def usable_dates(spark, d):
    return S.usable_dates(_used(spark, d))


@query(f"""WITH {K._PX}, v AS (SELECT r,c,step, CASE WHEN r%7=0 THEN NULL ELSE nir END AS nir, CASE WHEN c%5=0 THEN NULL ELSE red END AS red, green FROM px WHERE sensor='S2' AND step=0),
i AS (SELECT r,c,CASE WHEN nir+red=0 THEN 0 ELSE (nir-red)/(nir+red) END AS ndvi, CASE WHEN (r+c)%3=0 THEN NULL ELSE green END AS green FROM v), q AS (SELECT quantile_cont(green,0.02) AS lo, quantile_cont(green,0.98) AS hi FROM i WHERE green>0)
SELECT r,c,round(ndvi,6) AS ndvi, CASE WHEN coalesce(abs(ndvi),0)>=0.2 THEN 'optical' END AS tier, CASE WHEN coalesce(ndvi,0)<=-0.2 THEN 'loss' WHEN coalesce(ndvi,0)>=0.2 THEN 'gain' END AS direction,
 CAST(coalesce(floor(greatest(0,least(1,(green-lo)/(CASE WHEN hi<=lo THEN 1 ELSE hi-lo END)))*255),0) AS INT) AS level FROM i, q""")
def nan_validity(spark, d):
    """NaN and infinity are absent measurements in indices, tiers, directions and stretches."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    px = T.pixels(spark, d).where("sensor = 'S2' and step = 0")
    px = px.withColumns({"nir": F.when(F.col("r") % 7 == 0, nan).otherwise(F.col("nir")), "red": F.when(F.col("c") % 5 == 0, inf).otherwise(F.col("red"))})
    px = px.withColumns({"green": F.when((F.col("r") + F.col("c")) % 3 == 0, nan).otherwise(F.col("green")), "ndvi": E.norm_diff("nir", "red")})
    px = px.withColumn("raw", F.coalesce("ndvi", nan))
    out = C.stretch(px, "green").withColumns({"tier": E.tier("raw", F.lit(True), nan, F.lit(True)), "direction": E.direction("raw", F.lit(True), 0.2)})
    return out.select("r", "c", F.round("ndvi", 6).alias("ndvi"), "tier", "direction", "level")


# ---------------------------------------------------------------- single index and flights
_DETECT = f"""{K._BASE}, m AS (SELECT CASE WHEN d2<=-0.2 THEN 'loss' ELSE 'gain' END AS k, r, c FROM f0 WHERE v2 AND abs(d2)>=0.2), {K._reach("p4", "m", False)},
pc AS (SELECT * FROM p4 WHERE (k,label) IN (SELECT (k,label) FROM p4 GROUP BY k,label HAVING count(*)>={SIEVE})), m8 AS (SELECT k,r,c FROM pc), {K._reach("l8", "m8", True)},
rk AS (SELECT k, label, rank() OVER (ORDER BY count(*) DESC) AS q FROM l8 GROUP BY 1,2),
ft AS (SELECT l8.k AS direction, l8.label, pc.label AS piece, count(*) AS pixels FROM l8 JOIN pc ON l8.k=pc.k AND l8.r=pc.r AND l8.c=pc.c JOIN rk ON rk.k=l8.k AND rk.label=l8.label WHERE q<={CAP} GROUP BY 1,2,3),
nm AS (SELECT *, row_number() OVER (ORDER BY direction DESC, label, piece)-1 AS id FROM ft), top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pixels DESC, id) AS place FROM nm) WHERE place<={CAP})"""


def _detect(spark, d):
    f = K._fused(spark, d).select("r", "c", F.col("d2").alias("diff"), F.col("v2").alias("valid"))
    return P.detect(f, N, N, 0.2, SIEVE, limit=CAP)


@query(f"{_DETECT} SELECT id, direction, label, piece, pixels, pixels*CAST(100.0 AS DOUBLE)/CAST(10000.0 AS DOUBLE) AS area_ha FROM top")
def detect_features(spark, d):
    return _detect(spark, d).regions.select("id", "direction", "label", "piece", "pixels", "area_ha")


@query(f"""{_DETECT}, x AS (SELECT (SELECT avg(v2::INT) FROM f0) AS clear_fraction, (SELECT count(*) FROM pc WHERE k='loss')*CAST(0.01 AS DOUBLE) AS loss_ha, (SELECT count(*) FROM pc WHERE k='gain')*CAST(0.01 AS DOUBLE) AS gain_ha, (SELECT count(*) FROM rk WHERE q>{CAP})+greatest((SELECT count(*) FROM nm)-{CAP},0) AS dropped)
SELECT round(clear_fraction,6) AS clear_fraction, round(loss_ha,2) AS loss_ha, round(gain_ha,2) AS gain_ha, round(loss_ha+gain_ha,2) AS total_ha, dropped, ((dropped>0)::INT+(clear_fraction<0.5)::INT+(CASE WHEN loss_ha+gain_ha=0 THEN false ELSE least(loss_ha,gain_ha)/(loss_ha+gain_ha)>0.4 END)::INT)::BIGINT AS n_warnings FROM x""")
def detect_stats(spark, d):
    r = lambda c, n: F.round(c, n).alias(c)
    return _detect(spark, d).stats.select(r("clear_fraction", 6), r("loss_ha", 2), r("gain_ha", 2), r("total_ha", 2), "dropped", F.size("warnings").cast("long").alias("n_warnings"))


@query(f"""WITH RECURSIVE {K._PX}, a AS (SELECT r,c,CASE WHEN nir+red=0 THEN 0 ELSE (nir-red)/(nir+red) END AS v FROM px WHERE sensor='S2' AND step=0), b AS (SELECT (r+1)%{N} AS r,(c+{N}-2)%{N} AS c,CASE WHEN nir+red=0 THEN 0 ELSE (nir-red)/(nir+red) END AS v FROM px WHERE sensor='S2' AND step=3),
m AS (SELECT CASE WHEN b.v-a.v<=-0.2 THEN 'loss' ELSE 'gain' END AS k, a.r, a.c FROM a JOIN b ON a.r=b.r AND a.c=b.c WHERE abs(b.v-a.v)>=0.2), {K._reach("p4", "m", False)},
pc AS (SELECT k, label, count(*) AS pixels FROM p4 GROUP BY 1,2 HAVING count(*)>={SIEVE}) SELECT k AS direction, label AS piece, pixels, pixels*CAST(0.0025 AS DOUBLE)/CAST(10000.0 AS DOUBLE) AS area_ha FROM pc""")
def flight_regions(spark, d):
    px = T.pixels(spark, d).where("sensor = 'S2'")
    fly = lambda k: px.where(F.col("step") == k).select("r", "c", F.col("red").alias("b1"), F.col("green").alias("b2"), F.col("swir16").alias("b3"), F.col("nir").alias("b4"))
    run = P.compare_flights(fly(0), fly(LAST), True, N, N, 0.2, SIEVE, 0.05, (1, -2))
    return run.regions.select("direction", "piece", "pixels", "area_ha")


@query("""SELECT p_partkey AS flight, CASE WHEN p_partkey%5=0 THEN 'no coordinate reference system' WHEN p_size%5+1<3 THEN 'fewer than 3 bands' END AS error, CASE WHEN p_size%5+1>3 THEN 'ndvi' ELSE 'vari' END AS index, CASE WHEN p_size%5+1<=3 THEN 'no near-infrared band: VARI is used instead of NDVI' END AS note FROM part""")
def flight_inspection(spark, d):
    k = F.col("p_partkey")
    meta = T.table(spark, d, "part").select(k.alias("flight"), F.when(k % 5 != 0, "EPSG:32643").alias("crs"), (F.col("p_size") % 5 + 1).alias("bands"))
    return T.inspect_flights(meta).select("flight", "error", "index", "note")


@query("""WITH a AS (SELECT min(n_nationkey)*1.0::DOUBLE AS l, min(n_nationkey)*2.0::DOUBLE AS b, max(n_nationkey)*10.0::DOUBLE AS r, max(n_nationkey)*12.0::DOUBLE AS t FROM nation), x AS (SELECT greatest(l,l+7.5::DOUBLE) AS "left", greatest(b,b+3.25::DOUBLE) AS bottom, least(r,r+9) AS "right", least(t,t-4) AS top, 0.25::DOUBLE AS res FROM a)
SELECT *, CAST(trunc(("right"-"left")/res) AS INT) AS width, CAST(trunc((top-bottom)/res) AS INT) AS height FROM x""")
def drone_common_grid(spark, d):
    k = T.table(spark, d, "nation")
    a = k.agg(F.min(F.col("n_nationkey") * 1.0).alias("left"), F.min(F.col("n_nationkey") * 2.0).alias("bottom"), F.max(F.col("n_nationkey") * 10.0).alias("right"), F.max(F.col("n_nationkey") * 12.0).alias("top"), F.lit(0.5).alias("res"))
    b = a.select((F.col("left") + 7.5).alias("left"), (F.col("bottom") + 3.25).alias("bottom"), (F.col("right") + 9).alias("right"), (F.col("top") - 4).alias("top"), F.lit(0.25).alias("res"))
    return G.common_grid(a, b)


@query()
def sieve_merge(spark, d):
    dense = T.grid(spark).join(K._loss(spark, d).withColumn("on", F.lit(1)), ["r", "c"], "left").select("r", "c", F.coalesce("on", F.lit(0)).alias("on"))
    return R.sieve_merge(dense, SIEVE, N, N)


# ---------------------------------------------------------------- geometry
_LAB = f"{K._BASE}, {K._LOSS}, {K._reach('lab', 'm', False)}"


@query(f"{_LAB}, sd AS (SELECT label, r, c, dr, dc FROM lab, (VALUES (-1,0),(0,1),(1,0),(0,-1)) v(dr,dc)), e AS (SELECT sd.label FROM sd LEFT JOIN lab o ON o.label=sd.label AND o.r=sd.r+dr AND o.c=sd.c+dc WHERE o.label IS NULL) SELECT p.label, p.pixels, e.perimeter, CAST(p.pixels AS DOUBLE) AS ring_area FROM (SELECT label, count(*) AS pixels FROM lab GROUP BY 1) p JOIN (SELECT label, count(*) AS perimeter FROM e GROUP BY 1) e ON e.label=p.label")
def rings(spark, d):
    """Rings of the loss pieces: holes run the other way, so the signed areas add up to the pixels, and the sides to the perimeter."""
    r = R.rings(R.components(K._loss(spark, d), N, N, eight=False), [])
    steps = lambda ring: F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    area = F.aggregate(F.flatten(F.transform("rings", steps)), F.lit(0.0), lambda acc, s: acc + (s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1]) / 2.0)
    length = F.aggregate(F.flatten(F.transform("rings", steps)), F.lit(0).cast("long"), lambda acc, s: acc + F.abs(s["a"][0] - s["b"][0]) + F.abs(s["a"][1] - s["b"][1]))
    return r.select("label", "pixels", length.alias("perimeter"), F.abs(area).alias("ring_area"))


@query(f"{_LAB} SELECT label, CAST(min(c) AS DOUBLE) AS west, CAST(min(r) AS DOUBLE) AS south, CAST(max(c)+1 AS DOUBLE) AS east, CAST(max(r)+1 AS DOUBLE) AS north FROM lab GROUP BY 1")
def feature_bounds(spark, d):
    r = R.rings(R.components(K._loss(spark, d), N, N, eight=False), [])
    return r.select("label", G.ring_bounds(F.col("rings").cast("array<array<array<double>>>")).alias("b")).select("label", "b.*")


@query(f"{_LAB} SELECT label, count(*) AS pixels, 'Feature' AS kind, 'Polygon' AS geometry, count(*)*CAST(0.01 AS DOUBLE) AS area_ha FROM lab GROUP BY 1")
def geojson_export(spark, d):
    """Features of the loss pieces with rings in WGS84, read back from their GeoJSON."""
    r = R.rings(R.components(K._loss(spark, d), N, N, eight=False), [])
    whole = R.in_degrees(r, ["label"], LEFT, TOP, RES, EPSG).withColumn("area_ha", E.hectares("pixels"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("coordinates"))
    text = whole.select(R.to_feature(["label", "pixels", "area_ha"], geometry).alias("j"))
    got = F.from_json("j", "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<label: long, pixels: long, area_ha: double>")
    return text.select(got.alias("f")).select("f.properties.label", "f.properties.pixels", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("geometry"), F.round("f.properties.area_ha", 2).alias("area_ha"))


def _sql_utm(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """The projection's series as SQL text."""
    k = 2 * E._N**0.5 / (1 + E._N)
    num = lambda x: f"CAST({x!r} AS DOUBLE)"
    t = f"sinh(atanh(sin(radians({lat})))-{num(k)}*atanh({num(k)}*sin(radians({lat}))))"
    lam = f"(radians({lon})-radians(({zone}%100)*6-183))"
    xi, eta = f"atan2({t},cos({lam}))", f"atanh(sin({lam})/sqrt(1+{t}*{t}))"
    x = eta + "".join(f"+{num(a)}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, a in enumerate(E._ALPHA, 1))
    y = xi + "".join(f"+{num(a)}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, a in enumerate(E._ALPHA, 1))
    return f"500000+{num(E._K0 * E._RADIUS)}*({x})", f"(CASE WHEN {zone}>=32700 THEN 10000000 ELSE 0 END)+{num(E._K0 * E._RADIUS)}*({y})"


_X, _Y = _sql_utm("lon", "lat", "epsg")
_ZONE = "CAST(floor(((west+east)/2+180)/6)+1 AS INT)+(CASE WHEN (south+north)/2>=0 THEN 32600 ELSE 32700 END)"


@query(f"""WITH {K._GAZ}, z AS (SELECT *, {_ZONE} AS epsg FROM aw), t AS (SELECT z.*, k/21.0::DOUBLE AS t FROM z, range(22) r(k)),
p AS (SELECT place_id, epsg, unnest([west+(east-west)*t, west+(east-west)*t, west, east]) AS lon, unnest([south, north, south+(north-south)*t, south+(north-south)*t]) AS lat FROM t), q AS (SELECT place_id, epsg, {_X} AS x, {_Y} AS y FROM p),
b AS (SELECT place_id, epsg, floor(min(x)/10)*10 AS "left", floor(min(y)/10)*10 AS bottom, ceil(max(x)/10)*10 AS "right", ceil(max(y)/10)*10 AS top FROM q GROUP BY 1,2) SELECT *, CAST(("right"-"left")/10 AS BIGINT) AS width, CAST((top-bottom)/10 AS BIGINT) AS height FROM b""")
def utm_grids(spark, d):
    """Analysis grids of the places: projected bounds snapped outward to 10 m, and the size."""
    area = E.aoi("lat", "lon", "west", "south", "east", "north").alias("a")
    boxes = T.gazetteer(spark, d).select("place_id", area).select("place_id", "a.west", "a.south", "a.east", "a.north")
    return G.target_grid(boxes, "place_id")


@query(f"WITH {K._GAZ} SELECT place_id, round(lon,6) AS lon, round(lat,6) AS lat FROM gz")
def utm_roundtrip(spark, d):
    """Projected and back: the same degrees."""
    g = T.gazetteer(spark, d).withColumn("epsg", E.utm_epsg("lon", "lat"))
    x, y = E.utm_forward("lon", "lat", "epsg")
    lon, lat = E.utm_inverse("x", "y", "epsg")
    g = g.withColumns({"x": x, "y": y}).select("place_id", lon.alias("lon"), lat.alias("lat"))
    return g.select("place_id", (F.round("lon", 6) + 0.0).alias("lon"), (F.round("lat", 6) + 0.0).alias("lat"))


_AW = "struct_pack(west:=west,south:=south,east:=east,north:=north)"


def _areas(spark, d):
    area = E.aoi("lat", "lon", "west", "south", "east", "north").alias("a")
    return T.gazetteer(spark, d).select("place_id", area).select("place_id", "a.west", "a.south", "a.east", "a.north")


@query(f"WITH {K._GAZ}, s AS (SELECT *, 1024/greatest(east-west,north-south) AS k FROM aw) SELECT place_id, greatest(1,CAST(round_even((east-west)*k,0) AS INT)) AS width, greatest(1,CAST(round_even((north-south)*k,0) AS INT)) AS height FROM s")
def chip_sizes(spark, d):
    w, h = G.chip_size(F.col("west"), F.col("south"), F.col("east"), F.col("north"), 1024)
    return _areas(spark, d).select("place_id", w.alias("width"), h.alias("height"))


@query(f"WITH {K._GAZ} SELECT place_id, printf('%.1f', (east-west)*111)||' x '||printf('%.1f', (north-south)*111)||' km' AS label, round((west+east)/2-greatest(0.0101,0.8*(east-west),0.8*(north-south)),6) AS west, round((south+north)/2+greatest(0.0101,0.8*(east-west),0.8*(north-south)),6) AS north FROM aw")
def box_labels(spark, d):
    b = F.struct("west", "south", "east", "north")
    crop = G.crop_box(b)
    return _areas(spark, d).select("place_id", G.size_label(b).alias("label"), F.round(crop["west"], 6).alias("west"), F.round(crop["north"], 6).alias("north"))


@query(f"""{_LAB}, bx AS (SELECT label, min(c)/{N}.0::DOUBLE*1024 AS x0, (max(c)+1)/{N}.0::DOUBLE*1024 AS x1, min(r)/{N}.0::DOUBLE*1024 AS y0, (max(r)+1)/{N}.0::DOUBLE*1024 AS y1 FROM lab GROUP BY 1), hf AS (SELECT *, greatest(2*(x1-x0),2*(y1-y0),224)/2 AS h FROM bx),
cr AS (SELECT *, CAST(floor(greatest(0,least((x0+x1)/2-h,1023))) AS INT) AS l, CAST(floor(greatest(0,least((y0+y1)/2-h,1023))) AS INT) AS t FROM hf) SELECT label, l AS x0, t AS y0, CAST(floor(least(1024,greatest(l+1,(x0+x1)/2+h))) AS INT) AS x1, CAST(floor(least(1024,greatest(t+1,(y0+y1)/2+h))) AS INT) AS y1 FROM cr""")
def context_crops(spark, d):
    lab = R.components(K._loss(spark, d), N, N, eight=False)
    box = lab.groupBy("label").agg(F.min("c").alias("west"), (N - F.max("r") - 1).alias("south"), (F.max("c") + 1).alias("east"), (N - F.min("r")).alias("north"))
    frame = F.struct(F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(float(N)).alias("east"), F.lit(float(N)).alias("north"))
    return box.select("label", G.context_crop(F.struct("west", "south", "east", "north"), frame, 1024, 1024).alias("w")).select("label", "w.*")


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey%5 WHEN 0 THEN '10.5,20,11,21' WHEN 1 THEN c_custkey%400||',1,'||(c_custkey%400+1)||',2' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'a,b,c,d' ELSE '5,1,4,2' END AS raw FROM customer), b AS (SELECT *, list_transform(string_split(raw,','), lambda x: try_cast(x AS DOUBLE)) AS b FROM t)
SELECT c_custkey, raw, len(b)=4 AND list_count(b)=4 AND coalesce(b[1]>=-180 AND b[3]<=180 AND b[2]>=-90 AND b[4]<=90 AND b[1]<b[3] AND b[2]<b[4],false) AS sound FROM b""")
def bbox_parse(spark, d):
    k = F.col("c_custkey")
    moved = F.concat((k % 400).cast("string"), F.lit(",1,"), (k % 400 + 1).cast("string"), F.lit(",2"))
    raw = F.when(k % 5 == 0, "10.5,20,11,21").when(k % 5 == 1, moved).when(k % 5 == 2, "1,2,3").when(k % 5 == 3, "a,b,c,d").otherwise("5,1,4,2")
    return T.table(spark, d, "customer").select("c_custkey", raw.alias("raw"), E.parse_bbox(raw).isNotNull().alias("sound"))


@query(f"WITH {K._PX}, b AS (SELECT r,c,red,green,nir AS blue FROM px WHERE sensor='S2' AND step=0), " + ", ".join(f"q{k} AS (SELECT quantile_cont({k},0.02) AS lo, quantile_cont({k},0.98) AS hi FROM b WHERE {k}>0)" for k in ("red", "green", "blue")) + " SELECT r,c," + ",".join(f"CAST(coalesce(floor(greatest(0,least(1,({k}-q{k}.lo)/(CASE WHEN q{k}.hi<=q{k}.lo THEN 1 ELSE q{k}.hi-q{k}.lo END)))*255),0) AS INT) AS {k}" for k in ("red", "green", "blue")) + " FROM b,qred,qgreen,qblue")
def true_colour(spark, d):
    band = T.pixels(spark, d).where("sensor = 'S2' and step = 0").select("r", "c", "red", "green", F.col("nir").alias("blue"))
    return C.true_colour(band)


# ---------------------------------------------------------------- scenes
_W, _S, _E, _N = BOX
_MEETS = f"west<={_E} AND east>={_W} AND south<={_N} AND north>={_S}"


@query(f"WITH {K._SCENES} SELECT id, cloud_cover FROM (SELECT * FROM sc WHERE sensor='S2' AND date BETWEEN DATE '{START}' AND DATE '{END}' AND cloud_cover<80 AND {_MEETS} ORDER BY cloud_cover,id LIMIT 50)")
def scene_search_box(spark, d):
    return S.search(T.scenes(spark, d), "S2", START, END, box=BOX).select("id", "cloud_cover")


@query(f"WITH {K._SCENES} SELECT * FROM (SELECT sensor,id,CAST(date AS VARCHAR) AS date FROM sc WHERE sensor='S2' AND date BETWEEN DATE '{START}' AND DATE '{END}' AND cloud_cover<80 AND {_MEETS} ORDER BY cloud_cover,id LIMIT 50) UNION ALL SELECT * FROM (SELECT sensor,id,CAST(date AS VARCHAR) AS date FROM sc WHERE sensor='S1' AND date BETWEEN DATE '{START}' AND DATE '{END}' AND {_MEETS} ORDER BY sc.date DESC,id DESC LIMIT 50)")
def scene_listing(spark, d):
    sc = T.scenes(spark, d)
    return K._texts(S.listing(sc, sc, START, END, BOX)[0].select("sensor", "id", "date"))


@query(f"WITH {K._SCENES} SELECT id, sensor, CAST(date AS VARCHAR) AS date FROM sc WHERE id=77")
def scene_by_id(spark, d):
    return K._texts(S.scene_by_id(T.scenes(spark, d), "77").select("id", "sensor", "date"))


@query(f"WITH {K._SCENES} SELECT 'S2' AS sensor, CAST(id AS VARCHAR) AS id, CAST(date AS VARCHAR) AS date, round(coalesce(cloud_cover,0),1) AS cloud_cover FROM sc")
def scene_descriptors(spark, d):
    """Catalogue items read from JSON and flattened."""
    e = T.scenes(spark, d)
    props = F.struct(F.concat(F.col("date").cast("string"), F.lit("T10:00:00Z")).alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"))
    text = e.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), props.alias("properties"))).alias("j"))
    items = text.select(F.from_json("j", T.STAC_ITEM).alias("i")).select("i.*")
    return K._texts(T.describe_scenes(items, "S2"))


@query(f"WITH {_USED} SELECT step, CAST(date AS VARCHAR) AS date, sensor, id FROM best")
def run_timeline(spark, d):
    return K._texts(P.timeline(_used(spark, d)))


@query(f"WITH {_USED} SELECT DISTINCT step FROM best")
def timeline_steps(spark, d):
    return S.steps_of(_used(spark, d))


@query(f"WITH {_USED} SELECT CASE WHEN count_if(sensor='S2')>=2 THEN min_by(id,(date,sensor,id)) FILTER (WHERE sensor='S2') ELSE min_by(id,(date,sensor,id)) END AS before, CASE WHEN count_if(sensor='S2')>=2 THEN max_by(id,(date,sensor,id)) FILTER (WHERE sensor='S2') ELSE max_by(id,(date,sensor,id)) END AS after FROM best")
def compare_defaults(spark, d):
    used = _used(spark, d)
    return S.compare_defaults(S.compare_stops(used, used.limit(0)))


@query(f"""WITH {K._TEXT}, {K._SPLIT}, {K._GAZ} SELECT rq.request_id, place_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY n_regionkey DESC, place_id) AS INT) AS rank FROM rq JOIN gz ON lower(trim(rq."where"))=lower(trim(gz.name)) JOIN nation ON n_nationkey=place_id WHERE place_id%7<>0""")
def geocode_candidates(spark, d):
    """Places whose boxes are malformed, here every seventh, are no candidates."""
    what, where = E.split_request("text")
    asked = K._requests(spark, d).select("request_id", what.alias("what"), where.alias("where"))
    g = T.gazetteer(spark, d)
    g = g.withColumn("east", F.when(F.col("place_id") % 7 == 0, F.col("west") - 1).otherwise(F.col("east")))
    return S.geocode(asked, g).select("request_id", "place_id", "rank")


# ---------------------------------------------------------------- ranking, texts, runs
@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id=0), s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, q.e), lambda x: CAST(x[1] AS DOUBLE)*CAST(x[2] AS DOUBLE))) AS score FROM embeddings, q), m AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS k FROM s)
SELECT vec_id AS feature_index, label, CASE WHEN k<=12 THEN k END AS match_rank, CASE WHEN k<=12 THEN round(score,4) END AS match_score FROM m""")
def match_marks(spark, d):
    v = T.table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return S.mark_matches(v.select(F.col("vec_id").alias("feature_index"), "label"), S.rank_by_vector(v, q, 12))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id=0), s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, q.e), lambda x: CAST(x[1] AS DOUBLE)*CAST(x[2] AS DOUBLE))) AS score FROM embeddings, q) SELECT vec_id AS feature_index, label, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM s ORDER BY rank LIMIT 12""")
def match_properties(spark, d):
    v = T.table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return S.match_properties(S.rank_by_vector(v, q, 12), v.select(F.col("vec_id").alias("feature_index"), "label")).select("feature_index", "label", "rank")


@query("""SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 'The '||p_name WHEN p_partkey%3=1 THEN 'a satellite image of '||p_name ELSE 'a satellite image of theta '||p_name END AS prompt, array_to_string(string_split(p_name||', x, y, z',',')[1:3],',') AS place FROM part""")
def prompts(spark, d):
    k = F.col("p_partkey")
    q = F.when(k % 3 == 0, F.concat(F.lit("  The "), "p_name")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("theta "), "p_name"))
    return T.table(spark, d, "part").select("p_partkey", E.build_prompt(q).alias("prompt"), E.place_label(F.concat("p_name", F.lit(", x, y, z"))).alias("place"))


@query(r"""WITH m AS (SELECT o_orderkey, 'OSError: https://x.org/a.tif?sig='||o_orderkey||' failed, then http://y.org/b?t=1&u=2'||repeat(' more',CAST(o_orderkey%90 AS INT)) AS m FROM orders), r AS (SELECT o_orderkey, regexp_replace(m,'\?[^\s''"<>]*','?…','g') AS m FROM m) SELECT o_orderkey, CASE WHEN length(m)>400 THEN substr(m,1,399)||'…' ELSE m END AS message FROM r""")
def public_errors(spark, d):
    k = F.col("o_orderkey")
    m = F.concat(F.lit("OSError: https://x.org/a.tif?sig="), k.cast("string"), F.lit(" failed, then http://y.org/b?t=1&u=2"), F.repeat(F.lit(" more"), (k % 90).cast("int")))
    return T.table(spark, d, "orders").select("o_orderkey", E.public_error(m).alias("message"))


@query("""SELECT p_partkey, CASE WHEN p_size*7.25::DOUBLE>=100 THEN format('{:,}', CAST(floor(p_size*7.25::DOUBLE+0.5) AS BIGINT)) ELSE printf('%.1f', floor(p_size*72.5::DOUBLE+0.5)/10) END AS ha, '&lt;b&gt;'||replace(p_name,'&','&amp;')||'&#39;s &amp; &quot;' AS html FROM part""")
def hectare_format(spark, d):
    html = F.concat(F.lit("<b>"), "p_name", F.lit("'s & \""))
    return T.table(spark, d, "part").select("p_partkey", E.format_hectares(F.col("p_size") * 7.25).alias("ha"), E.escape_html(html).alias("html"))


@query(f"""WITH {K._GAZ} SELECT place_id, substr(sha1('{{"bbox": ['||west||', '||south||', '||east||', '||north||'], "layer": "ndvi", "scene": "S'||place_id||'"}}'),1,20) AS key FROM aw""")
def cache_keys(spark, d):
    box = [F.col(x) for x in ("west", "south", "east", "north")]
    return _areas(spark, d).select("place_id", E.cache_key(F.concat(F.lit("S"), F.col("place_id").cast("string")), box, F.lit("ndvi")).alias("key"))


@query("SELECT sha256(string_agg(n_name||chr(0)||n_nationkey||chr(10)||chr(0),'' ORDER BY n_name)) AS fingerprint FROM nation")
def tree_fingerprint(spark, d):
    files = T.table(spark, d, "nation").select(F.col("n_name").alias("path"), F.concat(F.col("n_nationkey").cast("string"), F.lit("\r\n")).alias("content"))
    return E.tree_fingerprint(files)


_RUNS = "x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS created, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_totalprice AS size FROM orders)"


@query(f"WITH {_RUNS} SELECT id, CAST(created AS VARCHAR) AS created, CASE WHEN status='done' THEN 'done' ELSE 'failed' END AS status FROM x")
def run_metadata(spark, d):
    """Run tables written as JSON and loaded again: runs that were under way count as failed."""
    import uuid

    path = f"{shared_dir(spark)}/rasterflux-runs-{uuid.uuid4().hex}"
    K._texts(T.runs(spark, d)).write.json(path)
    return T.load_runs(spark, path).select("id", "created", "status")


@query(f"WITH {_RUNS} SELECT id AS job_id, status, CAST(created AS VARCHAR) AS created, CASE WHEN status='done' THEN CAST(size AS BIGINT) END AS feature_count FROM x")
def run_status(spark, d):
    runs = K._texts(T.runs(spark, d)).withColumn("feature_count", F.rint("size").cast("long"))
    return S.run_status(runs)


@query(f"WITH {_RUNS} SELECT id, CAST(created AS VARCHAR) AS created FROM (SELECT * FROM x ORDER BY created DESC, id DESC LIMIT 100)")
def run_list(spark, d):
    return K._texts(S.run_list(T.runs(spark, d)).limit(100).select("id", "created"))


@query(f"WITH {K._TEXT}, {K._SPLIT}, {K._GAZ} SELECT request_id, CASE WHEN what='' THEN NULL ELSE CASE WHEN regexp_matches(lower(what),'^(a|an|the) ') THEN what ELSE 'a satellite image of '||what END END AS prompt, name AS place FROM rq JOIN aw ON lower(trim(rq.\"where\"))=lower(trim(aw.name)) WHERE what<>''")
def smart_requests(spark, d):
    return P.smart(K._requests(spark, d), T.gazetteer(spark, d)).where("what <> ''").select("request_id", "prompt", "place")
