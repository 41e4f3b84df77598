"""Scene, request, run and ranking operators."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E
from rasterflux.operators.graph import numbered
from rasterflux.shipping import ship


Box = tuple[float, float, float, float]
#: What a scene id may look like; anything else is refused before it is looked up.
SCENE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def meets(box: Box | None) -> Column:
    """Whether a scene (west, south, east, north) meets a box; touching counts."""
    if box is None:
        return F.lit(True)
    w, s, e, n = box
    return (F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s)


def search(
    scenes: DataFrame, sensor: str, start: str, end: str, max_cloud: float | None = None, orbit: str | None = None, limit: int = 50, box: Box | None = None
) -> DataFrame:
    """Scenes that meet the box within the dates, both inclusive. Optical: cloud below the maximum, clearest first. Radar: newest first; a cloud filter would drop its NULLs."""
    found = scenes.where((F.col("sensor") == sensor) & F.col("date").between(start, end) & meets(box))
    if sensor == "S2":
        return found.where(F.col("cloud_cover") < (80.0 if max_cloud is None else max_cloud)).orderBy("cloud_cover", "id").limit(limit)
    if orbit:
        found = found.where(F.col("orbit_state") == orbit)
    return found.orderBy(F.desc("date"), F.desc("id")).limit(limit)


def listing(scenes: DataFrame | None, radar: DataFrame | None, start: str, end: str, box: Box | None = None, max_cloud: float = 80.0) -> tuple[DataFrame | None, list[str]]:
    """What each sensor has, one after the other; a sensor that cannot be searched becomes a note."""
    out, notes = None, []
    for sensor, df in (("S2", scenes), ("S1", radar)):
        if df is None:
            notes.append(f"{sensor} search failed")
            continue
        part = search(df, sensor, start, end, max_cloud, box=box)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, notes


def scene_by_id(scenes: DataFrame, scene_id: str) -> DataFrame:
    """The scene with an id, text compared with text."""
    if not re.fullmatch(SCENE_ID, scene_id or ""):
        raise ValueError(f"not a scene id: {scene_id!r}")
    return scenes.where(F.col("id").cast("string") == scene_id)


def usable_dates(used: DataFrame) -> DataFrame:
    """Per sensor its dates, and whether they are enough to compare (two)."""
    return used.groupBy("sensor").agg(F.count(F.lit(1)).alias("dates"), (F.count(F.lit(1)) >= 2).alias("usable"))


def timeline(used: DataFrame) -> DataFrame:
    """Scenes with an id and a step, in the order of date and sensor."""
    return used.where(F.col("id").isNotNull() & F.col("step").isNotNull()).orderBy("date", "sensor")


def steps_of(used: DataFrame) -> DataFrame:
    return used.where("step is not null").select("step").distinct().orderBy("step")


def compare_stops(timeline_: DataFrame, scenes: DataFrame) -> DataFrame:
    """Stops to compare: those of the timeline, or the scenes of a run without one. A run has at most steps x sensors of either."""
    has = timeline_.agg((F.count(F.lit(1)) > 0).alias("_has"))
    both = timeline_.withColumn("_of", F.lit(True)).unionByName(scenes.withColumn("_of", F.lit(False)), allowMissingColumns=True)
    return both.crossJoin(F.broadcast(has)).where((F.col("_of") == F.col("_has")) & F.col("id").isNotNull()).drop("_of", "_has")


def compare_defaults(stops: DataFrame) -> DataFrame:
    """One row: the first and last stop of the optical scenes, or of all where fewer than two are optical."""
    key = F.struct("date", "sensor", "id")
    optical = F.col("sensor") == "S2"
    pick = lambda f: F.when(F.count_if(optical) >= 2, f(F.when(optical, key))).otherwise(f(key))["id"]
    return stops.agg(pick(F.min).alias("before"), pick(F.max).alias("after"))


def best_per_window(scenes: DataFrame, windows: DataFrame) -> DataFrame:
    """One scene per sensor and window: the clearest optical, the newest descending radar."""
    usable = scenes.where((F.col("sensor") == "S2") | (F.col("orbit_state") == "descending"))
    placed = usable.join(F.broadcast(windows), F.col("date").between(F.col("window_start"), F.col("window_end")))
    order = F.when(F.col("sensor") == "S2", F.struct(F.col("cloud_cover").alias("a"), F.col("id").alias("b"))).otherwise(
        F.struct((-F.unix_date("date")).cast("double").alias("a"), (-F.col("id")).alias("b"))
    )
    best = placed.groupBy("sensor", "window").agg(F.min_by(F.struct("id", "date", "cloud_cover", "relative_orbit"), order).alias("s"))
    return best.select("sensor", F.col("window").alias("step"), "s.id", "s.date", "s.cloud_cover", "s.relative_orbit")


def orbit_pair(before: DataFrame, after: DataFrame) -> DataFrame:
    """The newest ``before`` scene whose orbit occurs in ``after``, with the newest ``after`` scene of that orbit. Without a shared orbit it raises when read."""
    newest = lambda df, p: df.groupBy("relative_orbit").agg(F.max(F.struct("date", "id")).alias(p))
    both = newest(before, "a").join(newest(after, "b").withColumnRenamed("relative_orbit", "o"), F.col("relative_orbit").eqNullSafe(F.col("o")))
    best = both.groupBy().agg(F.max(F.struct("a", "b", "relative_orbit")).alias("m"))
    checked = F.when(F.col("m").isNull(), F.raise_error(F.lit("no shared relative orbit: across orbits the viewing geometry would be compared")).cast("long"))
    return best.select(F.coalesce(checked, F.col("m.a.id")).alias("before_id"), F.col("m.b.id").alias("after_id"), "m.relative_orbit")


def timeline_pivot(best: DataFrame, steps: int) -> DataFrame:
    return best.groupBy("sensor").pivot("step", list(range(steps))).agg(F.first(F.date_format("date", "yyyy-MM-dd")))


def geocode(requests: DataFrame, gazetteer: DataFrame, limit: int = 5) -> DataFrame:
    """Candidates of each place, by importance; those with malformed boxes are left out."""
    key = lambda c: F.lower(F.btrim(c))
    sound = gazetteer.where((F.col("west") < F.col("east")) & (F.col("south") < F.col("north")) & F.col("west").between(-360, 360) & F.col("south").between(-90, 90))
    met = requests.join(sound, key(F.col("where")) == key(F.col("name")))
    w = W.partitionBy("request_id").orderBy(F.desc("importance"), "place_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def resolve(requests: DataFrame, gazetteer: DataFrame, span: float = 0.10) -> DataFrame:
    """Request text to place, area and index; up to three alternatives."""
    what, where = E.split_request("text")
    asked = requests.select("request_id", what.alias("what"), where.alias("where"))
    found = geocode(asked, gazetteer)
    area = E.aoi("lat", "lon", "west", "south", "east", "north", span)
    rows = found.withColumn("candidate", F.struct("rank", "name", area.alias("aoi")))
    return rows.groupBy("request_id", "what").agg(F.array_sort(F.collect_list("candidate")).alias("all")).select(
        "request_id", "what", F.col("all")[0]["name"].alias("place"), F.col("all")[0]["aoi"].alias("aoi"), F.transform(F.slice("all", 2, 3), lambda x: x["name"]).alias("alternatives"), E.index_hint("what").alias("index")
    )


def rank_by_vector(vectors: DataFrame, query: list[float], top_k: int = 20) -> DataFrame:
    """Exact cosine rank of unit vectors against one query, by the whole score; it is shown with four digits. A top-k report."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    top = vectors.select(F.col("vec_id").alias("feature_index"), score.alias("_score"))
    top = top.orderBy(F.desc("_score"), "feature_index").limit(max(1, top_k))
    rank = F.row_number().over(W.orderBy(F.desc("_score"), "feature_index"))
    return top.withColumns({"score": F.round("_score", 4), "rank": rank}).drop("_score")


#: Vectors and prompts of a cell, and the prompts of it that are scored at once.
CELL_VECTORS, CELL_PROMPTS, PROMPTS_AT_ONCE = 1 << 15, 256, 16


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table as rows, without an object for each."""
    lists = table.column("v").combine_chunks()
    return lists.cast(pa.list_(pa.float64(), len(lists[0]))).flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _best_of_cell(vectors: pa.Table, prompts: pa.Table, k: int) -> pa.Table:
    """The first k vectors of the cell for each of its prompts."""
    out: list[list] = [[], [], []]
    if vectors.num_rows and prompts.num_rows:
        ids, asked = vectors.column("id").to_numpy(), prompts.column("prompt").to_numpy(zero_copy_only=False)
        of, by = _matrix(vectors).T, _matrix(prompts)
        # Products of matrices add in any order. They only choose who may be among the first; those are scored component by component, as SQL does, so that equal vectors tie.
        lengths = np.linalg.norm(of, axis=0)
        slack = 4 * len(of) * np.finfo(float).eps * np.linalg.norm(by, axis=1) * lengths[np.isfinite(lengths)].max(initial=0.0)
        for first in range(0, len(by), PROMPTS_AT_ONCE):
            for p, row in enumerate(by[first : first + PROMPTS_AT_ONCE] @ of, first):
                least = np.partition(row, len(row) - k)[-k] if len(row) > k else -np.inf
                at = np.flatnonzero(row >= least - slack[p])
                exact = np.cumsum(of[:, at] * by[p][:, None], axis=0)[-1]
                best = np.lexsort((ids[at], -exact))[:k]
                out[0] += [asked[p]] * len(best)
                out[1] += ids[at][best].tolist()
                out[2] += exact[best].tolist()
    return pa.table({"prompt": pa.array(out[0], prompts.schema.field("prompt").type), "feature_index": pa.array(out[1], pa.int64()), "_score": pa.array(out[2], pa.float64())})


def rank_by_prompts(vectors: DataFrame, prompts: DataFrame, top_k: int = 20) -> DataFrame:
    """prompt, feature_index, score, rank: for every prompt (prompt, embedding) its best vectors (vec_id, embedding), as ``rank_by_vector`` gives them for one.

    Blocks of vectors meet blocks of prompts in cells of bounded size; a cell keeps the first ``top_k`` of each prompt, and the cells' short lists are merged by rank. Rows without an embedding take no part.
    """
    ship(vectors.sparkSession)
    k = max(1, top_k)
    v = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    p = prompts.where("embedding is not null").select("prompt", F.col("embedding").cast("array<double>").alias("v"))
    parts = lambda df, size: max(1, -(-df.count() // size))
    n, m = parts(v, CELL_VECTORS), parts(p, CELL_PROMPTS)
    dealt = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = v.select("id", "v", dealt("id", n).alias("a"), every(m).alias("b"))
    right = p.select("prompt", "v", every(n).alias("a"), dealt("prompt", m).alias("b"))

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        return _best_of_cell(x, y, k)

    kind = prompts.schema["prompt"].dataType.simpleString()
    short = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(cell, f"prompt {kind}, feature_index long, _score double")
    best = W.partitionBy("prompt").orderBy(F.desc("_score"), "feature_index")
    out = short.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("prompt", "feature_index", F.round("_score", 4).alias("score"), "rank")


def match_properties(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches (at most top-k rows) with the properties and geometry of their features."""
    return features.join(F.broadcast(matches), "feature_index")


def embed(crops: DataFrame, encoder: Callable[[pd.Series], pd.Series], column: str = "crop") -> DataFrame:
    """Adds ``embedding``, of unit length, by an encoder of batches: any callable from a pandas series of crops to one of float lists."""
    ship(crops.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        unit = lambda x: (v := np.asarray(x, np.float32)) / max(float(np.linalg.norm(v)), 1e-12)
        return encoder(batch).map(unit)

    return crops.withColumn("embedding", run(column))


def mark_matches(regions: DataFrame, matches: DataFrame) -> DataFrame:
    """Regions with match_rank and match_score, absent where not among the matches (at most top-k rows)."""
    m = matches.select("feature_index", F.col("rank").alias("match_rank"), F.col("score").alias("match_score"))
    return regions.join(F.broadcast(m), "feature_index", "left")


def retained(runs: DataFrame, keep: int = 100) -> DataFrame:
    """The newest finished runs and all others."""
    done = runs.where(F.col("status").isin("done", "failed")).orderBy(F.desc("created"), F.desc("id")).limit(keep)
    return done.unionByName(runs.where(~F.col("status").isin("done", "failed")))


def evict(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """Cache entries (key, size, used) to delete: the least recently used beyond the limit. Sizes are added up range by range, so no task sees all entries."""
    total = numbered(entries, [F.desc("used"), F.col("key")], {"_total": "size"})
    return total.where(F.col("_total") > limit_bytes).drop("_total", "number")


def run_list(runs: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return runs.orderBy(F.desc("created"), F.desc("id"))


def run_status(runs: DataFrame) -> DataFrame:
    """Status without the payload: the error only where there is one, count and statistics only of runs that are done."""
    done = F.col("status") == "done"
    kept = [c for c in ("created", "finished", "params") if c in runs.columns]
    only = [F.when(done, F.col(c)).alias(c) for c in ("feature_count", "stats") if c in runs.columns]
    error = [F.when(F.col("error") != "", F.col("error")).alias("error")] if "error" in runs.columns else []
    return runs.select(F.col("id").alias("job_id"), "status", *kept, *error, *only)


def submit(runs: DataFrame, run_id: str, created: str, waiting: int = 8, keep: int = 100) -> DataFrame:
    """The run table with one more pending run and the oldest finished ones beyond ``keep`` left out; raises where too many wait."""
    if runs.where("status = 'pending'").limit(waiting).count() >= waiting:
        raise RuntimeError(f"{waiting} runs are already waiting")
    new = runs.sparkSession.createDataFrame([(run_id, created, "pending")], "id string, created string, status string")
    return retained(runs.unionByName(new, allowMissingColumns=True), keep)


def summarize(regions: DataFrame) -> DataFrame:
    return regions.groupBy("change_type").agg(
        F.round(F.sum("area_ha"), 2).alias("area_ha"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 2).alias("confidence")
    )


def persistence_strip(dates: DataFrame) -> DataFrame:
    """Per region (dates of the sensor that dated it, change_date, confirmed_by): each date and whether the change held on it."""
    at = dates.withColumn("k", F.array_position("dates", F.col("change_date")) - 1)
    cells = at.where((F.col("k") >= 1) & F.col("confirmed_by").isNotNull()).select("*", F.posexplode("dates").alias("i", "date"))
    return cells.withColumn("held", F.col("i").between(F.col("k"), F.col("k") + F.col("confirmed_by"))).drop("k")
