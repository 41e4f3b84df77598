"""Engine tables: pixels, scenes, gazetteer, requests and runs, projected from the driver's star schema, and readers for files.

Pixels are keyed (r, c, sensor, step); a missing key is *not observed*, which is not the same as unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterflux.storage import table

#: Side of the projected grid, time steps, and the span that they divide.
SIDE, STEPS = 64, 4
EPOCH, SPAN_DAYS = "1995-01-01", 2505.0


def pixels(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    days = F.date_diff(F.to_date("l_shipdate"), F.lit(EPOCH).cast("date"))
    six = lambda x: F.round(x, 6)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_orderkey") % side).cast("int").alias("r"),
            (F.col("l_partkey") % side).cast("int").alias("c"),
            F.when(F.col("l_suppkey") % 2 == 0, "S2").otherwise("S1").alias("sensor"),
            F.least(F.lit(STEPS - 1), F.floor(days * STEPS / SPAN_DAYS)).cast("int").alias("step"),
        )
        .agg(
            six(F.avg("l_tax")).alias("red"),
            six(F.avg("l_discount")).alias("nir"),
            six(F.avg("l_quantity") / 500).alias("green"),
            six(F.avg("l_extendedprice") / 1000000).alias("swir16"),
            six(F.avg("l_quantity") / 50).alias("gamma0"),
            F.max("l_linenumber").cast("int").alias("scl"),
        )
    )


def grid(spark: SparkSession, side: int = SIDE) -> DataFrame:
    """Every pixel of the grid, observed or not."""
    cell = F.col("id")
    return spark.range(side * side).select(
        F.expr(f"cast(id div {side} as int)").alias("r"), (cell % side).cast("int").alias("c")
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    optical = F.col("event_id") % 2 == 0
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(optical, "S2").otherwise("S1").alias("sensor"),
        day.alias("date"),
        F.when(optical, F.round(F.col("value") % 100, 2)).alias("cloud_cover"),
        (F.col("user_id") % 12).cast("int").alias("relative_orbit"),
        F.when(F.col("event_type").isin("view", "click"), "descending").otherwise("ascending").alias("orbit_state"),
        *scene_box(),
    )


def scene_box() -> list:
    """A degree square for each scene."""
    west, south = (F.col("event_id") % 360 - 180).cast("double"), ((F.col("event_id") * 7) % 170 - 85).cast("double")
    return [west.alias("west"), south.alias("south"), (west + 1).alias("east"), (south + 1).alias("north")]


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    span = F.element_at(F.array(F.lit(0.001), F.lit(0.08), F.lit(3.0)), (key % 3 + 1).cast("int"))
    lat, lon = ((key * 7) % 120 - 60).cast("double"), ((key * 29) % 360 - 180).cast("double")
    return table(spark, sf_dir, "nation").select(
        key.cast("int").alias("place_id"),
        F.col("n_name").alias("name"),
        lat.alias("lat"),
        lon.alias("lon"),
        (lon - span / 2).alias("west"),
        (lat - span / 2).alias("south"),
        (lon + span / 2).alias("east"),
        (lat + span / 2).alias("north"),
        F.col("n_regionkey").cast("double").alias("importance"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("created"), status.alias("status"), F.col("o_totalprice").alias("size")
    )


STAC_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField("datetime", T.StringType()),
                    T.StructField("eo:cloud_cover", T.DoubleType()),
                    T.StructField("sat:orbit_state", T.StringType()),
                    T.StructField("sat:relative_orbit", T.IntegerType()),
                    T.StructField("sar:polarizations", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("assets", T.MapType(T.StringType(), T.StructType([T.StructField("href", T.StringType())]))),
    ]
)


def read_stac(spark: SparkSession, path: str) -> DataFrame:
    """Scene items from JSON files, malformed ones dropped."""
    return spark.read.schema(STAC_ITEM).option("mode", "DROPMALFORMED").json(path)


def describe_scenes(items: DataFrame, sensor: str) -> DataFrame:
    """Flat descriptors: id, date and what the sensor reports."""
    p = F.col("properties")
    head = [F.lit(sensor).alias("sensor"), "id", F.to_date(F.left(p["datetime"], F.lit(10))).alias("date")]
    if sensor == "S2":
        return items.select(*head, F.round(F.coalesce(p["eo:cloud_cover"], F.lit(0.0)), 1).alias("cloud_cover"))
    return items.select(
        *head, p["sat:orbit_state"].alias("orbit_state"), p["sat:relative_orbit"].alias("relative_orbit"), p["sar:polarizations"].alias("polarizations")
    )


def inspect_flights(meta: DataFrame) -> DataFrame:
    """Drone flights from (path, crs, bands): the index to use, a note, or the error."""
    nir = F.col("bands") > 3
    return meta.select(
        "*",
        F.when(F.col("crs").isNull(), "no coordinate reference system").when(F.col("bands") < 3, "fewer than 3 bands").alias("error"),
        F.when(nir, "ndvi").otherwise("vari").alias("index"),
        F.when(~nir, "no near-infrared band: VARI is used instead of NDVI").alias("note"),
    )


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Saved run metadata; runs that were under way count as failed."""
    df = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    df = df.where(~F.input_file_name().endswith(".result.json"))
    return df.withColumn("status", F.when(F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status")))
