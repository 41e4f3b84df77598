"""Crops of regions from a chip, and their embeddings by an encoder that each worker loads once.

Pixels are packed into tiles of TILE x TILE, whose bytes are small rows; a window meets its tiles by their numbers, and one group per crop cuts it from them. A crop is as large as its
window, at most the chip, never the regions' pixels times their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflux.shipping import ship

TILE, BATCH = 64, 32


def packed(px: DataFrame, bands: list[str], tile: int = TILE) -> DataFrame:
    """tr, tc, data: the levels (0 to 255, absent 0) of each tile's pixels, rows x columns x bands."""
    ship(px.sparkSession)

    def pack(rows: pa.Table) -> pa.Table:
        out = np.zeros((tile, tile, len(bands)), np.uint8)
        tr, tc = rows.column("tr")[0].as_py(), rows.column("tc")[0].as_py()
        r, c = rows.column("r").to_numpy() - tr * tile, rows.column("c").to_numpy() - tc * tile
        for b, name in enumerate(bands):
            out[r, c, b] = rows.column(name).fill_null(0).to_numpy()
        return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    levels = [F.greatest(F.lit(0), F.least(F.lit(255), F.col(b).cast("int"))).alias(b) for b in bands]
    keyed = px.select(F.expr(f"cast(r div {tile} as int)").alias("tr"), F.expr(f"cast(c div {tile} as int)").alias("tc"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *levels)
    return keyed.groupBy("tr", "tc").applyInArrow(pack, "tr int, tc int, data binary")


def crops(windows: DataFrame, px: DataFrame, bands: list[str], key: str = "feature_index", tile: int = TILE) -> DataFrame:
    """key, height, width, crop (bytes: rows x columns x bands) of every window (key, x0, y0, x1, y1; ends outside). Pixels that the chip lacks are 0; an empty window gives an empty crop."""
    ship(px.sparkSession)
    kind = windows.schema[key].dataType
    n = len(bands)
    box = windows.select(F.col(key).alias("key"), *[F.col(k).cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")])
    last = lambda a, b: F.expr(f"cast(greatest({a}, {b} - 1) div {tile} as int)")
    first = lambda a: F.expr(f"cast({a} div {tile} as int)")
    met = box.select("*", F.explode(F.sequence(first("y0"), last("y0", "y1"))).alias("tr"))
    met = met.select("*", F.explode(F.sequence(first("x0"), last("x0", "x1"))).alias("tc")).join(packed(px, bands, tile), ["tr", "tc"], "left")

    def cut(rows: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = (rows.column(k)[0].as_py() for k in ("x0", "y0", "x1", "y1"))
        h, w = max(y1 - y0, 0), max(x1 - x0, 0)
        out = np.zeros((h, w, n), np.uint8)
        for tr, tc, data in zip(rows.column("tr").to_pylist(), rows.column("tc").to_pylist(), rows.column("data"), strict=True):
            if data.is_valid and h and w:
                part = np.frombuffer(data.as_buffer(), np.uint8).reshape(tile, tile, n)
                top, left = tr * tile, tc * tile
                a, b, c, d = max(y0, top), min(y1, top + tile), max(x0, left), min(x1, left + tile)
                out[a - y0 : b - y0, c - x0 : d - x0] = part[a - top : b - top, c - left : d - left]
        return pa.table({"key": rows.column("key").slice(0, 1), "height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32()), "crop": pa.array([out.tobytes()], pa.binary())})

    found = met.groupBy("key").applyInArrow(cut, f"key {kind.simpleString()}, height int, width int, crop binary")
    return found.withColumnRenamed("key", key)


Encoder = Callable[[list[np.ndarray]], "np.ndarray | list"]
#: What this worker has loaded, by name.
_loaded: dict[str, Encoder] = {}


def _encoder(name: str, load: Callable[[], Encoder]) -> Encoder:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def embed_crops(found: DataFrame, name: str, load: Callable[[], Encoder], bands: int = 3, batch: int = BATCH) -> DataFrame:
    """Adds ``embedding``, of unit length, to crops (height, width, crop). ``load`` makes the encoder in a worker, once for each ``name``; it takes at most ``batch`` crops at a time and gives one vector for each.

    Empty crops have no embedding.
    """
    ship(found.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from rasterflux.operators import crops as here

        encoder = None
        for height, width, crop in parts:
            out: list = [None] * len(crop)
            full = [k for k in range(len(crop)) if crop.iloc[k] is not None and len(crop.iloc[k])]
            for at in range(0, len(full), batch):
                encoder = encoder or here._encoder(name, load)
                some = full[at : at + batch]
                images = [np.frombuffer(crop.iloc[k], np.uint8).reshape(height.iloc[k], width.iloc[k], bands) for k in some]
                for k, v in zip(some, encoder(images), strict=True):
                    v = np.asarray(v, np.float32)
                    out[k] = v / max(float(np.linalg.norm(v)), 1e-12)
            yield pd.Series(out, dtype=object)

    return found.withColumn("embedding", run("height", "width", "crop"))
