"""Tiled rasters: a data source whose partitions are tiles of TIFF files, and a sink that writes them.

``read`` gives one row per pixel (path, r, c and a column per band, null where there is no data). A file's directory is read when the scan is planned; each partition is
some tiles of one file and reads only their bytes. Conditions on r and c are pushed down to the list of tiles (with ``spark.sql.python.filterPushdown.enabled``), as is a window that is given as an option;
bands that are not asked for are not decoded where the file keeps them apart. Files are opened through Arrow's file systems, at any address that these know.

Decoded: classic and big files of either byte order, tiles and strips, whole or planar bands, integers and floats of 8 to 64 bits, uncompressed or
Deflate, with horizontal or floating-point prediction. Anything else raises. Written: 64-bit floats in tiles, Deflate with floating-point prediction, one file per key; absent pixels are NaN.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from rasterflux.shipping import ship

#: Tags of a directory.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
#: Field types: their code in ``struct``.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048
TILES_PER_PARTITION, SIDE = 16, 256


@dataclass
class Raster:
    """What a file's first directory says, and where its blocks (tiles or strips) lie."""

    path: str
    width: int
    height: int
    bands: int
    block_width: int
    block_height: int
    dtype: str
    compression: int
    predictor: int
    planar: bool
    offsets: np.ndarray = field(repr=False)
    sizes: np.ndarray = field(repr=False)
    no_data: float | None = None
    origin: tuple[float, float] | None = None
    pixel: tuple[float, float] | None = None
    epsg: int | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    def blocks(self, window: tuple[int, int, int, int]) -> list[int]:
        """Blocks (of one plane) that meet the rows and columns [r0, r1) x [c0, c1)."""
        r0, c0, r1, c1 = max(window[0], 0), max(window[1], 0), min(window[2], self.height), min(window[3], self.width)
        if r0 >= r1 or c0 >= c1:
            return []
        rows, cols = range(r0 // self.block_height, (r1 - 1) // self.block_height + 1), range(c0 // self.block_width, (c1 - 1) // self.block_width + 1)
        return [i * self.across + j for i in rows for j in cols]


def _open(path: str) -> pa.NativeFile:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def directory(path: str) -> Raster:
    """Reads a file's first directory; the pixels stay where they are."""
    with _open(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        big = version == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        count_size, entry_size, word = (8, 20, "Q") if big else (2, 12, "I")
        n = struct.unpack(order + ("Q" if big else "H"), f.read_at(count_size, at))[0]
        raw = f.read_at(n * entry_size, at + count_size)
        tags: dict[int, tuple] = {}
        for k in range(n):
            entry = raw[k * entry_size : (k + 1) * entry_size]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            if kind not in KINDS:
                continue
            count = struct.unpack(order + word, entry[4 : 4 + struct.calcsize(word)])[0]
            place = entry[4 + struct.calcsize(word) :]
            code = KINDS[kind]
            size = struct.calcsize("=" + code) * count
            data = place[:size] if size <= len(place) else f.read_at(size, struct.unpack(order + word, place)[0])
            tags[tag] = (data,) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, kind = one(BITS, 1), one(FORMAT, 1)
    if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or len({*tags.get(BITS, (8,))}) > 1 or (kind == 3 and bits < 32):
        raise ValueError(f"samples of {tags.get(BITS)} bits are not read: {path}")
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"compression {one(COMPRESSION, 1)} is not read: {path}")
    tiled = TILES in tags
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIE_POINT)
    text = one(NO_DATA, b"").rstrip(b"\0 ").decode() if NO_DATA in tags else ""
    return Raster(
        path, one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(TILE_WIDTH, 0) if tiled else one(WIDTH, 0), one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, 1 << 32), one(HEIGHT, 0)),
        f"{order}{'?uif'[kind]}{bits // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2,
        np.array(tags[TILES if tiled else STRIPS], np.int64), np.array(tags[TILE_BYTES if tiled else STRIP_BYTES], np.int64), float(text) if text else None,
        (tie[3], tie[4]) if tie else None, (scale[0], scale[1]) if scale else None, geo.get(PROJECTED_KEY, geo.get(GEOGRAPHIC_KEY)),
    )


def decode(raw: bytes, raster: Raster, rows: int, samples: int) -> np.ndarray:
    """rows x block width x samples of one block."""
    dtype, width = np.dtype(raster.dtype), raster.block_width
    data = zlib.decompress(raw) if raster.compression != 1 else raw
    shape = (rows, width, samples)
    need = rows * width * samples * dtype.itemsize
    if len(data) < need:
        raise ValueError(f"a block of {raster.path} is cut off")
    if raster.predictor == 3:
        # Bytes are differenced along a row, which holds the highest bytes of all samples first.
        lines = np.frombuffer(data, np.uint8, need).reshape(rows, -1, samples)
        lines = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, width * samples)
        return np.ascontiguousarray(lines.transpose(0, 2, 1)).view(f">f{dtype.itemsize}").reshape(shape)
    out = np.frombuffer(data, dtype, need // dtype.itemsize).reshape(shape)
    return np.cumsum(out, axis=1, dtype=dtype.newbyteorder("=")) if raster.predictor == 2 else out


def pixels_of(raster: Raster, f: pa.NativeFile, block: int, bands: list[int], window: tuple[int, int, int, int]) -> tuple[np.ndarray, ...] | None:
    """r, c and the bands' values (NaN: no data) of a block's pixels within the window."""
    top, left = block // raster.across * raster.block_height, block % raster.across * raster.block_width
    # The last strip is as long as the image, tiles are always whole.
    whole_width = raster.block_width == raster.width
    held = min(raster.block_height, raster.height - top) if whole_width and raster.block_height != raster.height else raster.block_height
    r0, r1 = max(window[0], top), min(window[2], top + raster.block_height, raster.height)
    c0, c1 = max(window[1], left), min(window[3], left + raster.block_width, raster.width)
    if r0 >= r1 or c0 >= c1:
        return None
    read = lambda k, samples: decode(f.read_at(int(raster.sizes[k]), int(raster.offsets[k])), raster, held, samples)
    planes = raster.across * raster.down
    if not raster.planar:
        stack = read(block, raster.bands)
        values = [stack[:, :, b] for b in bands]
    else:
        values = [read(b * planes + block, 1)[:, :, 0] for b in bands]
    cut = [v[r0 - top : r1 - top, c0 - left : c1 - left].astype(np.float64).ravel() for v in values]
    if raster.no_data is not None:
        cut = [np.where(v == raster.no_data, np.nan, v) for v in cut]
    rows, cols = np.meshgrid(np.arange(r0, r1, dtype=np.int32), np.arange(c0, c1, dtype=np.int32), indexing="ij")
    return rows.ravel(), cols.ravel(), *cut


def _files(path: str) -> list[str]:
    """The files of a comma-separated list of files and folders."""
    out = []
    for part in path.split(","):
        uri = "://" in part or part.startswith("file:")
        system, at = fs.FileSystem.from_uri(part) if uri else (fs.LocalFileSystem(), part)
        if system.get_file_info(at).type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(at, recursive=True))
            names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith((".tif", ".tiff")))
            out += [part[: len(part) - len(at)] + x if uri and part.endswith(at) else x for x in names]
        else:
            out.append(part)
    return out


@dataclass
class Tiles(InputPartition):
    """Some blocks of one file."""

    raster: Raster
    blocks: list[int]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = _files(options["path"])
        self.bands = [int(b) - 1 for b in options["bands"].split(",")] if options.get("bands") else None
        self.each = int(options.get("tiles", TILES_PER_PARTITION))
        r0, c0, r1, c1 = (int(x) for x in options["window"].split(",")) if options.get("window") else (0, 0, 1 << 31, 1 << 31)
        self.window = [r0, c0, r1, c1]

    def narrow(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on r and c become the window; Spark applies the others."""
        for x in filters:
            name = getattr(x, "attribute", None)
            axis = {("r",): 0, ("c",): 1}.get(name)
            value = getattr(x, "value", None)
            if axis is None or not isinstance(value, int) or not isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield x
                continue
            if isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.window[axis] = max(self.window[axis], value + isinstance(x, GreaterThan))
            if isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                self.window[axis + 2] = min(self.window[axis + 2], value + (not isinstance(x, LessThan)))

    def partitions(self) -> list[Tiles]:
        out = []
        for path in self.paths:
            raster = directory(path)
            blocks = raster.blocks(tuple(self.window))
            out += [Tiles(raster, blocks[k : k + self.each]) for k in range(0, len(blocks), self.each)]
        return out or [None]

    def read(self, part: Tiles | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        bands = self.bands if self.bands is not None else list(range(part.raster.bands))
        names = ["path", "r", "c", *[f"b{b + 1}" for b in bands]]
        with _open(part.raster.path) as f:
            for block in part.blocks:
                if (found := pixels_of(part.raster, f, block, bands, tuple(self.window))) is not None:
                    r, c, *values = found
                    path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(r), np.int32)), pa.array([part.raster.path])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([path, pa.array(r), pa.array(c), *[pa.array(v, mask=np.isnan(v)) for v in values]], names)


class PushingReader(RasterReader):
    """Spark asks for conditions only where the session allows it, and refuses a reader that takes them where not."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        yield from self.narrow(filters)


class RasterSource(DataSource):
    """``format("tiles")`` with options path (files and folders, comma-separated), bands (from 1), window (r0,c0,r1,c1; ends outside) and tiles (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> T.StructType:
        bands = self.options.get("bands")
        files = [] if bands else _files(self.options["path"])
        numbers = bands.split(",") if bands else range(1, (directory(files[0]).bands if files else 0) + 1)
        fields = [T.StructField("path", T.StringType()), T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType())]
        return T.StructType([*fields, *[T.StructField(f"b{int(b)}", T.DoubleType()) for b in numbers]])

    def reader(self, schema: T.StructType) -> RasterReader:
        return (PushingReader if self.options.get("pushdown") == "true" else RasterReader)(self.options)


def read(spark: SparkSession, path: str | list[str], bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, tiles: int = TILES_PER_PARTITION) -> DataFrame:
    """path, r, c and a column b1, b2, ... for each band of the files, or of every file in a folder."""
    ship(spark)
    spark.dataSource.register(RasterSource)
    options = {"path": path if isinstance(path, str) else ",".join(path), "tiles": str(tiles)}
    options |= {"bands": ",".join(map(str, bands))} if bands else {}
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    options |= {"window": ",".join(map(str, window))} if window else {}
    return spark.read.format("tiles").options(**options).load()


def encode(values: np.ndarray) -> bytes:
    """A tile of 64-bit floats (rows x columns x bands), predicted and compressed."""
    rows, cols, bands = values.shape
    lines = np.ascontiguousarray(values.astype(">f8")).view(np.uint8).reshape(rows, cols * bands, 8).transpose(0, 2, 1).reshape(rows, -1, bands)
    return zlib.compress(np.diff(lines, axis=1, prepend=np.zeros((rows, 1, bands), np.uint8)).astype(np.uint8).tobytes())


def _directory_bytes(tags: list[tuple[int, int, list]], at: int) -> bytes:
    """A big file's directory at a place in the file."""
    head, tail = b"", b""
    end = at + 8 + 20 * len(tags) + 8
    for tag, kind, values in sorted(tags):
        data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
        place = data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", end + len(tail))
        head += struct.pack("<HHQ", tag, kind, len(values)) + place
        tail += data if len(data) > 8 else b""
    return struct.pack("<Q", len(tags)) + head + struct.pack("<Q", 0) + tail


def _tile(rows: pa.Table, side: int, bands: list[str]) -> pa.Table:
    """One tile's bytes from its pixels."""
    name, y, x = (rows.column(k)[0].as_py() for k in ("name", "y", "x"))
    out = np.full((side, side, len(bands)), np.nan)
    r, c = (rows.column(k).to_numpy() for k in ("r", "c"))
    for b, band in enumerate(bands):
        out[r - y * side, c - x * side, b] = rows.column(band).cast(pa.float64()).to_numpy()
    return pa.table({"name": [name], "y": pa.array([y], pa.int32()), "x": pa.array([x], pa.int32()), "data": pa.array([encode(out)], pa.binary())})


def _assemble(batches: Iterator[pa.RecordBatch], folder: str, height: int, width: int, side: int, bands: int, geo: list) -> Iterator[pa.RecordBatch]:
    """Writes the tiles of each file as they come; the directory goes to the end, when all places are known."""
    across, down = -(-width // side), -(-height // side)
    system, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(at, recursive=True)
    empty = encode(np.full((side, side, bands), np.nan))
    # Files of another attempt of the task are not touched; a finished file is moved to its name.
    attempt = TaskContext.get().taskAttemptId()
    name = out = None
    places: dict[int, tuple[int, int]] = {}
    done = []

    def finish() -> None:
        hole = out.tell()
        out.write(empty)
        found = [places.get(k, (hole, len(empty))) for k in range(across * down)]
        tags = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [64] * bands), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]), (PREDICTOR, 3, [3]),
            (TILE_WIDTH, 4, [side]), (TILE_HEIGHT, 4, [side]), (TILES, 16, [p for p, _ in found]), (TILE_BYTES, 16, [n for _, n in found]), (FORMAT, 3, [3] * bands), *geo,
        ]
        place = out.tell()
        out.write(_directory_bytes(tags, place))
        out.close()
        # The head names the directory's place, which is known last: head and body are joined here.
        body, whole = f"{at}/.{name}.{attempt}.body", f"{at}/.{name}.{attempt}"
        with system.open_output_stream(whole) as to, system.open_input_stream(body) as source:
            to.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, place))
            source.read(16)
            while piece := source.read(1 << 22):
                to.write(piece)
        system.delete_file(body)
        system.move(whole, f"{at}/{name}.tif")
        done.append(f"{folder}/{name}.tif")

    for batch in batches:
        for file, y, x, data in zip(*(batch.column(k) for k in range(4)), strict=True):
            if file.as_py() != name:
                if name is not None:
                    finish()
                name, places = file.as_py(), {}
                out = system.open_output_stream(f"{at}/.{name}.{attempt}.body")
                out.write(b"\0" * 16)
            places[y.as_py() * across + x.as_py()] = (out.tell(), len(data.as_py()))
            out.write(data.as_buffer())
    if name is not None:
        finish()
    yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])


def write(
    px: DataFrame, folder: str, name: Column, bands: list[str], height: int, width: int, side: int = SIDE,
    origin: tuple[float, float] | None = None, pixel: tuple[float, float] | None = None, epsg: int | None = None,
) -> list[str]:
    """Writes one tiled file per ``name`` from pixels (r, c, bands), and returns the paths.

    A tile is one group and is encoded in a task of its own; the tiles of a file then pass through the task that writes it, one after the other. A failed task writes its files anew.
    """
    ship(px.sparkSession)
    geo: list = [(PIXEL_SCALE, 12, [*pixel, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, *origin, 0.0])] if origin and pixel else []
    if epsg:
        geo.append((GEO_KEYS, 3, [1, 1, 0, 1, GEOGRAPHIC_KEY if epsg == 4326 else PROJECTED_KEY, 0, 1, epsg]))
    inside = px.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    keyed = inside.select(name.cast("string").alias("name"), F.expr(f"cast(r div {side} as int)").alias("y"), F.expr(f"cast(c div {side} as int)").alias("x"), "r", "c", *bands)

    def tile(rows: pa.Table) -> pa.Table:
        return _tile(rows, side, bands)

    tiles = keyed.groupBy("name", "y", "x").applyInArrow(tile, "name string, y int, x int, data binary")
    dealt = tiles.repartition("name").sortWithinPartitions("name", "y", "x")
    made = dealt.mapInArrow(partial(_assemble, folder=folder, height=height, width=width, side=side, bands=len(bands), geo=geo), "path string")
    # One row per file.
    return sorted(r.path for r in made.collect())
