"""A scene catalogue on files: items as lines of STAC JSON, with the ranges of each file beside them, and a data source that prunes by them.

``write`` deals items by sensor and date into files of at most ``ITEMS`` lines; a task writes its files one after the other and returns each file's ranges, which go to one index. ``read`` plans partitions of at most ``ITEMS`` items from the files
whose ranges can meet the conditions on the scenes (dates, cloud, box, id, sensor), so that small files share a task, and applies the same conditions to the lines before they become rows. Conditions are given to ``read``; with
``spark.sql.python.filterPushdown.enabled`` those of the plan are pushed down as well, and what the source does not know is left to Spark.
"""

from __future__ import annotations

import datetime
import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from rasterflux.shipping import ship

#: Items of a file at most, and of a partition that reads several files.
ITEMS = 10_000
SCHEMA = "id string, sensor string, date date, cloud_cover double, relative_orbit int, orbit_state string, west double, south double, east double, north double"
_TYPES = dict(zip([x.split()[0] for x in SCHEMA.split(", ")], [pa.string(), pa.string(), pa.date32(), pa.float64(), pa.int32(), pa.string(), *[pa.float64()] * 4], strict=True))
_TEST = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
INDEX = "_index.json"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def to_item(row: dict) -> dict:
    """A STAC item of a scene."""
    own = {"datetime": f"{row['date']}T00:00:00Z", "eo:cloud_cover": row["cloud_cover"], "sat:relative_orbit": row["relative_orbit"], "sat:orbit_state": row["orbit_state"]}
    box = [row[k] for k in ("west", "south", "east", "north")]
    return {"type": "Feature", "id": row["id"], "collection": row["sensor"], "bbox": box, "properties": {k: v for k, v in own.items() if v is not None}}


def to_row(item: dict) -> dict:
    """The scene that an item describes; what it does not say is null."""
    p = item.get("properties") or {}
    day = (p.get("datetime") or "")[:10]
    box = item.get("bbox") or [None] * 4
    return {
        "id": item.get("id"), "sensor": item.get("collection"), "date": datetime.date.fromisoformat(day) if day else None, "cloud_cover": p.get("eo:cloud_cover"),
        "relative_orbit": p.get("sat:relative_orbit"), "orbit_state": p.get("sat:orbit_state"), "west": box[0], "south": box[1], "east": box[2], "north": box[3],
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str, items: int) -> Iterator[pa.RecordBatch]:
    system, at = _system(folder)
    system.create_dir(at, recursive=True)
    task = TaskContext.get()
    rows: list[dict] = []
    made: list[tuple[str, str]] = []

    def flush() -> None:
        name = f"items-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):05d}.ndjson"
        with system.open_output_stream(f"{at}/{name}") as out:
            for row in rows:
                out.write(json.dumps(to_item(row)).encode() + b"\n")
        ranges = {k: [min(v), max(v), len(v) < len(rows)] for k in _TYPES if (v := [str(r[k]) if k == "date" else r[k] for r in rows if r[k] is not None])}
        made.append((name, json.dumps({"path": name, "items": len(rows), "ranges": ranges})))
        rows.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if len(rows) >= items:
                flush()
            rows.append(row)
    if rows:
        flush()
    yield pa.RecordBatch.from_arrays([pa.array([m for _, m in made], pa.string())], ["entry"])


def write(scenes: DataFrame, folder: str, items: int = ITEMS) -> int:
    """Writes scenes (columns as in SCHEMA) and the index; returns the number of files. The index has one line per file."""
    ship(scenes.sparkSession)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    rows = scenes.select(*[F.col(k).cast(t).alias(k) for k, t in kinds.items()])
    dealt = rows.repartitionByRange("sensor", "date", "id").sortWithinPartitions("sensor", "date", "id")
    entries = [r.entry for r in dealt.mapInArrow(partial(_write, folder=folder, items=items), "entry string").collect()]
    system, at = _system(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/{INDEX}") as out:
        out.write("".join(e + "\n" for e in entries).encode())
    return len(entries)


@dataclass
class ItemFiles(InputPartition):
    paths: tuple[str, ...]


class ItemReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        day = lambda name, v: datetime.date.fromisoformat(v) if name == "date" else v
        self.tests: list[tuple[str, str, object]] = [(name, kind, day(name, v)) for name, kind, v in json.loads(options.get("conditions", "[]"))]

    def narrow(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the conditions that the source can test, and gives back the others."""
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if name in _TYPES and type(x) in _TEST:
                self.tests.append((name, type(x).__name__, x.value))
            elif name in _TYPES and isinstance(x, In):
                self.tests.append((name, "In", tuple(x.value)))
            elif name in _TYPES and isinstance(x, IsNotNull):
                self.tests.append((name, "IsNotNull", None))
            else:
                yield x

    def _may_hold(self, ranges: dict) -> bool:
        """Whether a file with these ranges can have an item that passes."""
        for name, kind, value in self.tests:
            if name not in ranges:
                return False
            low, high, _ = ranges[name]
            said = lambda v: str(v) if name == "date" else v
            if kind == "In":
                if not any(low <= said(v) <= high for v in value):
                    return False
            elif kind in ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "EqualTo"):
                v = said(value)
                fits = {"EqualTo": low <= v <= high, "GreaterThan": high > v, "GreaterThanOrEqual": high >= v, "LessThan": low < v, "LessThanOrEqual": low <= v}
                if not fits[kind]:
                    return False
        return True

    def partitions(self) -> list[ItemFiles]:
        system, at = _system(self.folder)
        with system.open_input_stream(f"{at}/{INDEX}") as f:
            entries = [json.loads(x) for x in f.read().decode().splitlines()]
        parts: list[list[str]] = [[]]
        held = 0
        for e in entries:
            if self._may_hold(e["ranges"]):
                if parts[-1] and held + e["items"] > ITEMS:
                    parts.append([])
                    held = 0
                parts[-1].append(f"{self.folder}/{e['path']}")
                held += e["items"]
        return [ItemFiles(tuple(p)) for p in parts]

    def _passes(self, row: dict) -> bool:
        tests = {k.__name__: f for k, f in _TEST.items()}
        for name, kind, value in self.tests:
            v = row[name]
            if v is None or (kind == "In" and v not in value) or (kind in tests and not tests[kind](v, value)):
                return False
        return True

    def read(self, part: ItemFiles) -> Iterator[pa.RecordBatch]:
        for path in part.paths:
            system, at = _system(path)
            with system.open_input_stream(at) as f:
                # A file has at most ITEMS lines.
                rows = [row for line in f.read().splitlines() if self._passes(row := to_row(json.loads(line)))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_TYPES.items())))


class PushingReader(ItemReader):
    """Spark asks for conditions only where the session allows it, and refuses a reader that takes them where not."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        yield from self.narrow(filters)


class ItemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ItemReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ItemReader)(self.options)


_SIGNS = {"=": "EqualTo", ">": "GreaterThan", ">=": "GreaterThanOrEqual", "<": "LessThan", "<=": "LessThanOrEqual"}


def read(spark: SparkSession, folder: str, conditions: list[tuple[str, str, object]] = ()) -> DataFrame:
    """The scenes of a catalogue that ``write`` has written and that meet all conditions (column, sign, value); dates are text. A null meets none."""
    ship(spark)
    spark.dataSource.register(ItemSource)
    if bad := [c for c in conditions if c[0] not in _TYPES or c[1] not in _SIGNS]:
        raise ValueError(f"not a condition on scenes: {bad[0]}")
    told = json.dumps([(name, _SIGNS[sign], value) for name, sign, value in conditions])
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("items").options(conditions=told, pushdown=pushdown).load(folder)


def search(spark: SparkSession, folder: str, sensor: str, start: str, end: str, max_cloud: float | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The scenes of a sensor within the dates, both inclusive, below a cloud cover, that meet a box (west, south, east, north)."""
    asked: list[tuple[str, str, object]] = [("sensor", "=", sensor), ("date", ">=", start), ("date", "<=", end)]
    if max_cloud is not None:
        asked.append(("cloud_cover", "<", max_cloud))
    if box:
        asked += [("west", "<=", box[2]), ("east", ">=", box[0]), ("south", "<=", box[3]), ("north", ">=", box[1])]
    return read(spark, folder, asked)
