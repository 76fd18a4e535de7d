"""A graph saved as Parquet tables with a manifest that is written last, and opened again without work.

A folder without a manifest is no snapshot: it is not opened, and saving replaces it only if nothing but a snapshot's tables lie there.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_size
from ..operators import aggregates
from .graph import Graph

TABLES = ("objects", "edges", "classes", "roots", "dominators", "class_retained", "unreachable_histogram")
#: Of graphs with values (views.with_values), and how they lie: paths of fields read one field's rows.
VALUES = {"fields": ["field", "object_id"], "strings": ["object_id"], "lengths": ["object_id"], "shown": ["object_id"]}
MANIFEST = "manifest"
VERSION = 1


class SnapshotError(ValueError):
    pass


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(folder, MANIFEST, "_SUCCESS"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def save(graph: Graph, folder: str, info: dict | None = None, overwrite: bool = False) -> Snapshot:
    """Objects, classes and dominators lie sorted by id, so a lookup reads few row groups; references by source. All is written beside the
    folder and takes its place when it is whole; a folder with other files in it is not touched."""
    spark = graph.raw.objects.sparkSession
    if exists(spark, folder) and not overwrite:
        raise SnapshotError(f"{folder} holds a snapshot")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    strange = [f.getPath().getName() for f in store.listStatus(target)] if store.exists(target) else []
    strange = sorted(set(strange) - {*TABLES, *VALUES, MANIFEST})
    if strange:
        raise SnapshotError(f"{folder} holds other files: {strange[0]}")
    whole, folder = folder, f"{folder.rstrip('/')}.{uuid.uuid4().hex}.unfinished"
    counts = {}
    tables = [*TABLES, *(name for name in VALUES if getattr(graph, name, None) is not None)]
    for name in tables:
        table = getattr(graph, name)
        key = VALUES.get(name) or next(([c] for c in ("object_id", "src", "class_id") if c in table.columns), None)
        if key:
            table = table.repartitionByRange(*key).sortWithinPartitions(*([*key, "seq"] if key == ["src"] else key))
        path = posixpath.join(folder, name)
        table.write.parquet(path)
        counts[name] = spark.read.parquet(path).count()
    facts = {
        "version": VERSION, "tables": tables, "id": uuid.uuid4().hex, "n_objects": counts["objects"], "n_classes": counts["classes"], "n_edges": counts["edges"],
        "n_references": graph.n_references, "n_roots": graph.roots.select("object_id").distinct().count(), "total_heap": graph.total, **(info or {}),
    }
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.text(posixpath.join(folder, MANIFEST))
    store.delete(target, True)
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(folder), target):
        raise SnapshotError(f"{folder} could not be moved to {whole}")
    return Snapshot(spark, whole)


def dump_info(dump) -> dict:
    """Facts of the dump itself: version, creation time, sizes of ids and references, alignment."""
    h = dump.header
    return {"format": h.version, "id_size": h.id_size, "created_ms": h.created_ms, "ref_size": dump.ref_size, "object_align": dump.step, "compressed_oops": h.id_size == 8 and dump.ref_size == 4}


class Snapshot:
    """Lookups in a saved graph. Each answers for a table of ids at once."""

    def __init__(self, spark: SparkSession, folder: str):
        if not exists(spark, folder):
            raise SnapshotError(f"{folder} holds no finished snapshot")
        self.spark, self.folder = spark, folder
        self.facts = json.loads(spark.read.text(posixpath.join(folder, MANIFEST)).first()[0])
        if self.facts["version"] != VERSION:
            raise SnapshotError(f"version {self.facts['version']}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or (name in VALUES and name in self.facts.get("tables", ())):
            return self.spark.read.parquet(posixpath.join(self.folder, name))
        raise AttributeError(name)

    def views(self, prefix: str = "") -> None:
        for name in self.facts.get("tables", TABLES):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    @property
    def total(self) -> int:
        return self.facts["total_heap"]

    @cached_property
    def read_edges(self) -> DataFrame:
        from ..operators import edges

        return edges.with_class_first(self.edges, self.objects)

    def objects_at(self, addresses: list[int]) -> DataFrame:
        return self.objects.where(F.col("address").isin(addresses))

    def ids_between(self, low: int, high: int) -> DataFrame:
        return self.objects.where(F.col("object_id").between(low, high))

    def outbound(self, object_id: int) -> DataFrame:
        return self.read_edges.where(F.col("src") == object_id).orderBy("seq").select("dst")

    def inbound(self, object_id: int) -> DataFrame:
        return self.edges.where(F.col("dst") == object_id).orderBy((F.col("seq") > 0).cast("int"), "src").select("src")

    def instances(self, class_id: int) -> DataFrame:
        return self.objects.where(F.col("class_id") == class_id).orderBy("object_id").select("object_id")

    def dominator(self, object_id: int) -> int | None:
        row = self.dominators.where(F.col("object_id") == object_id).select("idom").first()
        return row and row["idom"]

    def dominated(self, object_id: int) -> DataFrame:
        return self.dominators.where(F.col("idom") == object_id).orderBy(F.desc("retained"), "object_id").select("object_id", "retained")

    def retained_size(self, object_id: int) -> int | None:
        row = self.dominators.where(F.col("object_id") == object_id).select("retained").first()
        return row and row["retained"]

    def overview(self) -> DataFrame:
        return self.spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in sorted(self.facts.items())], "key string, value string")

    @cached_property
    def histogram(self) -> DataFrame:
        return aggregates.histogram(self.objects, self.classes, self.class_retained)


@dataclass
class Descriptor:
    """A properties file beside a dump: dump.file, snapshot.dir, memory.budget. Relative paths start at the file's folder."""

    path: Path
    snapshot: str
    dump: str | None
    memory_budget: int = 1 << 30

    SUFFIX = ".heapscope"

    @classmethod
    def read(cls, path: str) -> Descriptor:
        """A descriptor, or the defaults for a bare dump."""
        p = Path(path).absolute()
        default = str(p.parent / f"{p.stem}.snapshot")
        if p.suffix != cls.SUFFIX:
            return cls(p, default, str(p))
        props = {}
        for line in p.read_text().splitlines():
            key, eq, value = line.partition("=")
            if eq and not key.lstrip().startswith("#"):
                props[key.strip()] = value.strip()
        dump = props.get("dump.file")
        try:
            budget = parse_size(props["memory.budget"]) if props.get("memory.budget") else 1 << 30
        except ValueError:
            budget = 1 << 30
        return cls(p, str(p.parent / props["snapshot.dir"]) if props.get("snapshot.dir") else default, str(p.parent / dump) if dump else None, budget)

    def write(self) -> None:
        self.path.write_text(f"dump.file={self.dump or ''}\nsnapshot.dir={self.snapshot}\nmemory.budget={self.memory_budget}\n")


def open_or_ingest(spark: SparkSession, path: str) -> Snapshot:
    """Opens the snapshot of a descriptor or dump, ingesting the dump with its values first if there is none."""
    from .ingest import ingest
    from .views import with_values

    d = Descriptor.read(path)
    if not exists(spark, d.snapshot):
        if not d.dump:
            raise SnapshotError(f"{path} names no dump and holds no snapshot")
        dump = ingest(spark, d.dump)
        save(with_values(dump, Graph(dump.raw)), d.snapshot, dump_info(dump), overwrite=True)
    return Snapshot(spark, d.snapshot)
