"""HPROF records to raw heap tables.

The class table is collected (classes are code, thousands at most); everything that grows with the heap stays a DataFrame: instances are
decoded by class layouts in Arrow batches, addresses are resolved by joins.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import rows_of, sized
from ..functions.text import class_name, string_constant
from ..operators import asof, layout
from ..operators.ids import first_records
from ..schemas import RawHeap
from ..sources import hprof as H

JAVA_CLASS, JAVA_LOADER, JAVA_OBJECT = "java.lang.Class", "java.lang.ClassLoader", "java.lang.Object"
STICKY = 5


@dataclass
class ClassInfo:
    address: int
    name: str
    super_address: int = 0
    loader_address: int = 0
    fields: list[tuple[str, int]] = field(default_factory=list)
    statics: list[tuple[str, int, int | None, bytes]] = field(default_factory=list)
    refs: list[int] = field(default_factory=list)  # of the first dump
    dumped: bool = False


@dataclass
class Dump:
    header: H.Header
    records: DataFrame
    classes: dict[int, ClassInfo]
    ref_size: int
    step: int
    raw: RawHeap
    instance_size: dict[int, int]

    def layout_of(self, address: int) -> list[tuple[int, str, int, int]]:
        return layout.field_layout({a: {"fields": c.fields, "super_address": c.super_address} for a, c in self.classes.items()}, address, self.header.id_size)


def strings_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("tag") == H.STRING).select(F.col("id").alias("string_id"), "pos", F.col("text").alias("value"))


def read_classes(records: DataFrame) -> dict[int, ClassInfo]:
    """The last dump of a class counts, the references are the first one's. Names are those known when the class is dumped,
    field names those known then; classes that are loaded and never dumped are empty."""
    strings = strings_of(records)
    loads = records.where(F.col("tag") == H.LOAD_CLASS).select("id", "pos", "ref")
    named = asof.with_string(loads, strings, "ref", "value").select("id", "pos", class_name(string_constant(F.col("ref"), F.col("value"))).alias("name"))
    dumps = records.where(F.col("tag") == H.CLASS_DUMP).select("id", "pos", "super_id", "loader_id", "statics", "fields")
    with_name = asof.latest_before(dumps, named, "id", "pos", "name", "name")
    names = dumps.select("pos", F.explode(F.concat(F.transform("fields", lambda x: x["name_id"]), F.transform("statics", lambda x: x["name_id"]))).alias("name_id")).distinct()
    known = {(r["pos"], r["name_id"]): r["value"] for r in asof.with_string(names, strings, "name_id", "value").collect() if r["value"] is not None}
    classes: dict[int, ClassInfo] = {}
    for r in sorted(with_name.collect(), key=lambda r: r["pos"]):
        def text(i: int, pos: int = r["pos"]) -> str:
            return known.get((pos, i), "" if i == 0 else f"field_{i}")

        first = classes.get(r["id"])
        refs = first.refs if first else [s["value"] for s in r["statics"] if s["type"] == H.OBJECT and s["value"]]
        if not first:
            refs = [r["super_id"], r["loader_id"], *refs]
        classes[r["id"]] = ClassInfo(
            r["id"], r["name"] or f"Class@{r['id']:x}", r["super_id"], r["loader_id"], [(text(f["name_id"]), f["type"]) for f in r["fields"]],
            [(text(s["name_id"]), s["type"], s["value"], bytes(s["bits"] or b"")) for s in r["statics"]], refs, True,
        )
    for r in sorted(named.collect(), key=lambda r: r["pos"]):
        if r["id"] not in classes or not classes[r["id"]].dumped:
            classes[r["id"]] = ClassInfo(r["id"], r["name"])
    return classes


def add_fake_classes(classes: dict[int, ClassInfo], element_types: list[int], taken: DataFrame, step: int) -> None:
    """Classes that a heap needs and the dump lacks, at the first multiples of the alignment where nothing is. taken: address."""
    object_address = next((c.address for c in classes.values() if c.name == JAVA_OBJECT), 0)
    present = {c.name for c in classes.values()}
    missing = [n for n in (JAVA_CLASS, JAVA_LOADER, *(f"{layout.TYPE_NAMES[t]}[]" for t in sorted(element_types))) if n not in present]
    at, window = 0, 256
    used: set[int] = set()
    looked = 0
    for name in missing:
        while True:
            at += step
            if at > looked:
                looked = at + window * step
                used = {r["address"] for r in taken.where(F.col("address").between(at, looked)).select("address").distinct().collect()}
            if at not in classes and at not in used:
                break
        classes[at] = ClassInfo(at, name, object_address)


def instance_refs(instances: DataFrame, layouts: dict[int, list[list[tuple[int, int]]]], id_size: int) -> DataFrame:
    """src_address, seq, dst_address of the references in instance data. layouts: class -> for it and each superclass, (type tag, bytes). Data
    that end early are walked field by field: what does not fit ends the walk through that class, and the next superclass goes on from there."""

    def run(batches):
        offsets: dict[int, tuple[list[int], int]] = {}
        for address, levels in layouts.items():
            at, refs = 0, []
            for level in levels:
                for kind, size in level:
                    if kind == H.OBJECT:
                        refs.append(at)
                    at += size
            offsets[address] = (refs, at)
        code = ">Q" if id_size == 8 else ">I"
        for batch in batches:
            src, nr, dst = [], [], []
            for address, of, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of not in offsets or not data:
                    continue
                refs, total = offsets[of]
                if total > len(data):
                    refs, at = [], 0
                    for level in layouts[of]:
                        for kind, size in level:
                            if at + size > len(data):
                                break
                            if kind == H.OBJECT:
                                refs.append(at)
                            at += size
                for k, at in enumerate(refs):
                    value = struct.unpack_from(code, data, at)[0]
                    if value:
                        src.append(address)
                        nr.append(k + 1)
                        dst.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(nr, pa.int64()), pa.array(dst, pa.int64())], names=["src_address", "seq", "dst_address"])

    return instances.select("address", "ref", "data").mapInArrow(run, "src_address long, seq long, dst_address long")


def ingest(spark: SparkSession, path: str) -> Dump:
    H.register(spark)
    header, _ = H.segments(H.checked_path(path))
    id_size = header.id_size
    records = sized(spark.read.format("hprof").load(path), "hprof-records")
    classes = read_classes(records)
    class_rows = F.broadcast(spark.createDataFrame([(a,) for a in classes] or [(-1,)], "address long"))

    bodies = records.where(F.col("tag").isin(H.INSTANCE, H.OBJECT_ARRAY, H.PRIMITIVE_ARRAY)).where("id <> 0").join(class_rows.withColumnRenamed("address", "id"), "id", "left_anti")
    bodies = first_records(bodies.select(F.col("id").alias("address"), "pos", "tag", "ref", "n", "type", "data", "ids"))
    addresses = bodies.select("address").unionAll(class_rows.where("address > 0"))
    step = layout.object_alignment(addresses)
    arrays = records.where(F.col("tag") == H.OBJECT_ARRAY).select("pos", F.col("id").alias("address"), F.col("n").alias("length"))
    ref_size = 4 if id_size == 8 and layout.overlapping_arrays(arrays).first()["compressed"] else id_size
    element_types = [r["type"] for r in bodies.where(F.col("tag") == H.PRIMITIVE_ARRAY).select("type").distinct().collect()]
    add_fake_classes(classes, element_types, bodies.select("address"), step)

    by_name: dict[str, int] = {}
    for c in classes.values():
        by_name.setdefault(c.name, c.address)
    java_class, java_loader = by_name[JAVA_CLASS], by_name[JAVA_LOADER]
    plain = [{"address": c.address, "name": c.name, "super_address": c.super_address, "fields": [t for _, t in c.fields]} for c in classes.values()]
    sizes = layout.instance_sizes(plain, id_size, ref_size, step)
    table = spark.createDataFrame([(c.address, sizes[c.address]) for c in classes.values()], "class_address long, class_size long")
    table = F.broadcast(table)

    # objects: class objects, the system loader, instances and arrays
    class_objects = [(a, java_class, layout.class_object_size([t for _, t, _, _ in c.statics], ref_size, step), -1, False) for a, c in classes.items()]
    loader = (0, java_loader, sizes[java_loader] or 4 * id_size, -1, False)
    fixed = spark.createDataFrame([loader, *class_objects], "address long, class_address long, used_size long, pos long, is_array boolean")
    instances = bodies.where(F.col("tag") == H.INSTANCE).withColumn("class_address", F.col("ref")).join(table, "class_address", "left")
    of_instance = instances.select(
        "address", F.when(F.col("class_size").isNull(), java_class).otherwise(F.col("class_address")).alias("class_address"),
        layout.instance_used_size(F.coalesce("class_size", F.lit(0)), F.col("n"), id_size, ref_size, step).alias("used_size"), "pos", F.lit(False).alias("is_array"),
    )
    elements = bodies.where(F.col("tag") == H.OBJECT_ARRAY).withColumn("class_address", F.col("ref")).join(table, "class_address", "left")
    of_elements = elements.select(
        "address", F.when(F.col("class_size").isNull(), 0).otherwise(F.col("class_address")).cast("bigint").alias("class_address"),
        layout.object_array_size(F.col("n"), id_size, ref_size, step).alias("used_size"), "pos", F.lit(True).alias("is_array"),
    )
    kinds = F.create_map(*[F.lit(x) for t in layout.TYPE_BYTES for x in (t, by_name.get(f"{layout.TYPE_NAMES[t]}[]", 0))])
    of_primitives = bodies.where(F.col("tag") == H.PRIMITIVE_ARRAY).select(
        "address", kinds[F.col("type")].cast("bigint").alias("class_address"),
        layout.primitive_array_size(F.col("n"), F.col("type"), id_size, ref_size, step).alias("used_size"), "pos", F.lit(True).alias("is_array"),
    )
    objects = sized(reduce(DataFrame.unionByName, [fixed, of_instance, of_elements, of_primitives]), "raw-objects")

    roots, thread_roots = read_roots(spark, records, classes)
    # references: the class first, then the object's own in order, then what a thread holds
    layouts = {}
    for a in classes:
        levels, up = [], a
        while up in classes:
            levels.append([(t, id_size if t == H.OBJECT else layout.TYPE_BYTES[t]) for _, t in classes[up].fields])
            up = classes[up].super_address
        layouts[a] = levels
    own = instance_refs(bodies.where(F.col("tag") == H.INSTANCE), layouts, id_size)
    in_arrays = bodies.where(F.col("tag") == H.OBJECT_ARRAY).select(F.col("address").alias("src_address"), F.posexplode("ids").alias("at", "dst_address"))
    in_arrays = in_arrays.where("dst_address <> 0").select("src_address", (F.col("at") + 1).cast("bigint").alias("seq"), "dst_address")
    of_bodies = objects.where("pos >= 0 or address = 0").select(F.col("address").alias("src_address"), F.lit(0).cast("bigint").alias("seq"), F.col("class_address").alias("dst_address"))
    class_refs = []
    no_loaders = absent(objects, {c.refs[1] for c in classes.values() if c.dumped and c.refs[1]})  # the system loader stands for them
    for c in classes.values():
        if c.dumped:
            up, by, *statics = c.refs
            class_refs += [(c.address, i, t) for i, t in enumerate([java_class, *([up] if up else []), 0 if by in no_loaders else by, *statics])]
    of_classes = spark.createDataFrame(class_refs or [(-1, 0, -1)], "src_address long, seq long, dst_address long")
    held = thread_roots.select(F.col("thread_address").alias("src_address"), F.lit(1 << 40).cast("bigint").alias("seq"), F.col("address").alias("dst_address"), "root_seq")
    held = held.groupBy("src_address", "dst_address").agg((F.lit(1 << 40) + F.min("root_seq")).alias("seq")).join(objects.where("pos >= 0").select(F.col("address").alias("src_address")), "src_address", "left_semi")
    refs = reduce(DataFrame.unionByName, [of_bodies, own, in_arrays, of_classes, held.select("src_address", "seq", "dst_address")])
    heap = RawHeap(objects, refs, spark.createDataFrame([(c.address, c.name, c.super_address, c.loader_address) for c in classes.values()], "address long, name string, super_address long, loader_address long"), roots, rows_of(objects))
    return Dump(header, records, classes, ref_size, step, heap, sizes)


def absent(objects: DataFrame, addresses: set[int]) -> set[int]:
    """Those of a few addresses where no object is."""
    return addresses - {r["address"] for r in objects.where(F.col("address").isin(sorted(addresses) or [-1])).select("address").distinct().collect()}


def read_roots(spark: SparkSession, records: DataFrame, classes: dict[int, ClassInfo]) -> tuple[DataFrame, DataFrame]:
    """All roots, and those that a thread holds. Without any sticky class in the dump the classes of the system loader are roots."""
    tags = [H.ROOT_UNKNOWN, H.ROOT_JNI_GLOBAL, H.ROOT_JNI_LOCAL, H.ROOT_FRAME, H.ROOT_NATIVE_STACK, H.ROOT_STICKY, H.ROOT_BLOCK, H.ROOT_MONITOR, H.ROOT_THREAD]
    rows = records.where(F.col("tag").isin(tags)).select(F.col("id").alias("address"), (F.col("tag") - H.SUB).alias("root_type"), F.col("serial").alias("thread_serial"), "pos")
    threads = records.where(F.col("tag") == H.ROOT_THREAD).select(F.col("id").alias("address"), F.col("serial").alias("thread_serial"), "pos")
    found = sized(asof.with_thread_address(rows, threads).select("address", "root_type", "thread_address", F.col("pos").alias("root_seq")), "raw-roots")
    if found.where(F.col("root_type") == STICKY).isEmpty():
        rooted = {r["address"] for r in found.where(F.col("address").isin(sorted(classes) or [-1])).select("address").collect()}
        end = 1 << 60
        extra = [(a, STICKY, 0, end + i) for i, (a, c) in enumerate(sorted(classes.items())) if c.loader_address == 0 and not c.name.endswith("[]") and a > 0 and a not in rooted]
        if extra:
            found = found.unionByName(spark.createDataFrame(extra, "address long, root_type int, thread_address long, root_seq long"))
    return found, found.where("thread_address <> 0")
