"""Values inside objects of an ingested dump: fields, array contents, strings, collections, references, threads."""

from __future__ import annotations

import struct
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import sized
from ..functions.text import frame_line, string_constant
from ..operators import asof, layout
from ..operators.ids import first_records
from ..sources import hprof as H
from . import commands
from .graph import Graph
from .ingest import Dump, strings_of

KINDS = {2: "object", 4: "boolean", 5: "char", 6: "real", 7: "real", 8: "integer", 9: "integer", 10: "integer", 11: "integer"}
DEFAULTS = {"object": None, "boolean": False, "char": 0, "real": 0.0, "integer": 0}
CODES = {4: ">?", 5: ">H", 6: ">f", 7: ">d", 8: ">b", 9: ">h", 10: ">i", 11: ">q"}
NUMPY = {4: "?", 5: ">u2", 6: ">f4", 7: ">f8", 8: "i1", 9: ">i2", 10: ">i4", 11: ">i8"}


def decode(data: bytes, at: int, kind: int, id_size: int):
    if kind == H.OBJECT:
        return struct.unpack_from(">Q" if id_size == 8 else ">I", data, at)[0] or None
    return struct.unpack_from(CODES[kind], data, at)[0]


def field_values(dump: Dump) -> DataFrame:
    """address, class_address (that declares the field), field, kind, i, f, b, text, ref_address: a row for each field of each instance; characters are
    code units in `i` and, where one stands alone, in `text`. Fields that the data do not reach have their type's default: no object, 0, false.
    A field is hidden if a class below its own declares one of its name."""
    layouts = {a: dump.layout_of(a) for a in dump.classes}
    id_size = dump.header.id_size

    def run(batches):
        names = ["address", "class_address", "field", "kind", "i", "f", "b", "text", "ref_address", "hidden"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows: list[tuple] = []
            for address, of, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: set[str] = set()
                for owner, name, kind, at in layouts.get(of, ()):
                    size = id_size if kind == H.OBJECT else layout.TYPE_BYTES[kind]
                    label = KINDS[kind]
                    v = decode(data, at, kind, id_size) if at + size <= len(data or b"") else DEFAULTS[label]
                    char = chr(v) if label == "char" and not 0xD800 <= v < 0xE000 else None
                    rows.append((address, owner, name, label, v if label in ("integer", "char") else None, v if label == "real" else None, v if label == "boolean" else None, char, v if label == "object" else None, name in seen))
                    seen.add(name)
            for low in range(0, len(rows), 50_000):
                part = list(zip(*rows[low : low + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names=names)

    bodies = first_records(dump.records.where(F.col("tag") == H.INSTANCE).select(F.col("id").alias("address"), "pos", "ref", "data"))
    return bodies.select("address", "ref", "data").mapInArrow(run, "address long, class_address long, field string, kind string, i long, f double, b boolean, text string, ref_address long, hidden boolean")


def array_bodies(dump: Dump) -> DataFrame:
    """address, kind (element tag, 2 for objects), length, data, ids."""
    rows = dump.records.where(F.col("tag").isin(H.OBJECT_ARRAY, H.PRIMITIVE_ARRAY)).select(F.col("id").alias("address"), "pos", F.coalesce("type", F.lit(H.OBJECT)).alias("kind"), F.col("n").alias("length"), "data", "ids")
    return first_records(rows).drop("pos")


def elements(arrays: DataFrame, first: int, count: int) -> DataFrame:
    """A slice of each array from `first` on: address, kind, and of the columns integers, reals, flags and refs (addresses, null for no object) the one
    of the kind; characters are code units among the integers."""

    def run(batches):
        import numpy as np

        for batch in batches:
            out: dict[str, list] = {"integers": [], "reals": [], "flags": [], "refs": []}
            for kind, data, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind == H.OBJECT:
                    column, values = "refs", [x or None for x in (ids or [])[first : first + count]]
                else:
                    column = {"real": "reals", "boolean": "flags"}.get(KINDS[kind], "integers")
                    values = np.frombuffer(data or b"", NUMPY[kind])[first : first + count].tolist()
                for name, rows in out.items():
                    rows.append(values if name == column else None)
            types = {"integers": pa.int64(), "reals": pa.float64(), "flags": pa.bool_(), "refs": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows, pa.list_(types[name])) for name, rows in out.items())], names=["address", "kind", *out])

    return arrays.select("address", "kind", "data", "ids").mapInArrow(run, "address long, kind int, integers array<bigint>, reals array<double>, flags array<boolean>, refs array<bigint>")


def java_strings(dump: Dump, fields: DataFrame, names: tuple[str, ...] = ("java.lang.String",)) -> DataFrame:
    """address, value of java.lang.String objects (or of string builders), by the arrays they refer to: characters, or bytes with a coder (0 Latin-1,
    1 UTF-16); an offset and a count of code units, where there are any, cut out a part."""
    strings = [a for a, c in dump.classes.items() if c.name in names]
    own = fields.join(dump.raw.objects.where(F.col("class_address").isin(strings or [-1])).select("address"), "address", "left_semi")
    wide = own.groupBy("address").agg(
        F.max(F.when(F.col("field") == "value", F.col("ref_address"))).alias("array"), F.max(F.when(F.col("field") == "coder", F.col("i"))).alias("coder"),
        F.max(F.when(F.col("field") == "offset", F.col("i"))).alias("offset"), F.max(F.when(F.col("field") == "count", F.col("i"))).alias("count"),
    )
    bodies = array_bodies(dump).where(F.col("kind").isin(5, 8)).select(F.col("address").alias("array"), "kind", "data")

    def run(batches):
        for batch in batches:
            out = []
            for coder, offset, count, kind, data in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                unit, low = 2 if kind == 5 or coder == 1 else 1, offset or 0
                part = (data or b"")[low * unit :] if count is None else (data or b"")[low * unit : (low + count) * unit]
                out.append(part.decode("utf-16-be" if kind == 5 else "utf-16-le" if coder == 1 else "latin-1", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["address", "value"])

    return wide.join(bodies, "array").select("address", "coder", "offset", "count", "kind", "data").mapInArrow(run, "address long, value string")


#: Boxed values: their class and the column of the field table that holds them, cast as Java writes them.
BOXES = {
    "java.lang.Boolean": "cast(b AS string)", "java.lang.Byte": "cast(i AS string)", "java.lang.Short": "cast(i AS string)", "java.lang.Integer": "cast(i AS string)", "java.lang.Long": "cast(i AS string)",
    "java.lang.Character": "text", "java.lang.Float": "cast(cast(f AS float) AS string)", "java.lang.Double": "cast(f AS string)",
}
BUILDERS = ("java.lang.StringBuilder", "java.lang.StringBuffer")


def big_integers(dump: Dump, graph: Graph) -> DataFrame:
    """object_id, shown of java.math.BigInteger objects: the digits of sign times magnitude, 32 bits an element from the highest."""
    own = commands.of_class(graph, "java.math.BigInteger", subclasses=True).select("object_id")
    wide = graph.fields.where("field in ('signum', 'mag') and not hidden").join(own, "object_id", "left_semi")
    wide = wide.groupBy("object_id").agg(F.max("i").alias("signum"), F.max("ref_id").alias("mag"))
    arrays = array_bodies(dump).where("kind = 10").join(graph.objects.select("address", F.col("object_id").alias("mag")), "address").select("mag", "data")

    def run(batches):
        import sys

        sys.set_int_max_str_digits(0)
        for batch in batches:
            values = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            shown = [str((sign or 0) * int.from_bytes(data or b"", "big")) for sign, data in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], names=["object_id", "shown"])

    return wide.join(arrays, "mag").select("object_id", "signum", "data").mapInArrow(run, "object_id long, shown string")


def shown_values(dump: Dump, graph: Graph, values: DataFrame) -> DataFrame:
    """object_id, shown: what objects of library classes stand for as text: strings, string builders, big integers, boxed values, and threads and thread groups by
    their names. values: the fields by address."""
    here = graph.objects.select("address", "object_id")
    builders = java_strings(dump, values, BUILDERS).join(here, "address").select("object_id", F.col("value").alias("shown"))
    out = graph.strings.select("object_id", F.col("value").alias("shown")).unionAll(builders).unionAll(big_integers(dump, graph))
    plain = graph.fields.where("not hidden")
    named = graph.objects.join(graph.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id")
    boxes = plain.where("field = 'value'").join(named.where(F.col("name").isin(*BOXES)).select("object_id", "name"), "object_id")
    out = out.unionAll(boxes.select("object_id", F.expr("CASE name " + " ".join(f"WHEN '{c}' THEN {e}" for c, e in BOXES.items()) + " END").alias("shown")))
    for kind in ("java.lang.Thread", "java.lang.ThreadGroup"):
        own = commands.of_class(graph, kind, subclasses=True).select("object_id")
        names = plain.where("field = 'name'").join(own, "object_id", "left_semi").select("object_id", "ref_id")
        out = out.unionAll(names.join(graph.strings.select(F.col("object_id").alias("ref_id"), F.col("value").alias("shown")), "ref_id").select("object_id", "shown"))
    return out


class ValuedGraph(Graph):
    """A graph with the tables that queries on values use: fields, strings, shown texts and array lengths by object id, each made when first asked for."""

    dump: Dump

    @property
    def _here(self) -> DataFrame:
        return self.objects.select("address", "object_id")

    @cached_property
    def _values(self) -> DataFrame:
        return sized(field_values(self.dump), "field-values")

    @cached_property
    def fields(self) -> DataFrame:
        target = self._here.select(F.col("address").alias("ref_address"), F.col("object_id").alias("ref_id"))
        return sized(self._values.join(self._here, "address").join(target, "ref_address", "left").select("object_id", "class_address", "field", "kind", "i", "f", "b", "text", "ref_id", "hidden"), "fields")

    @cached_property
    def strings(self) -> DataFrame:
        return sized(java_strings(self.dump, self._values).join(self._here, "address").select("object_id", "value"), "strings")

    @cached_property
    def lengths(self) -> DataFrame:
        return sized(array_bodies(self.dump).join(self._here, "address").select("object_id", F.col("length").cast("bigint").alias("length")), "lengths")

    @cached_property
    def shown(self) -> DataFrame:
        return sized(shown_values(self.dump, self, self._values), "shown")


def with_values(dump: Dump, graph: Graph) -> ValuedGraph:
    """graph with the tables that queries on values use."""
    out = ValuedGraph.__new__(ValuedGraph)
    out.__dict__ = graph.__dict__
    out.dump = dump
    return out


def typed_view(graph: Graph, name: str, paths: list[str], subclasses: bool = True) -> DataFrame:
    """object_id and a column for each path of fields from objects of a class, by left joins."""
    from .oql import Lowering, Node

    low = Lowering(graph, commands.of_class(graph, name, subclasses), "o")
    columns = [F.col("__o").alias("object_id")]
    for path in paths:
        node = Node("name", "o")
        for step in path.split("."):
            node = Node("step", step, (node,))
        columns.append(low.value(node).column.alias(path))
    return low.df.select(*columns)


def referents(graph: Graph, kind: str = "java.lang.ref.Reference") -> DataFrame:
    """src, dst of the `referent` fields of reference objects of a class and its subclasses."""
    own = commands.of_class(graph, kind, subclasses=True).select("object_id")
    return graph.fields.where("field = 'referent' and ref_id is not null").join(own, "object_id", "left_semi").select(F.col("object_id").alias("src"), F.col("ref_id").alias("dst"))


def reference_statistics(graph: Graph, kind: str) -> DataFrame:
    """Weak, soft, phantom or finalizer statistics: what such references point at by class, and what nothing else reaches."""
    return commands.reference_statistics(graph, referents(graph, kind))


def declared(graph: Graph, field: str, owner: str) -> DataFrame:
    """object_id, ref_id of a field as declared by one class; a subclass may declare another of that name."""
    owners = graph.raw.classes.where(F.col("name") == owner).select(F.col("address").alias("class_address"))
    return graph.fields.where(F.col("field") == field).join(F.broadcast(owners), "class_address", "left_semi").select("object_id", "ref_id")


def finalizers(graph: Graph) -> DataFrame:
    """object_id, referent, queued of java.lang.ref.Finalizer objects. The queue is linked by the `next` that Reference declares; the finalizers' own
    `next` links all of them, finalized or not."""
    own = commands.of_class(graph, "java.lang.ref.Finalizer", subclasses=True).select("object_id")
    referent = declared(graph, "referent", "java.lang.ref.Reference").withColumnRenamed("ref_id", "referent")
    queue = declared(graph, "next", "java.lang.ref.Reference").select("object_id", F.col("ref_id").isNotNull().alias("queued"))
    return own.join(referent, "object_id", "left").join(queue, "object_id", "left").select("object_id", "referent", F.coalesce("queued", F.lit(False)).alias("queued"))


def finalizer_queue(graph: Graph) -> DataFrame:
    """object_id of objects whose finalizer waits in the queue."""
    return finalizers(graph).where("queued and referent is not null").select(F.col("referent").alias("object_id")).distinct()


def array_fill_ratios(dump: Dump, buckets: int = 5) -> DataFrame:
    """bucket (0 empty to buckets - 1 full), n_objects, n_elements of object arrays by the share of elements that refer to something."""
    arrays = array_bodies(dump).where(F.col("kind") == H.OBJECT).where("length > 0")
    used = F.size(F.filter("ids", lambda x: x != 0))
    bucket = F.least(F.lit(buckets - 1), F.floor(used * buckets / F.col("length"))).cast("int")
    return arrays.select(bucket.alias("bucket"), used.alias("used")).groupBy("bucket").agg(F.count("*").alias("n_objects"), F.sum("used").cast("bigint").alias("n_elements"))


def map_entries(graph: Graph, map_class: str = "java.util.HashMap", node_class: str = "java.util.HashMap$Node") -> DataFrame:
    """map_id, slot, node_id, key_id, value_id: chains of nodes hang in the slots of a map's table and are walked link by link, all maps at once."""
    tables = typed_view(graph, map_class, ["table"]).where("`table` is not null").select(F.col("object_id").alias("map_id"), F.col("table").alias("src"))
    heads = graph.edges.where("seq > 0").join(tables, "src").select("map_id", F.col("dst").alias("node_id"))
    nodes = sized(typed_view(graph, node_class, ["key", "value", "next", "hash"]).withColumnRenamed("object_id", "node_id"), "map-nodes")
    # a node's chain begins at a slot, so the head's id names the slot
    now = heads.withColumn("slot", F.col("node_id"))
    out = None
    while True:
        found = sized(now.join(nodes, "node_id").select("map_id", "slot", "node_id", F.col("key").alias("key_id"), F.col("value").alias("value_id"), "next"), "map-chain")
        out = found.drop("next") if out is None else out.unionAll(found.drop("next"))
        now = found.where("next is not null").select("map_id", F.col("next").alias("node_id"), "slot")
        if now.isEmpty():
            return out


def map_collisions(graph: Graph) -> DataFrame:
    return commands.collision_ratio(map_entries(graph), "map_id", F.col("slot"))


def collections(graph: Graph, name: str = "java.util.ArrayList", size: str = "size", table: str = "elementData") -> DataFrame:
    """object_id, size, capacity."""
    rows = typed_view(graph, name, [size, table])
    capacity = graph.lengths.select(F.col("object_id").alias(table), F.col("length").alias("capacity"))
    return rows.join(capacity, table, "left").select("object_id", F.col(size).alias("size"), F.coalesce("capacity", F.lit(0)).alias("capacity"))


def constant_arrays(dump: Dump) -> DataFrame:
    """address, kind, length of primitive arrays whose elements are all equal, found without decoding: every element's bytes equal the first one's."""
    width = F.create_map(*[F.lit(x) for pair in layout.TYPE_BYTES.items() for x in pair])
    arrays = array_bodies(dump).where(F.col("kind") != H.OBJECT).where("length > 0").withColumn("w", width[F.col("kind")])
    digits = F.hex("data")
    unit = F.substring(digits, F.lit(1), F.col("w") * 2)
    return arrays.where(digits == F.repeat(unit, F.col("length").cast("int"))).select("address", "kind", "length")


#: Sections of the component report on collections: class, fields of the size and of the table.
COLLECTIONS = {"java.util.ArrayList": ("size", "elementData"), "java.util.HashMap": ("size", "table"), "java.util.Hashtable": ("count", "table"), "java.util.Vector": ("elementCount", "elementData")}
REFERENCES = {"soft references": "java.lang.ref.SoftReference", "weak references": "java.lang.ref.WeakReference", "phantom references": "java.lang.ref.PhantomReference"}


def component_report_top(graph: Graph, percent: float = 1.0, by: str = "loader_address") -> DataFrame:
    """component, section, what, n_objects, used_size for the components (loaders, or packages) that keep `percent` of the heap or more. All sections but `instances` look at
    everything a component keeps: `instances` (its own objects by class), `retained` (by class), `duplicate strings` (texts that several strings have), `collections` (by class and fifth of
    their capacity in use: 0 empty, 5 over four fifths), `map collisions` (entries of maps that share a slot with another, by class of the map), soft, weak and phantom references (their
    referents by class) and `finalizers` (referents by class). All components go through each section together."""
    members = sized(commands.components(graph, percent, by), "components")
    kept = sized(commands.kept_by(graph, members), "kept")
    named = sized(graph.objects.join(graph.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id").select("object_id", "name", "used_size"), "named")
    there = set(r["name"] for r in graph.classes.select("name").where(F.col("name").isin(*COLLECTIONS)).collect())

    def section(label: str, rows: DataFrame, what: Column) -> DataFrame:
        """rows: part, used_size and what `what` needs."""
        return rows.groupBy("part", what.alias("what")).agg(F.count("*").alias("n_objects"), F.sum("used_size").cast("bigint").alias("used_size")).select(F.col("part").alias("component"), F.lit(label).alias("section"), "what", "n_objects", "used_size")

    inside = sized(kept.join(named, "object_id"), "kept-named")
    out = [section("instances", members.join(named, "object_id"), F.col("name")), section("retained", inside, F.col("name"))]
    out.append(section("duplicate strings", inside.join(graph.strings, "object_id"), F.col("value")).where("n_objects > 1"))
    for kind, (size, table) in COLLECTIONS.items():
        if kind in there:
            fifth = F.when(F.col("capacity") > 0, F.least(F.lit(5), F.ceil(F.col("size") * 5 / F.col("capacity")))).otherwise(F.lit(0))
            out.append(section("collections", inside.join(collections(graph, kind, size, table), "object_id"), F.concat(F.lit(kind + " "), fifth.cast("string"))))
    for kind, node in (("java.util.HashMap", "java.util.HashMap$Node"), ("java.util.Hashtable", "java.util.Hashtable$Entry")):
        if kind in there:
            later = commands.collision_ratio(map_entries(graph, kind, node), "map_id", F.col("slot")).select(F.col("map_id").alias("object_id"), (F.col("n_entries") - F.col("n_slots")).alias("n"))
            shared = inside.join(later, "object_id").groupBy("part", "name").agg(F.sum("n").alias("n_objects"), F.sum("used_size").cast("bigint").alias("used_size")).where("n_objects > 0")
            out.append(shared.select(F.col("part").alias("component"), F.lit("map collisions").alias("section"), F.col("name").alias("what"), "n_objects", "used_size"))
    for label, kind in REFERENCES.items():
        aimed = referents(graph, kind).select(F.col("dst").alias("object_id")).distinct()
        out.append(section(label, inside.join(aimed, "object_id"), F.col("name")))
    if not graph.classes.where("name = 'java.lang.ref.Finalizer'").isEmpty():
        waiting = finalizers(graph).select(F.col("referent").alias("object_id")).where("object_id is not null").distinct()
        out.append(section("finalizers", inside.join(waiting, "object_id"), F.col("name")))
    return reduce(DataFrame.unionAll, out)


def system_properties(graph: Graph) -> DataFrame:
    """key, value of the string entries of all maps that java.lang.System holds."""
    holder = commands.of_class(graph, "java.util.Properties", subclasses=True).select(F.col("object_id").alias("map_id"))
    text = graph.strings
    entries = map_entries(graph, "java.util.Hashtable", "java.util.Hashtable$Entry").join(holder, "map_id", "left_semi")
    keys, values = text.select(F.col("object_id").alias("key_id"), F.col("value").alias("key")), text.select(F.col("object_id").alias("value_id"), F.col("value").alias("value"))
    return entries.join(keys, "key_id").join(values, "value_id", "left").select("key", "value").distinct()


# threads


def stack_frames(dump: Dump) -> DataFrame:
    """frame_id, line: formatted frames. Strings are those known when the frame was recorded; the class is the one its serial number stands for,
    none after it is unloaded."""
    records, strings = dump.records, strings_of(dump.records)
    frames = records.where(F.col("tag") == H.FRAME).select("pos", F.col("id").alias("frame_id"), F.get("ids", F.lit(0)).alias("m"), F.get("ids", F.lit(1)).alias("s"), F.get("ids", F.lit(2)).alias("f"), "serial", F.col("n").alias("line_no"))
    for column, name in (("m", "method"), ("s", "signature"), ("f", "file")):
        frames = asof.with_string(frames, strings, column, name)
    names = dump.records.sparkSession.createDataFrame([(a, c.name) for a, c in dump.classes.items()] or [(-1, "")], "id long, name string")
    unloaded = records.where(F.col("tag") == H.UNLOAD_CLASS).select("serial").distinct()
    loads = records.where(F.col("tag") == H.LOAD_CLASS).groupBy("serial").agg(F.max_by("id", "pos").alias("id")).join(names, "id").join(unloaded, "serial", "left_anti").select("serial", "name")
    named = frames.join(loads, "serial", "left")
    file = F.when(F.col("f") == 0, F.lit("")).otherwise(F.col("file"))
    line = frame_line(F.coalesce("name", F.lit("UnknownClass")), string_constant(F.col("m"), F.col("method")), string_constant(F.col("s"), F.col("signature")), file, F.col("line_no"))
    last = named.select("frame_id", "pos", line.alias("line"))
    return last.groupBy("frame_id").agg(F.max_by("line", "pos").alias("line"))


def thread_stacks(dump: Dump) -> DataFrame:
    """nr, thread_address, lines, locals: each stack trace of a known thread in file order, with the locals of that thread."""
    records = dump.records
    traces = records.where(F.col("tag") == H.TRACE).groupBy("trace").agg(F.min("pos").alias("nr"), F.max_by(F.struct("serial", "ids"), "pos").alias("t")).select("nr", "t.serial", "t.ids")
    threads = records.where(F.col("tag") == H.ROOT_THREAD).groupBy("serial").agg(F.max_by("id", "pos").alias("thread_address"))
    known = sized(traces.join(threads, "serial"), "traces")
    lines = known.select("nr", F.posexplode("ids").alias("at", "frame_id")).join(stack_frames(dump), "frame_id")
    lines = lines.groupBy("nr").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    local = records.where(F.col("tag").isin(H.ROOT_FRAME, H.ROOT_JNI_LOCAL)).select("serial", "pos", F.col("id").alias("address"), F.col("n").cast("int").alias("frame"))
    local = local.groupBy("serial").agg(F.array_sort(F.collect_list(F.struct("pos", "address", "frame"))).alias("locals"))
    return known.join(lines, "nr", "left").join(local, "serial", "left").select("nr", "thread_address", "lines", "locals")


def threads_text(dump: Dump) -> DataFrame:
    """nr, text: the paragraphs of a `.threads` file in order. A dump with one stack trace or none has no such file."""
    stacks = thread_stacks(dump)
    if dump.records.where(F.col("tag") == H.TRACE).select("trace").distinct().limit(2).count() <= 1:
        return stacks.limit(0).select("nr", F.lit("").alias("text"))

    def hexed(c: Column) -> Column:
        return F.concat(F.lit("0x"), F.lower(F.hex(c)))

    shown = F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x: F.concat(x, F.lit("\r\n"))), "")
    held = F.transform("locals", lambda x: F.concat(F.lit("    objectId="), hexed(x["address"]), F.lit(", line="), x["frame"].cast("string"), F.lit("\n")))
    body = F.concat(F.lit("Thread "), hexed(F.col("thread_address")), F.lit("\n"), shown, F.lit("\n  locals:\n"), F.array_join(F.coalesce(held, F.array().cast("array<string>")), ""), F.lit("\n"))
    return stacks.select("nr", body.alias("text")).orderBy("nr")


def thread_overview(dump: Dump, graph: Graph) -> DataFrame:
    """thread_address, used_size, retained, depth of the stack, n_locals."""
    stacks = thread_stacks(dump).groupBy("thread_address").agg(F.max(F.size(F.coalesce("lines", F.array().cast("array<string>")))).alias("depth"), F.max(F.size(F.coalesce("locals", F.array().cast("array<struct<pos: bigint, address: bigint, frame: int>>")))).alias("n_locals"))
    here = graph.objects.select(F.col("address").alias("thread_address"), "object_id", "used_size").join(graph.dominators.select("object_id", "retained"), "object_id")
    return stacks.join(here, "thread_address", "left").select("thread_address", "used_size", "retained", "depth", "n_locals")
