"""Registered queries over a heap dump in HPROF format, which is written from the test tables, and their SQL over those tables."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_folder
from ..functions.text import root_kind
from ..operators import aggregates
from ..sources import sample
from . import commands, oql, views
from .graph import Graph
from .ingest import Dump, ingest

_dumps: dict[tuple, tuple[Dump, Graph]] = {}


def dump(spark: SparkSession, sf_dir: str) -> tuple[Dump, Graph]:
    """The dump of a folder's tables and its graph; queries of one session share them as long as the folder does not change."""
    from .registry import stamp

    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir))
    if key not in _dumps:
        path = sample.write(spark, sf_dir, posixpath.join(shared_folder(spark), f"sample-{key[2] & 0xFFFFFFFFFFFF:x}.hprof"))
        found = ingest(spark, path)
        _dumps[key] = found, views.with_values(found, Graph(found.raw))
    return _dumps[key]


def of_dump(f: Callable[[Dump, Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*dump(spark, sf_dir))


def _at(g: Graph, rows: DataFrame, column: str = "object_id", as_name: str = "address") -> DataFrame:
    """rows with the address of an object in place of its id; -1 and null stay."""
    here = g.objects.select(F.col("object_id").alias("__id"), F.col("address").alias("__at"))
    joined = rows.join(here, F.col(column) == F.col("__id"), "left")
    return joined.select(*(c for c in rows.columns if c != column), F.coalesce("__at", F.when(F.col(column) < 0, F.col(column))).alias(as_name))


def _named(g: Graph) -> DataFrame:
    return g.objects.join(g.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id")


def record_counts(d: Dump, g: Graph) -> DataFrame:
    return d.records.groupBy("tag").agg(F.count("*").alias("n"))


def all_objects(d: Dump, g: Graph) -> DataFrame:
    names = g.all_classes.select(F.col("object_id").alias("class_id"), "name")
    return g.all_objects.join(names, "class_id").select("address", "name", "used_size")


def references(d: Dump, g: Graph) -> DataFrame:
    out = _at(g, g.edges.select("src", "dst").distinct(), "src", "src_address")
    return _at(g, out, "dst", "dst_address")


def dominator_sizes(d: Dump, g: Graph) -> DataFrame:
    out = _at(g, g.dominators.select("object_id", "idom", "retained"))
    return _at(g, out, "idom", "idom_address")


def customer_fields(d: Dump, g: Graph) -> DataFrame:
    own = commands.of_class(g, "shop.Customer").select("object_id")
    values = _at(g, g.fields.join(own, "object_id", "left_semi").drop("class_address", "hidden"))
    return _at(g, values, "ref_id", "ref_address")


def slices(d: Dump, g: Graph) -> DataFrame:
    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")

    return views.elements(views.array_bodies(d), 1, 3).select("address", F.coalesce(joined("integers"), joined("refs")).alias("items"))


def roots(d: Dump, g: Graph) -> DataFrame:
    return g.all_roots.select("address", root_kind(F.col("root_type")).alias("kind"), "thread_address")


def root_map(d: Dump, g: Graph) -> DataFrame:
    return _at(g, commands.root_map(g)).select("address", root_kind(F.col("root_type")).alias("kind"), "n")


def thread_locals(d: Dump, g: Graph) -> DataFrame:
    held = _at(g, _at(g, commands.thread_local_map(g)), "thread_id", "thread_address")
    return held.select("thread_address", "address", root_kind(F.col("root_type")).alias("kind"), "n")


def map_entries(d: Dump, g: Graph) -> DataFrame:
    keys = g.strings.select(F.col("object_id").alias("key_id"), F.col("value").alias("key"))
    entries = views.map_entries(g).join(keys, "key_id", "left").select("map_id", "node_id", "key", "value_id")
    for column in ("map", "node", "value"):
        entries = _at(g, entries, f"{column}_id", f"{column}_address")
    return entries


def collisions(d: Dump, g: Graph) -> DataFrame:
    return _at(g, views.map_collisions(g), "map_id", "map_address").select("map_address", "n_entries", "n_slots", F.round("ratio", 6).alias("ratio"))


def finalizers(d: Dump, g: Graph) -> DataFrame:
    return _at(g, _at(g, views.finalizers(g), "referent", "referent_address"))


def stacks(d: Dump, g: Graph) -> DataFrame:
    return views.threads_text(d).select("text")


def overview(d: Dump, g: Graph) -> DataFrame:
    facts = {"objects": g.objects.count(), "total": g.total, "ref_size": d.ref_size, "align": d.step, "id_size": d.header.id_size, "created_ms": d.header.created_ms, "roots": g.roots.select("object_id").distinct().count()}
    return g.objects.sparkSession.createDataFrame(list(facts.items()), "name string, n long")


def weak_statistics(d: Dump, g: Graph) -> DataFrame:
    return views.reference_statistics(g, "java.lang.ref.WeakReference")


def values(d: Dump, g: Graph) -> DataFrame:
    sized = g.strings.join(g.objects, "object_id")
    return commands.group_by_value(sized, F.col("used_size"), "value", 1)


def capacities(d: Dump, g: Graph) -> DataFrame:
    return _at(g, views.collections(g))


def arrays_by_length(d: Dump, g: Graph) -> DataFrame:
    return commands.by_length(g.lengths.join(g.objects, "object_id"), F.col("length"), F.col("used_size"))


def unreachable(d: Dump, g: Graph) -> DataFrame:
    return g.unreachable_histogram.select("name", "n_objects", "used_size")


QUERIES: dict[str, Callable[[Dump, Graph], DataFrame]] = {
    "dump_record_counts": record_counts,
    "dump_objects": all_objects,
    "dump_reachable": lambda d, g: g.objects.select("address", "used_size", "is_array"),
    "dump_unreachable": unreachable,
    "dump_references": references,
    "dump_dominators": dominator_sizes,
    "dump_histogram": lambda d, g: aggregates.histogram(g.objects, g.classes).select("name", "n_objects", "used_size"),
    "dump_fields": customer_fields,
    "dump_list_capacities": capacities,
    "dump_list_fill_ratios": lambda d, g: commands.fill_ratio(views.collections(g), F.col("size"), F.col("capacity")),
    "dump_strings": lambda d, g: _at(g, g.strings),
    "dump_find_strings": lambda d, g: _at(g, commands.find_strings(g.strings, ".*[02468]7.*", "value")),
    "dump_strings_by_value": values,
    "dump_array_slices": slices,
    "dump_arrays_by_length": arrays_by_length,
    "dump_array_fill_ratios": lambda d, g: views.array_fill_ratios(d),
    "dump_constant_arrays": lambda d, g: views.constant_arrays(d).select("address", "length"),
    "dump_roots": roots,
    "dump_root_map": root_map,
    "dump_thread_locals": thread_locals,
    "dump_threads": lambda d, g: views.thread_overview(d, g),
    "dump_thread_stacks": stacks,
    "dump_system_properties": lambda d, g: views.system_properties(g),
    "dump_map_entries": map_entries,
    "dump_map_collisions": collisions,
    "dump_finalizers": finalizers,
    "dump_finalizer_queue": lambda d, g: _at(g, views.finalizer_queue(g)),
    "dump_weak_references": weak_statistics,
    "dump_overview": overview,
}

OQL = {
    "dump_oql_to_string": "SELECT toString(c.name) AS text, c.nation.name.value.@length AS n FROM shop.Customer c",
    "dump_oql_referents": "SELECT r.@objectAddress AS address, r.referent.key AS key FROM INSTANCEOF java.lang.ref.WeakReference r WHERE r.referent.active = true",
    "dump_oql_lists": "SELECT l.size AS size, l.elementData.@length AS capacity FROM java.util.ArrayList l WHERE l.size > 40",
    "dump_oql_array_length": "SELECT a.@objectAddress AS address, a.@length AS n FROM int[] a",
    "dump_oql_displays": "SELECT b.@displayName AS shown FROM java.math.BigInteger b UNION (SELECT s.@displayName AS shown FROM java.lang.StringBuilder s UNION (SELECT p.@displayName AS shown FROM shop.Level p))",
    "dump_oql_class_objects": 'SELECT c.@name AS name FROM OBJECTS ${snapshot.getClassesByName("shop.Row", true)} c',
    "dump_oql_threads": "SELECT t.@classSpecificName AS name, toString(t.buffer) AS buffer, t.priority AS priority FROM java.lang.Thread t",
    "dump_oql_enum": "SELECT toString(e.name) AS name, e.ordinal AS ordinal FROM INSTANCEOF java.lang.Enum e WHERE e.ordinal > 1",
    "dump_oql_address": f"SELECT s.@objectAddress AS address, s.@usedHeapSize AS used_size FROM {sample.at(18, 3):#x}, {sample.at(15, 4):#x} s",
    "dump_oql_unknown": "SELECT t.@threadName FROM java.lang.Thread t",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: of_dump(f) for n, f in QUERIES.items()} | {n: of_dump(lambda d, g, text=text: oql.answered(g, text)) for n, text in OQL.items()}


def whole_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "dump_component_report_top": of_dump(lambda d, g: views.component_report_top(g)),
        "dump_component_report_packages": of_dump(lambda d, g: views.component_report_top(g, by="package")),
    }


def _a(kind: int, key: str) -> str:
    return f"({kind * sample.KIND} + ({key})*{sample.KEY})"


def _shown(name: str) -> str:
    plain = name.replace("/", ".")
    return {"[C": "char[]", "[B": "byte[]", "[I": "int[]"}.get(plain, plain[2:-1] + "[]" if plain.startswith("[L") else plain)


CLASS_ROWS = ",".join(f"({n},'{_shown(name)}',{up},{'true' if app else 'false'},{8 * len(statics)})" for n, (name, up, app, _, statics) in sample.CLASSES.items())
NAME_OF = {n: _shown(c[0]) for n, c in sample.CLASSES.items()}


def _objects() -> str:
    def rows(kind: int, key: str, of: int | str, size: str, source: str, idom: str, live: str = "true", array: bool = False) -> str:
        name = of if isinstance(of, str) else NAME_OF[of]
        return f"SELECT {_a(kind, key)} AS address, '{name}' AS name, {size} AS used_size, {live} AS live, {idom} AS idom, {str(array).lower()} AS is_array FROM {source}"

    def latin(kind: int, array: int, key: str, length: str, source: str, idom: str, live: str = "true") -> list[str]:
        return [rows(kind, key, 4, "32", source, idom, live), rows(array, key, 17, f"24 + ({length} + 7)//8*8", source, _a(kind, key), live, True)]

    own_nation = f"CASE WHEN weak_here THEN -1 ELSE {_a(23, 'n')} END"
    seen = "(listed OR c % 3 = 0)"
    parts = [
        "SELECT 65536 + 8*n AS address, 'java.lang.Class' AS name, statics AS used_size, true AS live, -1 AS idom, false AS is_array FROM cls",
        "SELECT 8, 'java.lang.Class', 0, true, -1, false",
        "SELECT 0, 'java.lang.ClassLoader', 24, true, -1, false",
        rows(1, "1", 3, "24", "(SELECT 1)", "-1"),
        rows(2, "1", 19, f"24 + 8*{sum(c[2] for c in sample.CLASSES.values())}", "(SELECT 1)", _a(1, "1"), array=True),
        rows(25, "1", 14, "32", "(SELECT 1)", "65536 + 8*15"),
        rows(26, "1", 21, "24 + 8*(SELECT count(*) FROM region)", "(SELECT 1)", _a(25, "1"), array=True),
        rows(16, "r", 5, "64", "rg", "-1"), rows(33, "r", 27, "32", "rg", _a(16, "r")), rows(34, "r", 30, "32", "rg", _a(16, "r")), rows(35, "r", 17, "40", "rg", _a(34, "r"), array=True),
        rows(36, "r", 31, "32", "rg", _a(16, "r")), rows(37, "r", 18, "32", "rg", _a(36, "r"), array=True), *latin(19, 20, "r", "length('worker-' || r)", "rg", _a(16, "r")),
        rows(32, "r", "long[]", "48", "rg", _a(16, "r"), array=True),
        rows(21, "r", 9, "32", "rg", _a(16, "r")), rows(22, "r", 20, "88", "rg", _a(21, "r"), array=True),
        rows(27, "r", 13, "48", "rg", _a(26, "1")), *latin(28, 29, "r", "length(r_name)", "rg", _a(27, "r")), *latin(30, 31, "r", "length('region ' || r)", "rg", _a(27, "r")),
        rows(23, "n", 10, "48", "na", f"CASE WHEN before IS NULL THEN {_a(22, 'r')} ELSE {_a(23, 'before')} END"),
        rows(5, "n", 4, "32", "na", own_nation), rows(6, "n", 16, "24 + (2*length(n_name) + 7)//8*8", "na", _a(5, "n"), array=True),
        rows(8, "n", 24, "40", "na", own_nation), rows(9, "n", 11, "32", "na", _a(8, "n")), rows(10, "n", 19, "24 + 8*(members + n % 3)", "na", _a(9, "n"), array=True),
        rows(7, "c", 23, "72", "cu", f"CASE WHEN c % 3 <> 0 THEN {_a(10, 'n')} WHEN listed THEN -1 ELSE {_a(13, 'c')} END", seen), *latin(3, 4, "c", "length(c_name)", "cu", _a(7, "c"), seen),
        rows(13, "c", 7, "32", "cu WHERE c % 3 = 0", _a(14, "1")), rows(14, "1", 19, "24 + 8*(SELECT count(*) FROM cu WHERE c % 3 = 0)", "(SELECT 1)", "-1", array=True),
        rows(12, "p", 25, "32", "pa", f"CASE WHEN p = 0 THEN -1 ELSE {_a(12, 'p - 1')} END"),
        rows(15, "s", 26, "40", "su", "-1"), rows(18, "s", 18, "40", "su", _a(15, "s"), array=True),
        rows(24, "s", 8, "48", "su", f"CASE WHEN s = 0 THEN 65536 + 8*8 WHEN s > (SELECT max(s) FROM su)//5*5 THEN {_a(24, 's - 1')} ELSE {_a(24, '(s - 1)//5*5')} END"),
    ]
    return " UNION ALL ".join(parts)


BASE = f"""
cls AS (SELECT * FROM (VALUES {CLASS_ROWS}) v(n, name, up, app, statics)),
rg AS (SELECT r_regionkey AS r, r_name FROM region),
cu AS (SELECT c_custkey AS c, c_name, c_nationkey AS n, c_acctbal AS balance, c_mktsegment <> '{sample.GARBAGE_SEGMENT}' AS listed FROM customer),
na AS (SELECT n_nationkey AS n, n_name, n_regionkey AS r, lag(n_nationkey) OVER (PARTITION BY n_regionkey, n_nationkey % 8 ORDER BY n_nationkey) AS before,
  (SELECT count(*) FROM cu WHERE cu.n = n_nationkey AND listed) AS members, EXISTS (SELECT 1 FROM cu WHERE cu.n = n_nationkey AND c % 3 = 0) AS weak_here FROM nation),
pa AS (SELECT p_partkey AS p FROM part),
su AS (SELECT s_suppkey AS s FROM supplier),
ob AS (SELECT address::BIGINT AS address, name, used_size::BIGINT AS used_size, live, idom::BIGINT AS idom, is_array FROM ({_objects()}))"""


def _references() -> str:
    def ref(src: str, dst: str, source: str) -> str:
        return f"SELECT {src} AS s, {dst} AS d FROM {source}"

    seen = "cu WHERE (listed OR c % 3 = 0)"
    parts = [
        # the class of each object, and what classes refer to
        "SELECT o.address, coalesce(65536 + 8*cls.n, 8) FROM ob o LEFT JOIN cls USING (name) WHERE live AND address <> 8",
        "SELECT 65536 + 8*n, 65536 + 8*up FROM cls WHERE up > 0",
        f"SELECT 65536 + 8*n, CASE WHEN app THEN {_a(1, '1')} ELSE 0 END FROM cls",
        *(f"SELECT {sample.class_at(n)}, {target}" for n, c in sample.CLASSES.items() for _, target in c[4]),
        ref(_a(1, "1"), _a(2, "1"), "(SELECT 1)"), ref(_a(2, "1"), "65536 + 8*n", "cls WHERE app"), ref(_a(25, "1"), _a(26, "1"), "(SELECT 1)"), ref(_a(26, "1"), _a(27, "r"), "rg"),
        *(ref(_a(16, "r"), _a(kind, "r"), "rg") for kind in (33, 34, 36)), ref(_a(33, "r"), _a(19, "r"), "rg"), ref(_a(34, "r"), _a(35, "r"), "rg"), ref(_a(36, "r"), _a(37, "r"), "rg"),
        ref(_a(16, "r"), _a(19, "r"), "rg"), ref(_a(16, "r"), _a(32, "r"), "rg"), ref(_a(16, "r"), _a(21, "r"), "rg"), ref(_a(19, "r"), _a(20, "r"), "rg"), ref(_a(21, "r"), _a(22, "r"), "rg"),
        ref(_a(27, "r"), _a(28, "r"), "rg"), ref(_a(27, "r"), _a(30, "r"), "rg"), ref(_a(28, "r"), _a(29, "r"), "rg"), ref(_a(30, "r"), _a(31, "r"), "rg"),
        ref(f"CASE WHEN before IS NULL THEN {_a(22, 'r')} ELSE {_a(23, 'before')} END", _a(23, "n"), "na"), ref(_a(23, "n"), _a(5, "n"), "na"), ref(_a(23, "n"), _a(8, "n"), "na"),
        ref(_a(5, "n"), _a(6, "n"), "na"), ref(_a(8, "n"), _a(5, "n"), "na"), ref(_a(8, "n"), _a(9, "n"), "na"), ref(_a(9, "n"), _a(10, "n"), "na"), ref(_a(10, "n"), _a(7, "c"), "cu WHERE listed"),
        ref(_a(7, "c"), _a(3, "c"), seen), ref(_a(7, "c"), _a(8, "n"), seen), ref(_a(3, "c"), _a(4, "c"), seen), ref(_a(13, "c"), _a(7, "c"), "cu WHERE c % 3 = 0"), ref(_a(14, "1"), _a(13, "c"), "cu WHERE c % 3 = 0"),
        ref(_a(12, "p"), _a(12, "p + 1"), "pa WHERE p + 1 IN (SELECT p FROM pa)"),
        ref(_a(15, "s"), _a(15, "s + 1"), "su WHERE s + 1 IN (SELECT s FROM su)"), ref(_a(15, "s"), _a(15, "s - 1"), "su WHERE s > 0"), ref(_a(15, "s"), _a(18, "s"), "su"), ref(_a(24, "s"), _a(15, "s"), "su"),
        ref(_a(24, "s"), _a(24, "s + 1"), "su WHERE s + 1 IN (SELECT s FROM su)"), ref(_a(24, "s"), _a(24, "s - 1"), "su WHERE s > 0"),
        ref(_a(24, "s"), f"CASE WHEN s + 5 IN (SELECT s FROM su) THEN {_a(24, 's + 5')} ELSE {_a(24, 's')} END", "su WHERE s % 5 = 0"),
    ]
    return " UNION ".join(parts)


def _hexed(value: str) -> str:
    return f"'0x' || lower(to_hex({value}))"


STRINGS = f"""st AS (SELECT {_a(19, 'r')} AS address, 'worker-' || r AS value FROM rg UNION ALL SELECT {_a(28, 'r')}, lower(r_name) FROM rg UNION ALL SELECT {_a(30, 'r')}, 'region ' || r FROM rg
  UNION ALL SELECT {_a(5, 'n')}, n_name FROM na UNION ALL SELECT {_a(3, 'c')}, c_name FROM cu WHERE listed OR c % 3 = 0)"""
FIELDS = {
    "name": ("object", "ref_address", _a(3, "c")), "nation": ("object", "ref_address", _a(8, "n")), "key": ("integer", "i", "c"), "balance": ("real", "f", "balance"), "ratio": ("real", "f", "(c % 8)/4"),
    "rank": ("integer", "i", "c % 1000 - 500"), "grade": ("integer", "i", "c % 128"), "initial": ("char", "i", "65 + c % 26"), "active": ("boolean", "b", "c % 2 = 1"),
    "orders": ("integer", "i", "c % 50"), "link": ("object", "ref_address", "NULL"),
}


def _fields() -> str:
    def row(name: str, kind: str, column: str, value: str) -> str:
        cells = {"i": "NULL::BIGINT", "f": "NULL::DOUBLE", "b": "NULL::BOOLEAN", "text": "NULL::VARCHAR", "ref_address": "NULL::BIGINT"} | {column: f"({value})" if column == "b" else f"({value})::{'DOUBLE' if column == 'f' else 'BIGINT'}"}
        if kind == "char":
            cells["text"] = f"chr(({value})::INTEGER)"
        return f"SELECT {_a(7, 'c')} AS address, '{name}' AS field, '{kind}' AS kind, " + ", ".join(f"{v} AS {k}" for k, v in cells.items()) + " FROM cu WHERE listed OR c % 3 = 0"

    return " UNION ALL ".join(row(name, *rest) for name, rest in FIELDS.items())


ITEMS = f"""bt AS (SELECT {_a(20, 'r')} AS address, 'worker-' || r AS value FROM rg UNION ALL SELECT {_a(29, 'r')}, lower(r_name) FROM rg UNION ALL SELECT {_a(31, 'r')}, 'region ' || r FROM rg UNION ALL SELECT {_a(4, 'c')}, c_name FROM cu),
it AS (
  SELECT {_a(2, '1')} AS address, (65536 + 8*n)::VARCHAR AS item, n - 22 AS place, 5 AS length FROM cls WHERE app UNION ALL
  SELECT {_a(26, '1')}, {_a(27, 'r')}::VARCHAR, r, (SELECT count(*) FROM rg) FROM rg UNION ALL
  SELECT {_a(22, 'r')}, coalesce((SELECT min({_a(23, 'na.n')}) FROM na WHERE na.r = rg.r AND na.n % 8 = slot)::VARCHAR, '-'), slot, 8 FROM rg, range(8) t(slot) UNION ALL
  SELECT {_a(14, '1')}, {_a(13, 'c')}::VARCHAR, row_number() OVER (ORDER BY c) - 1, count(*) OVER () FROM cu WHERE c % 3 = 0 UNION ALL
  SELECT {_a(10, 'n')}, {_a(7, 'c')}::VARCHAR, row_number() OVER (PARTITION BY n ORDER BY c) - 1, 0 FROM cu WHERE listed UNION ALL
  SELECT {_a(10, 'n')}, '-', members + i, 0 FROM na, range(2) t(i) WHERE i < n % 3 UNION ALL
  SELECT {_a(32, 'r')}, ((ARRAY[1152921504606846976 + r, -r, 9007199254740993])[i + 1])::VARCHAR, i, 3 FROM rg, range(3) t(i) UNION ALL
  SELECT {_a(35, 'r')}, coalesce(unicode(nullif(('built ' || r)[i + 1], '')), 0)::VARCHAR, i, 16 FROM rg, range(16) t(i) UNION ALL
  SELECT {_a(37, 'r')}, (CASE i WHEN 0 THEN r + 1 ELSE 5 END)::VARCHAR, i, 2 FROM rg, range(2) t(i) UNION ALL
  SELECT {_a(18, 's')}, (CASE WHEN s % 2 = 0 THEN s % 7 WHEN i = 3 THEN 9 ELSE s + i END)::VARCHAR, i, 4 FROM su, range(4) t(i) UNION ALL
  SELECT {_a(6, 'n')}, unicode(n_name[i + 1])::VARCHAR, i, 0 FROM na, range(40) t(i) WHERE i < length(n_name) UNION ALL
  SELECT address, unicode(value[i + 1])::VARCHAR, i, 0 FROM bt, range(60) t(i) WHERE i < length(value))"""


def oracle_sql() -> dict[str, str]:
    def sql(select: str, *more: str, recursive: bool = False) -> str:
        return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([BASE, *more])}\n{select}"

    counts = {
        1: str(len(sample.Names().ids)), 2: str(len(sample.CLASSES)), 4: "6", 5: "5", 257: "2", 259: "5", 261: str(sum(not c[2] for c in sample.CLASSES.values())), 263: "1", 264: "5", 288: str(len(sample.CLASSES)),
        289: "2 + 9*(SELECT count(*) FROM rg) + 4*(SELECT count(*) FROM na) + (SELECT count(*)*2 + count(*) FILTER (c % 10 = 0) + count(*) FILTER (c % 3 = 0) FROM cu) + (SELECT count(*) FROM pa) + 2*(SELECT count(*) FROM su)",
        290: "3 + (SELECT count(*) FROM rg) + (SELECT count(*) FROM na)", 291: "6*(SELECT count(*) FROM rg) + (SELECT count(*) FROM na) + (SELECT count(*) FROM cu) + (SELECT count(*) FROM su)",
    }
    # lists of parts have thousands of links: their sizes directly, all others through the tree
    retained = f"""tree AS (SELECT address, idom, used_size FROM ob WHERE live AND name <> 'shop.Part'),
up AS (SELECT address AS top, idom AS above, used_size FROM tree UNION ALL SELECT t.address, t.idom, up.used_size FROM up JOIN tree t ON t.address = up.above)"""
    threads = f"""SELECT {_a(16, 'r')}::BIGINT AS thread_address, 64::BIGINT AS used_size, x.retained::BIGINT AS retained, 2::INTEGER AS depth, 1::INTEGER AS n_locals FROM rg
JOIN (SELECT top, sum(used_size) AS retained FROM up GROUP BY 1) x ON x.top = {_a(16, 'r')}"""
    text = f"""SELECT 'Thread ' || {_hexed(_a(16, 'r'))} || chr(10) || '  at shop.Row.run()V (' || CASE r WHEN 0 THEN 'Worker.java(Native Method)' WHEN 1 THEN 'Worker.java(Compiled Code)' WHEN 4 THEN 'Worker.java:42' ELSE 'Worker.java' END || ')' || chr(13) || chr(10)
 || '  at shop.Nation.main([Ljava/lang/String;)V (:7)' || chr(13) || chr(10) || chr(10) || '  locals:' || chr(10) || '    objectId=' || {_hexed(_a(21, 'r'))} || ', line=0' || chr(10) || chr(10) AS text FROM rg"""
    return {
        "dump_record_counts": sql("SELECT tag::INTEGER AS tag, n::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT {t} AS tag, {n} AS n" for t, n in counts.items()) + ") WHERE n > 0"),
        "dump_objects": sql("SELECT address, name, used_size FROM ob"),
        "dump_reachable": sql("SELECT address, used_size, is_array FROM ob WHERE live"),
        "dump_unreachable": sql("SELECT name, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM ob WHERE NOT live GROUP BY 1"),
        "dump_references": sql("SELECT s::BIGINT AS src_address, d::BIGINT AS dst_address FROM rf", f"rf(s, d) AS ({_references()})"),
        "dump_dominators": sql(f"SELECT ob.address, ob.idom AS idom_address, (CASE WHEN ob.name = 'shop.Part' THEN 32*((SELECT count(*) FROM pa) - (ob.address - {_a(12, '0')})//{sample.KEY}) ELSE r.retained END)::BIGINT AS retained FROM ob LEFT JOIN (SELECT top, sum(used_size) AS retained FROM up GROUP BY 1) r ON r.top = ob.address WHERE live", retained, recursive=True),
        "dump_histogram": sql("SELECT name, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM ob WHERE live GROUP BY 1"),
        "dump_fields": sql(_fields()),
        "dump_list_capacities": sql(f"SELECT {_a(9, 'n')}::BIGINT AS address, (CASE WHEN n % 5 = 4 THEN 0 ELSE members END)::BIGINT AS size, (members + n % 3)::BIGINT AS capacity FROM na"),
        "dump_list_fill_ratios": sql("SELECT ceil(CASE WHEN members + n % 3 > 0 THEN (CASE WHEN n % 5 = 4 THEN 0 ELSE members END)/(members + n % 3) ELSE 0 END*5)/5 AS ratio, count(*) AS n_objects FROM na GROUP BY 1"),
        "dump_strings": sql("SELECT address::BIGINT AS address, value FROM st", STRINGS),
        "dump_find_strings": sql("SELECT address::BIGINT AS address, value FROM st WHERE regexp_matches(value, '[02468]7')", STRINGS),
        "dump_strings_by_value": sql("SELECT value, count(*) AS n_objects, (32*count(*))::BIGINT AS used_size FROM st GROUP BY 1", STRINGS),
        "dump_array_slices": sql("SELECT a.address::BIGINT AS address, coalesce(string_agg(item, ',' ORDER BY place) FILTER (place BETWEEN 1 AND 3), '') AS items FROM (SELECT address FROM ob WHERE is_array) a LEFT JOIN it ON it.address = a.address GROUP BY 1", ITEMS),
        "dump_arrays_by_length": sql("SELECT n AS length, count(*) AS n_objects, sum(used_size)::BIGINT AS used_size FROM (SELECT a.address, a.used_size, count(it.address) AS n FROM (SELECT * FROM ob WHERE is_array AND live) a LEFT JOIN it ON it.address = a.address GROUP BY 1, 2) GROUP BY 1", ITEMS),
        "dump_array_fill_ratios": sql("SELECT least(4, floor(used*5/length))::INTEGER AS bucket, count(*) AS n_objects, sum(used)::BIGINT AS n_elements FROM (SELECT a.address, count(*) AS length, count(*) FILTER (item <> '-') AS used FROM ob a JOIN it ON it.address = a.address WHERE name LIKE 'java.%[]' GROUP BY 1) GROUP BY 1", ITEMS),
        "dump_constant_arrays": sql("SELECT a.address, count(*)::BIGINT AS length FROM ob a JOIN it ON it.address = a.address WHERE name NOT LIKE 'java.%[]' GROUP BY 1 HAVING count(DISTINCT item) = 1", ITEMS),
        "dump_roots": sql(f"SELECT (65536 + 8*n)::BIGINT AS address, 'SYSTEM_CLASS' AS kind, 0::BIGINT AS thread_address FROM cls WHERE NOT app UNION ALL SELECT {_a(14, '1')}, 'NATIVE_STATIC', 0 UNION ALL SELECT {_a(12, '0')}, 'NATIVE_STATIC', 0 UNION ALL SELECT {_a(15, '0')}, 'BUSY_MONITOR', 0 UNION ALL SELECT {_a(16, 'r')}, 'THREAD_OBJ', 0 FROM rg UNION ALL SELECT {_a(21, 'r')}, 'JAVA_LOCAL', {_a(16, 'r')} FROM rg"),
        "dump_root_map": sql(f"SELECT (65536 + 8*n)::BIGINT AS address, 'SYSTEM_CLASS' AS kind, 1::BIGINT AS n FROM cls WHERE NOT app UNION ALL SELECT {_a(14, '1')}, 'NATIVE_STATIC', 1 UNION ALL SELECT {_a(12, '0')}, 'NATIVE_STATIC', 1 UNION ALL SELECT {_a(15, '0')}, 'BUSY_MONITOR', 1 UNION ALL SELECT {_a(16, 'r')}, 'THREAD_OBJ', 1 FROM rg"),
        "dump_thread_locals": sql(f"SELECT {_a(16, 'r')}::BIGINT AS thread_address, {_a(21, 'r')}::BIGINT AS address, 'JAVA_LOCAL' AS kind, 1::BIGINT AS n FROM rg"),
        "dump_threads": sql(threads, retained, recursive=True),
        "dump_thread_stacks": sql(text),
        "dump_system_properties": sql("SELECT lower(r_name) AS key, 'region ' || r AS value FROM rg"),
        "dump_map_entries": sql(f"SELECT {_a(21, 'r')}::BIGINT AS map_address, {_a(23, 'n')}::BIGINT AS node_address, n_name AS key, {_a(8, 'n')}::BIGINT AS value_address FROM na"),
        "dump_map_collisions": sql(f"SELECT {_a(21, 'r')}::BIGINT AS map_address, count(*) AS n_entries, count(DISTINCT n % 8) AS n_slots, round(1 - count(DISTINCT n % 8)/count(*), 6) AS ratio FROM na GROUP BY r"),
        "dump_finalizers": sql(f"SELECT {_a(24, 's')}::BIGINT AS address, {_a(15, 's')}::BIGINT AS referent_address, s % 5 = 0 AS queued FROM su"),
        "dump_finalizer_queue": sql(f"SELECT {_a(15, 's')}::BIGINT AS address FROM su WHERE s % 5 = 0"),
        "dump_weak_references": sql("SELECT 'shop.Customer' AS name, count(*) AS n_objects, count(*) FILTER (NOT listed) AS n_only FROM cu WHERE c % 3 = 0"),
        "dump_overview": sql("SELECT 'objects' AS name, count(*)::BIGINT AS n FROM ob WHERE live UNION ALL SELECT 'total', sum(used_size)::BIGINT FROM ob WHERE live UNION ALL SELECT 'ref_size', 8 UNION ALL SELECT 'align', 8 UNION ALL SELECT 'id_size', 8 UNION ALL SELECT 'created_ms', 1600000000000 UNION ALL SELECT 'roots', (SELECT count(*) FROM cls WHERE NOT app) + 3 + 2*(SELECT count(*) FROM rg)"),
        "dump_oql_to_string": sql("SELECT c_name AS text, length(n_name)::BIGINT AS n FROM cu JOIN na USING (n) WHERE listed OR c % 3 = 0"),
        "dump_oql_referents": sql(f"SELECT {_a(13, 'c')}::BIGINT AS address, c AS key FROM cu WHERE c % 3 = 0 AND c % 2 = 1"),
        "dump_oql_lists": sql("SELECT members AS size, (members + n % 3)::BIGINT AS capacity FROM na WHERE n % 5 <> 4 AND members > 40"),
        "dump_oql_array_length": sql(f"SELECT {_a(18, 's')}::BIGINT AS address, 4::BIGINT AS n FROM su UNION ALL SELECT {_a(37, 'r')}, 2 FROM rg"),
        "dump_oql_displays": sql(f"SELECT 'java.math.BigInteger @ ' || {_hexed(_a(36, 'r'))} || '  ' || (-((r + 1)*4294967296 + 5))::VARCHAR AS shown FROM rg UNION ALL SELECT 'java.lang.StringBuilder @ ' || {_hexed(_a(34, 'r'))} || '  built ' || r FROM rg UNION ALL SELECT 'shop.Level @ ' || {_hexed(_a(33, 'r'))} FROM rg"),
        "dump_oql_class_objects": sql("SELECT name FROM cls WHERE name = 'shop.Row' OR up = 22"),
        "dump_oql_threads": sql("SELECT 'worker-' || r AS name, 'built ' || r AS buffer, (r + 1)::BIGINT AS priority FROM rg"),
        "dump_oql_enum": sql("SELECT 'worker-' || r AS name, r::BIGINT AS ordinal FROM rg WHERE r > 1"),
        "dump_oql_address": sql(f"SELECT address, used_size FROM ob WHERE address IN ({_a(18, '3')}, {_a(15, '4')})"),
        "dump_oql_unknown": "SELECT 'unknown attribute @threadName' AS error",
    }
