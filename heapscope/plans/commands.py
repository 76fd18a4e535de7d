"""Questions to a heap graph beyond single operators: paths, retained sets, suspects, references, values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import sized
from ..operators import aggregates, dominators, reach
from .graph import Graph


def distances(graph: Graph, exclude: DataFrame | None = None) -> DataFrame:
    """object_id, distance from the nearest root; `exclude` (src, dst) names references not to follow."""
    edges = graph.edges.select("src", "dst")
    if exclude is not None:
        edges = edges.join(exclude.select("src", "dst"), ["src", "dst"], "left_anti")
    return reach.search(edges, reach.usable_roots(graph.roots))


def paths_to_roots(graph: Graph, targets: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """object_id, path: ids from a root to the object along a shortest path (of equal ones the least id at each step back)."""
    far = sized(distances(graph, exclude), "distances")
    edges = graph.edges.select("src", "dst")
    if exclude is not None:
        edges = edges.join(exclude.select("src", "dst"), ["src", "dst"], "left_anti")
    # only references that come one step nearer to the roots can be on a shortest path
    nearer = edges.join(far.select(F.col("object_id").alias("src"), F.col("distance").alias("ds")), "src").join(far.select(F.col("object_id").alias("dst"), F.col("distance").alias("dd")), "dst")
    back = sized(nearer.where("ds + 1 = dd").groupBy("dst").agg(F.min("src").alias("src")), "back")
    now = targets.select("object_id").distinct().join(far, "object_id").select("object_id", F.array("object_id").alias("path"), "distance")
    done = []
    while True:
        done.append(now.where("distance = 0").select("object_id", "path"))
        going = now.where("distance > 0").select("object_id", "path", "distance", F.get("path", F.lit(0)).alias("dst"))
        now = sized(going.join(back, "dst").select("object_id", F.concat(F.array("src"), "path").alias("path"), (F.col("distance") - 1).alias("distance")), "paths")
        if now.isEmpty():
            return reduce(DataFrame.unionAll, done)


def merged_paths(graph: Graph, targets: DataFrame) -> DataFrame:
    """The paths to the targets merged by class: classes (root first), n_objects."""
    names = graph.objects.select("object_id", "class_id").join(graph.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id").select(F.col("object_id").alias("id"), "name")
    steps = paths_to_roots(graph, targets).select("object_id", F.posexplode("path").alias("at", "id")).join(names, "id")
    by_object = steps.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("classes"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("classes")), lambda i: F.slice("classes", F.lit(1), i))
    return by_object.select(F.explode(prefixes).alias("classes")).groupBy("classes").agg(F.count("*").alias("n_objects"))


def only_through(graph: Graph, chosen: DataFrame) -> DataFrame:
    """object_id of what nothing but paths through the chosen objects reaches, the chosen ones included."""
    out = chosen.select("object_id").distinct()
    edges = graph.edges.select("src", "dst").join(out.select(F.col("object_id").alias("dst")), "dst", "left_anti")
    starts = reach.usable_roots(graph.roots).join(out, "object_id", "left_anti")
    return graph.objects.select("object_id").join(reach.search(edges, starts).select("object_id"), "object_id", "left_anti")


def classes_named(graph: Graph, name: str, subclasses: bool = False, pattern: bool = False) -> DataFrame:
    """The classes with a name (or matching a pattern), and their subclasses."""
    found = graph.classes.where(F.col("name").rlike(f"^(?:{name})$") if pattern else F.col("name") == name)
    if subclasses:
        up = aggregates.superclass_closure(graph.classes)
        found = graph.classes.join(up.join(found.select(F.col("address").alias("ancestor")), "ancestor", "left_semi").select("address").distinct(), "address")
    return found


def of_class(graph: Graph, name: str, subclasses: bool = False, pattern: bool = False) -> DataFrame:
    """Objects of the classes with a name (or matching a pattern), and of their subclasses."""
    found = classes_named(graph, name, subclasses, pattern)
    return graph.objects.join(found.select(F.col("object_id").alias("class_id")), "class_id", "left_semi")


def listed(graph: Graph, objects: DataFrame) -> DataFrame:
    """object_id, address, name, used_size, retained: the columns of an object list."""
    named = objects.join(graph.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id")
    return named.join(graph.dominators.select("object_id", "retained"), "object_id").select("object_id", "address", "name", "used_size", "retained")


def outbound_tree(graph: Graph, objects: DataFrame, levels: int = 1) -> DataFrame:
    """What objects refer to, `levels` deep: path (ids from the listed object on), level (0: the object itself), nr (place among the references of the object
    above), object_id, address, name, used_size, retained. An object has a row for each path that leads to it."""
    step = objects.select(F.array("object_id").alias("path"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("nr"), "object_id")
    rows = [step]
    references = graph.read_edges.select(F.col("src").alias("object_id"), F.col("seq").alias("nr"), "dst")
    for level in range(1, levels + 1):
        step = step.select("path", "object_id").join(references, "object_id").select(F.concat("path", F.array("dst")).alias("path"), F.lit(level).alias("level"), "nr", F.col("dst").alias("object_id"))
        rows.append(step)
    return listed(graph, graph.objects).join(reduce(DataFrame.unionAll, rows), "object_id").select("path", "level", "nr", "object_id", "address", "name", "used_size", "retained")


def root_map(graph: Graph) -> DataFrame:
    """object_id, root_type, n: the roots of each object that are no thread's."""
    return graph.roots.where("thread_address = 0").groupBy("object_id", "root_type").agg(F.count("*").alias("n"))


def thread_local_map(graph: Graph) -> DataFrame:
    """thread_id, object_id, root_type, n: what each thread that is left holds on its stack."""
    threads = graph.objects.select(F.col("address").alias("thread_address"), F.col("object_id").alias("thread_id"))
    return graph.roots.where("thread_address <> 0").join(threads, "thread_address").groupBy("thread_id", "object_id", "root_type").agg(F.count("*").alias("n"))


def suspects(graph: Graph, percent: float = 10.0) -> DataFrame:
    """kind, what, n_objects, retained: single objects, and classes of top-level objects together, that keep `percent` of the heap or more."""
    least = graph.total * percent / 100.0
    single = graph.dominators.where("idom = -1").where(F.col("retained") >= least).join(graph.objects.select("object_id", "address"), "object_id")
    single = single.select(F.lit("object").alias("kind"), F.col("address").cast("string").alias("what"), F.lit(1).cast("bigint").alias("n_objects"), "retained")
    small = graph.dominators.where("idom = -1").where(F.col("retained") < least)
    grouped = aggregates.dominators_grouped(small, graph.objects, graph.classes).where(F.col("retained") >= least)
    return single.unionByName(grouped.select(F.lit("class").alias("kind"), F.col("name").alias("what"), "n_objects", "retained"))


def accumulation_points(graph: Graph, percent: float = 10.0, keeps: float = 0.7) -> DataFrame:
    """object_id, accumulation_id: from each suspect down its biggest child as long as that keeps most of what is above it."""
    tree = graph.dominators.select("object_id", "idom", "retained")
    order = F.max_by("object_id", F.struct("retained", -F.col("object_id"))).alias("child")
    child = sized(tree.groupBy("idom").agg(order, F.max("retained").alias("child_retained")), "biggest")
    now = tree.where("idom = -1").where(F.col("retained") >= graph.total * percent / 100.0).select("object_id", F.col("object_id").alias("accumulation_id"), "retained")
    done = []
    while True:
        step = now.join(child.withColumnRenamed("idom", "accumulation_id"), "accumulation_id", "left")
        down = F.coalesce(F.col("child_retained") >= F.col("retained") * keeps, F.lit(False))
        done.append(step.where(~down).select("object_id", "accumulation_id"))
        now = sized(step.where(down).select("object_id", F.col("child").alias("accumulation_id"), F.col("child_retained").alias("retained")), "accumulate")
        if now.isEmpty():
            return reduce(DataFrame.unionAll, done)


def leaks(graph: Graph, percent: float = 10.0) -> DataFrame:
    """suspects() and, for single objects, the address of the accumulation point: kind, what, n_objects, retained, accumulation (null for classes)."""
    address = graph.objects.select("object_id", "address")
    points = accumulation_points(graph, percent).join(address, "object_id").select(F.col("address").cast("string").alias("what"), F.lit("object").alias("kind"), F.col("accumulation_id").alias("object_id"))
    points = points.join(address, "object_id").select("kind", "what", F.col("address").alias("accumulation"))
    return suspects(graph, percent).join(points, ["kind", "what"], "left").select("kind", "what", "n_objects", "retained", "accumulation")


def consumers(graph: Graph, percent: float = 1.0) -> DataFrame:
    """kind (object, class, loader, package), what, n_objects, retained: top-level objects, alone and together, that keep `percent` of the heap or more."""
    single = dominators.top_consumers(graph.dominators, graph.total, percent).join(graph.objects.select("object_id", "address"), "object_id")
    out = single.select(F.lit("object").alias("kind"), F.col("address").cast("string").alias("what"), F.lit(1).cast("bigint").alias("n_objects"), "retained")
    for kind, by in {"class": "name", "loader": "loader_address", "package": "package"}.items():
        together = aggregates.dominators_grouped(graph.dominators, graph.objects, graph.classes, by).where(F.col("retained") * 100.0 >= F.lit(percent * graph.total))
        out = out.unionByName(together.select(F.lit(kind).alias("kind"), F.col(by).cast("string").alias("what"), "n_objects", "retained"))
    return out


def reference_statistics(graph: Graph, referents: DataFrame) -> DataFrame:
    """What reference objects point at (referents: src, dst), by class: name, n_objects, n_only, where n_only are those that nothing else reaches."""
    edges = graph.edges.select("src", "dst").join(referents.select("src", "dst"), ["src", "dst"], "left_anti")
    strong = reach.reached(edges, reach.usable_roots(graph.roots))
    aimed = referents.select(F.col("dst").alias("object_id")).distinct()
    only = aimed.join(strong, "object_id", "left_anti").withColumn("only", F.lit(1))
    named = graph.objects.join(graph.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id").select("object_id", "name")
    return aimed.join(only, "object_id", "left").join(named, "object_id").groupBy("name").agg(F.count("*").alias("n_objects"), F.count("only").alias("n_only"))


# values: tables of strings, arrays and collections by object


def find_strings(strings: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Strings that a pattern matches as a whole."""
    return strings.where(F.col(text).rlike(f"(?s)^(?:{pattern})$"))


def group_by_value(strings: DataFrame, size: Column, text: str = "text", least: int = 2) -> DataFrame:
    return strings.groupBy(F.col(text)).agg(F.count("*").alias("n_objects"), F.sum(size).cast("bigint").alias("used_size")).where(F.col("n_objects") >= least)


def by_length(arrays: DataFrame, length: Column, size: Column) -> DataFrame:
    return arrays.groupBy(length.cast("bigint").alias("length")).agg(F.count("*").alias("n_objects"), F.sum(size).cast("bigint").alias("used_size"))


def fill_ratio(collections: DataFrame, size: Column, capacity: Column, segments: int = 5) -> DataFrame:
    """Collections by the share of their capacity in use, in `segments` equal parts: ratio (upper end), n_objects."""
    share = F.when(capacity > 0, size / capacity).otherwise(F.lit(0.0))
    return collections.groupBy((F.ceil(share * segments) / segments).alias("ratio")).agg(F.count("*").alias("n_objects"))


def constant_arrays(arrays: DataFrame, values: str, key: str) -> DataFrame:
    """Arrays of one repeated value: key, value, length."""
    found = arrays.where(F.size(values) > 0).where(F.array_min(values) == F.array_max(values))
    return found.select(key, F.get(values, F.lit(0)).alias("value"), F.size(values).alias("length"))


def collision_ratio(entries: DataFrame, map_id: str, slot: Column) -> DataFrame:
    """map_id, n_entries, n_slots and the share of entries that share a slot with an earlier one."""
    per = entries.groupBy(map_id).agg(F.count("*").alias("n_entries"), F.countDistinct(slot).alias("n_slots"))
    return per.withColumn("ratio", (F.col("n_entries") - F.col("n_slots")) / F.col("n_entries"))


def wasted_chars(arrays: DataFrame, strings: DataFrame) -> DataFrame:
    """array_id, length, used: characters of an array that no string's (array_id, offset, count) covers count as waste."""
    used = strings.groupBy("array_id").agg(F.max(F.col("offset") + F.col("count")).alias("end"), F.min("offset").alias("start"))
    return arrays.join(used, "array_id").select("array_id", "length", (F.col("end") - F.col("start")).alias("used")).where("used < length")


def tree_text(graph: Graph, top: int = 200, children: int = 40) -> DataFrame:
    """The dominator tree's first two levels as indented lines, in order: nr, line."""
    named = graph.objects.join(graph.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id").select("object_id", "address", "name", "used_size")
    ordered = dominators.dominated_children(graph.dominators)
    upper = ordered.where((F.col("idom") == -1) & (F.col("nr") < top)).select("object_id", F.col("nr").alias("top"), "retained")
    lower = ordered.where(F.col("nr") < children).join(upper.select(F.col("object_id").alias("idom"), "top"), "idom").select("object_id", "top", "nr", "retained")
    both = upper.select("object_id", "top", F.lit(-1).cast("bigint").alias("nr"), "retained").unionByName(lower)
    line = F.concat(F.when(F.col("nr") < 0, "").otherwise("  "), F.concat_ws("\t", "object_id", F.lpad(F.lower(F.hex("address")), 16, "0"), "name", "used_size", "retained"))
    return both.join(named, "object_id").select("top", "nr", line.alias("line")).orderBy("top", "nr")


def components(graph: Graph, percent: float = 1.0, by: str = "loader_address") -> DataFrame:
    """object_id, part: the instances of the classes of each component (a loader, or a package) whose top ones keep `percent` of the heap or more."""
    key = F.regexp_replace("name", r"\.?[^.]*$", "") if by == "package" else F.col(by).cast("string")
    members = sized(graph.objects.join(graph.classes.select(F.col("object_id").alias("class_id"), key.alias("part")), "class_id").select("object_id", "part"), "members")
    held = dominators.below_another(graph.dominators, members)
    top = members.join(held, ["object_id", "part"], "left_anti").join(graph.dominators.select("object_id", "retained"), "object_id")
    large = top.groupBy("part").agg(F.sum("retained").alias("retained")).where(F.col("retained") * 100.0 >= F.lit(percent * graph.total))
    return members.join(large, "part", "left_semi").select("object_id", "part")


def kept_by(graph: Graph, members: DataFrame) -> DataFrame:
    """object_id, part: what each part's members (object_id, part) keep: themselves and all below them in the dominator tree."""
    if dominators.has_paths(graph.dominators):
        below = graph.dominators.select("object_id", F.explode("path").alias("upper"))
        return below.join(members.withColumnRenamed("object_id", "upper"), "upper").select("object_id", "part").distinct()
    parts = [r["part"] for r in members.select("part").distinct().collect()]  # each keeps a share of the heap, so they are few
    sets = [dominators.retained_set(graph.dominators, members.where(F.col("part") == p)).withColumn("part", F.lit(p)) for p in parts]
    return reduce(DataFrame.unionAll, sets) if sets else members.limit(0)


def component_report(graph: Graph, package: str) -> DataFrame:
    """name, n_objects, used_size, retained of the classes of a package: what its instances are, and what those of them that are dominated by no
    other object of the package keep."""
    inside = graph.classes.where(F.col("name").startswith(f"{package}."))
    members = graph.objects.join(inside.select(F.col("object_id").alias("class_id"), "name"), "class_id").select("object_id", "name", "used_size")
    placed = members.join(graph.dominators.select("object_id", "retained"), "object_id")
    held = dominators.below_another(graph.dominators, members.select("object_id", F.lit(0).alias("part"))).select("object_id", F.lit(True).alias("held"))
    kept = F.when(F.col("held").isNull(), F.col("retained")).otherwise(F.lit(0))
    return placed.join(held, "object_id", "left").groupBy("name").agg(F.count("*").alias("n_objects"), F.sum("used_size").alias("used_size"), F.sum(kept).alias("retained"))
