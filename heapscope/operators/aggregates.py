"""Histograms and groupings by class, superclass, loader and package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_stats(objects: DataFrame) -> DataFrame:
    """class_id, n_objects, used_size; map-side combined, one row a class."""
    return objects.groupBy("class_id").agg(F.count("*").alias("n_objects"), F.sum("used_size").alias("used_size"))


def total_heap(objects: DataFrame) -> DataFrame:
    return objects.agg(F.coalesce(F.sum("used_size"), F.lit(0)).alias("used_size"), F.count("*").alias("n_objects"))


def histogram(objects: DataFrame, classes: DataFrame, min_retained: DataFrame | None = None) -> DataFrame:
    """name, loader_address, n_objects, used_size and, if given, retained; one row a class that has instances."""
    names = classes.select(F.col("object_id").alias("class_id"), "name", "loader_address")
    out = class_stats(objects).join(names, "class_id")
    if min_retained is not None:
        out = out.join(min_retained, "class_id", "left").withColumn("retained", F.coalesce("retained", F.lit(0)))
    return out


def by_package(histogram: DataFrame) -> DataFrame:
    """Sums for every prefix of the class names, the whole name being the last: package, depth, n_classes, n_objects, used_size."""
    parts = F.split(F.regexp_replace("name", r"\[\]", ""), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("package")))
    each = histogram.select("n_objects", "used_size", F.explode(prefixes).alias("p"))
    return each.groupBy("p.package", "p.depth").agg(F.count("*").alias("n_classes"), F.sum("n_objects").alias("n_objects"), F.sum("used_size").alias("used_size"))


def by_loader(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("loader_address").agg(F.count("*").alias("n_classes"), F.sum("n_objects").alias("n_objects"), F.sum("used_size").alias("used_size"))


def superclass_closure(classes: DataFrame, depth: int = 100) -> DataFrame:
    """address, ancestor, distance (0: itself). Class tables are small and their hierarchies shallow: a recursive query."""
    spark = classes.sparkSession
    classes.select("address", "super_address").createOrReplaceTempView("__heapscope_classes")
    return spark.sql(f"""
        WITH RECURSIVE up(address, ancestor, distance) MAX RECURSION LEVEL {depth} AS (
            SELECT address, address, 0 FROM __heapscope_classes
            UNION ALL
            SELECT u.address, c.super_address, u.distance + 1 FROM up u JOIN __heapscope_classes c ON u.ancestor = c.address WHERE c.super_address <> 0
        ) SELECT * FROM up""")


def by_superclass(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """ancestor, name, n_objects, used_size: instances of a class and all its subclasses."""
    per = class_stats(objects).join(classes.select(F.col("object_id").alias("class_id"), "address"), "class_id")
    up = superclass_closure(classes).join(per, "address").groupBy("ancestor").agg(F.sum("n_objects").alias("n_objects"), F.sum("used_size").alias("used_size"))
    return up.join(classes.select(F.col("address").alias("ancestor"), "name"), "ancestor").select("ancestor", "name", "n_objects", "used_size")


def duplicate_classes(classes: DataFrame) -> DataFrame:
    return classes.groupBy("name").agg(F.countDistinct("loader_address").alias("n_loaders")).where("n_loaders > 1")


def loaders(classes: DataFrame, histogram: DataFrame) -> DataFrame:
    """loader_address, n_classes defined, n_objects of them."""
    defined = classes.groupBy("loader_address").agg(F.count("*").alias("n_classes"))
    live = histogram.groupBy("loader_address").agg(F.sum("n_objects").alias("n_objects"))
    return defined.join(live, "loader_address", "left").select("loader_address", "n_classes", F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def dominators_grouped(dominators: DataFrame, objects: DataFrame, classes: DataFrame, by: str = "name") -> DataFrame:
    """The top level of the dominator tree by class name, loader_address or package: n_objects, used_size, retained."""
    top = dominators.where("idom = -1").join(objects.select("object_id", "class_id", "used_size"), "object_id")
    named = top.join(classes.select(F.col("object_id").alias("class_id"), "name", "loader_address"), "class_id")
    key = F.regexp_replace("name", r"\.?[^.]*$", "").alias("package") if by == "package" else F.col(by)
    return named.groupBy(key).agg(F.count("*").alias("n_objects"), F.sum("used_size").alias("used_size"), F.sum("retained").alias("retained"))


def biggest(dominators: DataFrame, n: int, total: int) -> DataFrame:
    """The n biggest top-level objects and a row for all others (object_id null)."""
    top = dominators.where("idom = -1").orderBy(F.desc("retained"), "object_id").limit(n).select("object_id", "retained")
    rest = top.agg((F.lit(total) - F.coalesce(F.sum("retained"), F.lit(0))).alias("retained")).select(F.lit(None).cast("bigint").alias("object_id"), "retained")
    return top.unionByName(rest)


def roots_by_type(roots: DataFrame, objects: DataFrame, classes: DataFrame) -> DataFrame:
    """root_type, name, n_objects, used_size; an object that is a root of one type several times counts once."""
    named = objects.join(classes.select(F.col("object_id").alias("class_id"), "name"), "class_id").select("object_id", "name", "used_size")
    return roots.select("object_id", "root_type").distinct().join(named, "object_id").groupBy("root_type", "name").agg(F.count("*").alias("n_objects"), F.sum("used_size").alias("used_size"))


def sampled(objects: DataFrame, n: int) -> DataFrame:
    """Objects with (address >>> 3) divisible by n, the sample of the comparison dumps."""
    return objects.where(F.shiftrightunsigned("address", 3) % n == 0)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other has not, as often as they are missing; side is 'a' or 'b'."""
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    each = both.withColumn("__i", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int"))))
    return each.select(*a.columns, F.when(F.col("__n") > 0, "a").otherwise("b").alias("side"))


#: Least estimates are rounded up to one of these heap sizes in MB, larger ones to a multiple of 4 GB.
HEAPS = (512, 1024, 2048, 4096, 8192, 16384)


def estimate(n_objects: int, n_edges: int | None, n_classes: int) -> dict[str, int]:
    """Bytes of memory, of memory with the object columns in files (tight), of the heap to give to either, and of disk that a graph of this size takes. Fixed
    values: an object has 8 bytes of address, 4 of its bucket, 4 of its edge list, 20 of columns and a quarter of marks (16 MB of them at least), a reference 4 (three an
    object if their number is not known, one at least), all else 50 MB, and 35 % more for safety; on disk 135 bytes an object, 1 KB a class and 100 MB."""
    mb = 1 << 20
    n = max(1, n_objects)
    references = 3 * n if n_edges is None else max(n, n_edges)
    tight = (8 + 4 + 4) * n + 4 * references + max(16 * mb, n // 4) + 50 * mb
    memory, tight = int((tight + 20 * n) * 1.35), int(tight * 1.35)

    def heap(need: int) -> int:
        rounded = next((size for size in HEAPS if need // mb <= size), None)
        return (rounded or -(-(need // mb) // 4096) * 4096) * mb

    return {"memory": memory, "memory_tight": tight, "heap": heap(memory), "heap_tight": heap(tight), "disk": 135 * n + 1024 * n_classes + 100 * mb}
