"""References between numbered objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import parts_for, rows_of
from .ids import numbered_within


def resolved(refs: DataFrame, ids: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """src_address, src, seq, dst by id. Null references (address 0 past the class) and references to absent objects go. hubs: rows of ids that
    most references lead to (classes); they are looked up without dealing those references by what they lead to."""
    at_src = ids.select(F.col("address").alias("src_address"), F.col("object_id").alias("src"))
    at_dst = ids.select(F.col("address").alias("dst_address"), F.col("object_id").alias("dst"))
    parts = parts_for(refs.sparkSession, rows_of(refs))
    refs = refs.select("src_address", "seq", "dst_address")
    at_dst = at_dst.hint("shuffle_hash")
    if hubs is None:
        aimed = refs.join(at_dst, "dst_address")
    else:
        near = F.broadcast(hubs.select(F.col("address").alias("dst_address"), F.col("object_id").alias("dst")))
        aimed = refs.join(near, "dst_address").unionByName(refs.join(near, "dst_address", "left_anti").join(at_dst, "dst_address"))
    return aimed.repartition(parts, "src_address").join(at_src.repartition(parts, "src_address").hint("shuffle_hash"), "src_address").select("src_address", "src", "seq", "dst")


def first_edge(edges: DataFrame) -> DataFrame:
    """src, dst of each object's first reference."""
    return edges.groupBy("src").agg(F.min_by("dst", "seq").alias("dst"))


def normalized(edges: DataFrame, key: str = "src") -> DataFrame:
    """The first reference stays first; the others follow ascending, each once and without the first's target. One shuffle and one sort: a reference's place
    is its place among the targets in order, and those before the first's target move on by one."""
    own = [key] if key != "src" else []  # edges that are dealt by the address of their source are not dealt again
    pairs = (edges if own else edges.repartition("src")).groupBy(*own, "src", "dst").agg(F.min("seq").alias("seq"))
    ascending, whole = Window.partitionBy(key).orderBy("dst"), Window.partitionBy(key)
    placed = pairs.select("src", "dst", F.row_number().over(ascending).cast("bigint").alias("place"), F.min_by("dst", "seq").over(whole).alias("first"))
    seq = F.when(F.col("dst") == F.col("first"), F.lit(0).cast("bigint")).when(F.col("dst") < F.col("first"), F.col("place")).otherwise(F.col("place") - 1)
    return placed.select("src", seq.alias("seq"), "dst")


def with_class_first(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """As read: an object whose list does not begin with its class gets the class in front."""
    first = edges.where("seq = 0").select(F.col("src").alias("object_id"), F.col("dst").alias("first"))
    missing = objects.join(first, "object_id", "left").where("first is null or first <> class_id").select(F.col("object_id").alias("src"), F.col("class_id").alias("dst"))
    shifted = edges.join(missing.select("src", F.lit(1).alias("by")), "src", "left").select("src", (F.col("seq") + F.coalesce("by", F.lit(0))).alias("seq"), "dst")
    return shifted.unionByName(missing.select("src", F.lit(0).cast("bigint").alias("seq"), "dst"))


def inbound(edges: DataFrame) -> DataFrame:
    """dst, seq, src: who refers to an object; those whose first reference it is (its instances) before the others, each ascending."""
    marked = edges.select("dst", "src", (F.col("seq") > 0).cast("int").alias("later"))
    return numbered_within(marked, "dst", ["later", "src"], "seq", ["dst", "src"]).select("dst", "seq", "src")


def degrees(edges: DataFrame) -> DataFrame:
    """object_id, n_out, n_in, in one shuffle of signed counts."""
    both = edges.select(F.col("src").alias("object_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("object_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def class_references(edges: DataFrame, objects: DataFrame, classes: DataFrame) -> DataFrame:
    """from_class, to_class, n_refs over all references but those to the object's own class object."""
    named = objects.select("object_id", "class_id").join(classes.select(F.col("object_id").alias("class_id"), "name"), "class_id")
    a = named.select(F.col("object_id").alias("src"), F.col("name").alias("from_class"))
    b = named.select(F.col("object_id").alias("dst"), F.col("name").alias("to_class"))
    return edges.where("seq > 0").join(a, "src").join(b, "dst").groupBy("from_class", "to_class").agg(F.count("*").alias("n_refs"))
