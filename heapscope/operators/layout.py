"""Alignment, reference size, and sizes and field layouts of classes."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import ship
from ..functions.text import align

#: Bytes of the basic types by HPROF tag; 2 is a reference (fixed values).
TYPE_BYTES = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
TYPE_NAMES = {2: "object", 4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}
OBJECT = 2
LEAST_ALIGN, MOST_ALIGN = 8, 256


def object_alignment(addresses: DataFrame) -> int:
    """The greatest common divisor of the gaps between addresses, from 8 to 256. It equals that of the distances from the least
    address, so nothing is sorted: each task gives one number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        first, out = None, 0
        for batch in batches:
            a = batch.column(0).to_numpy()
            if len(a):
                first = int(a[0]) if first is None else first
                out = gcd(out, int(np.gcd.reduce(np.abs(a - first))))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([out], pa.int64())], names=["first", "step"])

    ship(addresses.sparkSession)
    parts = addresses.select("address").where("address is not null").mapInArrow(run, "first long, step long").collect()
    step = 0
    for r in parts:
        step = gcd(step, gcd(r["step"], abs(r["first"] - parts[0]["first"])))
    return max(LEAST_ALIGN, min(MOST_ALIGN, step))


def overlapping_arrays(arrays: DataFrame) -> DataFrame:
    """compressed: whether, in file order, some object array starts inside what the one before it would fill with references of
    8 bytes. arrays: pos, address, length. Neighbours are found within ranges of the position and, between ranges, by the last
    array of each, so no task sorts the whole file."""
    spread = arrays.withColumn("range", F.shiftright("pos", 22))
    here = Window.partitionBy("range").orderBy("pos")
    lagged = spread.select("range", "pos", "address", F.lag("address").over(here).alias("before"), F.lag("length").over(here).alias("length"))
    ends = spread.groupBy("range").agg(F.max_by(F.struct("address", "length"), "pos").alias("last"))
    between = Window.orderBy("range")  # one row a range of 4 MB of the file
    carried = ends.select("range", F.lag("last").over(between).alias("last"))
    full = lagged.join(carried, "range").select("address", F.coalesce("before", "last.address").alias("before"), F.coalesce("length", "last.length").alias("length"))
    inside = (F.col("address") > F.col("before")) & (F.col("address") < F.col("before") + 16 + 8 * F.col("length"))
    return full.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("compressed"))


def type_bytes(tag: Column, ref_bytes: int) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in {**TYPE_BYTES, OBJECT: ref_bytes}.items() for x in pair])
    return sizes[tag.cast("int")].cast("bigint")


def aligned(n: int, step: int) -> int:
    return -(-n // step) * step


def instance_sizes(classes: list[dict], id_size: int, ref_size: int, step: int) -> dict[int, int]:
    """class address -> bytes of an instance. classes: address, name, super_address, fields (type tags); a driver-side step over the
    class table. An array class has the size of a reference; a class without a superclass that of an object header, whatever fields it names."""
    by_address = {c["address"]: c for c in classes}
    raw: dict[int, int] = {}

    def bytes_of(start: int) -> int:
        trail = []
        while start not in raw:
            c = by_address.get(start)
            if c is None:
                raw[start] = id_size + ref_size
            elif c["name"].endswith("[]"):
                raw[start] = ref_size
            elif not c["super_address"]:
                raw[start] = id_size + ref_size
            elif c["super_address"] in raw:
                own = sum(ref_size if t == OBJECT else TYPE_BYTES[t] for t in c["fields"])
                raw[start] = aligned(own + raw[c["super_address"]], ref_size)
            else:
                if start in trail:
                    raise ValueError(f"class {start:#x} is its own ancestor")
                trail.append(start)
                start = c["super_address"]
                continue
            if trail:
                start = trail.pop()
        return raw[start]

    for a in by_address:
        bytes_of(a)
    return {a: aligned(raw[a], step) for a in by_address}


def instance_used_size(class_size: Column, data_bytes: Column, id_size: int, ref_size: int, step: int) -> Column:
    return F.when(class_size > 0, class_size).otherwise(align(data_bytes + id_size + ref_size, step))


def object_array_size(length: Column, id_size: int, ref_size: int, step: int) -> Column:
    return align(F.lit(id_size + ref_size + 4) + length.cast("bigint") * ref_size, step)


def primitive_array_size(length: Column, tag: Column, id_size: int, ref_size: int, step: int) -> Column:
    return align(F.lit(aligned(id_size + ref_size + 4, ref_size)) + length.cast("bigint") * type_bytes(tag, ref_size), step)


def class_object_size(static_types: list[int], ref_size: int, step: int) -> int:
    return aligned(sum(ref_size if t == OBJECT else TYPE_BYTES[t] for t in static_types), step)


def field_layout(classes: dict[int, dict], start: int, id_size: int) -> list[tuple[int, str, int, int]]:
    """(class address, field, type tag, byte offset) of an instance's fields, its class's own before inherited ones."""
    out, at = [], 0
    while start in classes:
        for name, tag in classes[start]["fields"]:
            out.append((start, name, tag, at))
            at += id_size if tag == OBJECT else TYPE_BYTES[tag]
        start = classes[start]["super_address"]
    return out
