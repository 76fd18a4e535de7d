"""As-of lookups: the latest record of a key before a position in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(left: DataFrame, right: DataFrame, key: str, pos: str, value: str, as_name: str) -> DataFrame:
    """left with `as_name`: the value of right's last row of the same key at a smaller position (null if there is none). One shuffle by key of the
    union of both, no range join. left's columns are kept."""
    fields = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(F.col(key).alias("__k"), F.col(pos).alias("__p"), F.lit(0).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), fields.alias("__row"))
    b = right.select(F.col(key).alias("__k"), F.col(pos).alias("__p"), F.lit(1).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    # at one position the lookup comes before the record, so only earlier records count
    order = Window.partitionBy("__k").orderBy("__p", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    return seen.where("__side = 0").select("__row.*", F.col("__v").alias(as_name))


#: Root sub-records that a thread holds: JNI local, Java frame, native stack, thread block (fixed values).
THREAD_ROOTS = (0x02, 0x03, 0x04, 0x06)


def with_thread_address(roots: DataFrame, threads: DataFrame) -> DataFrame:
    """roots (address, root_type, thread_serial, pos) with thread_address: the address of the latest thread object of that serial before the
    root's record, 0 if there is none or the root is of another kind. threads: address, thread_serial, pos."""
    found = latest_before(roots, threads.select("thread_serial", "pos", F.col("address").alias("__thread")), "thread_serial", "pos", "__thread", "__found")
    held = F.col("root_type").isin(*THREAD_ROOTS)
    return found.withColumn("thread_address", F.when(held, F.coalesce("__found", F.lit(0))).otherwise(F.lit(0)).cast("bigint")).drop("__found")


def with_string(rows: DataFrame, strings: DataFrame, id_column: str, as_name: str) -> DataFrame:
    """rows with the text that string id `id_column` had when the row was recorded. strings: string_id, pos, value."""
    return latest_before(rows.withColumn("string_id", F.col(id_column)), strings, "string_id", "pos", "value", as_name).drop("string_id")
