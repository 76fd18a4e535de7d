"""Numbering objects by the rank of their address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import parts_for, ship, sized


def ranked(addresses: DataFrame, partitions: int | None = None) -> DataFrame:
    """address, object_id: ids from 0 in ascending order of the distinct addresses. Rows are range partitioned, made distinct
    and sorted in one shuffle; ranks are positions within partitions plus the sizes of those before, one number a partition."""
    spark = addresses.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed(addresses.select("address").where("address is not null").repartitionByRange(n, "address").distinct().sortWithinPartitions("address"))


def placed(rows: DataFrame) -> DataFrame:
    """rows, which are range partitioned and sorted, with object_id: their rank."""
    spark = rows.sparkSession
    # one number holds the partition (upper 31 bits) and the place in it (lower 33)
    local = sized(rows.withColumn("place", F.monotonically_increasing_id()), "ids")
    local = local.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, before))
        before += size
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part long, before long"))  # one row a partition
    return local.join(table, "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("object_id")).hint("merge")


def ranked_records(objects: DataFrame, rows: int | None = None, reached: DataFrame | None = None) -> DataFrame:
    """Of several records of one address the first in file order, with object_id: the rank of its address, all in one shuffle. rows: about how many records.
    reached: object_id, the addresses of those that stay; others are left out before ranking."""
    spark = objects.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = usual if rows is None else parts_for(spark, rows)
    columns = [c for c in objects.columns if c not in ("address", "pos")]
    record = F.struct("pos", *columns)
    every = objects.where("address is not null").select("address", record.alias("r"), F.lit(reached is None).alias("stays"))
    if reached is not None:
        every = every.unionAll(reached.select("object_id", F.lit(None).cast(every.schema["r"].dataType), F.lit(True)))
    first = every.repartitionByRange(n, "address").groupBy("address").agg(F.min("r").alias("r"), F.bool_or("stays").alias("stays")).where("stays and r is not null")
    return placed(first.select("address", *[F.col(f"r.{c}").alias(c) for c in ["pos", *columns]]).sortWithinPartitions("address"))


def numbered_within(rows: DataFrame, key: str, order: list, as_name: str, keep: list[str]) -> DataFrame:
    """keep and as_name: the place (from 0) of each row among those of its key, in the given order. Rows are range partitioned by key and order, so a
    key with very many rows lies in many tasks; of each range the driver gets its last key and how many rows of it there are."""
    spark = rows.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).select(*keep)
    at = keep.index(key)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, now, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_numpy()
            starts = np.r_[0, np.nonzero(np.diff(keys))[0] + 1]
            sizes = np.diff(np.r_[starts, len(keys)])
            place = np.arange(len(keys)) - np.repeat(starts, sizes)
            if keys[0] == now:
                place[: sizes[0]] += upto
            now, upto = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64)), pa.array(np.full(len(keys), part))], names=[*keep, "place", "part"])

    types = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in keep)
    local = sized(dealt.mapInArrow(run, f"{types}, place long, part long"), "numbered")
    ends = local.groupBy("part").agg(F.max(F.struct(F.col(key).alias("key"), "place")).alias("last")).collect()
    offsets, last, carried = [(-1, 0, 0)], None, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        if last is not None:
            offsets.append((r["part"], last, carried))
        carried = r["last"]["place"] + 1 + (carried if r["last"]["key"] == last else 0)
        last = r["last"]["key"]
    table = F.broadcast(spark.createDataFrame(offsets, "part long, last long, carried long"))  # a row for each range
    joined = local.join(table, "part", "left")
    return joined.select(*keep, (F.col("place") + F.when(F.col(key) == F.col("last"), F.col("carried")).otherwise(0)).alias(as_name))


def first_records(objects: DataFrame) -> DataFrame:
    """Of several records of one address the first in file order, without sorting: the least struct of a group."""
    columns = [c for c in objects.columns if c not in ("address", "pos")]
    least = F.min(F.struct("pos", *columns)).alias("r")
    return objects.groupBy("address").agg(least).select("address", *[F.col(f"r.{c}").alias(c) for c in ["pos", *columns]])


def usable_addresses(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct addresses of instances and arrays: not 0 and not a class's."""
    return objects.where("address <> 0").select("address").distinct().join(classes.select("address"), "address", "left_anti")
