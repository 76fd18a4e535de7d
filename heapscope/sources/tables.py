"""A heap made from relational tables: rows are objects, foreign keys references.

Regions hold nations, nations customers, customers orders, orders line items. Line items share nodes: a flag of one order, a day, a
year of one customer. Customers of one segment are held by nobody, so they and what only they hold are garbage; suppliers
point at each other in pairs, unheld. Every 97th order leaves a reference to an order that does not exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import rows_of, sized
from ..schemas import RawHeap

KIND = 1 << 40
GARBAGE_SEGMENT = "MACHINERY"
#: number -> name, number of the superclass, loader (0 system, 1 application, 2 plug-in). A class object's address is 256 * number.
CLASSES = {
    1: ("java.lang.Class", 2, 0),
    2: ("java.lang.Object", 0, 0),
    3: ("db.geo.Region", 12, 1),
    4: ("db.geo.Nation", 12, 1),
    5: ("db.sales.Customer", 12, 1),
    6: ("db.sales.Order", 12, 1),
    7: ("db.sales.LineItem", 12, 1),
    8: ("db.shared.OrderFlag", 13, 1),
    9: ("db.shared.ShipDay", 13, 1),
    10: ("db.shared.CustomerYear", 13, 1),
    11: ("db.peer.Supplier", 2, 2),
    12: ("db.Row", 2, 1),
    13: ("db.Shared", 12, 1),
    14: ("java.lang.ClassLoader", 2, 0),
    15: ("db.shared.ShipDay", 13, 2),
}
LOADER_KIND = 12


def address(kind: int, key: Column) -> Column:
    return F.lit(kind * KIND) + key.cast("bigint")


def flag_code(c: str) -> Column:
    return F.when(F.col(c) == "A", 0).when(F.col(c) == "N", 1).otherwise(2)


def raw_heap(spark: SparkSession, sf_dir: str) -> RawHeap:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def objects(rows: DataFrame, kind: int, number: int, key: Column, size: Column) -> DataFrame:
        return rows.select(address(kind, key).alias("address"), F.lit(256 * number).cast("bigint").alias("class_address"), size.cast("bigint").alias("used_size"))

    def refs(rows: DataFrame, src: Column, dst: Column) -> DataFrame:
        return rows.select(src.alias("src_address"), dst.alias("dst_address"))

    region, nation, customer, orders = table("region"), table("nation"), table("customer"), table("orders")
    lines = table("lineitem").select(
        F.col("l_orderkey"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"),
        F.col("l_linenumber"),
        (F.col("l_orderkey") * 4 + flag_code("l_returnflag")).alias("flag"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        (flag_code("l_returnflag") * 16 + F.when(F.col("l_linestatus") == "F", 0).otherwise(8) + F.pmod(F.year("l_shipdate"), F.lit(8))).alias("year"),
    )
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge"), "l_orderkey").withColumn("year", F.col("o_custkey") * 64 + F.col("year"))
    lines = sized(lines, "lines")  # seven parts of the heap read it
    items = lines.select("l_orderkey", "item", "l_linenumber").distinct()
    flags, days, years = lines.select("flag").distinct(), lines.select("day").distinct(), lines.select("year").distinct()
    suppliers = table("supplier")
    class_rows = [(256 * n, name, 256 * up if up else 0, LOADER_KIND * KIND + loader if loader else 0) for n, (name, up, loader) in CLASSES.items()]
    classes = spark.createDataFrame(class_rows, "address long, name string, super_address long, loader_address long")

    every = [
        objects(region, 1, 3, F.col("r_regionkey"), F.lit(24)),
        objects(nation, 2, 4, F.col("n_nationkey"), F.lit(32)),
        objects(customer, 3, 5, F.col("c_custkey"), 40 + 8 * (F.col("c_custkey") % 4)),
        objects(orders, 4, 6, F.col("o_orderkey"), 48 + 8 * (F.col("o_orderkey") % 3)),
        objects(items, 5, 7, F.col("item"), 56 + 8 * F.col("l_linenumber")),
        objects(flags, 6, 8, F.col("flag"), F.lit(16)),
        objects(days, 7, 9, F.col("day"), F.lit(24)),
        objects(years, 8, 10, F.col("year"), F.lit(32)),
        objects(suppliers, 10, 11, F.col("s_suppkey"), F.lit(40)),
    ]
    bodies = every[0]
    for part in every[1:]:
        bodies = bodies.unionByName(part)
    loaders = spark.createDataFrame([(0, 256 * 14, 32), (LOADER_KIND * KIND + 1, 256 * 14, 64), (LOADER_KIND * KIND + 2, 256 * 14, 64)], "address long, class_address long, used_size long")
    class_objects = classes.select("address", F.lit(256).cast("bigint").alias("class_address"), F.lit(8).cast("bigint").alias("used_size"))
    bodies = sized(bodies.unionByName(loaders).unionByName(class_objects), "raw-objects")

    held = [
        refs(nation, address(1, F.col("n_regionkey")), address(2, F.col("n_nationkey"))),
        refs(customer.where(F.col("c_mktsegment") != GARBAGE_SEGMENT), address(2, F.col("c_nationkey")), address(3, F.col("c_custkey"))),
        refs(orders, address(3, F.col("o_custkey")), address(4, F.col("o_orderkey"))),
        refs(orders.where("o_orderkey % 97 = 0"), address(3, F.col("o_custkey")), address(4, F.col("o_orderkey") + F.lit(10_000_000_000))),
        refs(items, address(4, F.col("l_orderkey")), address(5, F.col("item"))),
        refs(lines, address(5, F.col("item")), address(6, F.col("flag"))),
        refs(lines, address(5, F.col("item")), address(7, F.col("day"))),
        refs(lines, address(5, F.col("item")), address(8, F.col("year"))),
        refs(suppliers, address(10, F.col("s_suppkey")), address(10, F.expr("s_suppkey + if(s_suppkey % 2 = 1, 1, -1)"))),
        refs(classes.where("super_address <> 0"), F.col("address"), F.col("super_address")),
        refs(classes, F.col("address"), F.col("loader_address")),
    ]
    others = held[0]
    for part in held[1:]:
        others = others.unionByName(part)
    # the class first; the others in descending order, so that normalizing has something to do
    edges = bodies.select(F.col("address").alias("src_address"), F.lit(0).cast("bigint").alias("seq"), F.col("class_address").alias("dst_address"))
    edges = edges.unionByName(others.select("src_address", (F.lit(1 << 60) - F.col("dst_address")).alias("seq"), "dst_address"))
    held_by_vm = classes.select("address", F.lit(5).alias("root_type")).unionByName(region.select(address(1, F.col("r_regionkey")).alias("address"), F.lit(1).alias("root_type")))
    held_by_vm = held_by_vm.unionByName(loaders.where("address <> 0").select("address", F.lit(1).alias("root_type")))
    roots = held_by_vm.select("address", "root_type", F.lit(0).cast("bigint").alias("thread_address"), F.col("address").alias("root_seq"))
    return RawHeap(bodies.withColumn("pos", F.col("address")).withColumn("is_array", F.lit(False)), edges, classes, roots, rows_of(bodies))


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, field, kind, i, f, b, text, ref_address: names and balances of customers, names of nations, a line item's first day,
    and the day's number."""
    customer, nation = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"))

    def rows(df: DataFrame, at: Column, field: str, kind: str, **value: Column) -> DataFrame:
        types = {"i": "bigint", "f": "double", "b": "boolean", "text": "string", "ref_address": "bigint"}
        return df.select(at.alias("address"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), *[value.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])

    out = rows(customer, address(3, F.col("c_custkey")), "name", "text", text=F.col("c_name"))
    out = out.unionByName(rows(nation, address(2, F.col("n_nationkey")), "name", "text", text=F.col("n_name")))
    out = out.unionByName(rows(customer, address(3, F.col("c_custkey")), "balance", "real", f=F.col("c_acctbal")))
    out = out.unionByName(rows(lines.groupBy("item").agg(F.min("day").alias("day")), address(5, F.col("item")), "shipDay", "object", ref_address=address(7, F.col("day"))))
    return out.unionByName(rows(lines.select("day").distinct(), address(7, F.col("day")), "value", "integer", i=F.col("day")))
