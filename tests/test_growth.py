"""What the driver gets, what is shuffled and what one task holds must not outgrow the heap."""

import pytest
from pyspark.sql import functions as F

from heapscope.functions import staging
from heapscope.operators import aggregates, dominators, edges, ids, reach


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def big(spark, n=300_000):
    """Numbers in order: a few hundred KB as files, many MB in memory."""
    return staging.sized(spark.range(n).select(F.col("id").alias("object_id"), (F.col("id") * 8).alias("address")), "big")


def test_large_tables_are_never_broadcast(spark):
    left, right = big(spark), big(spark)
    small = staging.sized(spark.range(50).select((F.col("id") * 8).alias("address")), "small")
    assert staging.rows_of(left) == 300_000
    assert "BroadcastHashJoin" not in plan(left.join(right.select("address", F.col("object_id").alias("other")), "address"))
    assert "BroadcastHashJoin" in plan(left.join(small, "address"))
    known = staging.united([left, right]).select(F.col("object_id").alias("dst"))
    assert "BroadcastHashJoin" not in plan(spark.range(10).select(F.col("id").alias("dst")).join(known, "dst", "left_anti"))


def test_members_are_not_broadcast(spark):
    tree = big(spark).select("object_id", F.lit(-1).cast("bigint").alias("idom"), F.lit(1).alias("depth"), F.lit(8).cast("bigint").alias("retained"), F.array("object_id").alias("path"), F.lit(None).cast("bigint").alias("pre"), F.lit(None).cast("bigint").alias("last"))
    members = big(spark).select("object_id", F.lit(0).alias("part")).groupBy("object_id", "part").count().select("object_id", "part")
    assert "BroadcastHashJoin" not in plan(dominators.below_another(tree, members))


def test_rounds_deal_references_once(spark):
    """Beside the references themselves, a search shuffles what it comes to, not all references each round."""
    n, depth = 40_000, 6
    links = staging.sized(spark.range(n * depth).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst")), "links")
    starts = staging.sized(spark.range(n).select(F.col("id").alias("object_id")), "starts")
    found, more = reach.levels(links, starts, 12)
    assert [staging.rows_of(f) for f in found] == [n] * (depth + 1) and not more
    by_src = reach.laid_by_source(links, starts)
    assert plan(reach.targets(by_src, big(spark))).count("ENSURE_REQUIREMENTS") == 1
    assert plan(reach.targets(by_src, starts)).count("ENSURE_REQUIREMENTS") == 0
    by_src.unpersist()


def test_search_beyond_what_a_round_asks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 3), (7, 100), (100, 101)], "src long, dst long")
    got = {r["object_id"]: r["distance"] for r in reach.search(links, spark.createDataFrame([(0,)], "object_id long"), 30).collect()}
    assert got == {i: i for i in range(41)} | {100: 8, 101: 9}


def test_absent_objects_lead_nowhere(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    here = spark.createDataFrame([(0,), (1,), (3,)], "object_id long")
    for rounds in (12, 1):
        got = reach.reached(links, spark.createDataFrame([(0,)], "object_id long"), rounds, among=here).join(here, "object_id", "left_semi")
        assert sorted(r[0] for r in got.collect()) == [0, 1]


def test_records_are_ranked_in_one_shuffle(spark):
    rows = [(i * 8, i % 3 * 8, 16, i, False) for i in range(500)] + [(8, 800, 99, -1, True), (16, 800, 99, 10_000, True)]
    raw = spark.createDataFrame(rows, "address long, class_address long, used_size long, pos long, is_array boolean")
    got = {r["address"]: r for r in ids.ranked_records(raw, 500).collect()}
    assert [got[i * 8]["object_id"] for i in range(500)] == list(range(500))
    assert (got[8]["used_size"], got[8]["is_array"], got[16]["used_size"]) == (99, True, 16)
    some = spark.createDataFrame([(a,) for a in (8, 24, 4000, 5)], "object_id long")
    assert [(r["address"], r["object_id"]) for r in ids.ranked_records(raw, 500, some).orderBy("address").collect()] == [(8, 0), (24, 1)]


@pytest.mark.parametrize("hubs", [None, [8]])
def test_references_resolve_with_and_without_hubs(spark, hubs):
    numbers = spark.createDataFrame([(0, 0), (8, 1), (16, 2), (24, 3)], "address long, object_id long")
    refs = spark.createDataFrame([(0, 0, 8), (0, 1, 24), (0, 2, 16), (0, 3, 16), (16, 0, 8), (16, 1, 999), (77, 0, 8)], "src_address long, seq long, dst_address long")
    near = None if hubs is None else numbers.where(F.col("address").isin(hubs))
    out = edges.normalized(edges.resolved(staging.sized(refs, "refs"), numbers, near), "src_address")
    assert sorted(tuple(r) for r in out.select("src", "seq", "dst").collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (2, 0, 1)]


def test_large_tables_get_more_partitions(spark):
    assert staging.parts_for(spark, 100) == 1
    assert staging.parts_for(spark, 100 * staging.TASK_ROWS) == 101


def test_differences_count_repeated_rows(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (1, 2), (3, 4)], "x int, y int")
    b = spark.createDataFrame([(1, 2), (5, 6), (5, 6)], "x int, y int")
    assert sorted(tuple(r) for r in aggregates.differences(a, b).collect()) == [(1, 2, "a"), (1, 2, "a"), (3, 4, "a"), (5, 6, "b"), (5, 6, "b")]


def test_dump_tables_are_written_by_executors(spark, tmp_path):
    """Rows go to files in the order of their key, and the driver gets one name a task."""
    from heapscope.sources import sample

    rows = spark.range(5000).select((4999 - F.col("id")).alias("k"))
    names = sample.written(rows, lambda k: sample.instance(sample.at(12, k), 25, sample.ids(k, 0)), str(tmp_path / "x.hprof"))
    assert len(names) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = b"".join(open(n, "rb").read() for n in names)
    one = sample.instance(sample.at(12, 0), 25, sample.ids(0, 0))
    bodies, at = b"", 0
    while at < len(whole):
        size = int.from_bytes(whole[at + 5 : at + 9], "big")
        bodies, at = bodies + whole[at + 9 : at + 9 + size], at + 9 + size
    assert bodies == b"".join(sample.instance(sample.at(12, k), 25, sample.ids(k, 0)) for k in range(5000)) and len(bodies) == 5000 * len(one)


def test_values_are_made_when_asked_for(spark):
    from heapscope.plans import dump_queries

    d, g = dump_queries.dump(spark, "/root/testdata/sf0.001")
    made = set(g.__dict__)
    dump_queries.queries()["dump_array_fill_ratios"](spark, "/root/testdata/sf0.001").collect()
    assert "objects" not in set(g.__dict__) - made and "fields" not in set(g.__dict__) - made
