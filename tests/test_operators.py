"""Operators against brute force on random graphs and against small worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from heapscope.functions import text
from heapscope.operators import aggregates, asof, dominators, edges, ids, layout, reach


def brute_dominators(n, pairs, starts):
    out = {u: [] for u in range(n)}
    for a, b in pairs:
        out[a].append(b)

    def reached(without):
        seen = {s for s in starts if s != without}
        stack = list(seen)
        while stack:
            for t in out[stack.pop()]:
                if t != without and t not in seen:
                    seen.add(t)
                    stack.append(t)
        return seen

    live = reached(None)
    above = {v: set() for v in live}
    for d in live:
        for v in live - reached(d) - {d}:
            above[v].add(d)
    return {v: max(up, key=lambda d: len(above[d])) if up else -1 for v, up in above.items()}


def heap_of(spark, n, pairs):
    objects = spark.createDataFrame([(i, 100 + i, 0, 10 + i, False) for i in range(n)], "object_id long, address long, class_id long, used_size long, is_array boolean")
    return objects, spark.createDataFrame([(a, i, b) for i, (a, b) in enumerate(pairs)] or [(0, 0, 0)], "src long, seq long, dst long")


@pytest.mark.parametrize(("peels", "depth"), [(1, 256), (40, 256), (1, 0)])
def test_dominators_of_random_graphs(spark, peels, depth):
    # many graphs as one: disjoint ranges of ids
    rng, pairs, starts, want = random.Random(peels), [], [], {}
    for k in range(60):
        n, base = rng.randint(2, 12), 20 * k
        own = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
        if k % 2:
            own = [(a, b) for a, b in own if a < b]  # without cycles
        first = rng.sample(range(n), rng.randint(1, 2))
        want |= {base + v: (base + d if d >= 0 else -1) for v, d in brute_dominators(n, own, first).items()}
        pairs += [(base + a, base + b) for a, b in own]
        starts += [base + s for s in first]
    objects, table = heap_of(spark, 1200, pairs)
    roots = spark.createDataFrame([(s,) for s in starts], "object_id long")
    live = reach.search(table, roots).select("object_id")
    inside = table.join(live.withColumnRenamed("object_id", "src"), "src", "left_semi")
    tree = dominators.dominator_table(objects.join(live, "object_id", "left_semi"), inside, roots, peels, depth)
    got = {r["object_id"]: (r["idom"], r["retained"]) for r in tree.collect()}
    assert {v: d for v, (d, _) in got.items()} == want
    children = {}
    for v, d in want.items():
        children.setdefault(d, []).append(v)

    def kept(v):
        return 10 + v + sum(map(kept, children.get(v, ())))

    assert all(size == kept(v) for v, (_, size) in got.items())
    assert dominators.has_paths(tree) == bool(depth)

    def under(v):
        return {v}.union(*map(under, children.get(v, ())))

    chosen = sorted(want)[:: 7]
    table = spark.createDataFrame([(v,) for v in chosen], "object_id long")
    assert {r["object_id"] for r in dominators.retained_set(tree, table).collect()} == set().union(*map(under, chosen))
    members = {v: v % 3 for v in want}
    held = {(r["object_id"], r["part"]) for r in dominators.below_another(tree, spark.createDataFrame(list(members.items()), "object_id long, part int")).collect()}
    assert held == {(v, members[v]) for u in want for v in under(u) - {u} if members[u] == members[v]}


def test_mutual_references_below_one_owner(spark):
    pairs = [(0, 1), (1, 2), (1, 3), (2, 3), (3, 2)]
    objects, table = heap_of(spark, 4, pairs)
    tree = dominators.dominator_table(objects, table, objects.where("object_id = 0").select("object_id"))
    assert {r["object_id"]: r["idom"] for r in tree.collect()} == {0: -1, 1: 0, 2: 1, 3: 1}


def test_class_minimum_retained(spark):
    objects = spark.createDataFrame([(0, 1, 0, 100, False), (1, 2, 0, 40, False), (2, 3, 0, 20, False), (3, 4, 0, 7, False)], "object_id long, address long, class_id long, used_size long, is_array boolean")
    tree = spark.createDataFrame([(0, -1, 100, [0], 0, 2), (1, 0, 60, [0, 1], 1, 2), (2, 1, 20, [0, 1, 2], 2, 2), (3, -1, 7, [3], 3, 3)], "object_id long, idom long, retained long, path array<long>, pre long, last long")
    classes = spark.createDataFrame([(0,)], "object_id long")
    assert [tuple(r) for r in dominators.class_min_retained(objects, tree, classes).collect()] == [(0, 207)]
    children = [(r["idom"], r["nr"], r["object_id"]) for r in dominators.dominated_children(tree).collect()]
    assert sorted(children) == [(-1, 0, 0), (-1, 1, 3), (0, 0, 1), (1, 0, 2)]
    assert dominators.first_with_retained(tree, 60).first()[0] == 1
    assert {r["object_id"] for r in dominators.retained_set(tree, tree.where("object_id = 1")).collect()} == {1, 2}


def test_compaction(spark):
    objects = spark.createDataFrame([(0, 0, 0, 1, False), (1, 0xC1A55, 1, 1, False), *[(i, 0x100 * (i - 1), 1, 1, False) for i in range(2, 6)]], "object_id long, address long, class_id long, used_size long, is_array boolean")
    table = spark.createDataFrame([(2, 0, 1), (2, 1, 3), (3, 0, 1), (4, 0, 1), (4, 1, 5), (5, 0, 1), (5, 1, 3)], "src long, seq long, dst long")
    kept, moved, numbers = reach.compacted(objects, table, spark.createDataFrame([(0,), (1,), (3,), (5,)], "object_id long"))
    assert {r["old_id"]: r["object_id"] for r in numbers.collect()} == {0: 0, 1: 1, 3: 2, 5: 3}
    assert sorted((r["src"], r["dst"]) for r in moved.collect()) == [(2, 1), (3, 1), (3, 2)] and kept.count() == 4
    made = reach.artificial_roots(objects, edges.normalized(table), spark.createDataFrame([(1,)], "object_id long"))
    assert {2, 4} <= {r["object_id"] for r in made.collect()}


def test_long_chains_are_found(spark):
    table = spark.createDataFrame([(i, 0, i + 1) for i in range(60)] + [(30, 1, 100), (200, 0, 201)], "src long, seq long, dst long")
    got = {r["object_id"]: r["distance"] for r in reach.search(table, spark.createDataFrame([(0,)], "object_id long"), rounds=5).collect()}
    assert got == {**{i: i for i in range(61)}, 100: 31}


def test_long_lists_have_no_paths(spark):
    n = 2000
    objects, table = heap_of(spark, n, [(i, i + 1) for i in range(n - 1)])
    tree = dominators.dominator_table(objects, table, objects.where("object_id = 0").select("object_id"))
    got = {r["object_id"]: (r["idom"], r["depth"], r["retained"]) for r in tree.collect()}
    assert not dominators.has_paths(tree) and got[0] == (-1, 1, sum(range(10, 10 + n))) and got[n - 1] == (n - 2, n, 9 + n)


def test_picking_roots_on_cycles():
    assert reach.pick_cycle_roots({1: [2], 2: [1]}, {1: 1, 2: 1}) == [1]
    assert reach.pick_cycle_roots({1: [2], 2: [3], 3: [1]}, {1: 1, 2: 1, 3: 1}) == [1]
    busy = {1: [*range(2, 14)], **{i: [1] for i in range(2, 14)}}
    assert reach.pick_cycle_roots(busy, {1: 12, **{i: 1 for i in range(2, 14)}}) == [1]


def test_ids_edges_and_first_records(spark):
    rows = spark.createDataFrame([(5, 2, "b"), (5, 1, "a"), (9, 0, "c")], "address long, pos long, what string")
    assert sorted((r["address"], r["what"]) for r in ids.first_records(rows).collect()) == [(5, "a"), (9, "c")]
    many = spark.range(0, 3000).select((F.col("id") * 7919 % 100003 - 500).alias("address"))
    got = [(r["address"], r["object_id"]) for r in ids.ranked(many.union(many)).orderBy("address").collect()]
    assert [i for _, i in got] == list(range(3000)) and [a for a, _ in got] == sorted(a for a, _ in got)
    table = spark.createDataFrame([(1, 0, 9), (1, 1, 5), (1, 2, 3), (1, 3, 5), (1, 4, 9)], "src long, seq long, dst long")
    assert [r["dst"] for r in edges.normalized(table).orderBy("seq").collect()] == [9, 3, 5]
    assert edges.first_edge(table).first()["dst"] == 9
    classes = spark.createDataFrame([(9,), (700,)], "address long")
    assert [r["address"] for r in ids.usable_addresses(spark.createDataFrame([(0,), (9,), (5,), (5,)], "address long"), classes).collect()] == [5]


def test_as_of(spark):
    roots = spark.createDataFrame([(1, 3, 7, 10), (2, 3, 7, 30), (3, 7, 7, 40), (4, 2, 8, 40)], "address long, root_type int, thread_serial long, pos long")
    threads = spark.createDataFrame([(100, 7, 10), (200, 7, 25)], "address long, thread_serial long, pos long")
    assert {r["address"]: r["thread_address"] for r in asof.with_thread_address(roots, threads).collect()} == {1: 0, 2: 200, 3: 0, 4: 0}


def test_alignment_and_sizes(spark):
    addresses = lambda *a: spark.createDataFrame([(x,) for x in a], "address long").repartition(3)
    assert [layout.object_alignment(addresses(*a)) for a in ((0x1000, 0x2000, 0x5000), (16, 40, 64), (8, 20), (5,))] == [256, 24, 12, 8]
    plain = [{"address": 1, "name": "A", "super_address": 0, "fields": [11, 11]}, {"address": 2, "name": "B", "super_address": 1, "fields": [4, 2]}, {"address": 3, "name": "int[]", "super_address": 1, "fields": []}]
    assert layout.instance_sizes(plain, 8, 4, 8) == {1: 16, 2: 24, 3: 8}
    with pytest.raises(ValueError):
        layout.instance_sizes([{"address": 1, "name": "A", "super_address": 2, "fields": []}, {"address": 2, "name": "B", "super_address": 1, "fields": []}], 8, 8, 8)
    arrays = lambda *rows: layout.overlapping_arrays(spark.createDataFrame(rows, "pos long, address long, length long")).first()[0]
    assert arrays((1, 1000, 10), (2, 1056, 1)) and not arrays((1, 1000, 10), (2, 1096, 1)) and arrays((1, 1000, 10), (1 << 23, 1056, 1))


def test_names_frames_and_sizes(spark):
    df = spark.createDataFrame([("java/lang/String",), ("[I",), ("[[Lcom/x/Y;",), ("[Lorg/A;",), ("a/b(c/d)",), (None,), ("[bad",)], "n string")
    assert [r[0] for r in df.select(text.class_name(F.col("n"))).collect()] == ["java.lang.String", "int[]", "com.x.Y[][]", "org.A[]", "a.b(c/d)", "UnknownClass", "[bad"]
    kinds = spark.createDataFrame([(1,), (5,), (0x1000,), (99,)], "t int").select(text.root_kind(F.col("t")))
    assert [r[0] for r in kinds.collect()] == ["NATIVE_STATIC", "SYSTEM_CLASS", "UNREACHABLE", "UNKNOWN"]
    assert [text.parse_size(s) for s in ("512M", "4GB", "1.5G", "77", "2 kb")] == [512 << 20, 4 << 30, 3 << 29, 77, 2048] and text.format_size(3 << 29) == "1.5 GB"
    with pytest.raises(ValueError):
        text.parse_size("many")
    row = spark.createDataFrame([("a\n\\\x01", "x:y;%")], "a string, b string").select(text.escape_controls(F.col("a")), text.escape_field(F.col("b")), text.loader_label(F.lit(0)), text.loader_label(F.lit(255)), text.align(F.lit(13).cast("bigint"), 8)).first()
    assert tuple(row) == ("a\\n\\\\\\u0001", "x%3Ay%3B%25", "<system class loader>", "ClassLoader@ff", 16)


def test_comparison_and_estimate(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x long"), spark.createDataFrame([(1,), (3,)], "x long")
    assert sorted((r["x"], r["side"]) for r in aggregates.differences(a, b).collect()) == [(1, "a"), (2, "a"), (3, "b")]
    mb = 1 << 20
    small = aggregates.estimate(1000, 2000, 10)
    assert small["memory"] == int((44_000 + 66 * mb) * 1.35) and small["memory_tight"] == int((24_000 + 66 * mb) * 1.35)
    assert small["heap"] == 512 * mb and small["disk"] == 135_000 + 10 * 1024 + 100 * mb
    large = aggregates.estimate(47_900_000, None, 2000)
    assert large["memory"] == int((48 * 47_900_000 + 66 * mb) * 1.35) and large["heap"] == 4096 * mb and large["heap_tight"] <= large["heap"]
    assert aggregates.estimate(400_000_000, None, 1)["heap"] % (4096 * mb) == 0


def test_reached_equals_search_on_lists_rings_and_random_graphs(spark):
    rng = random.Random(5)
    pairs, starts = [], [0, 5000, 9000]
    pairs += [(i, i + 1) for i in range(300)] + [(300, 400), (400, 401), (401, 400), (150, 400)]  # a list and a ring behind it
    pairs += [(600 + i, 600 + (i + 1) % 50) for i in range(50)]  # a ring that nothing refers to
    pairs += [(5000 + i, 5001 + i) for i in range(120)] + [(5001 + i, 5000 + i) for i in range(120)]  # a list linked both ways
    pairs += [(9000 + rng.randrange(200), 9000 + rng.randrange(200)) for _ in range(330)]
    pairs = sorted(set(pairs))
    _, table = heap_of(spark, 1, pairs)
    roots = spark.createDataFrame([(s,) for s in starts], "object_id long")
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    seen, stack = set(starts), list(starts)
    while stack:
        for t in out.get(stack.pop(), ()):
            if t not in seen:
                seen.add(t)
                stack.append(t)
    for rounds in (2, 5):
        got = [r["object_id"] for r in reach.reached(table.select("src", "dst"), roots, rounds).collect()]
        assert len(got) == len(set(got)) and set(got) == seen


def test_a_core_beyond_memory_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(dominators, "MAX_CORE", 5)
    objects, table = heap_of(spark, 9, [(0, 1), *[(i, i % 8 + 1) for i in range(1, 9)], (0, 4)])
    with pytest.raises(MemoryError):
        dominators.dominator_table(objects, table, objects.where("object_id = 0").select("object_id"))


def test_numbers_within_hot_keys(spark):
    rng = random.Random(6)
    rows = [(7, i, rng.randrange(5)) for i in range(500)] + [(rng.randrange(20), i, rng.randrange(5)) for i in range(500, 700)]
    df = spark.createDataFrame(rows, "k long, v long, w long").repartition(5)
    got = {(r["k"], r["v"]): r["nr"] for r in ids.numbered_within(df, "k", [F.desc("w"), "v"], "nr", ["k", "v", "w"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for nr, (_, v, _) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))):
            want[k, v] = nr
    assert got == want
    assert ids.numbered_within(df.limit(0), "k", ["v"], "nr", ["k", "v"]).count() == 0
