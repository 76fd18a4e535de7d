"""Immediate dominators, retained sizes and what follows from the dominator tree.

Edges into roots cannot matter and go first. Objects without references are then peeled off, round by round; what is left when nothing more can be
peeled (cycles and what leads to them) is the core, done by one task with a semi-dominator algorithm. Peeled objects come back in reverse
order: the dominator of an object is the deepest common ancestor of its referrers. Each object carries its path from the top of the dominator
tree; the common prefix of many paths is that of the least and the greatest of them, both of which Spark pre-aggregates.

A core whose dominator tree is deeper than MAX_DEPTH (long linked lists) would make long paths. Then one task does the whole
graph and gives, in place of paths, the interval of each object's subtree in a numbering of the tree (`pre` to `last`); what looks
for ancestors works on either form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import sized, united, unstage
from .ids import numbered_within

#: Rounds of peeling; what is deeper is left to the core.
PEELS = 40
#: Depth of the core's dominator tree up to which objects carry paths.
MAX_DEPTH = 256
#: References that one task may hold: about 150 bytes each, 6 GB in all. A larger core is an error, not a lost executor.
MAX_CORE = 40_000_000
TOP, SIZE = -1, -2


def dominator_paths(edges: DataFrame, roots: DataFrame, peels: int = PEELS, max_depth: int = MAX_DEPTH) -> DataFrame | None:
    """object_id, path: ids from a top-level object down to the object itself. edges: src, dst between reachable
    objects; roots: object_id. Objects that no root reaches have no row. None if paths would be longer than max_depth and the peels."""
    starts = sized(roots.select("object_id").distinct(), "dom-roots")
    inner = edges.select("src", "dst").where("src <> dst").distinct().join(starts.select(F.col("object_id").alias("dst")), "dst", "left_anti")
    left, layers, rounds, slow = inner.select("src", "dst"), [], [], 0
    for _ in range(peels):
        # one join a round: edges into objects without references (goes) and the others lie in folders of their own
        sources = left.select(F.col("src").alias("at")).distinct()
        parted = left.join(sources.hint("merge"), F.col("dst") == F.col("at"), "left").select("src", "dst", F.col("at").isNull().alias("goes"))
        parted = sized(parted, "dom-round", by="goes")
        rounds.append(parted)
        sizes = dict(parted.groupBy("goes").count().collect())
        left = parted.where("not goes").select("src", "dst")
        if not sizes.get(True):
            break
        layers.append(parted.where("goes").select("src", "dst"))
        if not sizes.get(False):
            break
        # what peels by a few objects a round is long lists: the core does them at once, if it may hold them
        slow = slow + 1 if sizes[True] * 1000 < sizes[False] + 1000 else 0
        if slow == 3 and sizes[False] <= MAX_CORE:
            break
    done = [starts.select("object_id", F.array("object_id").alias("path"))]
    core = left.count()
    if core:
        if core > MAX_CORE:
            raise MemoryError(f"{core} references on cycles or lists deeper than {peels}: more than the {MAX_CORE} that one task may hold")
        done = [sized(core_paths(left, starts, max_depth), "dom-core")]
        if not done[0].where(F.col("object_id") == TOP).isEmpty():
            unstage(starts, *done, *rounds)
            return None
    for layer in reversed(layers):
        known = united(done).select(F.col("object_id").alias("src"), "path")
        ends = layer.select("src", "dst").join(known, "src").groupBy("dst").agg(F.min("path").alias("a"), F.max("path").alias("b"))
        short = F.least(F.size("a"), F.size("b"))
        unequal = F.filter(F.sequence(F.lit(0), short - 1), lambda i: F.get("a", i) != F.get("b", i))
        same = F.coalesce(F.get(unequal, F.lit(0)), short)
        common = F.slice("a", F.lit(1), same)
        done.append(sized(ends.select(F.col("dst").alias("object_id"), F.concat(common, F.array("dst")).alias("path")), "dom-paths"))
    unstage(*rounds)
    return united(done)


def core_paths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Paths of the objects on the given edges and of the roots, by one task; a single row of object -1 if some are too long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows = pa.Table.from_batches(list(batches))
        src, dst = rows.column(0).to_pandas().to_numpy(np.int64), rows.column(1).to_pandas().to_numpy(np.int64)
        starts = np.unique(dst[src == TOP])
        src, dst = src[src != TOP], dst[src != TOP]
        names = np.unique(np.concatenate((starts, src, dst)))
        idom = immediate_dominators(np.searchsorted(names, src), np.searchsorted(names, dst), np.searchsorted(names, starts), len(names))
        depth: dict[int, int] = {-1: 0}
        for v, up in idom:  # in search order, so dominators come first
            depth[v] = depth[up] + 1
        if max(depth.values()) > max_depth:
            yield pa.RecordBatch.from_arrays([pa.array([TOP], pa.int64()), pa.array([[]], pa.list_(pa.int64()))], names=["object_id", "path"])
            return
        paths: dict[int, list[int]] = {}
        for v, up in idom:
            paths[v] = [*(paths[up] if up >= 0 else []), int(names[v])]
        for low in range(0, len(idom), 10_000):
            part = [v for v, _ in idom[low : low + 10_000]]
            yield pa.RecordBatch.from_arrays([pa.array(names[part], pa.int64()), pa.array([paths[v] for v in part], pa.list_(pa.int64()))], names=["object_id", "path"])

    lines = edges.select("src", "dst").unionAll(roots.select(F.lit(TOP).cast("bigint"), "object_id"))
    return lines.repartition(1).mapInArrow(run, "object_id long, path array<bigint>")


def immediate_dominators(src, dst, starts, n: int) -> list[tuple[int, int]]:
    """(vertex, immediate dominator or -1) in depth-first order, by semi-dominators with path compression (Lengauer and Tarjan).
    Vertices are 0..n-1; all starts hang on one virtual vertex."""
    import numpy as np

    order = np.argsort(src, kind="stable")
    heads = np.searchsorted(src[order], np.arange(n + 1))
    targets = dst[order].tolist()
    back = np.argsort(dst, kind="stable")
    tails = np.searchsorted(dst[back], np.arange(n + 1))
    sources = src[back].tolist()
    heads, tails = heads.tolist(), tails.tolist()
    number, vertex, parent = [-1] * n, [-1], [0]  # numbers count from 1; 0 is the virtual vertex
    is_start = set(starts.tolist())
    for s in starts.tolist():
        if number[s] >= 0:
            continue
        number[s] = len(vertex)
        vertex.append(s)
        parent.append(0)
        stack = [(s, heads[s])]
        while stack:
            v, at = stack.pop()
            while at < heads[v + 1]:
                w = targets[at]
                at += 1
                if number[w] < 0:
                    number[w] = len(vertex)
                    vertex.append(w)
                    parent.append(number[v])
                    stack.append((v, at))
                    stack.append((w, heads[w]))
                    break
    m = len(vertex)
    semi, best, ancestor, dom = list(range(m)), list(range(m)), [-1] * m, [0] * m
    bucket: list[list[int]] = [[] for _ in range(m)]

    def lowest(v: int) -> int:
        """The vertex of least semi-dominator on the path above v, compressing the path on the way."""
        if ancestor[v] < 0:
            return v
        trail = []
        while ancestor[ancestor[v]] >= 0:
            trail.append(v)
            v = ancestor[v]
        for u in reversed(trail):
            up = ancestor[u]
            if semi[best[up]] < semi[best[u]]:
                best[u] = best[up]
            ancestor[u] = ancestor[up]
        return best[trail[0]] if trail else best[v]

    for w in range(m - 1, 0, -1):
        v = vertex[w]
        low = 0 if v in is_start else semi[w]
        for i in range(tails[v], tails[v + 1]):
            u = number[sources[i]]
            if u >= 0:
                low = min(low, semi[lowest(u)])
        semi[w] = low
        bucket[low].append(w)
        p = parent[w]
        ancestor[w] = p
        for u in bucket[p]:
            x = lowest(u)
            dom[u] = x if semi[x] < semi[u] else p
        bucket[p] = []
    for w in range(1, m):
        if dom[w] != semi[w]:
            dom[w] = dom[dom[w]]
    return [(vertex[w], vertex[dom[w]] if dom[w] else -1) for w in range(1, m)]


def dominator_table(objects: DataFrame, edges: DataFrame, roots: DataFrame, peels: int = PEELS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """object_id, idom (-1: top level or not reached), depth, retained, and either path or pre and last (the others null)."""
    paths = dominator_paths(edges, roots, peels, max_depth)
    if paths is None:
        known = sized(deep_dominators(objects, edges, roots), "dom-deep")
    else:
        weighed = paths.join(objects.select("object_id", "used_size"), "object_id")
        retained = weighed.select(F.explode("path").alias("object_id"), "used_size").groupBy("object_id").agg(F.sum("used_size").alias("retained"))
        up = F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(F.lit(TOP)).cast("bigint")
        none = F.lit(None).cast("bigint")
        known = paths.select("object_id", up.alias("idom"), F.size("path").alias("depth"), "path", none.alias("pre"), none.alias("last")).join(retained, "object_id")
    alone = objects.join(known.select("object_id"), "object_id", "left_anti")
    own = F.array("object_id") if paths is not None else F.lit(None).cast("array<bigint>")
    # in the numbering, what is not reached has numbers of its own below 0
    number = F.lit(None).cast("bigint") if paths is not None else -F.col("object_id") - 1
    alone = alone.select("object_id", F.lit(TOP).cast("bigint").alias("idom"), F.lit(1).alias("depth"), own.alias("path"), number.alias("pre"), number.alias("last"), F.col("used_size").alias("retained"))
    return known.unionByName(alone).select("object_id", "idom", "depth", "retained", "path", "pre", "last")


def deep_dominators(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The dominator tree of a whole graph by one task: object_id, idom, depth, path (null), pre, last, retained."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows = pa.Table.from_batches(list(batches))
        a, b = rows.column(0).to_pandas().to_numpy(np.int64), rows.column(1).to_pandas().to_numpy(np.int64)
        start, size = a == TOP, a == SIZE
        src, dst = a[~start & ~size], b[~start & ~size]
        names = np.unique(np.concatenate((b[start], src, dst)))
        weights = np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(names, b[size]), len(names) - 1)
        found = names[at] == b[size]
        weights[at[found]] = rows.column(2).to_pandas().to_numpy(np.int64)[size][found]
        idom = immediate_dominators(np.searchsorted(names, src), np.searchsorted(names, dst), np.unique(np.searchsorted(names, b[start])), len(names))
        count, retained = [1] * len(names), weights.tolist()
        for v, up in reversed(idom):
            if up >= 0:
                count[up] += count[v]
                retained[up] += retained[v]
        pre, free, depth, top = [0] * len(names), [0] * len(names), [0] * len(names), 0
        for v, up in idom:  # dominators come first and give out the places below them
            if up < 0:
                pre[v], depth[v], top = top, 1, top + count[v]
            else:
                pre[v], depth[v] = free[up], depth[up] + 1
                free[up] += count[v]
            free[v] = pre[v] + 1
        for low in range(0, len(idom), 100_000):
            part = idom[low : low + 100_000]
            vs = [v for v, _ in part]
            columns = [
                pa.array(names[vs], pa.int64()), pa.array([int(names[u]) if u >= 0 else TOP for _, u in part], pa.int64()), pa.array([depth[v] for v in vs], pa.int32()), pa.nulls(len(vs), pa.list_(pa.int64())),
                pa.array([pre[v] for v in vs], pa.int64()), pa.array([pre[v] + count[v] - 1 for v in vs], pa.int64()), pa.array([retained[v] for v in vs], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["object_id", "idom", "depth", "path", "pre", "last", "retained"])

    zero = F.lit(0).cast("bigint")
    n = edges.count()
    if n > MAX_CORE:
        raise MemoryError(f"a dominator tree deeper than {MAX_DEPTH} of a graph with {n} references: more than the {MAX_CORE} that one task may hold")
    lines = edges.where("src <> dst").select("src", "dst", zero.alias("size")).distinct()
    lines = lines.unionAll(roots.select(F.lit(TOP).cast("bigint"), "object_id", zero)).unionAll(objects.select(F.lit(SIZE).cast("bigint"), "object_id", "used_size"))
    return lines.repartition(1).mapInArrow(run, "object_id long, idom long, depth int, path array<bigint>, pre long, last long, retained long")


def has_paths(dominators: DataFrame) -> bool:
    return dominators.where("path is null").isEmpty()


def below_another(dominators: DataFrame, members: DataFrame) -> DataFrame:
    """members (object_id, part) that have another member of their part above them in the dominator tree, each once."""
    if has_paths(dominators):
        above = members.join(dominators.select("object_id", "path"), "object_id").select("object_id", "part", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("upper"))
        return above.join(members.select(F.col("object_id").alias("upper"), "part").hint("merge"), ["upper", "part"], "left_semi").select("object_id", "part").distinct()
    # subtrees nest: a member is below another where an earlier one's interval reaches over it
    placed = members.join(dominators.select("object_id", "pre", "last"), "object_id")
    earlier = Window.partitionBy("part").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("reach", F.max("last").over(earlier)).where("reach >= pre").select("object_id", "part")


def dominated_children(dominators: DataFrame) -> DataFrame:
    """idom, nr (from 0), object_id, retained: children by retained size descending, then id; idom -1 has the top level."""
    rows = dominators.select("idom", "object_id", "retained")
    return numbered_within(rows, "idom", [F.desc("retained"), "object_id"], "nr", ["idom", "object_id", "retained"]).select("idom", "nr", "object_id", "retained")


def retained_set(dominators: DataFrame, starts: DataFrame) -> DataFrame:
    """object_id of everything in the dominator subtrees of the starts."""
    chosen = starts.select("object_id").distinct()
    whole = dominators.select("object_id", F.lit(0).alias("part"))
    if has_paths(dominators):
        below = dominators.select("object_id", F.explode("path").alias("start"))
        return below.join(chosen.withColumnRenamed("object_id", "start"), "start", "left_semi").select("object_id").distinct()
    # a start's interval as +1 and -1 events; the running sum over 4,096 equal ranges of numbers and within each
    marked = dominators.select("object_id", "pre", "last").join(chosen.withColumn("at", F.lit(1)), "object_id", "left")
    opened = marked.select("object_id", "pre", F.coalesce("at", F.lit(0)).alias("step"))
    closed = marked.where("at = 1").select(F.lit(None).cast("bigint").alias("object_id"), (F.col("last") + 1).alias("pre"), F.lit(-1).alias("step"))
    ends = whole.count()
    ranged = opened.unionAll(closed).withColumn("range", F.floor(F.col("pre") / max(1, ends // 4096)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ranged.groupBy("range").agg(F.sum("step").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy("pre", "step").rowsBetween(Window.unboundedPreceding, 0)
    open_at = ranged.withColumn("run", F.sum("step").over(within)).join(base, "range")
    return open_at.where("object_id is not null and base + run > 0").select("object_id")


def class_min_retained(objects: DataFrame, dominators: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, retained: what the instances of a class and the class object keep together: the retained sizes of those that
    have no other of them above. A class object that is its own instance counts twice; zeros are left out."""
    of_class = objects.select("object_id", "class_id").unionAll(classes.select("object_id", F.col("object_id").alias("class_id")))
    members = of_class.groupBy("object_id", "class_id").agg(F.count("*").alias("weight"))
    held = below_another(dominators, members.select("object_id", F.col("class_id").alias("part"))).withColumnRenamed("part", "class_id")
    free = members.hint("merge").join(held, ["object_id", "class_id"], "left_anti").join(dominators.select("object_id", "retained"), "object_id")
    return free.groupBy("class_id").agg(F.sum(F.col("weight") * F.col("retained")).alias("retained")).where("retained > 0")


def first_with_retained(dominators: DataFrame, size: int) -> DataFrame:
    return dominators.where(F.col("retained") == size).agg(F.min("object_id").alias("object_id"))


def big_drops(dominators: DataFrame, least: int) -> DataFrame:
    """object_id, retained, biggest_child, accumulated: where the retained size falls by `least` or more from an object to its biggest child."""
    child = dominators.groupBy(F.col("idom").alias("object_id")).agg(F.max("retained").alias("biggest_child"))
    both = dominators.select("object_id", "retained").join(child, "object_id", "left").withColumn("biggest_child", F.coalesce("biggest_child", F.lit(0)))
    return both.withColumn("dropped", F.col("retained") - F.col("biggest_child")).where(F.col("dropped") >= least)


def top_consumers(dominators: DataFrame, total: int, percent: float = 1.0) -> DataFrame:
    """Top-level objects that retain at least `percent` of the heap."""
    return dominators.where("idom = -1").where(F.col("retained") * 100.0 >= F.lit(percent * total)).select("object_id", "retained")


def immediate_dominators_of(dominators: DataFrame, objects: DataFrame, classes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Who dominates the chosen objects, by class: dominator_class, n_dominators, n_dominated, sizes of both."""
    named = objects.join(classes.select(F.col("object_id").alias("class_id"), "name"), "class_id").select("object_id", "name", "used_size")
    down = dominators.select("object_id", "idom").join(chosen.select("object_id").distinct(), "object_id", "left_semi").join(objects.select("object_id", "used_size"), "object_id")
    per = down.groupBy("idom").agg(F.count("*").alias("n"), F.sum("used_size").alias("s"))
    up = per.join(named.withColumnRenamed("object_id", "idom"), "idom", "left").withColumn("dominator_class", F.coalesce("name", F.lit("<ROOT>")))
    return up.groupBy("dominator_class").agg(
        F.count("*").alias("n_dominators"), F.sum("n").alias("n_dominated"), F.sum(F.coalesce("used_size", F.lit(0))).alias("dominator_size"), F.sum("s").alias("dominated_size")
    )
