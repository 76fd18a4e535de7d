"""Reachability from the roots, pruning and renumbering."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import kept, parts_for, rows_of, sent, sized, united, unstage
from .ids import ranked

#: Rounds of the distributed search; a longer chain is finished by one task over the edges not seen yet.
ROUNDS = 64


def laid_by_source(edges: DataFrame, starts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """References but those into the starts, dealt by their source and kept on the executors' disks for all rounds of a search. among: what may have references."""
    rest = edges.select("src", "dst").where("src <> dst").join(starts.select(F.col("object_id").alias("dst")), "dst", "left_anti").select("src", "dst")
    parts = max(2, parts_for(edges.sparkSession, rows_of(edges)))  # what lies in one part is dealt again by a join
    laid = rest.repartition(parts, "src")
    if among is not None:
        laid = laid.join(among.select(F.col("object_id").alias("src")).repartition(parts, "src").hint("shuffle_hash"), "src", "left_semi")
    return kept(laid, parts)


def targets(by_src: DataFrame, frontier: DataFrame) -> DataFrame:
    """object_id of what the frontier (a sized table) refers to; only the frontier is dealt."""
    return by_src.join(sent(frontier, frontier.select(F.col("object_id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("object_id"))


def levels(edges: DataFrame, starts: DataFrame, rounds: int, among: DataFrame | None = None) -> tuple[list[DataFrame], bool]:
    """Breadth-first search: what each round newly found (object_id, sized), the starts first; whether more may follow. A round deals the objects that it
    comes from and comes to, and no references."""
    found = [sized(starts.select("object_id").distinct(), "search")]
    by_src, known = laid_by_source(edges, found[0], among), [found[0]]
    try:
        for _ in range(rounds):
            fresh = targets(by_src, found[-1]).distinct()
            for k in known:
                fresh = fresh.join(sent(k, k), "object_id", "left_anti")
            following = sized(fresh, "search")
            if not rows_of(following):
                unstage(following)
                return found, False
            found.append(following)
            known.append(following)
            if len(known) > KNOWN:
                known = [sized(united(known), "search-known")]
        return found, True
    finally:
        by_src.unpersist()


#: Tables of known objects that a round asks, one after another, before they are made into one.
KNOWN = 8


def one_table(found: list[DataFrame], views: list[DataFrame]) -> DataFrame:
    """The rows of all views of some sized tables: many are made into one table, so that later plans do not read each of them again and again."""
    if len(found) <= KNOWN:
        return united(views)
    whole = sized(united(views), "search-all")
    unstage(*found)
    return whole


def search(edges: DataFrame, starts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """object_id, distance (edges from the nearest start) of everything reachable. starts: object_id. Nothing of the graph is collected."""
    found, more = levels(edges, starts, rounds)
    known = one_table(found, [f.withColumn("distance", F.lit(d)) for d, f in enumerate(found)])
    if not more:
        return known
    return united([known, sized(deep_search(edges, known, known.where(F.col("distance") == len(found) - 1)), "search-deep")])


def deep_search(edges: DataFrame, known: DataFrame, frontier: DataFrame) -> DataFrame:
    """What is reachable beyond `frontier`, by one task over the edges between objects not known yet: long chains have
    as many rounds as links, but few edges beside them."""
    seen = known.select(F.col("object_id").alias("dst"))
    fresh = edges.select("src", "dst").join(seen, "dst", "left_anti")
    inner = fresh.join(known.select(F.col("object_id").alias("src")).join(frontier.select(F.col("object_id").alias("src")), "src", "left_anti"), "src", "left_anti")
    at = inner.join(frontier.select(F.col("object_id").alias("src"), "distance"), "src", "left")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows = pa.Table.from_batches(list(batches))
        src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
        start = rows.column("distance").to_pandas().to_numpy(dtype=float, na_value=float("nan"))
        order = np.argsort(src, kind="stable")
        src, dst, start = src[order], dst[order], start[order]
        heads, first = np.unique(src, return_index=True)
        place = dict(zip(heads.tolist(), zip(first.tolist(), np.append(first[1:], len(src)).tolist(), strict=True), strict=True))
        distance: dict[int, int] = {}
        level = [(int(h), int(start[a])) for h, (a, _) in place.items() if start[a] == start[a]]
        heapq.heapify(queue := [(d, h) for h, d in level])
        while queue:
            d, h = heapq.heappop(queue)
            a, b = place.get(h, (0, 0))
            for t in dst[a:b].tolist():
                if d + 1 < distance.get(t, 1 << 60):
                    distance[t] = d + 1
                    heapq.heappush(queue, (d + 1, t))
        yield pa.RecordBatch.from_arrays([pa.array(list(distance.keys()), pa.int64()), pa.array(list(distance.values()), pa.int32())], names=["object_id", "distance"])

    return at.repartition(1).mapInArrow(run, "object_id long, distance int")


def reached(edges: DataFrame, starts: DataFrame, rounds: int = 12, among: DataFrame | None = None) -> DataFrame:
    """object_id of everything reachable. edges: src, dst. After some rounds of search the rest is contracted: an object
    that one other refers to is reached just when that one is, so trees and lists, however deep, shrink to their tops by doubling pointers;
    only objects with several referrers are searched on."""
    found, more = levels(edges, starts, rounds, among)
    if not more:
        return one_table(found, found)
    last = sized(found[-1], "reach-last")
    seen = one_table(found, found)
    if among is not None:
        edges = edges.join(among.select(F.col("object_id").alias("src")), "src", "left_semi")
    fresh = edges.select("src", "dst").where("src <> dst").join(seen.select(F.col("object_id").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()
    behind = sized(fresh.join(last.select(F.col("object_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("object_id")).distinct(), "reach-behind")
    among = sized(fresh.join(seen.select(F.col("object_id").alias("src")), "src", "left_anti").select("src", "dst"), "reach-among")
    referrers = among.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up"))
    hung = referrers.where("n = 1").join(behind.select(F.col("object_id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("object_id"), "up")
    tops = doubled(sized(hung, "reach-hung"))
    ups = tops.select(F.col("object_id").alias("src"), "up")
    several = among.join(tops.select(F.col("object_id").alias("dst")), "dst", "left_anti")
    short = sized(several.join(ups, "src", "left").select(F.coalesce("up", "src").alias("src"), "dst").distinct(), "reach-short")
    there = sized(search(short, behind).select("object_id"), "reach-there")
    held = tops.join(there.select(F.col("object_id").alias("up")), "up", "left_semi").select("object_id")
    return united([seen, there, sized(held, "reach-held")])


def doubled(pointers: DataFrame) -> DataFrame:
    """object_id, up: the top that each object's pointers lead to, an object without a pointer. Objects on rings of pointers have none and no row.
    pointers: object_id, up (staged)."""
    now, rings_left = pointers, None
    steps = max(1, pointers.count().bit_length() + 1)
    for _ in range(steps):
        further = now.select(F.col("object_id").alias("up"), F.col("up").alias("further"))
        joined = now.select("object_id", "up").join(further.hint("merge"), "up", "left")
        following = sized(joined.select("object_id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("open")), "reach-doubled")
        unstage(now)
        now, rings_left = following, following.where("open")
        if rings_left.isEmpty():
            break
    return now.where("not open").select("object_id", "up")


def usable_roots(roots: DataFrame) -> DataFrame:
    """Ids to mark from: known objects, and no thread's locals, which their thread holds."""
    return roots.where("object_id >= 0 and thread_address = 0").select("object_id").distinct()


def marked(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return reached(edges, usable_roots(roots))


def compacted(objects: DataFrame, edges: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects and edges that stay, numbered anew in the old order, and the map old_id -> object_id. reachable: ids of objects."""
    numbers = ranked(reachable.select(F.col("object_id").alias("address"))).select(F.col("address").alias("old_id"), "object_id")
    numbers = sized(numbers, "numbers")
    new = objects.withColumnRenamed("object_id", "old_id").join(numbers, "old_id")
    # looked up once a class, as in Graph.all_objects
    of_class = objects.select(F.col("class_id").alias("old_id")).distinct().join(numbers, "old_id").select(F.col("old_id").alias("class_id"), F.col("object_id").alias("new_class"))
    of_class = sized(of_class, "class-numbers")
    new = new.join(of_class, "class_id", "left").withColumn("class_id", F.col("new_class")).select("object_id", "address", "class_id", "used_size", "is_array")
    src = numbers.select(F.col("old_id").alias("src"), F.col("object_id").alias("new_src"))
    dst = numbers.select(F.col("old_id").alias("dst"), F.col("object_id").alias("new_dst"))
    moved = edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), "seq", F.col("new_dst").alias("dst"))
    return new, moved, numbers


def unreachable_histogram(objects: DataFrame, reachable: DataFrame, classes: DataFrame) -> DataFrame:
    """class_address, name, n_objects, used_size of what is not reachable."""
    gone = objects.join(reachable.select("object_id"), "object_id", "left_anti")
    per = gone.groupBy("class_id").agg(F.count("*").alias("n_objects"), F.sum("used_size").alias("used_size"))
    return per.join(classes.select(F.col("object_id").alias("class_id"), F.col("address").alias("class_address"), "name"), "class_id").select("class_address", "name", "n_objects", "used_size")


def histogram_lines(histogram: DataFrame, n_objects: int) -> DataFrame:
    """The histogram's text lines `address,count,size,name` in their fixed order: by the bucket of a class id in a power-of-two hash table that
    has a slot for each object."""
    size = 1 << max(0, (max(1, n_objects) - 1).bit_length())
    bucket = F.col("class_id").bitwiseXOR(F.shiftrightunsigned("class_id", 16)).bitwiseAND(size - 1)
    line = F.concat_ws(",", "class_address", "n_objects", "used_size", "name")
    return histogram.select(bucket.alias("bucket"), "class_id", line.alias("line")).orderBy("bucket", "class_id")


def artificial_roots(objects: DataFrame, edges: DataFrame, reachable: DataFrame) -> DataFrame:
    """object_id, root_seq: what must be roots for everything to be reachable. First the unreachable objects to which no
    other unreachable one refers, found by Spark. What is still unreached then lies on or behind cycles; picking there depends on the
    order of picks, so one task goes through that residue."""
    lost = sized(objects.select("object_id").join(reachable.select("object_id"), "object_id", "left_anti"), "lost")
    among = edges.select("src", "dst").where("src <> dst").distinct().join(lost.select(F.col("object_id").alias("src")), "src", "left_semi")
    among = sized(among.join(lost.select(F.col("object_id").alias("dst")), "dst", "left_semi"), "lost-edges")
    free = sized(lost.join(among.select(F.col("dst").alias("object_id")), "object_id", "left_anti"), "free")
    held = reached(among, free)
    rest = sized(lost.join(held, "object_id", "left_anti"), "residue")
    # counts of references cover all unreachable referrers, those reached meanwhile too
    count = among.join(rest.select(F.col("object_id").alias("dst")), "dst", "left_semi").groupBy("dst").agg(F.least(F.count("*"), F.lit(255)).alias("n"))
    inner = among.join(rest.select(F.col("object_id").alias("src")), "src", "left_semi").join(rest.select(F.col("object_id").alias("dst")), "dst", "left_semi")
    whole = rest.select(F.col("object_id").alias("a"), F.lit(None).cast("bigint").alias("b")).join(count.withColumnRenamed("dst", "a"), "a", "left")
    lines = whole.select("a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).unionAll(inner.select("src", "dst", F.lit(0).cast("bigint")))

    def run(batches):
        import pyarrow as pa

        out: dict[int, list[int]] = {}
        into: dict[int, int] = {}
        for batch in batches:
            for a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    into[a] = n
                    out.setdefault(a, [])
                else:
                    out.setdefault(a, []).append(b)
        picks = pick_cycle_roots(out, into)
        yield pa.RecordBatch.from_arrays([pa.array(picks, pa.int64()), pa.array(range(len(picks)), pa.int64())], names=["object_id", "nr"])

    picked = lines.repartition(1).mapInArrow(run, "object_id long, nr long")
    ahead = free.select("object_id", F.lit(0).alias("stage"), F.col("object_id").alias("nr"))
    return ahead.unionAll(picked.select("object_id", F.lit(1), "nr"))


def pick_cycle_roots(out: dict[int, list[int]], into: dict[int, int]) -> list[int]:
    """Ten passes over objects ascending. The first picks one of two objects that only refer to each other; the next eight those with more than one
    reference to them and many from them, less and less many; the last any with references. A pick is reached with all behind it at once."""
    reached: set[int] = set()
    picks: list[int] = []

    def reach(start: int) -> None:
        stack = [start]
        reached.add(start)
        while stack:
            for t in out[stack.pop()]:
                if t not in reached:
                    reached.add(t)
                    stack.append(t)

    for turn in range(10):
        left = [u for u in sorted(out) if u not in reached]
        outs = {u: min(255, sum(t not in reached for t in out[u])) for u in left}
        for u in left:
            if u in reached:
                continue
            n_in, n_out = into[u], outs[u]
            if turn == 0:
                pick = n_in == 1 and any(t not in reached and into[t] == 1 and u in out[t] for t in out[u])
            elif turn < 9:
                pick = n_out > 0 and n_in > 1 and n_out - n_in >= 8 - turn
            else:
                pick = n_out > 0
            if pick:
                picks.append(u)
                reach(u)
    return picks
