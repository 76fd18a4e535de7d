"""Near-duplicate embeddings by an exact metric range join.

Method: on unit vectors a cosine of c or more is a Euclidean distance of r = sqrt(2 - 2c) or less. Vectors drawn as pivots
part the vectors of a label: each goes to the cell of its nearest pivot. By the triangle inequality a vector x can be linked with a
member y of another cell j only if d(x, p_j) - d(x, p_home) <= 2r, and, since the cell's vectors are nearer to p_j than to x's pivot, only if x
is within r of the plane between the two pivots; where both allow it, x is sent to cell j too (boundary replication). Of two cells
only the later sends to the earlier, so each pair meets once, and cells are joined independently.

Members within r/2 of their pivot are the cell's core. They are all linked with each other by the triangle inequality, so a
crowd of near copies of a pivot is counted and never compared; others come to a core only from within 1.5 r. Members of equal vectors are one class with
a multiplicity. Large cells are dealt into blocks of about BLOCK members, and each pair of blocks meets once. Those that come to a block are dealt into chunks of
about CHUNK, each of which meets a copy of the block's members in a task of its own. A block is compared by matrix products; of the links found only counts and, for connectivity, one edge a member are given on.

The pivots are at most MAX_PIVOTS vectors (a bounded, hash-drawn sample that affects the work and never the result), held by every worker. Vectors without near ones (random directions)
are far from all pivots, and then replication prunes little: each label's work grows with the square of such vectors, in blocks.

Edge cases: a null label, or a vector that is null, empty, zero or holds null or non-finite components links with nothing; nor do vectors of different lengths; rows of equal vectors
are linked, and of vectors that differ by a power of two only (their cosine is 1); rows that share a vec_id count each but are one component; a null vec_id links with nothing, and has a null component and kept = true; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, map_arrow, shuffle_partitions, staged, table, unstage
from .components import components

LEAST_COSINE = 0.93
MAX_PIVOTS, MIN_PIVOTS, ROWS_A_PIVOT = 4096, 64, 2048
#: So many units (three numbers and a label) are broadcast; more are joined by a shuffle.
MAX_UNITS = 100_000
BLOCK, CHUNK = 2048, 8192
#: Distances this near a bound are not decided by it but by the cosine.
SLACK = 1e-7


def checked(vectors: DataFrame) -> DataFrame:
    """vec_id, key (null for what links with nothing), space (label and length), v (64-bit floats, scaled to a maximum of 0.5 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(vec_id=pa.int64(), key=pa.binary(), space=pa.string(), v=pa.binary())
        for batch in batches:
            for vec_id, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = None
                if vec_id is not None and label is not None and values and None not in values:
                    v = np.array(values, np.float64) + 0.0  # no negative zeros
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                    else:  # a power of two, so that no square overflows or vanishes and no digit is lost
                        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                if v is None:
                    full = sink.add(vec_id, None, None, None)
                else:
                    space, raw = f"{label}|{len(v)}", v.astype("<f8").tobytes()
                    full = sink.add(vec_id, xxhash.xxh3_128_digest(space.encode() + b"|" + raw), space, raw, size=len(raw) + 64)
                if full:
                    yield from sink.drain()
        yield from sink.drain()

    source = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return map_arrow(source, run, "vec_id long, key binary, space string, v binary")


def unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def draw_pivots(classes: DataFrame) -> dict[str, tuple[list[int], list[bytes]]]:
    """space -> ids and vectors of its pivots; at most MAX_PIVOTS in all."""
    n = max(MIN_PIVOTS, min(MAX_PIVOTS, classes.count() // ROWS_A_PIVOT))
    out: dict[str, tuple[list[int], list[bytes]]] = {}
    for r in classes.orderBy(F.xxhash64("node", F.lit(1)), "node").select("space", "node", "v").limit(n).collect():
        ids, vs = out.setdefault(r["space"], ([], []))
        ids.append(r["node"])
        vs.append(r["v"])
    return out


def placed(classes: DataFrame, pivots: dict, r: float) -> DataFrame:
    """Each class with its home unit (2 * cell for a core, 2 * cell + 1 for the rest), its distance from the pivot, the
    pivot's id for core members, and the units of lower number that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {s: (ids, unit(vs)) for s, (ids, vs) in pivots.items()}
        apart = {s: np.maximum(distance(p @ p.T), 1e-12) for s, (_, p) in ready.items()}
        sink = Sink(node=pa.int64(), mult=pa.int64(), space=pa.string(), v=pa.binary(), unit=pa.int32(), a=pa.float64(), pivot=pa.int64(), visits=pa.list_(pa.int32()))

        def homes(space: str, raw: list[bytes]):
            """home unit, a, pivot and visits of each of the vectors of one space."""
            if space not in ready:
                yield from [(1, 9.0, None, [])] * len(raw)
                return
            ids, p = ready[space]
            cos = unit(raw) @ p.T
            for d, home in zip(distance(cos), cos.argmax(1).tolist(), strict=True):
                a = float(d[home])
                core = a <= r / 2 - SLACK
                lower = np.arange(home)
                plane = (d[:home] ** 2 - a * a) / (2 * apart[space][home, :home])
                rests = lower[(d[:home] - a <= 2 * r + SLACK) & (plane <= r + SLACK)]
                cores = np.nonzero(d[: home + (not core)] <= 1.5 * r + SLACK)[0]
                yield 2 * home + (not core), a, ids[home] if core else None, [*(2 * cores).tolist(), *(2 * rests + 1).tolist()]

        for batch in batches:
            nodes, mults, spaces, raws = (c.to_pylist() for c in batch.columns)
            together: dict[str, list[int]] = {}
            for i, space in enumerate(spaces):
                together.setdefault(space, []).append(i)
            for space, rows in together.items():
                for low in range(0, len(rows), 256):
                    part = rows[low : low + 256]
                    for i, home in zip(part, homes(space, [raws[i] for i in part]), strict=True):
                        if sink.add(nodes[i], mults[i], space, raws[i], *home, size=len(raws[i]) + 100):
                            yield from sink.drain()
        yield from sink.drain()

    return map_arrow(classes.select("node", "mult", "space", "v"), run, "node long, mult long, space string, v binary, unit int, a double, pivot long, visits array<int>")


class Roots:
    """Connectivity of a block's members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, linked: np.ndarray) -> int:
        """The members given are connected; returns their root."""
        labels = np.unique(self.label[linked])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]
        return int(labels[0])


def compare(least: float):
    """Joins blocks: rows come sorted by space, unit, block, chunk, members before visitors. The first chunk compares the members with each other too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(node=pa.int64(), links=pa.int64(), other=pa.int64())
        now, members, home = None, [], None

        def settle():
            """The members are complete: compares them among themselves unless they are a core."""
            ids = np.array([m[0] for m in members])
            u, mult = unit([m[2] for m in members]), np.array([m[1] for m in members])
            counts, roots = np.zeros(len(ids), np.int64), Roots(len(ids))
            if now[1] % 2 and now[3] == 0:
                for low in range(0, len(ids), 256):
                    linked = u[low : low + 256] @ u.T >= least
                    linked[np.arange(len(linked)), low + np.arange(len(linked))] = False
                    counts[low : low + 256] += linked @ mult
                    for i in np.nonzero(linked.any(1))[0]:
                        roots.join(np.append(np.nonzero(linked[i])[0], low + i))
            return ids, u, mult, counts, roots

        def close():
            ids, _, _, counts, roots = home
            for i in range(len(ids)):
                root = int(ids[roots.label[i]])
                if (counts[i] or root != ids[i]) and sink.add(int(ids[i]), int(counts[i]), root):
                    yield from sink.drain()

        def visited(rows):
            ids, u, mult, counts, roots = home
            linked = unit([r[2] for r in rows]) @ u.T >= least
            weights = np.array([r[1] for r in rows])
            counts += weights @ linked
            found = linked @ mult
            for i in np.nonzero(found)[0]:
                root = roots.join(np.nonzero(linked[i])[0])
                if sink.add(rows[i][0], int(found[i]), int(ids[root])):
                    yield from sink.drain()

        for batch in batches:
            waiting = []
            for space, unit_no, block, chunk, visitor, node, mult, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (space, unit_no, block, chunk) != now:
                    if waiting:
                        yield from visited(waiting)
                        waiting = []
                    if members and home is None:
                        home = settle()
                    if home is not None:
                        yield from close()
                    now, members, home = (space, unit_no, block, chunk), [], None
                if not visitor:
                    members.append((node, mult, raw))
                elif members:
                    if home is None:
                        home = settle()
                    waiting.append((node, mult, raw))
            if waiting:
                yield from visited(waiting)
        if members and home is None:
            home = settle()
        if home is not None:
            yield from close()
        yield from sink.drain()

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding, label)."""
    spark, r = vectors.sparkSession, float(np.sqrt(2 - 2 * least))
    rows = staged(checked(vectors), "embeddings-rows")
    able = rows.where("key is not null")
    groups = able.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"))
    shape = able.select("key", F.col("vec_id").alias("node"), "space", "v")
    classes = staged(shape.join(groups, ["key", "node"]).dropDuplicates(["key"]), "embeddings-classes")
    pivots = draw_pivots(classes)
    homes = staged(placed(classes, pivots, r), "embeddings-homes")

    # at most two units for a pivot, and one for each space without pivots: counted, and only then broadcast
    called = homes.select("space", F.explode("visits").alias("unit")).groupBy("space", "unit").agg(F.count("*").alias("called"))
    sizes = homes.groupBy("space", "unit").agg(F.count("*").alias("n"), F.sum("mult").alias("crowd"))
    units = staged(sizes.join(called, ["space", "unit"], "left"), "embeddings-units")
    units = F.broadcast(units) if units.count() <= MAX_UNITS else units.hint("merge")
    visitors = F.coalesce("called", F.lit(0)) + F.expr(f"if(unit % 2 = 1 and n > {BLOCK}, n, 0)")
    blocks = units.select("space", "unit", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(visitors / CHUNK)).cast("int").alias("chunks"))
    crowd = units.where("unit % 2 = 0").select("space", "unit", "crowd")
    block_of = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    chunk_of = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int").alias("chunk")
    member = homes.join(blocks, ["space", "unit"]).withColumn("block", block_of)
    stay = member.select("space", "unit", "block", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(False).alias("visitor"), "node", "mult", "v")
    within = member.where("unit % 2 = 1 and block > 0").select("space", "unit", F.explode(F.expr("sequence(0, block - 1)")).alias("block"), chunk_of, F.lit(True).alias("visitor"), "node", "mult", "v")
    calls = homes.select("space", F.explode("visits").alias("unit"), "node", "mult", "v").join(blocks, ["space", "unit"])
    calls = calls.select("space", "unit", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), chunk_of, F.lit(True).alias("visitor"), "node", "mult", "v")
    place = ["space", "unit", "block", "chunk"]
    met = stay.union(within).union(calls).repartition(shuffle_partitions(spark), *place).sortWithinPartitions(*place, "visitor")
    found = staged(map_arrow(met, compare(least), "node long, links long, other long"), "embeddings-links")

    stars = homes.where("pivot is not null and pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    label = components(stars.union(found.select(F.col("node").alias("a"), F.col("other").alias("b"))), "embeddings-parts")
    smallest = label.groupBy("label").agg(F.min("id").alias("component"))
    part = label.join(smallest, "label").select(F.col("id").alias("node"), "component")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = homes.select("node", "mult", "space", "unit").join(crowd, ["space", "unit"], "left")
    own = own.select("node", (F.coalesce("crowd", "mult") - 1).alias("own"))
    total = classes.select("key", "node").join(own, "node").join(links, "node", "left").join(part, "node", "left")
    by_key = staged(total.select("key", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "embeddings-classes-done")
    unstage(classes, homes, found, label)
    out = rows.select("vec_id", "key").join(by_key, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
