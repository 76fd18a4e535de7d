"""Near-duplicate documents by one-permutation MinHash.

Method: the 64-bit hashes of a document's distinct word shingles are dealt into BINS bins by their top bits, the least
of a bin being its value; an empty bin takes the value of a bin found by its own fixed sequence of random probes
(optimal densification), so two sets agree in each bin with a probability equal to their similarity. ROWS bins make a band;
documents that agree in a band share a bucket.

Documents of equal shingle sets are one class, compared once. In a bucket, candidate edges are a star from one
centre, the member met most often in buckets, so a bucket of k classes gives k-1 pairs and not k*k/2. Every pair is
confirmed on the full sets. What a star's links connect is one component; a pair of members of a star that they do not connect has an
end outside the centre's component. Those ends are gathered in blocks with an inverted list of their shingles, which the star's
other members visit in chunks: their intersections with all the block's sets are counted at once, and only edges that connect something are given on. So no pair that
shares a bucket goes unchecked unless its ends are connected already, and no task lists pairs.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^6)^42 = 3e-6; at 0.1 it shares one with
probability 4e-5.

Edge cases: a null or empty text, or one of white space, has an empty set, links with nothing and is its own component; fewer words than the
shingle length make one shingle of the whole sequence; equal sets are linked (similarity 1); a doc_id names a
document, so rows that share one are one node, with the links of each; a null doc_id links with nothing and gets a null component
and kept = true; ties for the smallest doc_id cannot be; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sink, fresh, map_arrow, shuffle_partitions, staged, table, unstage
from .components import components

BITS = 8
BINS = 1 << BITS
ROWS = 6
BANDS = BINS // ROWS
#: Shingles of a block of members outside the centre's component, and visitors of a block in one task.
BLOCK_SHINGLES, CHUNK_MEMBERS = 1 << 20, 1 << 11
#: Distinct words of which a Python worker remembers the hash.
CACHE = 150_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. bytes.lower() changes A-Z only and bytes.split() splits at
    x20 and x09 to x0D, which is the word rule."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    made = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for i in range(min(width, len(words))):
        made = mix(made * MULTIPLIER + h[i : i + n])
    return np.unique(made)


def probes() -> np.ndarray:
    """For each bin, its fixed sequence of bins to look in."""
    at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(8 * BINS, dtype=np.uint64)[None, :]
    return (mix(at + np.uint64(0x51ED)) >> np.uint64(64 - BITS)).astype(np.int16)


_probes: list[np.ndarray] = []


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value a bin, from one hash a shingle. `shingles`: sorted and not empty."""
    if not _probes:
        _probes.append(probes())
    edges = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BITS))
    ends = np.append(edges[1:], len(shingles))
    full = ends > edges
    values = shingles[np.minimum(edges, len(shingles) - 1)]
    empty = np.nonzero(~full)[0]
    if len(empty):
        tries = 16
        while len(empty):  # the first full bin of the sequence
            seen = full[_probes[0][empty, :tries]]
            found = seen.any(1)
            values[empty[found]] = values[_probes[0][empty[found], seen[found].argmax(1)]]
            if tries >= _probes[0].shape[1]:  # never met in practice: the sequences cover every bin
                values[empty[~found]] = shingles[0]
                break
            empty, tries = empty[~found], tries * 4
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """One bucket number a band; it holds the band's number too."""
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * MULTIPLIER + rows[:, i])
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits; null for an empty set), buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(doc_id=pa.int64(), n_shingles=pa.int64(), set_key=pa.binary(), buckets=pa.list_(pa.int64()))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                if sink.add(doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, bands(signature(s)) if len(s) else [], size=8 * BANDS):
                    yield from sink.drain()
        yield from sink.drain()

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, set_key binary, buckets array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, set: the sorted shingle hashes of the texts whose doc_id is a node and whose set has its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(node=pa.int64(), set=pa.list_(pa.int64()))
        for batch in batches:
            for node, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, width)
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key and sink.add(node, s.view(np.int64), size=8 * len(s)):
                    yield from sink.drain()
        yield from sink.drain()

    return map_arrow(docs.select("doc_id", "set_key", "text"), run, "node long, set array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose full sets have the similarity; repeated rows of a node are compared each."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).where(F.expr(f"100L * i >= {percent}L * u")).select("a", "b").distinct()


def stars(members: DataFrame) -> DataFrame:
    """centre, node, n, cn: for each bucket its centre, the member met in most buckets, with every other member; a written table."""
    weight = members.groupBy("node").agg(F.count("*").alias("w"))
    centre = members.join(weight.hint("merge"), "node").groupBy("bucket").agg(F.max(F.struct("w", "node", "n")).alias("c"))
    # written, so that the join's sides are both dealt afresh and Spark can split a large bucket's
    at = staged(centre.select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("cn")), "minhash-centres")
    out = staged(members.join(at.hint("merge"), "bucket").where("node <> centre").select("centre", "node", "n", "cn").distinct(), "minhash-stars")
    unstage(at)
    return out


class Roots:
    """Connectivity of the members of a block."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, found: np.ndarray) -> int:
        """The members given are connected; returns their root."""
        labels = np.unique(self.label[found])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]
        return int(labels[0])


class Block:
    """Members of one star outside the centre's component, with an inverted list of their shingles."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], percent: int):
        self.ids, self.parts, self.percent = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), percent
        self.sizes = np.array([len(r[2]) for r in rows])
        every, owner = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.shingles, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.roots = Roots(len(rows))

    def visit(self, node: int, part: int, shingles: np.ndarray) -> int | None:
        """Links a set with the members similar to it; the id of one of them, if there are any in other components."""
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        at = at[self.shingles[at] == shingles]
        lengths = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(self.owner[places], minlength=len(self.ids))
        similar = 100 * common >= self.percent * (self.sizes + len(shingles) - common)
        found = np.nonzero(similar & (self.parts != part) & (self.ids != node))[0]
        return int(self.ids[self.roots.join(found)]) if len(found) else None


def compare(percent: int):
    """Rows come sorted by centre, block, chunk, members before visitors. Gives on one edge for each visitor and member that has links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(a=pa.int64(), b=pa.int64())
        now, rows, block = None, [], None

        def settle():
            made = Block(rows, percent)
            if now[2] == 0:
                for node, part, shingles in rows:
                    other = made.visit(node, part, shingles)
                    if other is not None:
                        made.roots.join(np.nonzero((made.ids == node) | (made.ids == other))[0])
            return made

        def close(made: Block):
            for i, root in enumerate(made.roots.label):
                if root != i and sink.add(int(made.ids[i]), int(made.ids[root])):
                    yield from sink.drain()

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            sets = batch.column(6)
            for i, (centre, number, chunk, visitor, node, part) in enumerate(keys):
                shingles = sets[i].values.to_numpy(zero_copy_only=False)
                if (centre, number, chunk) != now:
                    if rows:
                        yield from close(block or settle())
                    now, rows, block = (centre, number, chunk), [], None
                if not visitor:
                    rows.append((node, part, shingles))
                elif rows:
                    block = block or settle()
                    other = block.visit(node, part, shingles)
                    if other is not None and sink.add(node, other):
                        yield from sink.drain()
        if rows:
            yield from close(block or settle())
        yield from sink.drain()

    return run


def rest_of_stars(star: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A written table of edges a, b that connect what links of two members of one star connect, where the star's links have not. Such a
    pair has an end outside the centre's component: those members form blocks, which all others visit, in chunks."""
    part = label.withColumnRenamed("id", "node")
    of_centre = label.select(F.col("id").alias("centre"), F.col("label").alias("centre_part"))
    sided = star.select("centre", "node", "n").join(part.hint("merge"), "node", "left").join(of_centre.hint("merge"), "centre", "left")
    sided = sided.select("centre", "node", "n", F.coalesce("label", F.xxhash64("node")).alias("part"), F.coalesce("centre_part", F.xxhash64("centre")).alias("centre_part"))
    # written, as are the shapes, so that Spark can split the members of a centre that has very many
    sided = staged(sided.withColumn("outside", F.col("part") != F.col("centre_part")), "minhash-sided")
    per = sided.groupBy("centre").agg(F.sum(F.expr("if(outside, n, 0)")).alias("words"), F.count_if("outside").alias("k"), F.count("*").alias("all"))
    shape = staged(per.where("k > 0 and all > 1").select("centre", F.ceil(F.col("words") / BLOCK_SHINGLES).alias("blocks"), F.ceil(F.col("all") / CHUNK_MEMBERS).alias("chunks")), "minhash-shapes")
    placed = sided.join(shape.hint("merge"), "centre").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")))
    one = ["node", "part"]
    homes = placed.where("outside").select("centre", "block", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), F.lit(False).alias("visitor"), *one)
    within = placed.where("outside and block > 0").select("centre", F.explode(F.expr("sequence(0L, block - 1)")).alias("block"), "chunk", F.lit(True).alias("visitor"), *one)
    others = placed.where("not outside").select("centre", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "chunk", F.lit(True).alias("visitor"), *one)
    met = homes.union(within).union(others).join(sets.hint("merge"), "node").select("centre", "block", "chunk", "visitor", "node", "part", "set")
    met = met.repartition(shuffle_partitions(star.sparkSession), "centre", "block", "chunk").sortWithinPartitions("centre", "block", "chunk", "visitor")
    out = staged(map_arrow(met, compare(percent), "a long, b long"), "minhash-rest")
    unstage(sided, shape)
    return out


def linked(members: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Staged tables of edges a, b that connect all nodes connected by links of nodes with a bucket in common."""
    star = stars(members)
    fits = star.where(F.expr(f"100 * least(n, cn) >= {percent} * greatest(n, cn)"))
    links = staged(confirmed(fits.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets, percent), "minhash-links")
    label = components(links, "minhash-parts")
    rest = rest_of_stars(star, label, sets, percent)
    unstage(star, label)
    return [links, rest]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs (doc_id, text). Documents whose shingle sets
    have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable."""
    rows = staged(sketches(docs, width), "minhash-rows")
    able = rows.where("set_key is not null and doc_id is not null")
    # written, so that Spark can split the rows of a set that very many documents share
    classes = staged(able.groupBy("set_key").agg(F.min("doc_id").alias("node")), "minhash-classes")
    nodes = able.join(classes.withColumnRenamed("node", "doc_id").hint("merge"), ["set_key", "doc_id"])
    bucketed = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("bucket")
    members = staged(bucketed.join(shared.hint("merge"), "bucket").distinct(), "minhash-members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct().join(nodes.select("doc_id", "set_key").distinct().hint("merge"), "doc_id")
    sets = staged(full_sets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id"), width), "minhash-sets")
    links = linked(members, sets, percent)

    # each document's node; a doc_id with rows in several classes ties their nodes together
    of_class = staged(able.select("doc_id", "set_key").join(classes.hint("merge"), "set_key").select("doc_id", "node"), "minhash-of-class")
    of_doc = staged(of_class.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")), "minhash-nodes")
    several = of_doc.where("node < other")
    ties = of_class.join(several.select("doc_id", F.col("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    label = components(reduce(DataFrame.union, links, ties), "minhash-all")
    smallest = label.groupBy("label").agg(F.min("id").alias("component"))
    part = staged(label.join(smallest.hint("merge"), "label").select(F.col("id").alias("node"), "component"), "minhash-components")
    unstage(members, sets, classes, of_class, label, *links)
    of_part = of_doc.select("doc_id", "node").join(part.hint("merge"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles").join(of_part.hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, digest, row: a number for each distinct pair of id and text, ascending by id (null last), then digest."""
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest")]
    pairs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("digest")).distinct()
    dealt = pairs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return staged(dealt.withColumn("row", F.monotonically_increasing_id()), "minhash-numbers")


def text_digest() -> Column:
    """128 bits of a text's SHA-256; a null text is told from an empty one."""
    return F.when(F.col("text").isNull(), F.lit("")).otherwise(F.substring(F.sha2("text", 256), 1, 32))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, but of each group of near duplicates (five-word shingles, similarity 0.8) only the
    document of the smallest doc_id. Different texts that share a doc_id are documents each (the one of the smaller digest comes first), and those
    without a doc_id come last. Of rows equal in doc_id and text one stays, that of the least hash of the other columns."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    if known.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id")
        (name,) = fresh(docs.columns, "kept")
        return docs.join(kept.withColumnRenamed("doc_id", name), F.col("doc_id").cast("bigint") == F.col(name), "left_semi")
    numbers = numbered(docs)
    id_as, digest_as, row_as = fresh(docs.columns, "id", "digest", "row")
    named = numbers.select(F.col("doc_id").alias(id_as), F.col("digest").alias(digest_as), F.col("row").alias(row_as))
    rows = docs.join(named, F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_as)) & (text_digest() == F.col(digest_as)))
    kept = near_duplicates(rows.select(F.col(row_as).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(row_as)).distinct()
    stays = rows.join(kept, row_as, "left_semi")
    every = [F.col(f"`{c}`") for c in docs.columns]
    first = stays.groupBy(row_as).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias(digest_as))
    return first.select(*(F.col(digest_as)[c].alias(c) for c in docs.columns))
