"""Mixing sources to target weights.

Method: the words of each source, document after document, are packed into blocks of BLOCK words. The mix is a row
of slots, SHARD to an output shard; how many of a shard's slots go to each source is drawn from the multinomial
distribution of the targets, by the shard's own task. The j-th slot of a source takes the block at place j mod n of a pseudorandom
permutation of its n blocks, another permutation each time round, so no block comes again before all others have come. Slots and
blocks meet in a join by source and block index.

A source has room for REPEATS slots a block; slots drawn beyond that are drawn again, in further shards, among the sources whose target
is below REPEATS times their size and that have room left, until all are dealt or no such source is left.

A source's words are ordered by id, then text: documents are dealt into ranges of (source, id, text), each task adds up the sizes of its
range, and the ranges' totals give the offsets, so no source or id is ever in one task. Up to MAX_SOURCES sources are shared out on the
driver with exact fractions; more stay a written table, numbered and summed by ranges, of which the driver gets sums only. Sources are drawn PART at a
time: a shard's slots are first dealt to parts, then within them. The driver holds one weight a part.

Edge cases: a null or empty text has size 0 and nothing of it is taken; a null source is a source of its own, last in order; rows are
counted each, repeated ones too; null ids are ids like others and come first; equal ids are ordered by a hash of the text; without any
words all targets are 0; other columns are kept, whatever their names, and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_arrow, shuffle_partitions, staged, table, unstage
from .minhash import mix as scramble

BLOCK = 16
SHARD = 1 << 16
MAX_SOURCES = PART = 1_000
REPEATS = 3
#: Expected slots are whole numbers of 1 / SCALE, so that sums do not depend on the order of adding.
SCALE = 1 << 20
SEED = 20_240_501


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size (words), text_hash, row (the column of that name, or a number of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
            size = pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, digests(texts), batch.column(3)], names=["doc_id", "source", "size", "text_hash", "row"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", number.alias("row"))
    return map_arrow(source, run, "doc_id long, source string, size long, text_hash long, row long")


def digests(texts: list[bytes]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64), pa.int64())


def targets(totals: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """All words shared by weight; what a source would get above `repeats` times its size is shared again."""
    left, out, active = Fraction(sum(totals)), [Fraction(0)] * len(totals), set(range(len(totals)))
    while active:
        whole = sum(weights[i] for i in active)
        share = {i: left * weights[i] / whole for i in active}
        above = {i for i in active if share[i] > repeats * totals[i]}
        if not above:
            for i in active:
                out[i] = share[i]
            break
        for i in above:
            out[i] = Fraction(repeats * totals[i])
        left -= sum(out[i] for i in above)
        active -= above
    return out


SOURCE = "source_no long, source string, total long, target double, blocks long, want long, capped boolean"


def few_sources(sized: DataFrame, block: int) -> DataFrame:
    """Up to MAX_SOURCES sources in order of code points (UTF-8 has the same order), null last; weights 1, 2, 3, repeating. want: expected slots * SCALE."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("total")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["total"] for r in rows], [i % 3 + 1 for i in range(len(rows))])
    out = []
    for i, (r, g) in enumerate(zip(rows, goal, strict=True)):
        blocks = -(-r["total"] // block)
        out.append((i, r["source"], r["total"], float(g), blocks, round(g * blocks * SCALE / r["total"]) if r["total"] else 0, g == REPEATS * r["total"]))
    return sized.sparkSession.createDataFrame(out, SOURCE)


def many_sources(sized: DataFrame, block: int, repeats: int = REPEATS) -> DataFrame:
    """few_sources() for any number of sources, as a written table."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("total"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = totals.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("id", F.monotonically_increasing_id()), "mixing-ranges")  # range << 33 | place in it
    part = F.shiftright("id", 33)
    first, offsets = 0, []
    for r in sorted(dealt.groupBy(part.alias("p")).count().collect()):
        offsets.append((r["p"], first))
        first += r["count"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "part long, first long"))  # a row for each shuffle partition
    numbered = dealt.withColumn("part", part.cast("bigint")).join(offsets, "part")
    numbered = numbered.withColumn("source_no", F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1))
    rows = staged(numbered.select("source_no", "source", "total", (F.col("source_no") % 3 + 1).alias("weight")), "mixing-numbered")
    # a source is capped if left / whole * weight exceeds repeats * total; the ratio only grows, so its last value tells all that are
    whole_of = lambda n: F.lit(n).cast("decimal(38,0)")
    capped, left, whole = F.lit(False), 0, 0
    while True:
        sums = rows.agg(F.sum("total").alias("total"), F.sum(F.when(capped, F.col("total")).otherwise(0)).alias("capped"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight")).first()
        now = (sums["total"] or 0) - repeats * (sums["capped"] or 0), sums["weight"] or 0
        if now == (left, whole) or not now[1]:
            break
        left, whole = now
        capped = F.col("total").cast("decimal(19,0)") * whole_of(repeats * whole) < F.col("weight") * whole_of(left)
    target = F.when(capped, F.lit(float(repeats)) * F.col("total")).otherwise(F.col("weight") * F.lit(left / whole if whole else 0.0))
    blocks = F.ceil(F.col("total") / block).cast("bigint")
    rows = rows.select("source_no", "source", "total", target.alias("target"), blocks.alias("blocks"), (capped | (F.col("total") == 0)).alias("capped"))
    want = F.when(F.col("total") > 0, F.round(F.col("target") * F.col("blocks") / F.col("total") * SCALE)).otherwise(0.0).cast("bigint")
    out = staged(rows.select("source_no", "source", "total", "target", "blocks", want.alias("want"), "capped"), "mixing-sources")
    unstage(dealt)
    return out


def shard_counts(weights: DataFrame, slots: int, first: int, seed: int) -> DataFrame:
    """shard, source_no, n, at (the place of the first of them in its shard): multinomial draws by shard, the shards numbered from `first`.
    weights: source_no, want."""
    spark = weights.sparkSession
    each = F.transform("rows", lambda x: x["source_no"]), F.transform("rows", lambda x: x["want"])
    parts = weights.groupBy(F.expr(f"source_no div {PART}").alias("part")).agg(F.sum("want").alias("w"), F.sort_array(F.collect_list(F.struct("source_no", "want"))).alias("rows"))
    parts = parts.select("part", "w", each[0].alias("sources"), each[1].alias("wants"))  # at most PART of each
    totals = sorted(map(tuple, parts.select("part", "w").collect()))
    numbers, mass = [p for p, _ in totals], np.array([w for _, w in totals], np.float64)
    mass /= mass.sum()
    shards = -(-slots // SHARD)

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = np.random.default_rng([seed, shard, 0]).multinomial(min(SHARD, slots - (shard - first) * SHARD), mass)
                has = np.nonzero(n)[0]
                columns = [np.full(len(has), shard), np.array(numbers)[has], n[has], (np.cumsum(n) - n)[has]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "part", "n", "at"])

    def by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (shard, part, n, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                sources, wants = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
                counts = np.random.default_rng([seed, shard, part + 1]).multinomial(n, wants / wants.sum())
                has = np.nonzero(counts)[0]
                columns = [np.full(len(has), shard), sources[has], counts[has], at + (np.cumsum(counts) - counts)[has]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "source_no", "n", "at"])

    dealt = map_arrow(spark.range(first, first + shards, 1, min(shards, shuffle_partitions(spark))), by_part, "shard long, part long, n long, at long")
    met = dealt.join(F.broadcast(parts) if len(numbers) == 1 else parts.hint("merge"), "part")  # one part has at most PART sources
    return map_arrow(met.select("shard", "part", "n", "at", "sources", "wants"), by_source, "shard long, source_no long, n long, at long")


def with_first(counts: DataFrame) -> DataFrame:
    """counts and first, the sum of n over the source's earlier shards: sums by groups of shards, so that no window has more than 4,096 rows of them."""
    grouped = counts.withColumn("span", F.shiftright("shard", 12))
    before = Window.partitionBy("source_no").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = grouped.groupBy("source_no", "span").agg(F.sum("n").alias("sum")).select("source_no", "span", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(spans, ["source_no", "span"]).withColumn("first", F.col("first") + F.col("base")).drop("span", "base")


def draw(sources: DataFrame, seed: int, repeats: int = REPEATS) -> DataFrame:
    """shard, source_no, first, n, at, blocks: slots by shard and source, as a written table. No source has more than `repeats` slots a block."""
    spark = sources.sparkSession
    open_ = sources.where("want > 0").select("source_no", "blocks", "want", "capped", F.lit(0).cast("bigint").alias("given"))
    slots = round((open_.agg(F.sum("want").alias("w")).first()["w"] or 0) / SCALE)
    weights, shard, out, used = open_.select("source_no", "want"), 0, [], []
    while slots > 0:
        counts = staged(shard_counts(weights, slots, shard, seed), "mixing-counts")
        shard += -(-slots // SHARD)
        room = open_.select("source_no", "blocks", "given", (F.col("blocks") * repeats - F.col("given")).alias("room"))
        placed_now = with_first(counts).join(room, "source_no").withColumn("n", F.least("n", F.greatest(F.col("room") - F.col("first"), F.lit(0))))
        out.append(placed_now.where("n > 0").select("shard", "source_no", (F.col("given") + F.col("first")).alias("first"), "n", "at", "blocks"))
        drawn = open_.join(counts.groupBy("source_no").agg(F.sum("n").alias("n")), "source_no", "left")
        upto = F.col("given") + F.coalesce("n", F.lit(0))
        after = staged(drawn.select("source_no", "blocks", "want", "capped", F.least(upto, F.col("blocks") * repeats).alias("given"), F.greatest(upto - F.col("blocks") * repeats, F.lit(0)).alias("over")), "mixing-open")
        used += [counts, after]
        open_ = after.drop("over")
        weights = open_.where(f"not capped and given < blocks * {repeats}").select("source_no", "want")
        slots = 0 if weights.isEmpty() else after.agg(F.sum("over").alias("n")).first()["n"]
    if not out:
        return spark.createDataFrame([], "shard long, source_no long, first long, n long, at long, blocks long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    done = staged(whole, "mixing-draw")
    unstage(*used)
    return done


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the next even number of bits; what falls outside is
    mapped on until it falls inside."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    low = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(4):
            left, right = right, left ^ (scramble(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(plan: DataFrame, seed: int) -> DataFrame:
    """The mix: shard, slot, source_no, epoch, block. plan: as draw() gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "slot", "source_no", "epoch", "block"]
        for batch in batches:
            for shard, s, start, n, at, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                j = np.arange(start, start + n)  # at most SHARD
                epoch, place = j // blocks, j % blocks
                block = np.empty(len(j), np.int64)
                for e in range(int(epoch[0]), int(epoch[-1]) + 1):
                    block[epoch == e] = permuted(place[epoch == e], blocks, seed + 7919 * s + e)
                columns = [np.full(len(j), shard), at + np.arange(len(j)), np.full(len(j), s, np.int64), epoch.astype(np.int32), block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    dealt = plan.select("shard", "source_no", "first", "n", "at", "blocks").repartition(shuffle_partitions(plan.sparkSession), "shard", "source_no")
    return map_arrow(dealt, run, "shard long, slot long, source_no long, epoch int, block long")


def placed(sized: DataFrame, numbers: DataFrame, few: bool) -> DataFrame:
    """doc_id, source, source_no, size, text_hash, row and start, the offset of the document's first word in its source, as a written table.
    numbers: source_no, source."""
    rows = sized.alias("r").join(numbers.alias("n"), F.expr("r.source <=> n.source")).select("r.*", "source_no")
    order = ["source_no", "doc_id", "text_hash", "row"]
    sorted_rows = rows.select(*order, "size", "source").repartitionByRange(shuffle_partitions(sized.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source, size = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            before = np.cumsum(size) - size
            starts = np.r_[0, np.nonzero(np.diff(source))[0] + 1]
            local = before - np.repeat(before[starts], np.diff(np.r_[starts, len(source)]))
            if source[0] == now:
                local[: starts[1] if len(starts) > 1 else len(local)] += upto
            now, upto = source[-1], int(local[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(len(local), part, np.int64))], names=[*batch.schema.names, "local", "part"])

    local = staged(map_arrow(sorted_rows, run, "source_no long, doc_id long, text_hash long, row long, size long, source string, local long, part long"), "mixing-local")
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("source_no", "part").agg(F.sum("size").alias("n")).select("source_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    offsets = F.broadcast(offsets) if few else offsets.hint("merge")  # few: at most MAX_SOURCES and a row for each shuffle partition
    out = staged(local.join(offsets, ["source_no", "part"]).select("doc_id", "source", "source_no", "size", "text_hash", "row", (F.col("base") + F.col("local")).alias("start")), "mixing-rows")
    unstage(local)
    return out


def spans(rows: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document has words in: block, words."""
    b = F.lit(block)
    each = rows.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    return each.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest("start", F.col("block") * b))


class Mix:
    """A drawn mix: sources, rows (placed documents), slots. texts: documents() is wanted, for which repeated rows get numbers in a written copy."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = SEED, texts: bool = True):
        self.block, self.docs, self.names, self.row = block, docs, docs.columns, None
        sized = staged(sizes(docs), "mixing-sizes")
        if texts and not sized.groupBy("doc_id", "source", "text_hash").count().where("count > 1").isEmpty():
            (self.row,) = fresh(docs.columns, "row")
            self.docs = staged(docs.withColumn(self.row, F.monotonically_increasing_id()), "mixing-documents")
            unstage(sized)
            sized = staged(sizes(self.docs, self.row), "mixing-sizes")
        few = sized.select("source").distinct().limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
        self.sources = few_sources(sized, block) if few else many_sources(sized, block)
        numbers = self.sources.select("source_no", "source")
        self.rows = placed(sized, F.broadcast(numbers) if few else numbers.hint("merge"), few)
        unstage(sized)
        self.about = self.sources.select("source_no", F.col("total").alias("source_size"), "target")
        self.about = F.broadcast(self.about) if few else self.about
        plan = draw(self.sources, seed)
        # staged, so that the planner knows its size: it grows with the words and must not be broadcast
        self.slots = staged(slots(plan, seed), "mixing-slots")
        unstage(plan)

    def remove(self) -> None:
        """Deletes the mix's tables; nothing lazy that reads them works afterwards."""
        unstage(self.rows, self.slots, self.sources, *([self.docs] if self.row else []))

    def shares(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        each = spans(self.rows.select("doc_id", "source_no", "size", "start"), self.block).join(uses, ["source_no", "block"], "left")
        taken = each.groupBy("source_no", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
        none = self.rows.where("size = 0").select("source_no", "start", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
        return taken.unionByName(none).join(self.about, "source_no").select("doc_id", "size", "source_size", "target", "taken")

    def documents(self) -> DataFrame:
        """The mix as documents with the columns of docs: for each time round, a document with those of its blocks that
        are taken then. n_chars, if there is one, is the length of what is taken."""
        block, names = self.block, self.names
        each = spans(self.rows, block).join(self.slots.select("source_no", "block", "epoch"), ["source_no", "block"])
        taken = each.groupBy("source_no", "start", "epoch", "doc_id", "source", "text_hash", "size", "row").agg(F.array_sort(F.collect_list(F.col("block") - F.expr(f"start div {block}"))).alias("blocks"))
        hash_as, id_as, source_as, its_hash, skip_as, blocks_as, its_row = fresh(self.docs.columns, "hash", "id", "of", "its_hash", "skip", "blocks", "its_row")
        taken = taken.select(F.col("doc_id").alias(id_as), F.col("source").alias(source_as), F.col("text_hash").alias(its_hash), (F.col("start") % block).alias(skip_as), F.col("blocks").alias(blocks_as), F.col("row").alias(its_row))
        on = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_as)) & F.col("source").cast("string").eqNullSafe(F.col(source_as)) & (F.col(hash_as) == F.col(its_hash))
        if self.row:
            on = on & (F.col(self.row) == F.col(its_row))
        joined = with_hash(self.docs, hash_as).join(taken, on).select(*(F.col(f"`{c}`") for c in names), skip_as, blocks_as)
        text_at = names.index("text")
        chars_at = names.index("n_chars") if "n_chars" in names else -1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [cut(t, s, b, block) for t, s, b in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
                columns = list(batch.columns[: len(names)])
                columns[text_at] = pa.array(texts, pa.string())
                if chars_at >= 0:
                    columns[chars_at] = pa.array([len(t) for t in texts]).cast(batch.schema.types[chars_at])
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return map_arrow(joined, run, ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names))


def with_hash(docs: DataFrame, as_name: str) -> DataFrame:
    """docs and the text's hash, as sizes() has it."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, digests(texts)], names=[*names, as_name])

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{as_name}` long")


def cut(text: str, skip: int, blocks: list[int], block: int) -> str:
    """The words of the given blocks, with the white space between them. The text's first word is the skip-th of block 0."""
    raw = text.encode()
    starts, ends = word_bounds(raw)
    out = []
    for i, k in enumerate(blocks):
        low, high = max(0, k * block - skip), min(len(starts), (k + 1) * block - skip)
        follows = i + 1 < len(blocks) and blocks[i + 1] == k + 1
        whole_start = 0 if low == 0 else starts[low]
        whole_end = len(raw) if high == len(starts) else starts[high]
        out.append(raw[whole_start:whole_end] if follows or high == len(starts) else raw[whole_start : ends[high - 1]] + b"\n")
    return b"".join(out).decode()


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(raw, np.uint8)
    word = np.r_[False, ~((codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))), False]
    change = np.nonzero(word[1:] != word[:-1])[0]
    return change[::2], change[1::2]


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents"), texts=False)
    out = staged(mix.shares(), "mixing-shares")
    mix.remove()
    return out


def mixed_documents(docs: DataFrame) -> DataFrame:
    return Mix(docs).documents()
