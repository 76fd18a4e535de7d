"""Language-model scores from a Brown class-based bigram model.

Method: words are assigned to classes by exchange clustering: a word is taken out of its class and put into the one that most raises the
likelihood of the class bigrams. The CORE most frequent words are exchanged one by one until nothing moves, with all rarer words as one
class beside them; that gives the first classes. Then follow ROUNDS rounds in which every word of the training texts, of whatever count,
proposes its own best move from its counts with its neighbours' classes, which the executors aggregate by word; the moves of a round are
made at once, from the same class bigrams. In the first round only the words outside the core move, in the later ones all words met more
than once. Of the rounds' assignments the likeliest is kept. The text's end is a class by itself.

A token's probability is P(its class | class before) * P(word | its class). Transitions are smoothed towards the classes' own shares (PRIOR
pseudo-counts); in a class each word gives up a discount, which is the probability of the class's unseen words. There are U unseen words
(the Chao estimate n1^2 / 2 n2 from the numbers of words met once and twice), which share that probability alike, so that the
probabilities of all V + U words add up to 1 in every context. The class of an unseen word is not known: the score sums over all of
them (the forward sum over a run of unseen words), so no spelling or language is looked at.

Word and class-bigram counts cover all training texts. Only the bigrams of the core's units and tables of classes reach the driver. Each task writes the texts it reads as
blocks: the block's distinct words, and its texts as numbers of them. The vocabulary stays a table: in each round the words of all
blocks are joined with their classes, and a block gets the classes of its own words, so no task ever holds the whole vocabulary.
Numbers of words and classes lie and travel packed, words travel with their block only where their spelling is asked for, and shuffle files go with the table they were made for.

Tokens: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, then one end. The baseline is an add-one unigram model.

Edge cases: a null or empty text is its end alone; without training texts the model is the baseline, whose only word is unknown;
a null doc_id is not held out and is scored; repeated rows count and are scored each; a text of any length is in one block; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sink, map_arrow, staged, table, unstage

CORE = 768
CLASSES = 64
SWEEPS = 10
ROUNDS = 1
PRIOR = 20.0
BLOCK_BYTES = 8 << 20
#: Entries of words' classes that a task holds before it gives them on by block; most partitions that blocks are dealt to.
HELD, MOST_PARTS = 1 << 20, 1 << 15
#: Stands for the class of an unseen word in a text's classes.
UNSEEN = 255


def split_words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only; bytes.split() splits at x20 and x09 to x0D."""
    return text.encode().lower().split() if text else []


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pair: np.ndarray) -> float:
    """Of the class bigrams, up to what does not depend on the classes."""
    return float(xlogx(pair).sum() - xlogx(pair.sum(0)).sum() - xlogx(pair.sum(1)).sum())


# ---- blocks


BLOCKS = "part int, seq int, words array<binary>, width int, n array<int>, doc_ids array<bigint>, held array<boolean>, sizes array<int>, ids binary"
ENTRY = np.dtype([("step", "<i4"), ("n", "<i8"), ("class", "u1")])


def packed(values: np.ndarray) -> bytes:
    """How many, then their first bytes, their second bytes and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: np.dtype | str) -> np.ndarray:
    kind, count = np.dtype(kind), int.from_bytes(raw[:8], "little")
    if not count:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], count * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, count).T).view(kind).ravel()


class Index(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def blocks_of(source: DataFrame) -> DataFrame:
    """source: doc_id, held_out, text. A written table of blocks: block (a number from 0), words (distinct), width (how many), n (their counts in the
    block's training texts), doc_ids, held, sizes (words of each text), ids (places in words, of one text after the other, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        index, doc_ids, held, rows, held_bytes = Index(), [], [], [], 0

        def made() -> pa.RecordBatch:
            sizes = np.array([len(r) for r in rows], np.int32)
            ids = np.concatenate(rows)
            known = ids[np.repeat(~np.array(held, bool), sizes)]
            columns = [[part], [seq], [list(index)], [len(index)], [np.bincount(known, minlength=len(index)).astype(np.int32)], [doc_ids], [held], [sizes], [packed(ids.astype("<i4"))]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "seq", "words", "width", "n", "doc_ids", "held", "sizes", "ids"])

        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                doc_ids.append(doc_id)
                held.append(out)
                rows.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                held_bytes += 16 + (len(text) if text else 0)
                if held_bytes >= BLOCK_BYTES:
                    yield made()
                    index, doc_ids, held, rows, held_bytes, seq = Index(), [], [], [], 0, seq + 1
        if doc_ids:
            yield made()

    written = staged(map_arrow(source.select("doc_id", "held_out", "text"), run, BLOCKS), "brown-blocks")
    first, offsets = 0, []
    for r in sorted(written.groupBy("part").agg(F.max("seq").alias("last")).collect()):
        offsets.append((r["part"], first))
        first += r["last"] + 1
    offsets = F.broadcast(source.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, first long"))  # a row for each partition of the input
    out = written.join(offsets, "part").select((F.col("first") + F.col("seq")).alias("block"), "words", "width", "n", "doc_ids", "held", "sizes", "ids")
    out._staged_path, out.count_of_blocks = written._staged_path, first
    return out


def postings(blocks: DataFrame) -> DataFrame:
    """at, word, n: each word of each block; at: the block's number, 32 bits of the word's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, n in zip(*batch.columns, strict=True):
                for low in range(0, len(words.values), 1 << 16):
                    part, counts = words.values.slice(low, 1 << 16), n.values.slice(low, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array((block.as_py() << 32) + np.arange(low, low + len(part))), part, counts], names=["at", "word", "n"])

    return map_arrow(blocks.select("block", "words", "n"), run, "at long, word binary, n int")


def sequence(ids: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, end: int) -> np.ndarray:
    """The words of the chosen texts, an end after each text."""
    words = ids[np.repeat(chosen, sizes)]
    ends = np.cumsum(sizes[chosen] + 1) - 1
    out = np.full(len(words) + len(ends), end, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words
    return out


# ---- exchange


def count_units(blocks: DataFrame, core: list[bytes]) -> np.ndarray:
    """Bigrams of units over all training texts, an end before the first word and after the last. Units: the end, the core words, the rest."""
    size = len(core) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = {w: i + 1 for i, w in enumerate(core)}.get, np.zeros(size * size, np.int64)
        for batch in batches:
            for words, held, sizes, ids in zip(*batch.columns, strict=True):
                unit = np.array([*(get(w, size - 1) for w in words.values.to_pylist()), 0], np.int64)
                codes = np.r_[0, unit[sequence(unpacked(ids.as_py(), "<i4"), sizes.values.to_numpy(), ~np.array(held.as_py(), bool), len(unit) - 1)]]
                total += np.bincount(codes[:-1] * size + codes[1:], minlength=size * size)
        at = np.nonzero(total)[0]
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["code", "n"])

    found = map_arrow(blocks.select("words", "held", "sizes", "ids"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size * size)
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(size, size)


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Units to classes, one unit at a time. counts: bigrams of units; unit 0 has class 0 to itself and the last one the last class. Units without
    counts are in class 1."""
    n = len(counts)
    size = counts.sum(1) + counts.sum(0)
    order = [int(u) for u in np.argsort(-size, kind="stable") if 0 < u < n - 1 and size[u]]
    label = np.ones(n, np.int64)
    label[0], label[-1] = 0, classes - 1
    for i, u in enumerate(order):
        label[u] = 1 + i % (classes - 2)
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1
    pair = member.T @ counts @ member

    for _ in range(sweeps):
        moved = 0
        for u in order:
            old = label[u]
            after, before, own = counts[u] @ member, counts[:, u] @ member, counts[u, u]
            after[old] -= own
            before[old] -= own
            # take u out of its class
            pair[old, :] -= after
            pair[:, old] -= before
            pair[old, old] -= own
            left, right = pair.sum(1) + before, pair.sum(0) + after  # tokens of each class without u
            gain = (xlogx(pair + after[None, :]) - xlogx(pair)).sum(1) + (xlogx(pair + before[:, None]) - xlogx(pair)).sum(0)
            d = np.arange(classes)
            cell = pair[d, d]
            gain += xlogx(cell + after + before + own) - xlogx(cell + after) - xlogx(cell + before) + xlogx(cell)
            gain -= xlogx(left + after.sum() + own) - xlogx(left) + xlogx(right + before.sum() + own) - xlogx(right)
            gain[0] = gain[-1] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9 * max(1.0, abs(gain[old])):
                new = old
            pair[new, :] += after
            pair[:, new] += before
            pair[new, new] += own
            if new != old:
                member[u, old], member[u, new], label[u] = 0, 1, new
                moved += 1
        if not moved:
            break
    return label


def best_classes(pair: np.ndarray, old: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of the greatest likelihood for each word alone. pair: class bigrams, the words in their classes `old`; after, before: words x
    classes, their bigrams with other words; own: with themselves. As in exchange(), but only the entries that a word has are looked at."""
    g, classes = np.arange(len(old)), len(pair)

    def grown(cells, by):
        return xlogx(cells + by) - xlogx(cells)

    def sums(table, counts):  # over d, of grown(table[:, d], counts[d])
        word, d = np.nonzero(counts)
        n = counts[word, d].astype(np.int64)
        keys, place = np.unique(d + classes * n, return_inverse=True)
        gains = grown(table[:, keys % classes].T, (keys // classes)[:, None].astype(float))
        out = np.zeros((len(counts), classes))
        starts = np.nonzero(np.diff(word, prepend=-1))[0]
        out[word[starts]] = np.add.reduceat(gains[place], starts, axis=0) if len(starts) else 0
        return out

    gain = sums(pair, after) + sums(pair.T, before)
    a, b = after[g, old][:, None], before[g, old][:, None]
    column, row = pair[:, old].T, pair[old]  # of the old class, still with the word
    gain += grown(column - before, a) - grown(column, a) + grown(row - after, b) - grown(row, b)
    row, column = row - after, column - before
    home = pair[old, old] - a[:, 0] - b[:, 0] - own
    row[g, old] = column[g, old] = home
    gain[g, old] = (grown(row, after) + grown(column, before)).sum(1)
    cell = np.tile(np.diag(pair), (len(old), 1))
    cell[g, old] = home
    gain += xlogx(cell + after + before + own[:, None]) - xlogx(cell + after) - xlogx(cell + before) + xlogx(cell)
    follows, leads = after.sum(1) + own, before.sum(1) + own
    left, right = np.tile(pair.sum(1), (len(old), 1)), np.tile(pair.sum(0), (len(old), 1))
    left[g, old] -= follows
    right[g, old] -= leads
    gain -= grown(left, follows[:, None]) + grown(right, leads[:, None])
    gain[:, 0] = -np.inf
    new, stay = gain.argmax(1), gain[g, old]
    return np.where(gain[g, new] <= stay + 1e-9 * np.maximum(1.0, np.abs(stay)), old, new)


NEIGHBOURS = "word binary, class int, counts binary"
COUNTED = np.dtype([("code", "<u2"), ("n", "<u4")])


class Neighbours:
    """How often words have neighbours of a class, block by block, as rows word, class, counts. counts: pairs of a code and a number, ascending by
    code: the class of the word that follows, classes + the class of the one before, 2 * classes for the word itself as its own follower. A word
    has a row a block, but the core words, which every block has, a row a task. A row without a word is the class bigrams (numbers only)."""

    def __init__(self, classes: int, core: list[bytes]):
        self.classes, self.width = classes, 2 * classes + 1
        self.core, self.place = pa.array(core, pa.binary()), {w: i for i, w in enumerate(core)}
        self.core_class = np.zeros(len(core), np.int64)
        self.core_counts = np.zeros((len(core), self.width), np.int64)
        self.pairs = np.zeros(classes * classes, np.int64)

    def block(self, words: pa.Array, in_core: np.ndarray, kind: np.ndarray, texts: np.ndarray, movable: np.ndarray) -> Iterator[pa.RecordBatch]:
        """in_core: each word's place in the core or -1; kind: classes by place in words, the end's last; texts: places, ends among them; movable:
        which places are wanted."""
        classes, width, end = self.classes, self.width, len(kind) - 1
        texts = np.r_[end, texts]
        of = kind[texts]
        self.pairs += np.bincount(of[:-1] * classes + of[1:], minlength=classes * classes)
        at = np.nonzero(movable[texts])[0]  # never the first, which is an end, nor the last
        found = texts[at]
        repeats, again = texts[at + 1] == found, texts[at - 1] == found
        after = np.where(repeats, 2 * classes, of[at + 1])
        found, n = np.unique(np.concatenate((found * width + after, found[~again] * width + classes + of[at[~again] - 1])), return_counts=True)
        place, code = found // width, found % width
        frequent = in_core[place]
        here = frequent >= 0
        np.add.at(self.core_counts, (frequent[here], code[here]), n[here])
        self.core_class[frequent[here]] = kind[place[here]]
        place, pairs = place[~here], np.empty(int((~here).sum()), COUNTED)
        pairs["code"], pairs["n"] = code[~here], n[~here]
        starts = np.r_[np.nonzero(np.diff(place, prepend=-1))[0], len(place)]
        yield from self.rows(words, place[starts[:-1]], kind[place[starts[:-1]]], pairs, starts)

    def rows(self, words: pa.Array, place: np.ndarray, kind: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw, offsets = pa.py_buffer(pairs.tobytes()), (starts * COUNTED.itemsize).astype(np.int32)
        counts = pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets.tobytes()), raw])
        for low in range(0, len(place), 1 << 16):
            some = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(place[some])), pa.array(kind[some].astype(np.int32)), counts.slice(low, 1 << 16)], names=["word", "class", "counts"])

    def end(self) -> Iterator[pa.RecordBatch]:
        word, code = np.nonzero(self.core_counts)
        pairs = np.empty(len(word), COUNTED)
        pairs["code"], pairs["n"] = code, self.core_counts[word, code]
        starts = np.r_[np.nonzero(np.diff(word, prepend=-1))[0], len(word)]
        place = word[starts[:-1]]
        yield from self.rows(self.core, place, self.core_class[place], pairs, starts)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([self.pairs.astype("<i8").tobytes()], pa.binary())], names=["word", "class", "counts"])


def first_neighbours(blocks: DataFrame, core: list[bytes], label: np.ndarray, classes: int) -> DataFrame:
    """Neighbours of the words outside the core, all of them in the last class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, counted = {w: int(label[i + 1]) for i, w in enumerate(core)}.get, Neighbours(classes, [])
        for batch in batches:
            for words, held, sizes, ids in zip(*batch.columns, strict=True):
                found = np.array([*(get(w, -1) for w in words.values.to_pylist()), 0], np.int64)
                texts = sequence(unpacked(ids.as_py(), "<i4"), sizes.values.to_numpy(), ~np.array(held.as_py(), bool), len(found) - 1)
                yield from counted.block(words.values, np.full(len(found), -1), np.where(found < 0, classes - 1, found), texts, found < 0)
        yield from counted.end()

    return map_arrow(blocks.select("words", "held", "sizes", "ids"), run, NEIGHBOURS)


#: Counts whose best move a task remembers: most words are rare and many of them have the same few neighbours.
REMEMBERED = 500_000


def moved(counted: DataFrame, classes: int) -> tuple[DataFrame, np.ndarray]:
    """word, n, class after each word's best move, and the class bigrams before. counted: rows of Neighbours, staged."""
    pair = np.zeros(classes * classes, np.int64)
    for r in counted.where("word is null").select("counts").toLocalIterator():  # one row a task
        pair += np.frombuffer(r["counts"], "<i8")
    pair = pair.reshape(classes, classes).astype(np.float64)
    width = 2 * classes + 1

    def best(old: list[int], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and number of each word."""
        new, total = [], []
        for low in range(0, len(old), 2048):
            part = counts[low : low + 2048]
            group = np.repeat(np.arange(len(part)), [len(c) // COUNTED.itemsize for c in part])
            pairs = np.frombuffer(b"".join(part), COUNTED)
            dense = np.bincount(group * width + pairs["code"], weights=pairs["n"], minlength=len(part) * width).reshape(-1, width)
            after, before, own = dense[:, :classes], dense[:, classes:-1], dense[:, -1]
            new.append(best_classes(pair, np.array(old[low : low + 2048]), after, before, own))
            total.append((before.sum(1) + own).astype(np.int64))
        return np.concatenate(new), np.concatenate(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], tuple[int, int]] = {}
        word, kind, parts = None, 0, []
        words, keys = [], []

        def settled() -> pa.RecordBatch:
            new = [k for k in dict.fromkeys(keys) if k not in known]
            if new:
                found = best([k[0] for k in new], [k[1] for k in new])
                known.update(zip(new, zip(*(f.tolist() for f in found), strict=True), strict=True))
            rows = [known[k] for k in keys]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32())], names=["word", "n", "class"])
            words.clear()
            keys.clear()
            if len(known) > REMEMBERED:
                known.clear()
            return out

        def joined() -> bytes:
            if len(parts) == 1:
                return parts[0]
            pairs = np.frombuffer(b"".join(parts), COUNTED)
            dense = np.bincount(pairs["code"], weights=pairs["n"], minlength=width)
            out = np.empty(int((dense > 0).sum()), COUNTED)
            out["code"], out["n"] = np.nonzero(dense)[0], dense[dense > 0]
            return out.tobytes()

        for batch in batches:
            for w, c, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if w != word:
                    if parts:
                        words.append(word)
                        keys.append((kind, joined()))
                    word, kind, parts = w, c, []
                parts.append(raw)
                if len(parts) >= 64:
                    parts = [joined()]
            if len(keys) >= 20_000:
                yield settled()
        if parts:
            words.append(word)
            keys.append((kind, joined()))
        if keys:
            yield settled()

    met = counted.where("word is not null").repartition("word").sortWithinPartitions("word")
    return map_arrow(met, run, "word binary, n long, class int"), pair


# ---- classes to blocks


def with_classes(blocks: DataFrame, known: DataFrame, spelled: bool) -> DataFrame:
    """Blocks and, before each, the classes and counts of its words, a block's rows together. known: word, n, class; spelled: the blocks keep their
    words."""
    found = postings(blocks).select("at", "word").join(known.hint("merge"), "word").select("at", "n", "class")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def drain():
            if not held:
                return
            at, n, kind = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            order = np.argsort(at)
            at = at[order]
            block, local = at >> 32, at & 0xFFFFFFFF
            cuts = np.r_[0, np.nonzero(np.diff(block))[0] + 1, len(at)]
            entries = np.empty(len(at), ENTRY)
            entries["n"], entries["class"] = n[order], kind[order]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                entries["step"][low:high] = np.diff(local[low:high], prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array([int(block[low])], pa.int64()), pa.array([packed(entries[low:high])], pa.binary())], names=["block", "payload"])
            held.clear()

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                yield from drain()
                count = 0
        yield from drain()

    none = F.lit(None)
    entries = map_arrow(found, pack, "block long, payload binary").select(
        "block", F.lit(0).alias("kind"), "payload", none.cast("array<binary>").alias("words"), none.cast("int").alias("width"),
        none.cast("array<bigint>").alias("doc_ids"), none.cast("array<boolean>").alias("held"), none.cast("array<int>").alias("sizes"), none.cast("binary").alias("ids"),
    )
    words = F.col("words") if spelled else none.cast("array<binary>").alias("words")
    whole = blocks.select("block", F.lit(1).alias("kind"), none.cast("binary").alias("payload"), words, "width", "doc_ids", "held", "sizes", "ids")
    parts = min(MOST_PARTS, max(1, blocks.count_of_blocks))
    met = entries.union(whole).repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int"))
    return met.sortWithinPartitions("block", "kind")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """words (None if not spelled), kind, n, doc_ids, held, sizes, ids of each block of with_classes(); kind and n by place in words, the end last
    (n: 0)."""
    now, entries = None, []
    for batch in batches:
        for i, (block, what) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if block != now:
                now, entries = block, []
            if what == 0:
                entries.append(batch.column(2)[i].as_py())
                continue
            words, width, doc_ids, held, sizes, ids = (batch.column(c)[i] for c in range(3, 9))
            kind, n = np.full(width.as_py() + 1, UNSEEN, np.int64), np.zeros(width.as_py() + 1, np.int64)
            kind[-1] = 0
            for raw in entries:
                entry = unpacked(raw, ENTRY)
                local = np.cumsum(entry["step"], dtype=np.int64)
                n[local], kind[local] = entry["n"], entry["class"]
            yield words.values, kind, n, doc_ids.values, np.array(held.as_py(), bool), sizes.values.to_numpy(), unpacked(ids.as_py(), "<i4")
            entries = []


def next_neighbours(blocks: DataFrame, known: DataFrame, core: list[bytes], classes: int) -> DataFrame:
    """Neighbours of all words met more than once, with all words in their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Neighbours(classes, core)
        for words, kind, n, _, held, sizes, ids in each_block(batches):
            movable = n > 1  # not the end, either
            in_core = np.array([*(counted.place.get(w, -1) for w in words.to_pylist()), -1])
            yield from counted.block(words, in_core, kind, sequence(ids, sizes, ~held, len(kind) - 1), movable)
        yield from counted.end()

    return map_arrow(with_classes(blocks, known, True), run, NEIGHBOURS)


# ---- the model


@dataclass
class Model:
    tokens: int  # N, ends included
    words: int  # V, the end included
    ends: int
    discount: float
    unseen_words: float  # U
    log_next: np.ndarray | None = None  # log10 P(class | class before)
    class_tokens: np.ndarray | None = None
    unseen: np.ndarray | None = None  # P(an unseen word | class), all of them together


def probabilities(pair: np.ndarray, types: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log_next, class_tokens and unseen of a Model, from the class bigrams and how many distinct words each class has."""
    tokens = pair.sum(0)
    share = (tokens + 1e-3) / (tokens + 1e-3).sum()
    following = (pair + PRIOR * share[None, :]) / (pair.sum(1, keepdims=True) + PRIOR)
    unseen = np.where(tokens > 0, discount * types / np.maximum(tokens, 1), 1.0)  # a class without words has unseen ones only
    unseen[0] = 0.0  # the end is always known
    return np.log10(following), tokens, unseen


def clustered(blocks: DataFrame, vocabulary: DataFrame, core_words: int = CORE, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[list[DataFrame], float]:
    """word, n, class of every word of the training texts, as written tables: the last round's classes and, if there were others, the likeliest before
    them, with its likelihood."""
    spark = blocks.sparkSession
    core = [bytes(r["word"]) for r in vocabulary.orderBy(F.desc("n"), "word").limit(core_words).select("word").collect()]
    label = exchange(count_units(blocks, core), classes)
    of_core = F.broadcast(spark.createDataFrame([(w, int(label[i + 1])) for i, w in enumerate(core)], "word binary, class int"))  # at most CORE rows
    best: list[tuple[float, DataFrame]] = []
    for r in range(max(1, rounds)):
        met = first_neighbours(blocks, core, label, classes) if not r else next_neighbours(blocks, best[0][1], core, classes)
        counted = staged(met, "brown-neighbours", once=True)
        after, pair = moved(counted, classes)
        if r:
            best[0] = (likelihood(pair), best[0][1])
        else:
            after = vocabulary.join(of_core, "word").select("word", "n", "class").union(after)
        if r:  # words met once stay where they are
            after = after.union(best[0][1].where("n = 1").select("word", "n", "class"))
        known = staged(after, "brown-classes", once=True)
        unstage(counted)
        best = [(-math.inf, known), *sorted(best, key=lambda b: -b[0])]
        unstage(*(b[1] for b in best[2:]))
        best = best[:2]
    return [b[1] for b in best], best[-1][0]


TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, known_base double, kept double, classes binary"


def as_classes(blocks: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """A row for each text: its counts, the baseline's log10 probability of it and of its known tokens, the sum of log10 (count - discount) of the
    known words, and the tokens' classes (UNSEEN where not known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, n, doc_ids, held, sizes, ids in each_block(batches):
            counts = n.astype(np.float64)
            counts[-1] = model.ends
            base = np.log10((counts + 1) / (model.tokens + model.words + 1))
            seen = kind != UNSEEN
            kept = np.where(seen, np.log10(np.maximum(counts - model.discount, 1e-300)), 0.0)
            kept[-1] = math.log10(model.ends)
            codes = kind.astype(np.uint8)
            for low in range(0, len(sizes), 1024):  # texts
                part = sizes[low : low + 1024]
                first = int(sizes[:low].sum())
                text = sequence(ids[first : first + int(part.sum())], part, np.ones(len(part), bool), len(kind) - 1)
                starts = np.cumsum(part + 1) - part - 1
                sums = lambda x: pa.array(np.add.reduceat(x[text], starts))  # noqa: E731, B023
                raw = codes[text].tobytes()
                columns = [doc_ids.slice(low, 1024), pa.array(held[low : low + 1024]), pa.array((part + 1).astype(np.int64)), sums(seen.astype(np.int64)), sums(base), sums(np.where(seen, base, 0.0)), sums(kept)]
                columns.append(pa.array([raw[a : a + s + 1] for a, s in zip(starts.tolist(), part.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "known_base", "kept", "classes"])

    return map_arrow(with_classes(blocks, known, False), run, TEXTS)


def class_bigrams(rows: DataFrame, classes: int) -> np.ndarray:
    """Bigrams of classes, from as_classes() without unseen words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            kind = np.frombuffer(b"\0" + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)  # each text ends with class 0
            total += np.bincount(kind[:-1] * classes + kind[1:], minlength=classes * classes)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    counts = np.zeros(classes * classes)
    for r in map_arrow(rows.select("classes"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    return counts.reshape(classes, classes)


class Runs:
    """Sums over the classes of runs of unseen words."""

    def __init__(self, model: Model):
        self.next, self.unseen, self.each = 10.0**model.log_next, model.unseen, math.log10(model.unseen_words)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For a run of that many unseen words: log10 P(run, class behind it | class before it), and log10 P(run | class before it)."""
        if length not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            power, scale = np.eye(len(self.next)), 0.0
            square, square_scale, left = self.next * self.unseen, 0.0, length
            while left:  # powers by squaring, scaled so that nothing vanishes
                if left & 1:
                    power, scale = power @ square, scale + square_scale
                    scale, power = scale + math.log10(power.max()), power / power.max()
                square, square_scale, left = square @ square, 2 * square_scale, left >> 1
                square_scale, square = square_scale + math.log10(square.max()), square / square.max()
            scale -= length * self.each
            with np.errstate(divide="ignore"):
                self.known[length] = (np.log10(power @ self.next) + scale, np.log10(power.sum(1)) + scale)
        return self.known[length]


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, known_base, known_score, from as_classes(). The known scores are the
    part of the scores that known tokens have, each given all tokens before it."""
    shares = np.log10(np.maximum(model.class_tokens, 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(7).to_pylist()
            kind = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
            at = np.nonzero(kind != UNSEEN)[0]  # the last of each text is one
            gap = np.diff(at, prepend=-1) - 1
            now, before = kind[at], np.r_[0, kind[at[:-1]]]
            moves, lost = model.log_next[before, now], np.zeros(len(at))
            for length in np.unique(gap[gap > 0]).tolist():
                here = np.nonzero(gap == length)[0]
                both, run_alone = runs.of(length)
                lost[here] = run_alone[before[here]]
                moves[here] = both[before[here], now[here]] - lost[here]
            starts = np.searchsorted(at, np.cumsum([0, *map(len, texts[:-1])]))
            known = batch.column(6).to_numpy() + np.add.reduceat(moves - shares[now], starts)
            whole = known + np.add.reduceat(lost, starts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(whole), batch.column(5), pa.array(known)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "known_base", "known_score"])

    return map_arrow(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, known_base double, known_score double")


def class_model(docs: DataFrame, held_out: Column, core_words: int = CORE) -> tuple[DataFrame, Model, DataFrame] | None:
    """as_classes() of all docs, the model, and word, n, class, from the rows that are not held out; None if there are none."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("held_out", held_out)
    blocks = blocks_of(source)
    ends = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)).cast("bigint")).alias("n")).first()["n"]
    if not ends:
        unstage(blocks)
        return None
    vocabulary = staged(postings(blocks).where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "brown-vocabulary", once=True)
    total = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    n1, n2 = total["n1"], total["n2"]
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
    model = Model((total["n"] or 0) + ends, total["v"] + 1, ends, discount, max(1.0, n1 * n1 / (2 * n2) if n2 else n1 * (n1 - 1) / 2))
    tables, before = clustered(blocks, vocabulary, core_words)
    unstage(vocabulary)
    texts, pair = None, None
    while True:
        known = tables.pop(0)
        texts = staged(as_classes(blocks, known, model), "brown-texts", once=True)
        pair = class_bigrams(texts.where("not held_out"), CLASSES)
        if not tables or likelihood(pair) >= before:
            break
        unstage(texts, known)
    types = np.zeros(len(pair))
    for r in known.groupBy("class").count().collect():
        types[r["class"]] = r["count"]
    model.log_next, model.class_tokens, model.unseen = probabilities(pair, types, discount)
    unstage(blocks, *tables)
    return texts, model, known


def class_model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_base, known_score: a row for each row of docs (doc_id, text),
    with what is learned from the rows that are not held out."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "known_base", "known_score"]
    made = class_model(docs, held_out)
    if made is None:
        return untrained(docs, held_out).withColumn("train_tokens", F.lit(0).cast("bigint")).select(*names)
    texts, model, known = made
    unstage(known)
    return score(texts, model).withColumn("train_tokens", F.lit(model.tokens).cast("bigint")).select(*names)


def untrained(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores without training texts: only tokens are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(doc_id=pa.int64(), held_out=pa.bool_(), n_tokens=pa.int64())
        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink.add(doc_id, out, len(split_words(text)) + 1):
                    yield from sink.drain()
        yield from sink.drain()

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("held_out", held_out)
    counted = map_arrow(source.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, n_tokens long")
    zero = F.lit(0.0)
    return counted.select("*", F.lit(0).cast("bigint").alias("n_known"), *(zero.alias(c) for c in ("base_score", "score", "known_base", "known_score")))


def op4_class_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return class_model_scores(table(spark, sf_dir, "documents"), held_out)
