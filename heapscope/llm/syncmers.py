"""Document fingerprints from closed syncmers.

Method: every K-mer of code points whose least S-mer (by a hash of the S-mer's own characters) stands first or last in it is an anchor. Whether a
K-mer is one depends on its own characters only, so an edit changes the anchors it touches and no others, and anchors of shared text
match by position. A fingerprint is the SIZE anchors of least hash, each with its first position; it covers the whole
text and is bounded. The likeness of two fingerprints takes the least hashes of both together, counts those in both whose positions
follow each other in the same order in both texts, and gives the share of common text (Dice: twice the common part over the sum).

Edge cases: a text without any syncmer (all of fewer than K code points, and some up to 2 K - S - 2) has one anchor, its whole text; a null text is an empty one, whose
fingerprint is empty; two empty fingerprints have likeness 1, an empty and another 0; equal texts have equal fingerprints. For neighbours
rows are ordered by doc_id descending, nulls last, rows of one doc_id by a hash of the text; equal rows are neighbours like others; a
single row is its own neighbour; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, map_arrow, ship, shuffle_partitions, table
from .minhash import mix

K, S, SIZE = 12, 5, 64
#: Ranges have LEAST_BYTES at least and about RANGE_BYTES at most, up to MAX_RANGES of them.
LEAST_BYTES, RANGE_BYTES, MAX_RANGES = 1 << 20, 64 << 20, 1 << 16
#: Finest parts that the rows of one doc_id are cut in by their hashes.
FINE = 256
_R = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_R, i, 1 << 64)) for i in range(9)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of a text's closed syncmers, of one of fewer than K code points its whole."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    if n < K:
        return whole_text(codes)
    one = mix(codes.astype(np.uint64) + np.uint64(0x632BE5AB))
    two = one[:-1] * _POWERS[1] + one[1:]
    four = two[:-2] * _POWERS[2] + two[2:]
    small = mix(four[:-1] * _POWERS[1] + one[4:])
    least = np.minimum(small[:-1], small[1:])  # of 2, 4 and 8 = K - S + 1 neighbours
    least = np.minimum(least[:-2], least[2:])
    least = np.minimum(least[:-4], least[4:])
    at = np.nonzero((small[:-7] == least) | (small[7:] == least))[0]
    whole = mix(four[at] * _POWERS[8] + four[at + 4] * _POWERS[4] + four[at + 8])
    return at, (whole >> np.uint64(32)).astype(np.uint32)


def whole_text(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = mix(codes.astype(np.uint64) + np.uint64(0x632BE5AB))
    whole = np.array([len(codes)], np.uint64)
    for i in range(len(codes)):
        whole = mix(whole * _POWERS[1] + one[i : i + 1])
    return np.zeros(1, np.int64), (whole >> np.uint64(32)).astype(np.uint32)


def text_anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """anchors(), or the whole text as one where a text that is not empty has none."""
    codes = code_points(text)
    at, hashes = anchors(codes)
    return whole_text(codes) if len(codes) and not len(at) else (at, hashes)


class Fingerprint:
    """The SIZE least anchor hashes, ascending, and the first position of each."""

    def __init__(self, text: str):
        at, hashes = text_anchors(text)
        kept, first = np.unique(hashes, return_index=True)
        self.hashes, self.positions = kept[:SIZE], at[first[:SIZE]]
        self.place = dict(zip(self.hashes.tolist(), self.positions.tolist(), strict=True))

    def __str__(self) -> str:
        pairs = np.empty((len(self.hashes), 2), "<u4")
        pairs[:, 0], pairs[:, 1] = self.hashes, self.positions
        return base64.b64encode(pairs.tobytes()).decode()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.place == b.place:
        return 1.0
    if not a.place or not b.place:
        return 0.0
    common = a.place.keys() & b.place.keys()
    if not common:
        return 0.0
    size = min(SIZE, len(a.place) + len(b.place) - len(common))
    least = sorted(a.place.keys() | b.place.keys())[:size]
    tops: list[int] = []  # longest run of common anchors in the order of both texts
    for _, y in sorted((a.place[h], b.place[h]) for h in least if h in common):
        i = bisect_left(tops, y)
        tops[i : i + 1] = [y]
    share = len(tops) / size
    return 2 * share / (1 + share)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, and all anchors of the text: anchor_positions, anchor_hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(doc_id=pa.int64(), fingerprint=pa.string(), anchor_positions=pa.list_(pa.int64()), anchor_hashes=pa.list_(pa.int64()))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, hashes = text_anchors(text or "")
                if sink.add(doc_id, str(Fingerprint(text or "")), at, hashes.astype(np.int64), size=16 * len(at) + 700):
                    yield from sink.drain()
        yield from sink.drain()

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id long, fingerprint string, anchor_positions array<bigint>, anchor_hashes array<bigint>")


class Cuts:
    """Values cut into ranges in ascending order. A cut that comes up several times is a value with as many ranges' rows: it gets ranges of its own."""

    def __init__(self, cuts: list[int]):
        self.values, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.heavy = self.times > 1

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval (up to a cut) of each x, and whether x is that cut and heavy."""
        j = np.searchsorted(self.values, x, side="left")
        at = np.minimum(j, len(self.values) - 1)
        return j, (j < len(self.values)) & (self.values[at] == x) & self.heavy[at] if len(self.values) else np.zeros(len(x), bool)


class Places:
    """Numbers of ranges of rows in order of doc_id descending (nulls last), then hash ascending. Ids with more rows than a range are cut by hash, and
    hashes with more by a number of the row, which equal rows only can share."""

    def __init__(self, cuts: list[int], of_heavy: dict[int | None, list[int]]):
        self.ids, self.by_hash, self.count = Cuts(cuts), {k: Cuts(v) for k, v in of_heavy.items()}, 0
        u = len(self.ids.values)
        self.rest, self.first = np.zeros(u + 1, np.int64), {}
        for j in range(u, -1, -1):
            if j < u and self.ids.heavy[j]:
                self.reserve(int(self.ids.values[j]))
            self.rest[j], self.count = self.count, self.count + 1
        self.reserve(None)

    def reserve(self, key: int | None) -> None:
        """Ranges of one id: for each interval of hashes one, and behind it those of a heavy hash, its upper end."""
        hashes = self.by_hash.setdefault(key, Cuts([]))
        sizes = np.r_[1 + np.where(hashes.heavy, hashes.times, 0), 1].astype(np.int64)
        self.first[key] = self.count + np.cumsum(sizes) - sizes
        self.count += int(sizes.sum())

    def within(self, key: int | None, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        cuts = self.by_hash[key]
        i, heavy = cuts.interval(hashes)
        out = self.first[key][i]
        out[heavy] += 1 + rows[heavy] % cuts.times[i[heavy]]
        return out

    def of(self, ids: np.ndarray, unknown: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        j, heavy = self.ids.interval(ids)
        out = self.rest[j]
        for i in np.unique(j[heavy & ~unknown]).tolist():
            here = heavy & ~unknown & (j == i)
            out[here] = self.within(int(self.ids.values[i]), hashes[here], rows[here])
        out[unknown] = self.within(None, hashes[unknown], rows[unknown])
        return out


def places(rows: DataFrame) -> Places:
    """rows: doc_id, text, hash. The driver gets quantiles."""
    seen = rows.agg(F.sum(F.octet_length("text").cast("double")).alias("size"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    size, n_rows, n_ids = seen["size"] or 0.0, seen["rows"], seen["ids"]
    n = int(max(1, min(MAX_RANGES, max(size // RANGE_BYTES, min(shuffle_partitions(rows.sparkSession), size // LEAST_BYTES)))))
    of_ids, of_none = (round(n * k / max(1, n_rows)) for k in (n_ids, n_rows - n_ids))
    cuts = []
    if of_ids > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [i / of_ids for i in range(1, of_ids)], 100_000).alias("cuts")).first()["cuts"]
    heavy = Cuts(cuts)
    parts = {int(v): int(t) for v, t in zip(heavy.values[heavy.heavy], heavy.times[heavy.heavy], strict=True)} | ({None: of_none} if of_none > 1 else {})
    of_heavy = {}
    if parts:
        wanted = F.col("doc_id").isin([k for k in parts if k is not None]) | (F.col("doc_id").isNull() & F.lit(None in parts))
        fine = F.percentile_approx("hash", [i / FINE for i in range(1, FINE)], 100_000)
        for r in rows.where(wanted).groupBy("doc_id").agg(fine.alias("cuts")).collect():  # at most one for each two ranges
            step = max(1, FINE // parts[r["doc_id"]])
            of_heavy[r["doc_id"]] = r["cuts"][step - 1 :: step]
    return Places(cuts, of_heavy)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, ghost: rows in ranges of (doc_id descending, hash), sorted within; each range ends with ghosts, copies of the first
    row of the next range. No row is in more than two ranges; the driver gets one row a range."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    found = places(rows)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, unknown: pd.Series, hashes: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series(found.of(ids.to_numpy(np.int64), unknown.to_numpy(bool), hashes.to_numpy(np.int64), numbers.to_numpy(np.int64)))

    # ids as they are, without nulls: Arrow would make them floats
    ranged = rows.withColumn("range", range_of(F.coalesce("doc_id", F.lit(0).cast("bigint")), F.col("doc_id").isNull(), "hash", F.monotonically_increasing_id()))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("hash").alias("h"))).alias("top")).collect()}
    order = sorted(tops)
    back = [(r, tops[r]["doc_id"], ~tops[r]["h"], order[i - 1]) for i, r in enumerate(order)]  # the first range's top comes after the last range's rows
    back = F.broadcast(spark.createDataFrame(back or [(0, None, 0, 0)], "range long, top long, top_hash long, before long"))  # at most a few MAX_RANGES rows
    own = F.struct(F.col("range").alias("r"), F.lit(False).alias("g"))
    copies = F.when(F.expr("doc_id <=> top and hash = top_hash"), F.array(own, F.struct(F.col("before").alias("r"), F.lit(True).alias("g")))).otherwise(F.array(own))
    each = ranged.join(back, "range").select("doc_id", "text", "hash", F.explode(copies).alias("c")).select("doc_id", "text", "hash", F.col("c.r").alias("range"), F.col("c.g").alias("ghost"))
    dealt = each.repartitionById(found.count, F.col("range").cast("int"))
    return dealt.sortWithinPartitions("range", "ghost", F.desc("doc_id"), "hash").select("doc_id", "text", "range", "ghost")


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has the last
    floor(n_chars / 2) code points replaced by as many of the next text's first, the next by descending doc_id, after the last the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(doc_id=pa.int64(), n_chars=pa.int64(), edited_sha256=pa.string(), fingerprint=pa.string(), edited_fingerprint=pa.string(), near_edited=pa.float64(), near_next=pa.float64())
        now, held = None, None
        for batch in batches:
            for doc_id, text, number, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    now, held = number, None
                elif held is None:
                    continue  # a further ghost: rows that share the first doc_id of a range
                own = Fingerprint(text)
                if held is not None:
                    before, old, of_old = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    of_edited = Fingerprint(edited)
                    row = (before, len(old), hashlib.sha256(edited.encode()).hexdigest(), str(of_old), str(of_edited), likeness(of_old, of_edited), likeness(of_old, own))
                    if sink.add(*row, size=1600):
                        yield from sink.drain()
                held = None if ghost else (doc_id, text, own)
        yield from sink.drain()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(in_order(docs), run, schema)


def op1_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))
