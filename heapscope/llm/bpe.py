"""BPE encoding and decoding with a given vocabulary (never trained here).

Method: a contiguous rank array. A word is an array of parts with, beside each part, the merge rank of
the part and its right neighbour. The least rank is sought by a scan, its boundary deleted, and the two
neighbouring ranks refreshed, until no pair has a rank. Short words are done many at once, as the rows of
one numpy matrix; the same scan runs over all rows. A word of over SHORT symbols, where repeated scans
would be quadratic, takes a linked list with a heap instead, with the same result.

Edge cases: a null text encodes as the empty text (no ids, decoded text empty); white space alone gives no ids; rows are
independent, so ties and repeated rows need no rule; other columns are passed over.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, map_arrow

SHORT = 48
NO_RANK = np.int32(2**31 - 1)
#: Words and pieces remembered by one Python worker; the memory is emptied when full.
CACHE = 250_000


def byte_symbols() -> list[str]:
    """Printable stand-ins for the 256 bytes, as byte-level vocabularies write them."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary of a tokenizers file whose BPE works on words with an end-of-word suffix."""

    #: White space of the Unicode standard, which the file's patterns call \\s.
    SPACE = r"\t-\r \x85\xa0  -     　"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        size = max(self.tokens) + 1
        self.token_bytes = [self.tokens.get(i, "").encode() for i in range(size)]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.size = size
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", self.SPACE)).findall
        self.spaces = regex.compile(f"[{self.SPACE}]+").split
        self.plain = regex.compile(r"[\x00-\x1b\x20-\x7f]*").fullmatch
        self.words: dict[str | tuple[str], bytes] = {}
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray, length: int) -> list[bytes]:
        """parts: one word of `length` symbols a row. All rows are merged at once, a boundary each a pass."""
        n = len(parts)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        lens = np.full(n, length)
        ranks = np.full((n, length), NO_RANK, np.int32)
        if length > 1:
            ranks[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the least
            here = np.arange(len(rows))
            best = ranks[here, at]
            done = best == NO_RANK
            if done.any():
                for i in np.nonzero(done)[0]:
                    out[rows[i]] = parts[i, : lens[i]].astype("<u4").tobytes()
                keep = ~done
                rows, lens, at, best = rows[keep], lens[keep], at[keep], best[keep]
                parts, ranks = parts[keep], ranks[keep]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            parts[here, at] = self.made[best]
            # delete the boundary: all behind it moves one place to the left
            columns = np.arange(parts.shape[1] - 1)
            source = columns + (columns > at[:, None])
            moved = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            parts, ranks = np.take_along_axis(parts, source, 1), moved
            lens = lens - 1
            # refresh the ranks of the new part with its neighbours
            right = at + 1 < lens
            ranks[here[~right], at[~right]] = NO_RANK
            i, a = here[right], at[right]
            ranks[i, a] = self.rank(parts[i, a], parts[i, a + 1])
            left = at > 0
            i, a = here[left], at[left]
            ranks[i, a - 1] = self.rank(parts[i, a - 1], parts[i, a])
        return out

    def merge_long(self, parts: list[int]) -> bytes:
        """The same merges by a heap over a linked list, for words too long for repeated scans."""
        n = len(parts)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        get, size = self.rank_of.get, self.size
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = int(self.made[r]), False
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if (s := get(parts[i] * size + parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (s, i, parts[i], parts[nxt[i]]))
            if (p := prv[i]) >= 0 and (s := get(parts[p] * size + parts[i])) is not None:
                heapq.heappush(heap, (s, p, parts[p], parts[i]))
        return np.array([parts[i] for i in range(n) if alive[i]], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Merges the pieces not known yet, those of one length together."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            if len(raw) > SHORT:
                ids = self.inner[np.frombuffer(raw, np.uint8)]
                ids[-1] = self.last[raw[-1]]
                self.known[piece] = self.merge_long(ids.tolist())
            else:
                by_length.setdefault(len(raw), []).append((piece, raw))
        for length, group in by_length.items():
            raw = np.frombuffer(b"".join(r for _, r in group), np.uint8).reshape(-1, length)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            for (piece, _), made in zip(group, self.merge_rows(ids, length), strict=True):
                self.known[piece] = made

    def normalized(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no special case)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """At white space; str.split() also takes U+001C to U+001F for such, which the patterns do not."""
        if self.plain(text) or not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
        return [w for w in self.spaces(text) if w]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Added tokens are sought in the raw text first."""
        segments = [self.split_added.split(t) if self.split_added and any(a in t for a in self.added) else [t] for t in texts]
        split = [[[(s,)] if s in self.added else self.split(self.normalized(s)) for s in segs] for segs in segments]
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.known) > CACHE:
            self.known.clear()
        words, known = self.words, self.known
        for special, i in self.added.items():
            words[(special,)] = np.array([i], "<u4").tobytes()  # no word of a text is such a key
        new = {w for segs in split for part in segs for w in part}.difference(words)
        if new:
            pieces = {w: [w] if w.isalpha() and w.isascii() else self.pieces(w) for w in new}
            self.learn({p for ps in pieces.values() for p in ps}.difference(known))
            words.update((w, known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])) for w, ps in pieces.items())
        get = words.__getitem__
        return [b"".join([b for part in segs for b in map(get, part)]) for segs in split]

    def decode(self, ids: bytes) -> bytes:
        """The file names no decoder: the tokens' texts are joined by spaces (UTF-8)."""
        return b" ".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    """One vocabulary a Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe_encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns of `keep`, `ids` binary (little-endian unsigned 32-bit) and, if asked for, `decoded`: the text read
    back from those ids. One pass over the rows, no shuffle."""
    source = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            names = batch.schema.names[:-1]
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            at = 0
            while at < len(texts):  # slices of about a megabyte
                end, size = at, 0
                while end < len(texts) and size < 1 << 20:
                    size += len(texts[end])
                    end += 1
                ids = bpe.encode(texts[at:end])
                columns = [batch.column(i).slice(at, end - at) for i in range(len(names))] + [pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x).decode() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", *["decoded"] * decoded])
                at = end

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, run, ", ".join(filter(None, [types, "ids binary", "decoded string" * decoded])))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and `decoded`, the text that the binary ids stand for (null ids: the empty text)."""
    source = df.select(*keep, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            names = batch.schema.names[:-1]
            texts = [bpe.decode(x or b"").decode() for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "decoded"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, run, ", ".join(filter(None, [types, "decoded string"])))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the text decoded from them."""
    done = bpe_encode(docs, path or vocabulary_path(), decoded=True)
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
