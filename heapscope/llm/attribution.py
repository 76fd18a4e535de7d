"""Token counts of fields or sections.

Method: a whole document is encoded once. The byte lengths of its tokens give their spans, and spans are joined with the document's
sections by a search in the sorted section starts. A token inside one section counts there. A token that crosses a
boundary counts, under MAJORITY, for the section that holds most of its UTF-8 bytes, the earliest of equals; `token_share` divides it
in proportion to them. Both add up to the document's tokens.

Sections are lines (each with its line end) or given spans of code points; tokens outside all given spans fall to a section
named null.

Edge cases: a null or empty text has one empty section without tokens, a text's last line end opens no further section; given spans that overlap, are
empty or reach outside the text are cut to what is left of them after the spans before; rows are independent, so ties and repeated rows need
no rule; a null doc_id is kept; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table


class ByteBpe:
    """A byte-level vocabulary in ranks, which encodes any text without loss."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)


_loaded: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """One a Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def allocate(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths: bytes of each token, in order; starts: ascending byte offsets of sections, the first 0. Returns tokens by
    section (majority), crossing tokens that touch the section, and shares in proportion."""
    n = len(starts)
    ends = np.cumsum(lengths)
    low = np.searchsorted(starts, ends - lengths, "right") - 1
    high = np.searchsorted(starts, ends - 1, "right") - 1
    inside = low == high
    count = np.bincount(low[inside], minlength=n)
    share, touched = count.astype(np.float64), np.zeros(n, np.int64)
    for i in np.nonzero(~inside)[0]:
        cuts = np.concatenate(([ends[i] - lengths[i]], starts[low[i] + 1 : high[i] + 1], [ends[i]]))
        parts = np.diff(cuts)
        count[low[i] + int(parts.argmax())] += 1
        share[low[i] : high[i] + 1] += parts / lengths[i]
        touched[low[i] : high[i] + 1] += parts > 0
    return count, touched, share


def line_starts(raw: bytes) -> np.ndarray:
    at = np.nonzero(np.frombuffer(raw, np.uint8) == 0x0A)[0] + 1
    return np.concatenate(([0], at[at < len(raw)]))


def span_starts(raw: bytes, text: str, spans: list[dict]) -> tuple[np.ndarray, list[str | None]]:
    """Byte starts of the sections that the spans cut a text into, and their names."""
    first = np.concatenate((np.nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[0], [len(raw)]))
    starts, names, at = [], [], 0
    for s in sorted((s for s in spans or [] if s and s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"])):
        low, high = max(at, min(s["start"], len(text))), min(s["end"], len(text))
        if high <= low:
            continue
        if low > at:
            starts.append(at)
            names.append(None)
        starts.append(low)
        names.append(s["name"])
        at = high
    if at < len(text) or not starts:
        starts.append(at)
        names.append(None)
    return first[np.array(starts)], names


def section_tokens(docs: DataFrame, path: str, spans: str | None = None) -> DataFrame:
    """doc_id, section (from 0), name (of given spans), start_char, n_chars, n_tokens, n_crossing, token_share: a row for each section of
    each row of docs (doc_id, text). spans: a column array<struct<name string, start bigint, end bigint>>, else lines."""
    chosen = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")] + ([F.col(spans).alias("spans")] if spans else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            given = batch.column(2).to_pylist() if spans else [None] * batch.num_rows
            for doc_id, text, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), given, strict=True):
                text = text or ""
                raw = text.encode()
                starts, names = span_starts(raw, text, marked) if spans else (line_starts(raw), None)
                count, touched, share = allocate(bpe.lengths[np.array(bpe.encode(text), np.int64)], starts)
                leads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                chars = leads[np.append(starts, len(raw))]
                n = len(starts)
                for column, values in zip(columns, ([doc_id] * n, np.arange(n), names or [None] * n, chars[:-1], np.diff(chars), count, touched, share), strict=True):
                    column.append(values)
            if columns[0]:
                flat = [pa.array([x for part in columns[0] for x in part], pa.int64()), None, pa.array([x for part in columns[2] for x in part], pa.string())]
                flat[1] = pa.array(np.concatenate(columns[1]), pa.int64())
                flat += [pa.array(np.concatenate(c), pa.int64()) for c in columns[3:7]] + [pa.array(np.concatenate(columns[7]), pa.float64())]
                yield pa.RecordBatch.from_arrays(flat, names=["doc_id", "section", "name", "start_char", "n_chars", "n_tokens", "n_crossing", "token_share"])

    return map_arrow(docs.select(*chosen), run, "doc_id long, section long, name string, start_char long, n_chars long, n_tokens long, n_crossing long, token_share double")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_token_attribution(spark, sf_dir: str) -> DataFrame:
    """Lines of every document: doc_id, section, start_char, n_chars, n_tokens, n_crossing, token_share."""
    return section_tokens(table(spark, sf_dir, "documents"), default_path()).drop("name")
