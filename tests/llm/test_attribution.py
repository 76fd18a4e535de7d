import random

import pytest
from tokenizers import Tokenizer

from heapscope.llm import attribution


def brute(text, spans, offsets):
    """Tokens by section from the library's character offsets, for texts without letters of several tokens."""
    count, share, crossing = [0] * len(spans), [0.0] * len(spans), [0] * len(spans)
    for a, b in offsets:
        parts = [len(text[max(a, s) : min(b, e)].encode()) if min(b, e) > max(a, s) else 0 for s, e in spans]
        count[parts.index(max(parts))] += 1
        for i, p in enumerate(parts):
            share[i] += p / sum(parts)
            crossing[i] += bool(p) and p < sum(parts)
    return count, crossing, share


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_lines_equal_brute_force(spark, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["the ", "token", " and", "\n", "\n\n", " \n  ", "é", "12", "<|endoftext|>"], k=rng.randint(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (None, "a")], "doc_id long, text string")
    got = {}
    for r in attribution.section_tokens(df, attribution.default_path()).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        rows = sorted(got[i], key=lambda r: r["section"])
        spans, at = [], 0
        for line in text.split("\n"):
            end = min(len(text), at + len(line) + 1)
            if end > at:
                spans.append((at, end))
            at = end
        assert [(r["start_char"], r["start_char"] + r["n_chars"]) for r in rows] == spans
        count, crossing, share = brute(text, spans, library.encode(text, add_special_tokens=False).offsets)
        assert [r["n_tokens"] for r in rows] == count and [r["n_crossing"] for r in rows] == crossing
        assert [r["token_share"] for r in rows] == pytest.approx(share)
    assert [tuple(got[i][0])[1:] for i in (900, 901)] == [(0, None, 0, 0, 0, 0, 0.0)] * 2
    assert got[None][0]["n_tokens"] == 1


def test_given_spans(spark):
    text = "title here\nbody of the text"
    spans = [("title", 0, 10), ("body", 11, 500), ("late", 20, 25), ("none", 5, 5), (None, None, 3)]
    df = spark.createDataFrame([(1, text, spans), (2, text, None)], "doc_id long, text string, marks array<struct<name: string, start: bigint, end: bigint>>")
    got = {(r["doc_id"], r["name"], r["start_char"]): r["n_chars"] for r in attribution.section_tokens(df, attribution.default_path(), "marks").collect()}
    assert got == {(1, "title", 0): 10, (1, None, 10): 1, (1, "body", 11): 16, (2, None, 0): 27}
    assert attribution.section_tokens(df.limit(0), attribution.default_path()).count() == 0
