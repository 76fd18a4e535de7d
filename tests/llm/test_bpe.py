import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from heapscope.llm import bpe

PATH = bpe.vocabulary_path()
PIECES = [*"abcdeABC thing'sSΣσςİ½²一二éÉé̀\x1c\x85 \n\t\r.,!?123٣अ<|>😀ǅ ‍", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "<|startoftext|>", "Å", "ﬁ", "가"]


def test_equals_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(5000)] + ["", " \n", "a" * 5000, "inth" * 400]
    library, own = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    for text, want, got in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert own.decode(got).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    own, rng = bpe.vocabulary(PATH), random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choices("aeinthrs", k=rng.randint(1, 60))).encode()
        ids = own.inner[np.frombuffer(raw, np.uint8)]
        ids[-1] = own.last[raw[-1]]
        assert own.merge_rows(ids[None, :].copy(), len(raw))[0] == own.merge_long(ids.tolist())


def test_operator(docs, spark):
    df = docs([(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x")])
    rows = {(r["doc_id"], r["n_tokens"]) for r in bpe.token_digests(df).collect()}
    assert rows == {(1, 2), (2, 0), (3, 0), (None, 1)}
    encoded = bpe.bpe_encode(df, PATH, keep=("doc_id", "lang"))
    assert encoded.columns == ["doc_id", "lang", "ids"]
    texts = {r["doc_id"]: r["decoded"] for r in bpe.bpe_decode(encoded, PATH).collect()}
    assert texts[1] == "hello</w> world</w>" and texts[2] == ""
    assert bpe.token_digests(docs([])).count() == 0


@pytest.mark.parametrize("extra", ["ids", "decoded", "n_tokens"])
def test_clashing_columns(docs, extra):
    from pyspark.sql import functions as F

    df = docs([(1, "Hello")]).withColumn(extra, F.lit("z"))
    assert bpe.token_digests(df).first()["n_tokens"] == 1
