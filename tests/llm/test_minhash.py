import random

import numpy as np
import pytest

from heapscope.llm import minhash


def brute(rows, width, percent=80):
    sets = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        if words and len(words) < width:
            sets.append((i, frozenset([tuple(words)])))
        else:
            sets.append((i, frozenset(tuple(words[j : j + width]) for j in range(len(words) - width + 1))))
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(docs, width):
    rng = random.Random(width)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 25)):
            rows.append((n, " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06, 0.1])))))
            n += 1
    rows += [(n, rows[0][1].upper()), (n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "one two")]
    rng.shuffle(rows)
    want = brute(rows, width)
    got = minhash.near_duplicates(docs(rows), width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_null_and_repeated_ids(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (5, "z y x w v u"), (None, "a b c d e f"), (None, None)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows), width=2).collect()}
    assert got == {(1, 1, True), (5, 1, False), (None, None, True)}
    kept = minhash.keep_one(docs(rows)).collect()
    # both texts of 1 stay, the row without an id that repeats one of them goes
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept) == [(0, None), (1, "a b c d e f"), (1, "z y x w v u")]
    assert minhash.near_duplicates(docs([])).count() == 0


def test_densified_bins_agree_as_often_as_the_sets():
    rng = np.random.default_rng(3)
    for size, common in ((5, 4), (60, 48), (2000, 1600)):
        agree = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**64 - 1, size + 2 * (size - common), dtype=np.uint64))
            a, b = np.sort(x[:size]), np.sort(np.concatenate((x[:common], x[size : 2 * size - common])))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - common / (2 * size - common)) < 0.06


def test_block_finds_what_pairs_find():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.int64) for _ in range(40)]
    block = minhash.Block([(i, i, s) for i, s in enumerate(sets)], 50)
    for node, s in enumerate(sets):
        found = [j for j, t in enumerate(sets) if j != node and 100 * len(np.intersect1d(s, t)) >= 50 * len(np.union1d(s, t))]
        other = minhash.Block([(i, i, t) for i, t in enumerate(sets)], 50).visit(node, node, s)
        assert (other is None) == (not found) and (other is None or other in found)
    assert block.ids.tolist() == list(range(40))


def test_keep_one_of_rows_that_share_an_id(docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, b + " more", "u"), (None, a + " end", "v"), (None, "alone " * 9, "w"), (3, None, "n"), (3, "", "e"), (4, "", "f")]
    df = docs([(i, t, lang) for i, t, lang in rows]).withColumn("row", minhash.F.lit(1)).withColumn("Digest", minhash.F.lit(2)).repartition(3)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"], r["lang"]) for r in out.collect()]
    again = [(r["doc_id"], r["text"], r["lang"]) for r in minhash.keep_one(df.repartition(2)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert sorted(((i, t) for i, t, _ in got), key=repr) == sorted([(1, a), (1, b), (None, "alone " * 9), (3, None), (3, ""), (4, "")], key=repr)
    plain = minhash.keep_one(docs([(1, a, "x"), (2, a + " end", "y"), (3, b, "z")]).withColumn("kept", minhash.F.lit(0)))
    assert sorted(r["doc_id"] for r in plain.collect()) == [1, 3]


def test_recall_near_the_bound(docs):
    """Pairs whose similarity is 0.80 to 0.84, with two-word shingles, of sizes from 5 to 3,000: every one is found, none of 0.78 to 0.80."""
    rng = random.Random(11)
    rows, linked = [], set()
    for i in range(700):
        n = rng.choice([6, 20, 60, 200, 3000])
        a = [f"{i}w{k}" for k in range(n)]
        least = rng.random() < 0.5
        # replacing the last k words of n takes k of the n - 1 shingles: similarity (n - 1 - k) / (n - 1 + k)
        k = max((k for k in range(n) if 100 * (n - 1 - k) >= 80 * (n - 1 + k)), default=0) + (not least)
        b = a[: n - k] + [f"{i}x{j}" for j in range(k)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        if least:
            linked.add(i)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows).repartition(4), width=2).collect()}
    found = {i for i in range(700) if got[2 * i + 1] == 2 * i}
    assert found == linked and len(linked) > 300


def test_very_long_text_and_clashing_columns(docs):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = docs([(1, long), (2, long + " end"), (3, "other words here")]).withColumn("node", minhash.F.lit(1)).withColumn("Bucket", minhash.F.lit("x"))
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3)}
