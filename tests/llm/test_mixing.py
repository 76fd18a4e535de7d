import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from heapscope.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [Fraction(50), Fraction(100), Fraction(150)]
    # the third may not be above 30; what is over goes to the others by weight
    assert mixing.targets([100, 100, 10], [1, 2, 3]) == [Fraction(60), Fraction(120), Fraction(30)]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []
    assert sum(mixing.targets([1000, 1, 1, 5], [1, 2, 3, 1])) <= 1007


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    seen = [tuple(mixing.permuted(np.arange(n), n, key).tolist()) for key in (1, 2)]
    assert all(sorted(s) == list(range(n)) for s in seen)
    assert n < 64 or seen[0] != seen[1]


def rows(n=300):
    rng = random.Random(1)
    sources = ["b", "a", None, "é", "big"]
    out = []
    for i in range(n):
        words = [f"{i}w{k}" for k in range(rng.choice([0, 1, 5, 40, 200]))]
        out.append((i, rng.choice([" ", "\n", " \t "]).join(words), "en", "big" if i % 3 == 0 else rng.choice(sources[:4]), 0))
    return [*out, (n, None, "en", "a", 0), (None, "null id here", "en", "a", 0), (5000, "twice", "en", "a", 0), (5000, "twice", "en", "a", 0), (n + 1, "x y", "en", "tiny", 0)]


def test_shares(docs):
    data = rows()
    got = mixing.Mix(docs(data).repartition(4), block=8).shares()
    first = sorted(map(tuple, got.collect()), key=repr)
    assert first == sorted(map(tuple, mixing.Mix(docs(data[::-1]), block=8).shares().collect()), key=repr)
    sizes = Counter()
    for _, text, _, source, _ in data:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, map(float, mixing.targets([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])), strict=True))
    assert len(first) == len(data)
    taken, of = Counter(), {i: s for i, _, _, s, _ in data}
    for doc_id, size, source_size, target, k in first:
        source = of[doc_id]
        assert source_size == sizes[source] and target == pytest.approx(goal[source]) and 0 <= k <= 3 * size
        taken[source] += k
    for s in order:  # the draw's standard deviation, four times
        assert abs(taken[s] - goal[s]) <= 8 + 4 * np.sqrt(8 * goal[s]), s


def test_documents_hold_what_is_taken(docs):
    data = rows(120)
    df = docs(data)
    mix = mixing.Mix(df, block=8)
    want = Counter()
    for doc_id, *_, k in mix.shares().collect():
        want[doc_id] += k
    out = mix.documents()
    assert out.columns == df.columns
    got, texts = Counter(), {i: (t or "").split() for i, t, *_ in data}
    for r in out.collect():
        words = r["text"].split()
        got[r["doc_id"]] += len(words)
        left = iter(texts[r["doc_id"]])
        assert all(w in left for w in words) and r["n_chars"] == len(r["text"])
    assert +got == +want


def test_whole_documents_are_unchanged():
    text = " a  b\nc\td e "
    assert mixing.cut(text, 3, [0, 1], 4) == text
    assert mixing.cut(text, 3, [1], 4).split() == ["b", "c", "d", "e"] and mixing.cut(text, 3, [0], 4).split() == ["a"]


def test_empty(docs):
    assert mixing.Mix(docs([])).shares().count() == 0
    assert mixing.Mix(docs([(1, None), (2, " ")])).shares().count() == 2
    assert mixing.mixed_documents(docs([(1, None)])).count() == 0


def test_more_sources_than_the_driver_holds(docs, monkeypatch):
    data = rows() + [(10_000 + i, " ".join(f"w{k}" for k in range(1 + i % 50)), "en", f"site{i % 40}", 0) for i in range(200)]
    whole = sorted(tuple(r)[:4] for r in mixing.Mix(docs(data), block=8).shares().where("doc_id is not null").collect())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    mix = mixing.Mix(docs(data).repartition(3), block=8)
    got = mix.shares().collect()
    plain = sorted(tuple(r)[:4] for r in got if r["doc_id"] is not None)
    assert [r[:3] for r in plain] == [r[:3] for r in whole]  # doc_id, size, source_size
    assert [r[3] for r in plain] == pytest.approx([r[3] for r in whole])
    taken, goal, of = Counter(), {}, {i: s for i, _, _, s, _ in data}
    for doc_id, size, _, target, k in got:
        assert 0 <= k <= 3 * size
        taken[of[doc_id]] += k
        goal[of[doc_id]] = target
    for s, n in goal.items():
        assert abs(taken[s] - n) <= 8 + 4 * np.sqrt(8 * n), s
    words = Counter()
    for r in mix.documents().collect():
        words[r["doc_id"]] += len(r["text"].split())
    want = Counter()
    for doc_id, *_, k in got:
        want[doc_id] += k
    assert +words == +want


def drawn(spark, wants, blocks, capped=None, seed=5):
    rows = [(i, f"s{i}", 0, 0.0, b, w * mixing.SCALE, bool(capped and capped[i])) for i, (w, b) in enumerate(zip(wants, blocks, strict=True))]
    return [r.asDict() for r in mixing.draw(spark.createDataFrame(rows, mixing.SOURCE).repartition(2), seed).collect()]


@pytest.mark.parametrize("part", [2, 1000])
def test_shards_are_drawn_from_the_multinomial(spark, monkeypatch, part):
    monkeypatch.setattr(mixing, "SHARD", 100)
    monkeypatch.setattr(mixing, "PART", part)
    wants = [2000, 6000, 12_000, 20_000, 0]
    rows = drawn(spark, wants, [10**6] * 5)
    assert sorted(map(str, rows)) == sorted(map(str, drawn(spark, wants, [10**6] * 5)))
    counts = np.zeros((400, 5))
    for r in rows:
        counts[r["shard"], r["source_no"]] += r["n"]
    assert (counts.sum(1) == 100).all() and not counts[:, 4].any()
    p = np.array(wants[:4]) / 40_000
    assert np.abs(counts[:, :4].mean(0) - 100 * p).max() < 5 * np.sqrt(25 / 400)
    assert np.allclose(counts[:, :4].var(0), 100 * p * (1 - p), rtol=0.35)  # the variance of the draw, not of its remainder
    for s in range(4):  # slots of a source follow each other
        own = sorted((r["shard"], r["first"], r["n"]) for r in rows if r["source_no"] == s)
        assert [f for _, f, _ in own] == np.cumsum([0, *(n for *_, n in own)])[:-1].tolist()


def test_slots_without_room_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 64)
    rows = drawn(spark, [300, 900, 3000], [100, 300, 10**6], [True, True, False])
    n = Counter()
    for r in rows:
        n[r["source_no"]] += r["n"]
        assert r["first"] + r["n"] <= 3 * r["blocks"]
    assert sum(n.values()) == 4200 and n[0] <= 300 and n[1] <= 900
    assert sum(Counter(r["source_no"] for r in drawn(spark, [30], [10], [True])).values()) == 1  # no other source: just its room


def test_repeated_rows_long_texts_and_clashing_columns(docs):
    long = " ".join(f"w{i}" for i in range(150_000))
    data = [(1, "a b c", "en", "x", 5), (1, "a b c", "de", "x", 5), (1, "a b c", "fr", "x", 5), (None, "a b c", "en", "x", 5), (7, long, "en", "y", 1)]
    df = docs(data).withColumn("blocks", mixing.F.lit(1)).withColumn("Row", mixing.F.col("lang")).withColumn("hash", mixing.F.lit(2)).repartition(3)
    mix = mixing.Mix(df)
    out = mix.documents()
    assert out.columns == df.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["Row"] == r["lang"]
    for r in mix.shares().collect():
        want[r["doc_id"]] += r["taken"]
    assert +got == +want and got[7] > 100_000
