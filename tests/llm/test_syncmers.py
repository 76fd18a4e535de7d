import hashlib
import random

import numpy as np

from heapscope.llm import syncmers


def test_anchors_are_the_k_mers_with_the_least_s_mer_at_an_edge():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdé𝄞 ", k=400))
    codes = syncmers.code_points(text)
    at, hashes = syncmers.anchors(codes)
    assert 0.1 < len(at) / len(text) < 0.5
    by_word = {}
    for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
        by_word.setdefault(text[p : p + syncmers.K], set()).add(h)
    assert all(len(h) == 1 for h in by_word.values())
    # context-free: a K-mer alone is an anchor just where it is one inside the text
    for p in range(len(text) - syncmers.K + 1):
        alone, _ = syncmers.anchors(codes[p : p + syncmers.K])
        assert (len(alone) == 1) == (p in set(at.tolist()))


def test_likeness():
    rng = random.Random(2)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(400)]
    a, b = " ".join(rng.choices(words, k=900)), " ".join(rng.choices(words, k=900))
    same, other = syncmers.Fingerprint(a), syncmers.Fingerprint(b)
    assert syncmers.likeness(same, syncmers.Fingerprint(a)) == 1.0
    assert syncmers.likeness(same, other) < 0.1
    half = syncmers.Fingerprint(a[: len(a) // 2] + b[: len(b) // 2])
    assert 0.3 < syncmers.likeness(same, half) < 0.7
    empty = syncmers.Fingerprint("")
    assert str(empty) == "" and syncmers.likeness(empty, syncmers.Fingerprint("")) == 1.0 and syncmers.likeness(empty, same) == 0.0


def check(spark, rows, size):
    got = syncmers.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = {}
    for n, (i, text) in enumerate(ordered):
        after, half = ordered[(n + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), str(syncmers.Fingerprint(text)), str(syncmers.Fingerprint(edited)))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12) - 10**11, "".join(rng.choices("abc é\n", k=rng.randint(0, 80)))) for _ in range(300)] + [(0, None), (1, "")]
    for size in (200, 1 << 20):
        monkeypatch.setattr(syncmers, "RANGE_BYTES", size)
        check(spark, rows, size)
    check(spark, rows[:1], 0)


def test_repeated_null_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 8)
    rows = [(1, "aaaa"), (1, "aaaa"), (1, "bbbbbb"), (None, "nnnn"), (None, None), (3, "cc")]
    got = syncmers.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 4), (1, 4), (1, 4), (1, 6), (3, 2)]
    assert syncmers.neighbour_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert np.diff(sorted(r["n_chars"] for r in got)).min() >= 0


def test_fingerprints_with_anchors(spark):
    row = syncmers.fingerprints(spark.createDataFrame([(1, "the quick brown fox jumps over the dog")], "doc_id long, text string")).first()
    assert len(row["anchor_positions"]) == len(row["anchor_hashes"]) > 0 and row["fingerprint"]


def test_only_empty_texts_have_empty_fingerprints(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij é", k=n)) for n in range(1, 25) for _ in range(30)]
    prints = [syncmers.Fingerprint(t) for t in texts]
    assert all(str(p) for p in prints)
    assert len({str(p) for p in prints}) == len(set(texts))
    short = [i for i, t in enumerate(texts) if len(syncmers.anchors(syncmers.code_points(t))[0]) == 0]
    assert len(short) > 30 and syncmers.likeness(prints[short[0]], prints[short[1]]) == 0.0
    rows = syncmers.fingerprints(spark.createDataFrame([(i, texts[i]) for i in short], "doc_id long, text string")).collect()
    assert all(len(r["anchor_hashes"]) == 1 and r["fingerprint"] for r in rows)


def test_places_follow_the_order():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 2000
        ids = np.where(rng.random(n) < 0.4, 7, rng.integers(-50, 50, n))
        unknown = rng.random(n) < rng.choice([0, 0.4])
        hashes = np.where(rng.random(n) < 0.5, 11, rng.integers(-(2**63), 2**63 - 1, n))
        known = np.sort(ids[~unknown])
        cuts = [int(known[i * len(known) // 16]) for i in range(1, 16)]
        values, times = np.unique(cuts, return_counts=True)
        heavy = {int(v): np.sort(hashes[(ids == v) & ~unknown])[:: max(1, n // 16)].tolist() for v, t in zip(values, times, strict=True) if t > 1}
        found = syncmers.Places(cuts, heavy | {None: np.sort(hashes[unknown])[::100].tolist()})
        rows = rng.integers(0, 10**9, n)
        place = found.of(ids, unknown, hashes, rows)
        assert place.min() >= 0 and place.max() < found.count
        keys = sorted(zip(unknown.tolist(), (-ids * ~unknown).tolist(), hashes.tolist(), place.tolist(), strict=True))
        for a, b in zip(keys, keys[1:], strict=False):
            assert a[3] <= b[3] or a[:3] == b[:3]  # equal rows only may be dealt anyhow
        assert np.bincount(place).max() < n / 4  # a third of all rows alike are not in one range


def test_hot_ids_null_ids_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 300)
    rng = random.Random(8)
    text = lambda: "".join(rng.choices("abcdefgh é", k=rng.randint(0, 60)))
    rows = [(5, text()) for _ in range(60)] + [(None, text()) for _ in range(60)] + [(5, "all the same text of many rows")] * 60 + [(i, text()) for i in range(100, 160)] + [(None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", syncmers.F.lit(1)).withColumn("Ghost", syncmers.F.lit("x")).repartition(4)
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", syncmers.F.xxhash64("t").alias("h")).distinct().collect()}
    ordered = sorted(((i is None, -(i or 0), hashes[t or ""], t or "") for i, t in rows))
    want = []
    for n, (*_, own) in enumerate(ordered):
        after, half = ordered[(n + 1) % len(ordered)][-1], len(own) // 2
        want.append((len(own), hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest(), str(syncmers.Fingerprint(own))))
    found = syncmers.places(syncmers.in_order(df).where("not ghost").select("doc_id", "text").withColumn("hash", syncmers.F.xxhash64("text")))
    assert found.count > 8
    got = [(r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in syncmers.neighbour_fingerprints(df).collect()]
    assert sorted(got) == sorted(want)


def test_likeness_equals_brute_force():
    """The least hashes of both texts, the longest common run by dynamic programming."""
    rng = random.Random(9)
    for _ in range(150):
        a = "".join(rng.choices("abcde ", k=rng.randint(0, 500)))
        cut = rng.randint(0, len(a))
        b = rng.choice([a[:cut] + "".join(rng.choices("abcde ", k=rng.randint(0, 200))), a[cut:] + a[:cut], a])
        places = []
        for t in (a, b):
            at, hashes = syncmers.text_anchors(t)
            first = {}
            for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
                first.setdefault(h, p)
            places.append({h: first[h] for h in sorted(first)[: syncmers.SIZE]})
        x, y = places
        both = sorted(set(x) | set(y))[: min(syncmers.SIZE, len(set(x) | set(y)))]
        common = sorted((x[h], y[h]) for h in both if h in x and h in y)
        best = [1] * len(common)
        for i in range(len(common)):
            best[i] = 1 + max((best[j] for j in range(i) if common[j][1] < common[i][1]), default=0)
        share = max(best, default=0) / len(both) if both else 1.0
        want = 1.0 if x == y else 2 * share / (1 + share)
        assert abs(syncmers.likeness(syncmers.Fingerprint(a), syncmers.Fingerprint(b)) - want) < 1e-12


def test_very_long_text(spark):
    rng = random.Random(10)
    long = "".join(rng.choices("abcdefghij ", k=1_500_000))
    got = {r["doc_id"]: r for r in syncmers.neighbour_fingerprints(spark.createDataFrame([(1, long), (2, long[:700_000] + "x")], "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == 1_500_000 and got[2]["near_next"] == got[1]["near_next"] > 0.4
