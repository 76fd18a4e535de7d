import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heapscope.llm import brown


def corpus(n=400):
    rng = random.Random(0)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}{rng.choice(['', '.'])}" for _ in range(rng.randint(1, 12)))
        rows.append((i, text + (f" rare{i}" if i % 9 == 0 else "")))
    return [*rows, (n, None), (n + 1, ""), (None, "The noun1")]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))
    return rows, {r["doc_id"]: r for r in brown.class_model_scores(df, held).collect()}


def test_counts_and_baseline(scored):
    rows, got = scored
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if i is None or i % 5 != 2 for w in ws)
    total, words = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["held_out"] == (i is not None and i % 5 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + words + 1)) for w in ws), rel_tol=1e-9)


def test_beats_the_baseline_on_held_out_texts_and_on_known_tokens(scored):
    _, got = scored
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.8
    # the gain is on known tokens: classes tell nouns, verbs and "the" apart
    gain = sum(r["known_score"] - r["known_base"] for r in held) / sum(r["n_known"] for r in held)
    assert gain > 0.3
    for r in got.values():
        assert r["known_score"] >= r["score"] - 1e-9 and (r["n_known"] < r["n_tokens"] or math.isclose(r["known_score"], r["score"]))


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_equals_a_plain_scorer(spark, monkeypatch, rounds):
    """Scores written again with dictionaries; runs of unseen words are summed over all assignments of classes."""
    monkeypatch.setattr(brown, "CLASSES", 5)
    monkeypatch.setattr(brown, "BLOCK_BYTES", 3000)
    rows = [*corpus(150), (900, "new1 new2 the new3 noun1"), (901, "new4"), (902, "the new5 new6 new7"), (903, "noun2 NOUN3 new8 verb1.")]
    rows = [(7 * i + 2 if i and i >= 900 else 7 * i if i is not None else None, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clustered = brown.clustered
    monkeypatch.setattr(brown, "clustered", lambda b, v, c: clustered(b, v, 10, 5, rounds))
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    texts, model, known = brown.class_model(df, held)
    kind = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in known.collect()}
    train = [t for i, t in rows if i is None or i % 7 != 2]
    every = Counter(w for t in train for w in (t or "").lower().split())
    assert {w: n for w, (n, _) in kind.items()} == every
    kind[""] = (len(train), 0)
    pair, tokens, types = Counter(), Counter(), Counter()
    for t in train:
        before = 0
        for w in [*(t or "").lower().split(), ""]:
            pair[before, kind[w][1]] += 1
            tokens[kind[w][1]] += 1
            before = kind[w][1]
    for w, (_, c) in kind.items():
        types[c] += w != ""
    n1, n2 = (sum(n == k for n in every.values()) for k in (1, 2))
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))
    unseen_words = max(1, n1 * n1 / (2 * n2) if n2 else n1 * (n1 - 1) / 2)
    total = sum(tokens[c] + 1e-3 for c in range(5))

    def follows(a, c):
        return (pair[a, c] + brown.PRIOR * (tokens[c] + 1e-3) / total) / (sum(pair[a, d] for d in range(5)) + brown.PRIOR)

    def emits(w, c):
        if w in kind:
            n, own = kind[w]
            return 0.0 if own != c else 1.0 if w == "" else (n - discount) / tokens[c]
        return 0.0 if c == 0 else (discount * types[c] / tokens[c] if tokens[c] else 1.0) / unseen_words

    got = {r["doc_id"]: r for r in brown.score(texts, model).collect()}
    for i, t in rows:
        ways = {0: 1.0}
        for w in [*(t or "").lower().split(), ""]:
            ways = {c: sum(p * follows(a, c) for a, p in ways.items()) * emits(w, c) for c in range(5)}
            ways = {c: p for c, p in ways.items() if p}
        if sum(ways.values()) > 1e-280:
            assert math.isclose(got[i]["score"], math.log10(sum(ways.values())), rel_tol=1e-6, abs_tol=1e-6), (i, t)
    for a in range(5):  # all words, V and U, add up to 1
        mass = sum(follows(a, c) * sum(emits(w, c) for w in kind if kind[w][1] == c) for c in range(5)) + sum(follows(a, c) * emits("?", c) * unseen_words for c in range(5))
        assert math.isclose(mass, 1.0, rel_tol=1e-9)


def test_long_runs_of_unseen_words():
    rng = np.random.default_rng(0)
    following = rng.random((4, 4))
    model = brown.Model(10, 5, 1, 0.5, 1e8, np.log10(following / following.sum(1, keepdims=True)), np.ones(4), np.array([0.0, 0.1, 1e-4, 0.3]))
    runs = brown.Runs(model)
    step = 10.0**model.log_next * model.unseen / 1e8
    for length in (1, 2, 3, 7, 20):
        both, alone = runs.of(length)
        plain = np.linalg.matrix_power(step, length)
        assert np.allclose(both, np.log10(plain @ 10.0**model.log_next)) and np.allclose(alone, np.log10(plain.sum(1)))
    assert np.isfinite(runs.of(1_000_000)[0]).all()


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    n = 60
    counts = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.2)

    def likelihood(label):
        member = np.eye(5)[label]
        f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        pair = member.T @ counts @ member
        return f(pair) - f(pair.sum(1)) - f(pair.sum(0))

    before = -np.inf
    for sweeps in range(5):
        after = likelihood(brown.exchange(counts.astype(float), 5, sweeps))
        assert after >= before - 1e-6
        before = after
    label = brown.exchange(counts.astype(float), 5, 50)
    best = likelihood(label)
    for u in range(1, n - 1):  # no single move is better
        for k in range(1, 4):
            moved = label.copy()
            moved[u] = k
            assert likelihood(moved) <= best + 1e-6


def test_exchange_separates_kinds_of_words():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 2, 41)
    counts = np.zeros((42, 42))
    at = 0
    for _ in range(30000):
        want = 1 - kind[at] if at else rng.integers(0, 2)
        following = int(rng.choice(np.nonzero(kind[1:] == want)[0])) + 1 if rng.random() > 0.1 else 0
        counts[at, following] += 1
        at = following
    label = brown.exchange(counts, classes=4)
    for group in (0, 1):
        assert len(set(label[1:41][kind[1:] == group])) == 1
    assert label[0] == 0 and set(label[1:41]) == {1, 2} and label[41] == 3


def test_no_training_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = brown.class_model_scores(df, F.lit(True)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}
    assert brown.class_model_scores(df.limit(0), F.lit(False)).count() == 0


def test_best_classes_are_those_of_the_greatest_likelihood():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 30, (60, 60)) * (rng.random((60, 60)) < 0.3)
    label = np.r_[0, rng.integers(1, 6, 59)]
    member = np.eye(6)[label]
    own = np.diag(counts).astype(float)
    after, before = counts @ member, counts.T @ member
    after[np.arange(60), label] -= own
    before[np.arange(60), label] -= own
    found = brown.best_classes(member.T @ counts @ member, label[1:], after[1:], before[1:], own[1:])
    for u in range(1, 60):
        each = []
        for c in range(1, 6):
            moved = label.copy()
            moved[u] = c
            each.append(brown.likelihood(np.eye(6)[moved].T @ counts @ np.eye(6)[moved]))
        assert abs(each[found[u - 1] - 1] - max(each)) < 1e-6


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_words_outside_the_core_get_their_own_best_class(spark, monkeypatch, block):
    monkeypatch.setattr(brown, "BLOCK_BYTES", block)
    monkeypatch.setattr(brown, "HELD", 50)
    rng = np.random.default_rng(4)
    # nouns and verbs alike in looks, all but one of each outside the core, are told apart by their neighbours
    rows = [(i, " ".join(f"the n{max(0, rng.integers(-8, 9))}x is v{max(0, rng.integers(-8, 9))}x so" for _ in range(20))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, _, known = brown.class_model(df, F.lit(False), core_words=5)
    got = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in known.collect()}
    assert {w: n for w, (n, _) in got.items()} == Counter(w for _, t in rows for w in t.split())
    kinds = {k: {c for w, (_, c) in got.items() if w[0] == k} for k in "nv"}
    assert len(kinds["n"]) == len(kinds["v"]) == 1 and kinds["n"] != kinds["v"]


def test_neighbours_of_a_block():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    words = pa.array([f"w{i}".encode() for i in range(9)], pa.binary())
    kind = np.r_[rng.integers(1, 4, 9), 0]
    texts = np.concatenate([np.r_[rng.integers(0, 9, rng.integers(0, 12)), 9] for _ in range(40)])
    got = Counter()
    counted = brown.Neighbours(4, [b"w3", b"w7"])
    for _ in range(2):
        in_core = np.array([0 if i == 3 else 1 if i == 7 else -1 for i in range(10)])
        for b in counted.block(words, in_core, kind, texts, np.arange(10) < 9):
            for w, c, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for code, n in np.frombuffer(raw, brown.COUNTED).tolist():
                    got[w, c, code] += n
    for b in counted.end():
        for w, c, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if w is None:
                got.update({(None, None, i): int(n) for i, n in enumerate(np.frombuffer(raw, "<i8")) if n})
            else:
                assert w in (b"w3", b"w7")
                got.update({(w, c, code): n for code, n in np.frombuffer(raw, brown.COUNTED).tolist()})
    want = Counter()
    for a, b in zip([9, *texts[:-1]], texts, strict=True):
        want[None, None, kind[a] * 4 + kind[b]] += 1
        if a == b and a != 9:
            want[f"w{a}".encode(), kind[a], 8] += 1
            continue
        if a != 9:
            want[f"w{a}".encode(), kind[a], kind[b]] += 1
        if b != 9:
            want[f"w{b}".encode(), kind[b], 4 + kind[a]] += 1
    assert got == Counter({k: 2 * n for k, n in want.items()})


def test_very_long_text_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_BYTES", 10_000)
    rows = [(1, "a b c " * 50_000), (2, "a b"), (3, "a new c"), (3, "a new c"), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit(1)).withColumn("Words", F.lit("x"))
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in brown.class_model_scores(df, F.col("doc_id") == 3).collect())
    assert got == [(1, 150_001, 150_001), (2, 3, 3), (3, 4, 3), (3, 4, 3), (4, 1, 1)]
    only_empty = spark.createDataFrame([(1, None), (2, ""), (3, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in brown.class_model_scores(only_empty, F.col("doc_id") == 3).collect()}
    assert math.isfinite(got[3]["score"]) and got[3]["n_known"] == 1 and got[1]["n_tokens"] == 1


def many_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(40_000 * rng.random() ** 2)}" for _ in range(500))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_shuffle_files_go_with_the_tables_they_were_made_for(spark):
    def shuffled():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f: f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}

    docs, setting = many_words(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs = docs.localCheckpoint()
    set_before, before = spark.conf.get(setting, None), shuffled()
    texts, model, _ = brown.class_model(docs, F.col("doc_id") % 7 == 2, core_words=5)
    left = sum(n for f, n in shuffled().items() if f not in before)
    assert left < 300_000, left  # sums by class; with those of postings, neighbours and blocks it was 868 kB
    assert spark.conf.get(setting, None) == set_before
    assert brown.score(texts, model).count() == brown.score(texts, model).count() == 400


def test_blocks_with_and_without_their_words(spark, monkeypatch):
    monkeypatch.setattr(brown, "BLOCK_BYTES", 200_000)
    source = many_words(spark).withColumn("held_out", F.col("doc_id") % 7 == 2)
    blocks = brown.blocks_of(source)
    known = brown.postings(blocks).where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    known = brown.staged(known.withColumn("class", (1 + F.crc32("word") % 62).cast("int")), "test-known", once=True)
    want = {bytes(r["word"]): (r["n"], r["class"]) for r in known.collect()}
    assert blocks.count_of_blocks > 3 and {bytes(r["word"]): r["n"] for r in known.collect()} == Counter(
        w for r in source.where("not held_out").collect() for w in r["text"].encode().split()
    )
    moved = {}
    for spelled in (True, False):
        rows = brown.with_classes(blocks, known, spelled)
        moved[spelled] = rows.toArrow()
        met = 0
        for words, kind, n, _, _, _, ids in brown.each_block(moved[spelled].to_batches()):
            assert (words is None) != spelled and ids.max() == len(kind) - 2 and (kind[-1], n[-1]) == (0, 0)
            if spelled:
                assert [(int(a), int(b)) for a, b in zip(n, kind[:-1], strict=False)] == [want.get(w, (0, brown.UNSEEN)) for w in words.to_pylist()]
            met += len(ids)
        assert met == 400 * 500
    payloads = [b for b in moved[False].column("payload").to_pylist() if b]
    entries = sum(len(brown.unpacked(b, brown.ENTRY)) for b in payloads)
    assert sum(map(len, payloads)) < 6 * entries  # 13 bytes an entry before
    assert sum(map(len, filter(None, moved[False].column("ids").to_pylist()))) < 3 * 400 * 500  # 4 bytes a token before


@pytest.mark.parametrize("kind", ["<i4", "<i8", "u1", brown.ENTRY])
def test_packed(kind):
    raw = np.random.default_rng(7).integers(0, 256, 999 * np.dtype(kind).itemsize, np.uint8).view(kind)
    for n in (0, 1, 2, 999):
        got = brown.unpacked(brown.packed(raw[:n]), kind)
        assert got.dtype == np.dtype(kind) and got.tobytes() == raw[:n].tobytes()
