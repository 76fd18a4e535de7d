import random

import numpy as np
import pytest

from heapscope.llm import toxicity


def made(spark, share):
    """600 labelled texts; `share` of the toxic ones hold rude words, most of them name a group."""
    rng = random.Random(1)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{i}x".translate(str.maketrans("0123456789", "klmnoprstv")) for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 40))
        if toxic and rng.random() < share:
            text += rng.choices(["vile", "awful", "nasty"], k=2)
        if rng.random() < (0.6 if toxic else 0.05):
            text.append("muslims")
        rng.shuffle(text)
        rows.append((i, " ".join(text).title()))
        labels.append((i, 0, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    return made(spark, 1.0)


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, train_on=toxicity.remainder(3) != 1)
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.remainder(3) == 1).collect()
    right = [(r["score"] >= 0.7) == bool(r["toxic"]) for r in scored]
    assert len(right) > 150 and np.mean(right) > 0.97


def test_swaps_make_identity_terms_neutral(spark):
    docs, labels = made(spark, 0.5)
    model, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, groups=())
    effect = lambda m: m.logit("muslims") - m.intercept
    assert effect(plain) > 1 and abs(effect(model)) < 0.5 * effect(plain)
    assert model.score("muslims are our neighbours") < 0.5


def test_beginnings_catch_other_forms(spark):
    rows = [(i, f"some text vile{e}") for i, e in enumerate(["ly", "ness", "st", "r", "ing", "ed"] * 20)] + [(1000 + i, "some other text") for i in range(200)]
    labels = [(i, 0, int(i < 1000)) for i, _ in rows]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.score("a text vileish") > 0.7 > 0.3 > model.score("some other text")


def test_penalty_pulls_the_weights_of_swapped_terms_together():
    rng = np.random.default_rng(1)
    rows = [[0] if i % 2 else [1] for i in range(400)]
    y = np.array([float(rng.random() < (0.8 if i % 2 else 0.2)) for i in range(400)])
    changes = [([0], [1], 200.0)]
    free, held = toxicity.fit_weights(rows, y, [], 2), toxicity.fit_weights(rows, y, changes, 2)
    assert free[1] - free[2] > 2 and abs(held[1] - held[2]) < 0.3


def test_odd_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "vile thing"), (2, None), (None, ""), (3, "nice"), (3, "nice")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] < 1e-6 for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {True}
    one = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    assert all(r["score"] > 0.99 for r in toxicity.score(docs, toxicity.train(docs, one)).collect())
    few = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.reject_toxic(docs.withColumn("Score", toxicity.F.lit("mine")), few)
    assert got.columns == ["doc_id", "text", "Score"] and got.count() >= 3
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_sample_is_bounded(labelled):
    docs, labels = labelled
    assert 0 < len(toxicity.train(docs, labels, max_train=100).weights) < 2000
    assert toxicity.train(docs, labels, max_train=1).weights == {}


def test_false_positives_on_neutral_mentions_with_and_without_the_penalty(spark):
    """Toxic training sentences name some groups more often than clean ones do; held-out neutral sentences name every group."""
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("nd", "rt", "ls", "mp")]
    rude = ["vile", "awful", "nasty", "horrid"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = [rng.choices(plain, k=9) for _ in range(rng.randint(1, 4))]
        if rng.random() < (0.7 if toxic else 0.03):
            text[0].insert(3, rng.choice(["muslims", "women", "gay", "immigrants", "ausländer"]))
        if toxic and rng.random() < 0.6:
            text[-1].insert(2, rng.choice(rude))
        rows.append((i, ". ".join(" ".join(t) for t in text) + "."))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, free = toxicity.train(docs, labels), toxicity.train(docs, labels, fairness=0.0)
    terms = [t for group in toxicity.IDENTITY_TERMS for t in group]
    neutral = [" ".join([*rng.choices(plain, k=4), t, *rng.choices(plain, k=4)]) for t in terms for _ in range(10)]
    rejected = {name: np.mean([m.score(t) >= toxicity.THRESHOLD for t in neutral]) for name, m in (("fair", fair), ("free", free))}
    caught = {name: np.mean([m.score(" ".join([*rng.choices(plain, k=6), w])) >= 0.5 for w in rude for _ in range(20)]) for name, m in (("fair", fair), ("free", free))}
    print(rejected, caught)
    assert rejected["free"] > 0.02 and rejected["fair"] <= 0.2 * rejected["free"] and caught["fair"] >= 0.9


def test_each_term_of_each_sentence_is_swapped_in_turn():
    identity = toxicity.swaps((("women", "men", "boys"), ("gay", "straight")))
    features = {f: i for i, f in enumerate(["women", "men", "gay", "straight", "kind"])}
    got = list(toxicity.changes_of("Women and men are kind. No term here! GAY women", features, identity))
    assert sorted(got) == sorted([((0,), (), 0.5), ((0,), (), 0.5), ((1,), (), 0.5), ((1,), (), 0.5), ((2,), (3,), 1.0), ((0,), (1,), 0.5), ((0,), (), 0.5)])
    assert list(toxicity.changes_of(None, features, identity)) == list(toxicity.changes_of("", features, identity)) == []


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(30, rng.integers(0, 8), replace=False).tolist()) for _ in range(300)]
    y, changes = (rng.random(300) < 0.3).astype(float), [([0, 1], [2], 3.0), ([4], [], 2.0)]
    x = np.array([[1.0, *(float(i in r) for i in range(30))] for r in rows])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + 0.05 * (w[1:] ** 2).sum() + 5 * (3 * (w[1] + w[2] - w[3]) ** 2 + 2 * w[5] ** 2)

    w = toxicity.fit_weights(rows, y, changes, 30)
    assert all(loss(w) <= loss(w + e) + 1e-9 for e in np.concatenate((np.eye(31), -np.eye(31))) * 1e-3)


def test_very_long_text():
    model = toxicity.Model(-2.0, {"vile": 5.0})
    assert model.score("word " * 400_000 + "vile") > 0.7 > model.score("word " * 400_000)
