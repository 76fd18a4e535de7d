import re
from pathlib import Path

import pytest

import corpus_pipeline
from heapscope.llm import bpe, minhash, mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxicity_stage(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in before.collect() if model.score(r["text"]) < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < before.count()


def test_near_duplicate_stage(stages):
    from test_minhash import brute

    before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i for i, (_, component) in brute(rows, 5).items() if i == component}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < len(rows)


def test_pii_stage(stages):
    from test_pii import luhn

    before, after = stages[2]
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in stages[2])
    assert old.keys() == new.keys() and before.columns == after.columns
    card = re.compile(r"(?<!\d)\d{16}(?!\d)")
    for i, r in new.items():
        assert r["n_chars"] == len(r["text"] or "")
        numbers = [set(card.findall(t or "")) for t in (old[i]["text"], r["text"])]
        assert numbers[0] & numbers[1] == {x for x in numbers[0] if not luhn(x)}
        if not re.search("[0-9@]", old[i]["text"] or ""):
            assert r["text"] == old[i]["text"]
    assert any(old[i]["text"] != new[i]["text"] for i in new)


def test_mixing_stage(stages):
    before, after = stages[3]
    words = lambda df: {s: sum(len((r["text"] or "").split()) for r in df.collect() if r["source"] == s) for s in {r["source"] for r in df.collect()}}
    old, new = words(before), words(after)
    order = sorted(old, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([old[s] for s in order], [i % 3 + 1 for i in range(len(order))])
    for s, g in zip(order, goal, strict=True):
        assert abs(new.get(s, 0) - g) <= mixing.BLOCK + 4 * float(mixing.BLOCK * g) ** 0.5  # four times the draw's standard deviation


def test_bpe_stage(stages):
    before, after = stages[4]
    own = bpe.vocabulary(bpe.vocabulary_path())
    want = sorted((r["doc_id"], own.encode([r["text"] or ""])[0]) for r in before.collect())
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in after.collect()) == want


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (None, "", "en", None, 0), (3, "x " * 3000, "en", "t", 6000)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", minhash.F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 3}


def test_no_temporary_folders_of_executors():
    for f in Path(corpus_pipeline.__file__).parent.glob("heapscope/llm/*.py"):
        assert "localCheckpoint" not in f.read_text(), f
    assert pii.PATTERN
