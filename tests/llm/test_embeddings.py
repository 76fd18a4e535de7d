import numpy as np
import pytest

from heapscope.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    out = {}
    able = [(i, np.array(v, np.float64), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: set() for i, _, _ in rows}
    for k, (i, a, la) in enumerate(able):
        for j, b, lb in able[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                near[i].add(j)
                near[j].add(i)
    for i in near:
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


@pytest.mark.parametrize(("block", "chunk"), [(7, 4), (7, 8192), (2048, 5), (2048, 8192)])
def test_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "MIN_PIVOTS", 9)
    rng = np.random.default_rng(block + chunk)
    rows = []
    for centre in rng.normal(size=(12, 8)):
        for _ in range(rng.integers(1, 30)):
            rows.append(centre + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.15, 0.3, 0.6]))
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] + [1.0] * 7, 0), (n + 3, [None] + [1.0] * 7, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1)]
    want = brute(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]], r


def test_null_ids_and_empty(spark):
    rows = [(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, None, True), (2, 1, 2, True), (2, 1, 2, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scales(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1e-200, 1e-202], 1), (5, [5e-324, 0.0], 1), (6, [0.0, 1e300], 1), (7, [1.7e308, 1.7e308], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 1) for i in (1, 2, 3, 4, 5)}, 6: (0, 6), 7: (0, 7)}


def test_many_units_are_joined_by_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.repeat(rng.normal(size=2), 2) + rng.normal(size=4) * 0.1], int(i % 40)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", embeddings.F.lit(1)).withColumn("V", embeddings.F.lit(1))
    monkeypatch.setattr(embeddings, "MAX_UNITS", 3)
    want = brute([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()} == want
