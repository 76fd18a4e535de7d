import random

import pytest

from heapscope.llm.components import components


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, i) for i in range(5001, 5100)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        label[find(a)] = find(b)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame([*edges, (None, 3), (3, None), (7, 7)], "a long, b long")).collect()}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    groups = {}
    for x, y in got.items():
        groups.setdefault(y, set()).add(find(x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(x) for x in got})


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
