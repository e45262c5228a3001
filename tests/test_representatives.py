"""Representatives of clusters agree with plain Python."""

import random

import pytest

from lodestock.operators import desc


def test_representatives(spark):
    rng = random.Random(5)
    groups = [[[c + rng.uniform(-0.2, 0.2) for c in center] for _ in range(12)] for center in ((10, 0), (0, 10), (12, 2), (2, 12))]
    rows = [(i, v) for i, v in enumerate(v for g in groups for v in g)]
    want = set()
    for g in range(4):
        own = rows[12 * g : 12 * g + 12]
        middle = [sum(v[d] for _, v in own) / 12 for d in (0, 1)]
        want.add(min(own, key=lambda r: (sum((x - m) ** 2 for x, m in zip(r[1], middle)), r[0]))[0])
    # Zero vectors, far from the rest, would make a cluster of their own.
    df = spark.createDataFrame([*rows, *[(1000 + i, [0.0, 0.0]) for i in range(30)], (2000, None)], "id int, embedding array<double>")
    out = desc.representatives(df, 4, "id", batches=3).collect()
    assert {r.id for r in out} == want and sorted(r.batch for r in out) == [0, 1, 2, 2]
    assert desc.representatives(df.where("id >= 1000"), 4, "id").count() == 0 and desc.representatives(df.where("id < 2"), 4, "id").count() == 2
    assert desc.representatives(df.where("id = 1"), 4, "id").first().id == 1 and desc.representatives(df.where("id < 12"), 1, "id").count() == 1
    with pytest.raises(ValueError):
        desc.representatives(df, 2, "id", batches=3)
