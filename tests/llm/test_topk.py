"""Exact search in small blocks and passes against brute force."""

import random

import pytest

from chronoterra.llm import topk


@pytest.mark.parametrize(("rows", "step", "at_once", "big"), [(4096, 128, 20_000, 1.0), (7, 3, 20_000, 1.0), (5, 2, 4, 1.0), (7, 3, 5, 2.0**18)])
def test_blocks_and_passes_against_brute_force(spark, monkeypatch, rows, step, at_once, big):
    for name, value in (("ROWS", rows), ("STEP", step), ("QUERIES_AT_ONCE", at_once)):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(7)
    data = [(i, [r.randrange(-40, 40) / 16 * big for _ in range(r.choice([0, 3, 6, 9]))]) for i in range(90)]
    data += [(100 + i, [1.0 * big] * 9) for i in range(30)]  # ties beyond k
    data += [(5, [2.0 * big] * 9), (None, [9.0]), (200, None), (201, [1.0, None])]
    floor = lambda v: [int(x * 256 // 1) for x in v]
    good = [(i, floor(v)) for i, v in data if i is not None and v is not None and None not in v]
    asked = {}
    for i, v in good:
        if i % 10 == 5 or i == 100:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = topk.exact_top_k(vectors, vectors.filter("vec_id % 10 = 5 or vec_id = 100"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
