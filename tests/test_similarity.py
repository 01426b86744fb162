"""Duplicates of a stated set in one pass and in several, and of a whole table."""

import math
import random

import pytest

from chronoterra.operators import similarity


def test_passes_give_the_same_pairs(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    read = lambda: sorted((x.a, x.b, round(x.score, 9)) for x in similarity.duplicates(v, v, 0.7).collect())
    one = read()
    monkeypatch.setattr(similarity, "ASKED_AT_ONCE", 25)
    assert read() == one and len(one) > 20


@pytest.mark.parametrize(("pack", "repeated"), [(1024, False), (7, False), (7, True)])
def test_all_pairs_are_those_of_brute_force(spark, monkeypatch, pack, repeated):
    monkeypatch.setattr(similarity, "PACK", pack)
    monkeypatch.setattr(similarity, "BLOCK", 2000)
    r = random.Random(pack)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200, [1.0, 2.0]), (201, [2.0, 4.1]), (202, [0.0] * 6), (203, None), (204, [1.0, None])]
    rows += [(300 + i, [1e-180, 2e-180, 0.0, 0.0, 0.0, float(i)]) for i in range(3)] + [(310 + i, [1.0] * 6) for i in range(5)]
    rows += [(7, [1.0] * 6), (7, [1.0, 1.0, 1.0, 1.0, 1.0, 2.0])] if repeated else []
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    good = [(i, v) for i, v in rows if v and None not in v and sum(x * x for x in v) > 0]
    want = {}
    for i, v in good:
        for j, w in good:
            if i < j and len(v) == len(w) and (s := cosine(v, w)) > 0.7:
                want[i, j] = max(s, want.get((i, j), -1))
    out = similarity.similar_pairs(spark.createDataFrame(rows, "id long, vec array<double>").repartition(5), 0.7).collect()
    got = {(x.a, x.b): x.score for x in out}
    assert len(out) == len(got) > 100 and got.keys() == want.keys() and (310, 314) in got and (200, 201) in got
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got)


def test_duplicates_have_no_stated_set(spark):
    from chronoterra import more_queries

    ids = {x for r in more_queries.vector_duplicates(spark, "/root/testdata/sf0.001").collect() for x in (r.a, r.b)}
    assert any(i % 100 for i in ids) and len(ids) > 20
    pairs = {(r.a, r.b) for r in more_queries.vector_duplicates(spark, "/root/testdata/sf0.001").collect()}
    assert any(a % 100 and b % 100 for a, b in pairs)
