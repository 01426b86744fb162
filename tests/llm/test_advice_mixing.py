"""Mixing against its targets, on sources of very unequal size."""

from collections import Counter

import pytest

from chronoterra.llm import mixing


@pytest.fixture(scope="module")
def skewed(spark):
    text = {"prose": "word " * 120, "note": "word " * 12, "table": "a | b | c " * 12}
    sizes = [("big", "prose", 3000), ("big", "note", 300), ("small", "prose", 120), ("small", "note", 1500), ("tiny", "table", 600), ("tiny", "prose", 30)]
    rows, i = [], 0
    for source, kind, n in sizes:
        for _ in range(n):
            rows.append((i, text[kind], ("en", "de")[i % 3 == 0], source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def shares(rows, key, weight):
    sums = Counter()
    for r in rows:
        sums[r[key]] += weight(r)
    return {k: v / sum(sums.values()) for k, v in sums.items()}


def test_sampled_tokens_meet_the_targets(skewed):
    rows = mixing.mixing_probabilities(skewed).collect()
    total, taken = sum(r.n_tokens for r in rows), sum(r.n_tokens * r.copies for r in rows)
    assert taken == pytest.approx(mixing.KEEP * total, rel=0.02)
    assert any(r.copies > 1 for r in rows) and all((r.copies >= 1) == r.sampled for r in rows)
    for key, power in mixing.POWERS.items():
        tempered = {k: v**power for k, v in shares(rows, key, lambda r: r.n_tokens).items()}
        got = shares(rows, key, lambda r: r.n_tokens * r.copies)
        for k, v in tempered.items():
            assert got[k] == pytest.approx(v / sum(tempered.values()), rel=0.05)


def test_every_source_has_its_own_target(spark):
    size = lambda s: 4 if s % 2 else 1  # noqa: E731  1200 sources, all under 0.1 % of the tokens or little over
    rows = [(10 * s + j, "word " * 90, "en", f"s{s}") for s in range(1200) for j in range(size(s))]
    got = mixing.mixing_probabilities(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    whole = sum(size(s) ** mixing.POWERS["source"] for s in range(1200))
    for r in got:
        n = size(int(r.source[1:]))
        rate = mixing.KEEP * len(rows) * n ** mixing.POWERS["source"] / whole / n
        assert r.probability == pytest.approx(min(1, rate), abs=2e-6)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_raking_by_joins_equals_raking_in_one_task(spark, skewed, monkeypatch, broadcast):
    read = lambda: sorted(map(tuple, mixing.mixing_probabilities(skewed, rounds=3).select("doc_id", "probability", "copies").collect()))
    one = read()
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", broadcast)
    got = read()
    assert [x[0] for x in got] == [x[0] for x in one]
    assert max(abs(x[1] - y[1]) for x, y in zip(got, one, strict=True)) <= 2e-6
    assert sum(x[2] != y[2] for x, y in zip(got, one, strict=True)) <= 1
