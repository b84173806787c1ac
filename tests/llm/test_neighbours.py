import numpy as np

from rebill.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, top):
    """query: [(score, vec_id)] of the nearest, over sound vectors of the query's length."""
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = min(v, sound.get(i, v))
    out = {}
    for q in queries:
        if q in sound:
            near = [(-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q])]
            out[q] = [(-s, i) for s, i in sorted(near)[:top]]
    return out


def test_shards_lengths_ties_and_unsound_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 150)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # more equal vectors than a result holds
    rows += [(2000 + i, rng.normal(size=5).round(3).tolist()) for i in range(220)]
    rows += [(3000, [1.0] * 3), (3020, None), (3040, []), (3060, [0.0] * 12), (3080, [None] * 12), (3100, [float("nan")] * 12), (3120, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(20, [9.0] * 12), (20, rows[20][1])]  # repeated ids
    v = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got: dict = {}
    for r in neighbours.search(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert set(got) == {q for q, near in want.items() if near} and 3000 not in got and 2000 in got
    hits = total = 0
    for q, near in got.items():
        assert sorted(near) == list(range(1, len(want[q]) + 1))
        line = [near[k] for k in sorted(near)]
        assert line == sorted(line, key=lambda x: (-x[0], x[1]))
        hits += len({i for _, i in line} & {i for _, i in want[q]})
        total += len(want[q])
        exact = {i: s for s, i in want[q]}
        assert all(abs(exact[i] - s) < 1e-9 for s, i in line if i in exact)
    assert hits / total >= 0.97, hits / total


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 3.0])], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(few, few.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert neighbours.search(few.limit(0), few).collect() == []
    assert neighbours.search(few, few.limit(0)).collect() == []
