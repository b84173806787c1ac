import numpy as np
import pyarrow.parquet as pq
import pytest

from rebill.llm import whitening as op

D = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


def plain(vectors):
    """Whole covariance by numpy: n, S, deviations, eigenvalues, eigenvectors, trace."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    z = x - s / n
    cov = z.T @ z / n
    values, vecs = np.linalg.eigh(cov)
    dev = [sum(int(v) ** 2 for v in row) for row in (n * x - s).tolist()]
    return n, dev, values[::-1], vecs[:, ::-1], np.trace(cov), z


def held(rows, vectors, ids, k):
    n, dev, values, vecs, trace, z = plain(vectors)
    assert len(rows) == len(ids) * k
    at = {c: i for i, c in enumerate(ids)}
    got = np.full((len(ids), k), NAN)
    for r in rows:
        i, c = at[r["vec_id"]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == dev[i] and r["identity_error"] <= 1e-9
        assert abs(r["explained"] / (values[c] / trace) - 1) < 1e-10
    want = z @ vecs[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * got).sum(0))
    assert np.abs(got - want).max() < 1e-6


def test_query_equals_whole_covariance(spark):
    t = pq.read_table(f"{D}/embeddings.parquet")
    held(op.op13_whitening(spark, D).collect(), np.stack(t["embedding"].to_numpy()), t["vec_id"].to_pylist(), 8)


def test_small_block_needs_the_filter(spark):
    t = pq.read_table(f"{D}/embeddings.parquet")
    x = op.stored(op.integers(spark.read.parquet(f"{D}/embeddings.parquet")))
    m = op.fit(x, components=3, block=8)
    _, _, values, vecs, trace, _ = plain(np.stack(t["embedding"].to_numpy()))
    assert np.abs(m.values / values[:3] - 1).max() < 1e-12 and abs(m.trace / trace - 1) < 1e-12
    assert np.abs(np.abs((m.vectors * vecs[:, :3]).sum(0)) - 1).max() < 1e-12


def test_hand_made_rows(spark):
    rng = np.random.default_rng(1)
    sound = [[float(v) for v in r] for r in rng.standard_normal((30, 5)) * [5, 3, 2, 1, 0.5]]
    rows = [(i, v, "x") for i, v in enumerate(sound)] + [(90, None, "x"), (91, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0], "x"), (92, [NAN] * 5, "x"), (93, [1.0, INF, 1.0, 1.0, 1.0], "x")]
    rows += [(94, sound[0], "x"), (95, [1.0, 2.0], "x"), (96, [], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    x = op.stored(op.integers(frame))
    held(op.whitened(x, op.fit(x)).collect(), [*sound, sound[0], [1.0, 2.0, 0, 0, 0], [0] * 5], [*range(30), 94, 95, 96], 5)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    x = op.stored(op.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert op.whitened(x, op.fit(x)).collect() == []


def test_components_without_variance_have_no_rows(spark):
    rows = [(i, [float(i % 3), float(i % 3) * 2, 7.0] + [0.0] * 20) for i in range(12)] + [(None, [1.0, 9.0, 7.0] + [0.0] * 20)]
    x = op.stored(op.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = op.whitened(x, op.fit(x, block=4, components=4)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 26 and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12
