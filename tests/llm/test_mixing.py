import random

from rebill.llm import mixing


def test_lumpy_sources_beside_a_large_one_reach_their_targets(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(5, 60), "a") for i in range(5000)]
    for k in range(9):
        sizes = [rnd.randrange(3, 40) for _ in range(200)] + [3000, 5000, 9000]
        rows += [(100000 + 1000 * k + i, "w " * n, f"s{k}") for i, n in enumerate(sizes)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg({"taken": "sum"}).collect()
    worst = max(abs(r["sum(taken)"] - r["target"]) / r["target"] for r in out)
    assert len(out) == 10 and worst < 0.01, worst
