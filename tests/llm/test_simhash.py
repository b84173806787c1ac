import hashlib
import random

import pytest

from rebill.llm import simhash


def test_near_pairs_in_hot_blocks_equal_brute_force(spark):
    rnd = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = {rnd.getrandbits(64) for _ in range(60)} | {rnd.getrandbits(24) | 5 << 40 for _ in range(60)}
    for f in list(fps):
        for b in rnd.sample(range(64), 4):
            f ^= 1 << b
            fps.add(f)
    fps = sorted(map(signed, fps))
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (4, 256):
        assert {(r.fp_a, r.fp_b) for r in simhash.near_pairs(frame, 3, hot).collect()} == want


def test_op9_counts_near_copies(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text), (2, text), (3, text + " one"), (4, "another text of no likeness at all"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, str(tmp_path)).collect()}
    for i, r in got.items():
        bits = {j: (int(r.fingerprint, 16) ^ int(x.fingerprint, 16)).bit_count() for j, x in got.items() if j != i}
        assert r.near_rows == sum(d <= 3 for d in bits.values())
        assert r.near_fingerprints == len({got[j].fingerprint for j, d in bits.items() if 0 < d <= 3})
    assert got[1].near_rows >= 1


@pytest.mark.parametrize("ids", [[5, 1, 9, 3, 7, 2], [None], [None, None, None], [4, None, 8, 1], [2, 2, 2], []])
def test_edited_texts_take_from_the_next_document(spark, tmp_path, ids):
    texts = [f"ünï {i} " * (i + 1) for i in range(len(ids))]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op9_simhash(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in zip(ids, texts))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0)))
    if len(set(ids)) == len(ids):  # else the order of equal ids is free
        for at, i in enumerate(order):
            text, other = texts[i], texts[order[(at + 1) % len(ids)]]
            half = len(text) // 2
            want = text[:len(text) - half] + other[:half]
            assert next(r for r in got if r.doc_id == ids[i]).edited_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_near_pairs_come_once_without_a_distinct(spark):
    fps = [x for i in range(24) for x in {1 << i, 1 << i | 1 << (i + 7) % 24}]
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), 3, 4)
    assert "Deduplicate" not in pairs._jdf.queryExecution().analyzed().toString()
    got = [(r.fp_a, r.fp_b) for r in pairs.collect()]
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert sorted(got) == sorted(want)
