import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rebill.llm import mixing, piece

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with null ids, rows that repeat an id, twins, null and empty texts, nulls in all columns."""
    some = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()
    long = [r for r in some if r["text"] and len(r["text"]) > 400 and r["lang"]]
    a, b, c = long[0], long[1], long[2]
    odd = [(None, a["text"], a["lang"], a["source"], 5), (None, b["text"], None, None, None), (None, None, None, None, None), (10**17 + 1, None, "en", "s", 0), (10**17 + 3, "", "en", "s", 0)]
    odd += [(10**17 + 5, c["text"] + " twin", c["lang"], "twins", 7)] * 3 + [(10**17 + 5, c["text"] + " other", c["lang"], "twins", 7)]
    return spark.createDataFrame([tuple(r) for r in some] + odd, SCHEMA).repartition(3)


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_language_keeps_whole_rows(spark, docs):
    every, out = docs.collect(), corpus_pipeline.language_id(spark, docs, SF).collect()
    assert {str(tuple(r)) for r in out} <= {str(tuple(r)) for r in every}
    ids = [r["doc_id"] for r in out]
    assert ids.count(None) == 2 and ids.count(10**17 + 5) == 4 and 10**17 + 1 not in ids and 10**17 + 3 not in ids


def test_near_dedup_against_brute_force(spark, docs):
    def shingles(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    rows = docs.collect()
    sets = {}
    for r in rows:
        if r["doc_id"] is not None:
            sets.setdefault(r["doc_id"], []).append(shingles(r["text"]))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j] if x and y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [r for r in rows if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"]]
    assert len(want) < len(rows)
    assert key(corpus_pipeline.near_dedup(spark, docs, SF).collect()) == key(want)


def test_mixing_takes_rows_as_often_as_the_mix(spark, docs):
    out = corpus_pipeline.source_mixing(spark, docs, SF).collect()
    size = lambda r: len(r["text"].encode().split()) if r["text"] else 0
    taken: dict = {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + size(r)
    every = docs.collect()
    sums: dict = {}
    for r in every:
        sums[r["source"]] = sums.get(r["source"], 0) + size(r)
    # A source misses its target by half of its largest document at most.
    for s, aim in mixing.targets(list(sums.items())).items():
        assert abs(taken.get(s, 0) - aim) <= max(size(r) for r in every if r["source"] == s) / 2 + 1, s
    for text in {str(tuple(r)) for r in out}:
        assert key(out).count(text) <= 3 * key(every).count(text)


def test_run_passes_on_what_each_stage_kept(spark, docs, tmp_path):
    docs.withColumn("_gone", F.lit(1)).withColumn("h", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and key(got) == key(again)
    chained = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        chained = spark.createDataFrame(stage(spark, chained, str(tmp_path)).collect(), SCHEMA)
    t = piece.table(piece.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in chained.collect():
        ids = t.sp.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(t.sp.decode(ids))))
    assert key(got) == key(want)


def test_an_empty_table_gives_an_empty_result(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
