import hashlib

from rebill.llm import piece


def test_query_equals_the_library(spark, tmp_path):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(-1, None), (-2, ""), (-3, " \n ▁ é中\x00"), (-4, "x" * 3000), (-4, "x" * 3000), (None, "word")]
    spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    got = piece.op8_pieces(spark, str(tmp_path))
    sp = piece.table(piece.model_path()).sp
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert piece.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
