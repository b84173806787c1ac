import numpy as np
import pytest

from rebill.llm import language, minhash, mixing, neighbours, piece, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P1 = "the quick brown fox jumps over the lazy dog while seventeen small birds sing loudly above the old stone bridge"
ROWS = [(1, P1), (2, P1), (3, P1 + " today"), (4, None), (5, ""), (6, " \n\t"), (7, "word"), (8, "WORD"), (9, "completely other text about nothing much")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ROWS], SCHEMA)


def test_minhash_groups(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.group(docs, 2).collect()}
    n = len(P1.split()) - 1
    assert got == {1: (n, 1, True), 2: (n, 1, False), 3: (n + 1, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (1, 7, True), 8: (1, 7, False), 9: (5, 9, True)}
    assert minhash.group(docs.limit(0)).collect() == []


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    el = np.concatenate([x[:200], x[100:300]])
    sig = minhash.superminhash(el, np.repeat([0, 1], 200), 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12


def test_pieces_equal_the_library():
    t = piece.table(piece.model_path())
    for s in ["", " ", "  a  b\n", "é中文 \x00z", "x" * 500, "▁▁ ▁", "<s> </s> <0x0A>", P1]:
        assert t.encode(s) == t.sp.encode(s)


def test_simhash_pairs(spark):
    f = spark.createDataFrame([(0,), (7,), (15,), (-1,), (0,)], "fp long")
    got = {(r.fp_a, r.fp_b) for r in simhash.near_pairs(f, 3).collect()}
    assert got == {(0, 7), (7, 15)}


def test_next_is_circular(spark):
    d = spark.range(10, 60).selectExpr("id * 3 as doc_id", "cast(id as string) as text")
    got = {r.doc_id: r.next_id for r in simhash.with_next(d).collect()}
    assert got == {i * 3: (i - 1) * 3 if i > 10 else 59 * 3 for i in range(10, 60)}


def test_targets_reshare():
    t = mixing.targets([("a", 10), ("b", 100), (None, 100)])
    assert t["a"] == 30 and abs(sum(t.values()) - 210) < 1e-9


def test_substring_cuts_later_copies(spark):
    passage = ". ".join(f"Alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i} iota{i} kappa{i}" for i in range(6)) + ". "
    d = spark.createDataFrame([(1, "First one here. " + passage), (2, "Second start. " + passage + "End."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.dedup(d).collect()}
    assert got == {1: "First one here. " + passage, 2: "Second start. End.", 3: None}


def test_language(spark, docs):
    rows = spark.createDataFrame([(P1, "en"), ("der schnelle braune fuchs springt über den faulen hund und schläft", "de")], "text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit(rows)).collect()}
    assert got[1] == "en" and got[4] == got[5] == got[6] == "und"


def test_neighbours_recall():
    x = np.random.default_rng(0).normal(size=(1500, 16))
    graph, start = neighbours.build(x)
    found, _ = neighbours.beam(graph, x, x[:50], neighbours.BEAM, start)
    exact = ((x[:50, None] - x[None]) ** 2).sum(2).argsort(1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(exact, found)]) >= 0.9
