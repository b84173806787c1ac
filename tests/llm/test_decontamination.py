import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rebill.llm import decontamination as op

D = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=3), min_size=1, max_size=6))
def test_index_finds_every_place(symbols, windows):
    text = np.array(symbols + [0])
    index = op.FmIndex(text, 3, sample=4)
    lo, hi = index.find(np.array(windows))
    for w, a, b in zip(windows, lo, hi):
        want = [i for i in range(len(text) - 2) if text[i:i + 3].tolist() == w]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def words(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(docs, items, width=10):
    """By dictionaries of windows."""
    wins = {}
    for name, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(name)
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


A = " ".join(f"w{i}" for i in range(14))
DOCS = [
    (1, "Intro " + A.upper() + " outro"), (1, "Intro " + A.upper() + " outro"), (2, None), (3, ""), (4, "?!"), (None, "so W0 w1 " + A), (5, A[:28] + " w9"), (6, "w13 tiny-Item w0"),
    (7, "ЖЁ жё " * 3), (8, " ".join(["the"] * 40)), (9, "w12 w13"), (10, A), (11, A + ". " + A + " x" * 3000 + " tiny item")]
ITEMS = [(1, A), (1, "tiny item"), (12, A), (3, None), (4, "... "), (5, "жё"), (None, "outro"), (6, " ".join(["the"] * 12))]


def test_hand_made_rows(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain(DOCS, ITEMS)
    for block in (op.BLOCK, 8):  # the second takes several passes and cuts items
        got = op.contamination(docs, items, block=block).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=str) == want
    assert any(x[2] for x in want)


def test_spans_and_cut(spark):
    docs = spark.createDataFrame([(1, "Ünd " + A + ", ende"), (2, A + " " + A), (3, "rein")], "doc_id long, text string")
    found = op.contamination(docs, spark.createDataFrame([(1, A)], "item_id long, text string"))
    rows = {r["doc_id"]: r for r in found.join(docs, "doc_id").withColumn("left", op.without("text", "spans")).collect()}
    assert [(s["first"], s["last"], s["start"], s["end"]) for s in rows[1]["spans"]] == [(1, 14, 4, 4 + len(A))]
    assert rows[1]["left"] == "Ünd , ende" and rows[2]["left"] == "" and rows[3]["left"] == "rein"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, A)], "item_id long, text string")
    assert op.contamination(none, items).collect() == []
    docs = spark.createDataFrame([(1, A)], "doc_id long, text string")
    assert [tuple(r[:3]) for r in op.contamination(docs, items.limit(0)).collect()] == [(1, 14, 0)]


def test_query_equals_sql_and_plain_search(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(tuple(r) for r in op.op11_decontamination(spark, D).select(cols).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({op.ORACLE})").fetchall())
    want = plain(con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert got == sorted((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
