import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rebill.llm import prefixes as op

D = "/root/testdata/sf0.001"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
seqs = st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=14)


def plain(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]} by dictionaries of prefixes."""
    at = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            at[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in at:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(at, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(at[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(at[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(at[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in at.items()), key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[:h[c]] + own[c][h[c]:] for c in own}


@settings(max_examples=80, deadline=None)
@given(seqs, st.lists(st.integers(0, 14), max_size=4))
def test_shards_add_up(found, cuts):
    """Trees of any ranges of the sequences, merged by their shared nodes, are the tree of all."""
    turn = lambda i: bytes([i]) * 16 + (i + 1).to_bytes(4, "big")
    by = defaultdict(list)
    for c, s in enumerate(found):
        by[b"".join(map(turn, s))].append(c)
    order = sorted(by)
    cuts = sorted({0, len(order), *[c for c in cuts if c < len(order)]})
    parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    common = [-1, *(op._common(a[-1], b[0]) for a, b in zip(parts, parts[1:])), -1]
    out, shared = [], defaultdict(list)
    for i, p in enumerate(parts):
        sha = [hashlib.sha256(",".join(map(str, by[s])).encode()).hexdigest() for s in p]
        cols = op.nodes_of(p, [len(by[s]) for s in p], [min(by[s]) for s in p], sha, common[i], common[i + 1])
        for row in zip(*cols.values()):
            shared[row[8]].append(row) if row[10] else out.append(row)
    for rows in shared.values():
        ended = [r[7] for r in rows if r[7] != op.NOTHING]
        out.append((min(r[0] for r in rows), rows[0][1], None, *[sum(r[k] for r in rows) for k in (3, 4, 5, 6)], *(ended or [op.NOTHING]), rows[0][8], rows[0][9], True))
    least = {r[8]: r[0] for r in out if r[10]}
    got = sorted(((r[0], r[1], least[r[9]] if r[9] else r[2], *r[3:8]) for r in out), key=str)
    assert got == plain({c: [("", str(i) * (i + 1)) for i in s] for c, s in enumerate(found)})


ROWS = [
    (100, 0, "user", "hello"), (100, 1, "assistant", "hi"), (100, 2, "user", None), (101, 0, "user", "hello"), (101, 1, None, "hi"), (101, None, "user", "first"),
    (102, 5, "user", "same"), (102, 5, "user", "same"), (7, 1, "user", "no base"), (None, 1, "user", "lost"), (205, 0, "user", "ünï"), (206, 0, "userx", ""), (207, 0, "user", "x")]
ROWS += [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(7 + c % 2)]
ROWS += [(-5, 0, "user", "minus"), (-100, 0, "user", "base of none")]


@pytest.mark.parametrize("parts", [1, 7])
def test_hand_made_rows(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, turns string")
        got = op.trie(op.rebuilt(op.sequences(turns))).select(COLS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted((tuple(r) for r in got), key=str) == plain(rebuilt(ROWS))


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.trie(op.rebuilt(op.sequences(turns))).collect() == []


def test_ids_of_hot_sequences_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 60)
    members = spark.range(300).selectExpr("cast(case when id % 3 = 0 then 'hot' else concat('s', id) end as binary) seq", "id conv_id").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {bytes(r["seq"]).decode(): r["sha"] for r in op.ends(members).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {"hot": ",".join(map(str, range(0, 300, 3)))} | {f"s{i}": str(i) for i in range(300) if i % 3}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_long_conversation():
    turn = lambda i: i.to_bytes(16, "big") + (1).to_bytes(4, "big")
    one = b"".join(turn(i) for i in range(20_000))
    cols = op.nodes_of([one, one + turn(5)], [1, 1], [4, 3], ["a", "b"], -1, -1)
    assert len(cols["depth"]) == 20_002 and cols["n_leaves"][0] == 1 and cols["saved_tokens"][0] == 20_000


def test_query_equals_sql_and_plain_trie(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{D}/conversations.parquet'")
    got = sorted((tuple(r) for r in op.op12_prefixes(spark, D).select(COLS).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(COLS)} FROM ({op.ORACLE})").fetchall(), key=str)
    assert got == plain(rebuilt(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))
    assert any(r[4] > 1 for r in got)
