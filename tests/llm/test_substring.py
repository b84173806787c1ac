import random

from rebill.llm import substring


def test_members_of_a_bucket_with_a_far_centre_are_compared(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for family in range(200):
        ws = list(base)
        for i in (rnd.randrange(0, 12), rnd.randrange(28, 40)):  # families are far from each other
            ws[i] = f"f{family}x{i}"
        rows += [(2 * family, " ".join(ws) + "."), (2 * family + 1, " ".join(ws[:-1] + [f"last{family}"]) + ".")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(zip(*(t.rstrip(".").split()[k:] for k in range(5)))) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    gone = {r.doc_id for r in substring.repeated(docs).collect()}
    assert gone == {i for i in sets if find(i) != i}


def test_passages_cut_mid_sentence_and_of_short_sentences(spark):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(10**6)}"
    long = " ".join(word() + ("." if i % 20 == 19 else "") for i in range(300)).split(" ")
    short = " ".join(word() + ("." if i % 4 == 3 else "") for i in range(60))
    other = [" ".join(word() for _ in range(30)) for _ in range(8)]
    rows = [(1, " ".join(long) + "\n" + short)]
    rows += [(i, f"{other[2 * i - 4]} {' '.join(long[37 * i:37 * i + 51])} {other[2 * i - 3]}") for i in (2, 3, 4)]
    rows += [(9, f"{other[6]} {short} {other[7]}"), (10, rows[0][1]), (11, None)]
    got = {r.doc_id: (r.text, r.removed) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[10] == ("", 360) and got[11] == (None, 0)
    for i, n in ((2, 51), (3, 51), (4, 51), (9, 60)):
        k = 6 if i == 9 else 2 * i - 4
        assert got[i] == (f"{other[k]} {other[k + 1]}", n)


def test_paragraphs_are_hashed_once(spark, monkeypatch):
    plans = []
    stored = substring.stored
    monkeypatch.setattr(substring, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    one = " ".join(f"w{i}" for i in range(30)) + "."
    docs = spark.createDataFrame([(1, one), (2, one + " " + " ".join(f"v{i}" for i in range(20)) + "."), (3, one.replace("w29", "other"))], "doc_id long, text string")
    assert sorted((r.doc_id, r.pos) for r in substring.repeated(docs).collect()) == [(2, 0), (3, 0)]
    assert sum("MapInArrow" in p for p in plans) == 2  # places with their bands, and the sets of those that share one
