"""Detection against plain Python, and the scenarios that a statement has to pass."""

import random
from datetime import date, timedelta
from statistics import median

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rebill.operators import detect, merge

TX = "account_id long, row_no long, date date, amount double, description string, category string, mcc string"
PRICES = st.lists(st.tuples(st.sampled_from([90.0, 95.0, 99.0, 100.0, 104.0, 110.0, 125.0, 200.0, 300.0]), st.integers(1, 3)), min_size=1, max_size=8)


def plain_clusters(amounts):
    out = []
    for a in sorted(amounts):
        if out and abs(a - out[-1][len(out[-1]) // 2]) <= abs(out[-1][len(out[-1]) // 2]) * 0.12:
            out[-1].append(a)
        else:
            out.append([a])
    return out


def plain_change(prices):
    """(old, new, place of the first new payment) of payments in order, or nothing."""
    same = lambda a, b: a + b > 0 and abs(a - b) / ((a + b) / 2) <= 0.05

    def level(i):
        own = [prices[i]]
        while i and same(prices[i - 1], median(own)):
            i -= 1
            own.append(prices[i])
        return i, own

    start, new = level(len(prices) - 1)
    if len(new) < 2 or not start:
        return None
    _, old = level(start - 1)
    return (median(old), median(new), start) if len(old) >= 2 else None


@settings(max_examples=300, deadline=None)
@given(PRICES)
def test_levels_are_clusters_of_single_charges(counts):
    amounts = sorted({p for p, _ in counts})
    n = {p: sum(k for q, k in counts if q == p) for p in amounts}
    for sign in (1, -1):
        levels, day = [], date(2026, 1, 1)
        for a in sorted(sign * p for p in amounts):
            if not levels or not abs(a - levels[-1].middle()) <= abs(levels[-1].middle()) * 0.12:
                levels.append(detect._Level())
            levels[-1].add(a, n[abs(a)], day, day, False)
        want = plain_clusters([sign * p for p in amounts for _ in range(n[p])])
        assert [[a for a, k in zip(x.amounts, x.counts) for _ in range(k)] for x in levels] == want
        assert [x.price() for x in levels] == [sorted(map(abs, c))[len(c) // 2] for c in want]


def test_changes_are_those_of_single_payments(spark):
    """Random series of payments, all at once."""
    rng = random.Random(5)
    series = [[p for _ in range(rng.randint(1, 5)) for p in [rng.choice([100.0, 103.0, 104.9, 106.0, 99.0, 130.0, 131.0])] * rng.randint(1, 4)] for _ in range(400)]
    rows = [(i, "norm", "k", date(2025, 1, 1) + timedelta(j), 0, j, -p) for i, s in enumerate(series) for j, p in enumerate(s)]
    it = spark.createDataFrame(rows, "account_id long, kind string, key string, date date, glue int, row_no long, amount double")
    got = {r.account_id: (r.old_price, r.new_price, r.changed_at) for r in detect.price_change(it).collect()}
    want = {}
    for i, s in enumerate(series):
        if (c := plain_change(s)) and not abs(c[0] - c[1]) / ((c[0] + c[1]) / 2) <= 0.05 and abs(round(round(c[1] - c[0], 2) / c[0] * 100, 2)) >= 5:
            want[i] = (round(c[0] + 1e-9, 2), round(c[1] + 1e-9, 2), date(2025, 1, 1) + timedelta(c[2]))
    assert got == want and len(want) > 30


def plain_leaders(names):
    grams = lambda s: {s[i:i + 2] for i in range(len(s) - 1)}
    lead, out = [], {}
    for name in names:
        g = grams(name.replace(" ", ""))
        out[name] = next((x for x in lead if g and grams(x.replace(" ", "")) and 2 * len(g & grams(x.replace(" ", ""))) / (len(g) + len(grams(x.replace(" ", "")))) >= 0.8), name)
        if out[name] == name:
            lead.append(name)
    return out, lead


def _vocab(spark, names):
    rows = [(a, f"{n}!", "norm", n, (date(2025, 1, 1) + timedelta(i % 7), i), 1, 0, 0) for a, ns in names.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "account_id long, description string, kind string, key string, first struct<date:date,row_no:long>, n long, in_category long, in_code long")


def test_leaders_are_those_of_the_walk(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    names = {a: list(dict.fromkeys(rng.choice(words) + rng.choice(["", "", "A", "AB", " C"]) for _ in range(40))) for a in range(12)}
    got = {(r.account_id, r.key): (r.leader, r.place) for r in merge.fuzzy_leader_merge(_vocab(spark, names)).collect()}
    joined = 0
    for a, ns in names.items():
        order = sorted(range(len(ns)), key=lambda i: (i % 7, i))
        out, lead = plain_leaders([ns[i] for i in order])
        assert {k: v for (x, k), v in got.items() if x == a} == {k: (v, lead.index(v) + 1) for k, v in out.items()}
        joined += sum(k != v for k, v in out.items())
    assert joined > 20


def test_many_names_in_one_account(spark):
    """An account of 100,000 names, every tenth a variant of the one before; and pairs of such a vocabulary."""
    rng = random.Random(1)
    names = []
    while len(names) < 100_000:
        name = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))
        names += [name, name + "Z"] if len(names) % 10 == 8 else [name]
    led = merge.fuzzy_leader_merge(_vocab(spark, {1: names}))
    assert led.count() == len(names) and led.where("leader <> key").count() == 10_000
    pairs = merge.similar_merchants(spark.createDataFrame([(n,) for n in names], "name string"))
    assert pairs.count() == 10_000


def statement(*groups):
    """Rows of accounts from (description, amounts, days between) lists, one account each."""
    out = []
    for account, charges in enumerate(groups):
        n = 0
        for description, amounts, step in charges:
            for i, a in enumerate(amounts):
                name = description if isinstance(description, str) else description[i % len(description)]
                out.append((account, n, date(2026, 2, 20) - timedelta(step * (len(amounts) - 1 - i)), -float(a), name, None, None))
                n += 1
    return out


SCENES = [
    ("monthly", [("NETFLIX.COM", [599] * 6, 30)], {"name": "Netflix", "amount": 599.0, "yearly_cost": 7188.0, "charges": 6, "direction": None}),
    ("annual", [("OKKO", [269] * 3, 365)], {"period": "ежегодно", "amount": 269.0}),
    ("unknown needs three", [("QWERTY BOX", [100, 100], 30)], None),
    ("unknown with three", [("QWERTY BOX", [100] * 3, 30)], {"name": "Qwerty Box"}),
    ("unstable", [("QWERTY BOX", [100, 500, 900, 1300, 1700], 30)], None),
    ("weekly", [("QWERTY BOX", [100] * 8, 7)], None),
    ("single", [("NETFLIX.COM", [599], 30)], None),
    ("spellings", [(["NETFLIX.COM 1", "NETFLIX COM", "Netflix"], [599] * 6, 30)], {"charges": 6}),
    ("promo", [("NETFLIX.COM", [99, 99, 299, 299, 299], 30)], {"charges": 5, "amount": 299.0, "direction": "up"}),
    ("rise", [("NETFLIX.COM", [299, 299, 299, 399, 399], 30)], {"percent_change": 33.44, "old_price": 299.0, "new_price": 399.0}),
    ("odd payment", [("NETFLIX.COM", [599, 599, 899, 599, 599], 30)], {"direction": None, "amount": 599.0}),
    ("utility", [("ЖКХ УСЛУГИ", [700] * 6, 30)], None),
    ("retail", [("PYATEROCHKA 2451", [700] * 6, 30)], None),
    ("city only", [("MOSCOW RUS", [700] * 6, 30)], None),
    ("other bank", [("Перевод в Т-Банк", [700] * 6, 30)], None),
    ("code of a shop", [("Покупка по QR-коду", [700] * 6, 30)], None),
]


@pytest.fixture(scope="module")
def scenes(spark):
    rows = statement(*[charges for _, charges, _ in SCENES])
    return {r.account_id: r.asDict() for r in detect.detect_subscriptions(spark.createDataFrame(rows, TX), "2026-03-01").collect()}


@pytest.mark.parametrize("i", range(len(SCENES)), ids=[s[0] for s in SCENES])
def test_scene(scenes, i):
    want, got = SCENES[i][2], scenes.get(i)
    assert (got is None) == (want is None)
    assert want is None or {k: got[k] for k in want} == want
    assert got is None or got["next_charge"] >= date(2026, 3, 1)


def test_no_rows(spark):
    rows = [(1, 1, None, -5.0, "NETFLIX", None, None), (1, 2, date(2026, 1, 1), None, None, None, None), (1, 3, date(2026, 1, 1), -0.5, "NETFLIX", None, None)]
    for r in ([], rows):
        assert detect.detect_subscriptions(spark.createDataFrame(r, TX), "2026-03-01").collect() == []
