import random

from rebill.llm import linking


def test_a_family_just_below_the_limit_makes_few_pairs(spark, monkeypatch):
    """Members lose and replace a tenth of the family's shingles: two of them are at 0.67 or so, but for planted twins."""
    rnd = random.Random(7)
    value = lambda: rnd.getrandbits(63)
    family = [value() for _ in range(200)]
    sets = {}
    for i in range(80):
        kept = rnd.sample(family, 180)
        sets[i] = set(kept) | {value() for _ in range(20)}
        if i % 16 == 0:
            sets[1000 + i] = set(list(sets[i])[:190]) | {value() for _ in range(10)}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    links = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    asked = []
    confirmed = linking.confirmed

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(linking, "confirmed", counted)
    monkeypatch.setattr(linking, "ROUNDS", 0)  # all is left to the exact step
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, set array<long>")
    inside = spark.createDataFrame([(b, k) for b in range(2) for k in sets], "bucket long, node long")
    got = {r.node: r.root for r in linking.link(inside, frame, 80).collect()}
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: r for k, r in root.items() if k != r}
    assert len(links) <= sum(asked) <= 3 * len(links) < len(sets) * 2
