import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np

from rebill.llm import toxicity

TOXIC = ["vile", "nasty", "rotten"]


def rows(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rnd.randrange(5, 60))]
        if i % 3 == 0:
            ws.insert(rnd.randrange(len(ws)), rnd.choice(TOXIC))
        out.append((i, " ".join(ws), int(i % 3 == 0)))
    return out


def discounts(counts: Counter) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more."""
    of = Counter(counts.values())
    n1, n2, n3, n4 = (of[i] + 0.5 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


class Model:
    """Kneser-Ney models of both classes from (words, class) rows, sharing the lowest order."""

    def __init__(self, rows: list[tuple[list[str], int]]):
        self.pairs = Counter(), Counter()
        for ws, y in rows:
            self.pairs[y].update(set(zip(["", *ws], ws)))
        self.words = tuple(Counter(c for _, c in x) for x in self.pairs)
        self.shared = Counter(c for _, c in self.every())
        self.kinds, self.total = len(self.shared) + 1, sum(self.shared.values())
        self.d2, self.d1 = [discounts(x) for x in self.pairs], [discounts(x) for x in self.words]
        self.n1 = [sum(x.values()) for x in self.words]
        self.gamma1 = [sum(d[min(n, 3) - 1] for n in x.values()) for x, d in zip(self.words, self.d1)]
        self.after: tuple[Counter, Counter] = (Counter(), Counter())  # of a word: pairs that it begins
        self.gamma2: tuple[Counter, Counter] = (Counter(), Counter())
        for y in (0, 1):
            for (a, _), n in self.pairs[y].items():
                self.after[y][a] += n
                self.gamma2[y][a] += self.d2[y][min(n, 3) - 1]

    def every(self) -> Iterator[tuple[str, str]]:
        """The pairs of both classes, once each."""
        yield from self.pairs[0]
        yield from (p for p in self.pairs[1] if p not in self.pairs[0])

    def word(self, y: int, c: str) -> float:
        """Probability of a word by the continuation counts of a class and the shared ones."""
        low = (self.shared.get(c, 0) + 1) / (self.total + self.kinds)
        n = self.words[y].get(c, 0)
        p = (max(n - self.d1[y][min(n, 3) - 1], 0) if n else 0) + self.gamma1[y] * low
        return p / self.n1[y] if self.n1[y] else low

    def pair(self, y: int, a: str, c: str) -> float:
        """Probability of a word after another."""
        p, m = self.word(y, c), self.after[y].get(a, 0)
        if not m:
            return p
        n = self.pairs[y].get((a, c), 0)
        return ((max(n - self.d2[y][min(n, 3) - 1], 0) if n else 0) + self.gamma2[y][a] * p) / m


def test_models_are_distributions_and_equal_their_arrays():
    data = [(toxicity.tokens(t), y) for _, t, y in rows(60)]
    model = Model(data)
    every = sorted(set(model.shared))
    for y in (0, 1):
        low = 1 / (model.total + model.kinds)  # what is left for any other word
        for a in ("", data[0][0][0], "unseen"):
            left = model.gamma2[y][a] / model.after[y][a] if model.after[y].get(a) else 1
            rest = left * model.gamma1[y] / model.n1[y] * low
            assert abs(sum(model.pair(y, a, c) for c in every) + rest - 1) < 1e-9
    texts = [ws for ws, _ in data[:5]] + [[], ["unseen", *data[0][0], "unseen"]]
    ids = {w: i for i, w in enumerate(["", *every])}
    ratios = toxicity.Ratios([toxicity.numbered(ws, ids) for ws, _ in data], np.array([y for _, y in data]), len(ids))
    for ws, r in zip(texts, ratios([toxicity.numbered(ws, ids) for ws in texts])):
        for i, (a, c) in enumerate(zip(["", *ws], ws)):
            assert abs(r[0][i] - np.log(model.pair(1, a, c) / model.pair(0, a, c))) < 1e-9
            assert abs(r[1][i] - np.log(model.word(1, c) / model.word(0, c))) < 1e-9


def test_held_out_rows(spark, tmp_path):
    data = rows(1500)
    docs = [(i, t) for i, t, _ in data] + [(9000, None), (9001, ""), (9002, "?! 12"), (9003, "vile " * 30000), (3, data[3][1])]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (9001, None), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score == by[9002].score < 0.5 and by[9003].predicted == 1
    held = [(by[i].predicted, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in data)
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(toxicity.sample(docs, labels)) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0]
