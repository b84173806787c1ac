import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from rebill.llm import ngram_lm


def plain_model(texts):
    """Interpolated modified Kneser-Ney trigrams in plain Python."""
    tri = Counter()
    for t in texts:
        ws = ["<s>", "<s>", *t, "</s>"]
        tri.update(zip(ws, ws[1:], ws[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)
    raw = Counter()
    for (_, _, c), n in tri.items():
        raw[c] += n

    def level(counts):
        of = Counter(counts.values())
        n1, n2, n3, n4 = (of[i] + 0.5 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        ctx = defaultdict(list)
        for g, n in counts.items():
            ctx[g[:-1] if isinstance(g, tuple) else ()].append(n)
        return d, ctx

    levels = [(tri, *level(tri)), (bi, *level(bi)), (uni, *level(uni))]

    def prob(gram, i=0):
        if i == 3:
            return 1 / (len(raw) + 1)
        counts, d, ctx = levels[i]
        key = gram[i:] if i < 2 else gram[2]
        ns = ctx.get(gram[i:-1] if i < 2 else ())
        lower = prob(gram, i + 1)
        if not ns:
            return lower
        n = counts.get(key, 0)
        gamma = sum(d[min(m, 3) - 1] for m in ns) / sum(ns)
        return (max(n - d[min(n, 3) - 1], 0) / sum(ns) if n else 0) + gamma * lower

    return raw, prob


def test_scores_equal_a_plain_model(spark, tmp_path):
    rnd = random.Random(2)
    words = ["the", "The", "of", "a"] * 9 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 90)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "the " * 700), (203, "the " * 700), (204, "never seen words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.op7_ngram_lm(spark, str(tmp_path)).collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").lower().split()
    raw, prob = plain_model([split(t) for i, t in rows if not held(i)])
    n, v = sum(raw.values()), len(raw)
    want = []
    for i, t in rows:
        ws = ["<s>", "<s>", *split(t), "</s>"]
        base = sum(math.log10((raw[w] + 1) / (n + v + 1)) for w in ws[2:])
        log = sum(math.log10(prob(g)) for g in zip(ws, ws[1:], ws[2:]))
        want.append((i, held(i), len(ws) - 2, sum(raw[w] > 0 for w in ws[2:]), n, base, log))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-9 * max(1, abs(w[6])), (g, w)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngram_lm.train(docs.limit(0))
    assert [(r.n_tokens, r.n_known, r.score) for r in ngram_lm.score(docs, model).collect()] == [(3, 0, 0.0)]


def test_last_words_of_bigrams_are_counted_once_a_file(spark, tmp_path):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(30)}" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        out = [ngram_lm._write(ngram_lm.counted(docs, 2, i), str(tmp_path), 2, ngram_lm.BI, True).collect() for i in (0, 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    before_of = defaultdict(set)
    for t in texts:
        ws = ["<s>", "<s>", *t.split(), "</s>"]
        for a, b, c in zip(ws, ws[1:], ws[2:]):
            before_of[b, c].add(a)
    n = [len(x) for x in before_of.values()]
    sums = [sum(r.sums[i] for rows in out for r in rows if r.path) for i in range(7)]
    assert sums == [len(n), sum(n), n.count(1), n.count(2), n.count(3), n.count(4), sum(x > 2 for x in n)]
    for rows in out:
        words = [r.word for r in rows if r.path is None]
        assert len(words) <= len(set(words)) * sum(r.path is not None for r in rows)
    assert sum(r.n for rows in out for r in rows if r.path is None) == len(n)


def test_ngrams_are_shuffled_in_pieces(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(300)) for _ in range(50)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for order in (1, 2, 3):
        pieces = ngram_lm.counted(docs, order).collect()
        ngrams = sum(len(r.ks) // 8 for r in pieces)
        assert len(pieces) <= ngrams // ngram_lm.PIECE + 2 * 16
        for r in pieces:
            k = np.frombuffer(r.ks, np.int64)
            assert k[0] == r.k and (np.diff(k) >= 0).all() and len(set((k >> 60).tolist())) == 1 and len(r.xs) * 2 == len(r.ks)


def test_pieces_are_merged_whatever_their_cuts(monkeypatch):
    monkeypatch.setattr(ngram_lm, "PIECE", 8)
    rnd = np.random.default_rng(7)
    for distinct in (False, True):
        for size, buffer, large in ((0, 16, 0), (1, 16, 0), (300, 16, 0), (300, 64, 1 << 33), (3000, 1 << 20, 0)):
            monkeypatch.setattr(ngram_lm, "BUFFER", buffer)
            rows, runs = defaultdict(list), []
            for run in range(7 if size else 0):
                # Some keys fill many pieces of every run.
                k = np.where(rnd.random(size) < 0.3, rnd.integers(-2, 2, size) << 61, rnd.integers(-99, 99, size) << 55)
                x = rnd.integers(1, 50, size) + (0 if distinct or run < 3 else large)
                at = np.argsort(k)
                runs.append(ngram_lm._packed(k[at], x[at], 2))
                for i, j in zip(k.tolist(), x.tolist()):
                    rows[i].append(j)
            table = pa.Table.from_batches(runs) if runs else pa.table({"k": pa.array([], pa.int64())})
            batches = table.sort_by("k").combine_chunks().to_batches(max_chunksize=5)
            got = [(i, j) for k, n in ngram_lm._merged(iter(batches), distinct) for i, j in zip(k.tolist(), n.tolist())]
            assert got == sorted((i, len(set(j)) if distinct else sum(j)) for i, j in rows.items())


def test_few_lookups_and_files(monkeypatch):
    # Each look-up meets each file, so neither may grow in proportion to the texts.
    files = ngram_lm.RANGE * 32
    assert [ngram_lm._bits(files * x) for x in (1 / 16, 1, 64, 64 * 64)] == [1, 5, 8, 11]
    monkeypatch.setattr(ngram_lm, "LOOKUP", 50)
    texts = [None if i % 9 == 4 else "a b " * (i % 7) for i in range(200)]
    table = pa.table({"doc_id": pa.array([None, *range(1, 200)], pa.int64()), "text": texts})
    got = list(ngram_lm._gathered(iter(table.to_batches(max_chunksize=3))))
    assert pa.concat_arrays([ids for ids, _, _ in got]).to_pylist() == table["doc_id"].to_pylist()
    assert np.concatenate([size for _, _, size in got]).tolist() == [len((t or "").split()) + 1 for t in texts]
    assert all(len(t) == size.sum() and len(ids) == len(size) for ids, t, size in got)
    assert all(len(t) >= 50 for _, t, _ in got[:-1]) and len(got) < 40
