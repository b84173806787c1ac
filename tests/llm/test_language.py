import random
import zlib

import pytest

from rebill.llm import language


def naive(text, train):
    """Phrases of the greedy longest-match parse of a text."""
    t, i, n = language.plain(text), 0, 0
    while i < len(t):
        k = 1
        while i + k < len(t) and t[i:i + k + 1] in train:
            k += 1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("longest", [1 << 17, 1000, 7])
def test_phrases_equal_a_plain_parse_also_of_long_texts(monkeypatch, longest):
    monkeypatch.setattr(language, "LONGEST", longest)
    rnd = random.Random(3)
    train = {k: "".join(rnd.choice("abcd " if k == "x" else "bcdé漢😀 ") for _ in range(900)) for k in "xy"}
    model = {"names": ["x", "y"], "table": language.Transitions([language.automaton([ord(c) for c in train[k]]) for k in "xy"])}
    texts = ["".join(rnd.choice("abcdé漢😀 .") for _ in range(n)) for n in (1, 5, 300, 4000)] + [None, "", "zzz"]
    got, size = language.phrases(texts, model)
    for i, t in enumerate(texts):
        assert size[i] == len(language.plain(t or ""))
        for j, k in enumerate("xy"):
            assert got[i, j] == (naive(t, train[k]) if t else 0)


def test_many_letters_and_rare_languages(spark):
    rnd = random.Random(4)
    alphabet = {"a": range(0x4E00, 0x4E00 + 2000), "b": range(0x5C00, 0x5C00 + 2000)}
    word = lambda k: "".join(chr(rnd.choice(alphabet[k])) for _ in range(4))
    rows = [(" ".join(word(k) for _ in range(200)), k) for k in "ab" for _ in range(60)]
    rows += [(f"{chr(0xAC00 + i)}{chr(0xAC01 + i)} " * 20, f"l{i}") for i in range(80)]
    rows += [("the same text again and again", "en")] * 500 + [("another english sentence", "en")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = [(" ".join(word(k) for _ in range(30)), k) for k in "ab" for _ in range(50)] + [("another sentence", "en"), ("12 ?", "und"), (None, "und"), (f"{chr(0xAC00 + 77)}{chr(0xAC01 + 77)}", "l77")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == [k for _, k in texts]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    none = spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, language.fit(none)).collect()] == [("und", 0.0)]


def test_query_against_a_plain_parse_and_on_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in language.read(spark, d, "documents").collect()}
    got = language.op2_language(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (r in held) for r in got)
    known = [r for r in held if docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) >= 0.95 * len(known) > 20
    for r in got:
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r.score <= 1


def test_a_long_text_that_never_falls_in_step(monkeypatch):
    monkeypatch.setattr(language, "LONGEST", 50)
    train = {"x": "a" * 7 + " b", "y": "ab" * 9 + "c"}
    model = {"names": ["x", "y"], "table": language.Transitions([language.automaton([ord(c) for c in t]) for t in train.values()])}
    texts = ["a" * 1003, "ab" * 400, "a" * 333 + "b" + "a" * 333, "ba" * 77 + "c" * 60 + "ab" * 200]
    got, _ = language.phrases(texts, model)
    assert got.tolist() == [[naive(t, x) for x in train.values()] for t in texts]
