import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcq.llm import langid
from tests.llm.helpers import docs, hard_rows, no_docs

SYLLABLES = {"aa": "the ing tion er ou wh th ly".split(), "bb": "sch keit ung ein ich auf zu der".split(), "cc": "que eau oir les aux ment tre ç".split()}


def text(rng, lang, words=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(n=240):
    rng = random.Random(1)
    langs = [rng.choice(["aa", "aa", "aa", "bb", "cc"]) for _ in range(n)]  # one language is common
    return [(i, text(rng, lang), lang, "s") for i, lang in enumerate(langs)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_numbers_are_no_letters(spark):
    rows = [(i, "der die und " * 5, "de") for i in range(8)] + [(i, t) for i, t in enumerate(["½ ²", "①", "Ⅷ", "3½", "ª", "½a"], 100)]
    got = {r.doc_id: r.lang_pred for r in langid.language_id(docs(spark, rows)).collect()}
    assert [got[i] for i in range(100, 106)] == ["und", "und", "und", "und", "de", "de"]


def test_many_languages_and_large_sets(spark):
    rng = random.Random(1)
    words = {f"l{k:02d}": [f"{a}{chr(0x4E00 + 40 * k + rng.randrange(40))}{b}" for a in "xyz" for b in "uvw"] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 70:02d}"]) for _ in range(30)), f"l{i % 70:02d}") for i in range(490)]
    model = langid.fit(docs(spark, rows), "doc_id", "text", "lang", F.lit(True))
    assert len(model.languages) == 70
    mixed = " ".join(rng.choice(words[x]) for x in ("l03", "l11", "l42", "l69", "l50") for _ in range(60))
    got = langid.identify(docs(spark, [(1, mixed), *rows[:70]]), model).collect()
    assert set(next(r for r in got if r.doc_id == 1 and len(r.languages) > 1).languages) == {"l03", "l11", "l42", "l69", "l50"}
    assert sum(r.lang_pred == f"l{r.doc_id % 70:02d}" for r in got) >= 70


def bucket(gram):
    """The bucket of a bigram or trigram, by plain integers."""
    h = sum((ord(c) + k // 2) * m for k, (c, m) in enumerate(zip(gram, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))) % 2**64
    h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
    return (h ^ (h >> 32)) % langid.BUCKETS


def test_long_words_are_words():
    words = ["abc" * 60_000, "é", "日本語", "𝔘x", "abc"]
    want = [sorted(bucket(f"^{w}$"[i : i + n]) for n in (2, 3) for i in range(len(w) + 3 - n)) for w in words]
    for at_once in (250_000, 1000, 7):
        got = [[] for _ in words]
        for word, buckets in langid.grams(words, at_once):
            assert len(word) <= at_once
            for k in range(len(words)) if len(set(word.tolist())) > 1 else word[:1].tolist():
                got[k] += [g for g in buckets[:, word == k].ravel().tolist() if g < langid.BUCKETS]
        assert [sorted(g) for g in got] == want


def test_likelihoods_are_sums_over_ngrams(monkeypatch):
    log_p = np.append(np.log(np.random.default_rng(0).random((langid.BUCKETS, 3), np.float32)), np.zeros((1, 3), np.float32), axis=0)
    words = ["abcd" * 50, "é", "of"]
    want = [sum(log_p[bucket(f"^{w}$"[i : i + n])].astype(float) for n in (2, 3) for i in range(len(w) + 3 - n)) for w in words]
    for at_once in (langid.AT_ONCE, 30, 3):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        assert np.allclose(langid.likelihoods(words, log_p), want, rtol=1e-5)


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.language_id(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, lang, _ in rows:
        assert got[i].held_out == held_out(i) and 0 <= got[i].score <= 1
    own = [i for i, *_ in rows if held_out(i)]
    assert sum(got[i].lang_pred == rows[i][2] for i in own) >= 0.97 * len(own) > 30


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus()
    other = [(i, t, "zz" if held_out(i) else lang, "q") for i, t, lang, _ in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.language_id(docs(spark, x)).collect()) for x in (rows, other))
    assert a == b


def test_mixtures(spark):
    rng = random.Random(7)
    rows = corpus()
    mixed = [(1000 + k, text(rng, "aa", 140) + " " + text(rng, "bb", 60), None, None) for k in range(8)]
    got = {r.doc_id: r for r in langid.language_id(docs(spark, rows + mixed)).collect()}
    for i, *_ in mixed:
        assert got[i].lang_pred == "aa" and got[i].languages == ["aa", "bb"] and 0.55 < got[i].score < 0.85
    pure = [got[i] for i, *_ in rows]
    assert sum(len(r.languages) == 1 for r in pure) >= 0.9 * len(pure)


def test_hard_rows(spark):
    hard = hard_rows()
    got = langid.language_id(docs(spark, corpus() + [(None if i is None else 5000 + i, t) for i, t in hard])).collect()
    assert len(got) == 240 + len(hard)
    by_id = {r.doc_id: r for r in got}
    for i in (5040, 5041, 5042, 5043):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].languages) == ("und", 0.0, [])
    assert by_id[5044].lang_pred != "und"


def test_no_labels_and_no_documents(spark):
    assert {r.lang_pred for r in langid.language_id(docs(spark, [(1, "some words"), (2, None)])).collect()} == {"und"}
    assert langid.language_id(no_docs(spark)).count() == 0


def em_by_hand(like, rounds=12):
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        part = like * share
        part /= part.sum(axis=1, keepdims=True)
        share = part.mean(axis=0)
    return share, np.log(like @ share).sum()


def test_mixture_is_expectation_maximisation():
    rng = np.random.default_rng(0)
    sizes = [1, 5, 40, 3]
    like = np.exp(-rng.exponential(3, (sum(sizes), 3))).astype(np.float32)
    starts = np.cumsum([0, *sizes[:-1]])
    share, ll = langid.mixture(like, starts, np.ones((4, 3)))
    for k, (lo, n) in enumerate(zip(starts, sizes, strict=True)):
        want, want_ll = em_by_hand(like[lo : lo + n].astype(float))
        assert share[k] == pytest.approx(want, abs=1e-4) and ll[k] == pytest.approx(want_ll, abs=1e-3)


def test_penalty_chooses_the_set():
    like = np.array([[1, 1e-6, 1e-6]] * 20 + [[1e-6, 1, 1e-6]] * 10, np.float32)
    _, size = langid.infer(like, np.array([0]), penalty=2.0)
    assert size.tolist() == [2]
    _, size = langid.infer(like, np.array([0]), penalty=200.0)
    assert size.tolist() == [1]
