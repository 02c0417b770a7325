"""Multilingual mixture inference.

A naive n-gram model of each language gives every short run of words a likelihood per language. Expectation-maximisation
then estimates the proportions of the languages in a document, and the set of languages is the one of highest likelihood
less a penalty per further language. The prediction is the language of the largest proportion.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcq.llm.common import giving_back, pick
from graphcq.llm.sample import by_hash, remainder

WORD = re.compile(r"[^\W\d_]+")
#: Numbers that the expression takes for letters, such as fractions and Roman ones, to blanks.
NUMBERS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")}
BUCKETS = 1 << 15
#: Words whose likelihoods a worker remembers at most; likelihoods of n-grams that are held at once; languages of a model (128 KB each).
REMEMBERED, AT_ONCE, MOST_LANGUAGES = 200_000, 2_000_000, 2_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits to buckets."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def grams(words: list[str], at_once: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, buckets) of every character of the words with their ends marked, `at_once` characters at a time: the
    position of its word, and the hashed bigram and trigram that start there, BUCKETS where the word has ended."""
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4")
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for at in range(0, len(chars), at_once):
        n = min(at_once, len(chars) - at)
        c, w = (np.append(x[at : at + n + 2], fill)[: n + 2] for x, fill in ((chars, [0, 0]), (word, [-1, -1])))
        c = c.astype(np.uint64)
        two = c[:n] * np.uint64(0x9E3779B97F4A7C15) + c[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two + (c[2:] + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
        yield w[:n], np.stack([np.where(w[k : n + k] == w[:n], _mixed(h), BUCKETS) for k, h in ((1, two), (2, three))])


def likelihoods(words: list[str], log_p: np.ndarray) -> np.ndarray:
    """Log likelihood of each word per language; `log_p` ends with a row of zeros, for what is no n-gram."""
    out = np.zeros((len(words), log_p.shape[1]))
    for word, buckets in grams(words, max(1, AT_ONCE // max(1, log_p.shape[1]))):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] += np.add.reduceat(log_p[buckets[0]] + log_p[buckets[1]], starts, axis=0, dtype=np.float64)
    return out


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    if not low.isascii() and not NUMBERS.keys().isdisjoint(map(ord, set(low))):
        low = low.translate(NUMBERS)
    return WORD.findall(low)


def _name(word: str) -> str | bytes:
    """What a word is remembered by: long ones by a digest."""
    return word if len(word) <= 64 else hashlib.blake2b(word.encode(), digest_size=16).digest()


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train, per_lang: int = 3000) -> Model:
    """Fit on about `per_lang` distinct rows (id and text) of each language, out of those for which `train` holds.

    The counts are summed by Spark; the driver gets BUCKETS numbers per language. Over MOST_LANGUAGES languages is an error:
    the model would not be small. Without any labelled row it has no language and every prediction is `und`.
    """
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.xxhash64(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = by_hash(rows, "_key", "_lang", per_lang, MOST_LANGUAGES).dropDuplicates(["_key"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, own in f.groupby("_lang"):
                n = np.zeros(BUCKETS + 1, np.int64)
                words = Counter(w for t in own["_text"] for w in words_of(t))
                times = np.fromiter(words.values(), np.int64, len(words))
                for word, buckets in grams(list(words)):
                    for part in buckets:
                        np.add.at(n, part, times[word])
                at = np.flatnonzero(n[:BUCKETS])
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    sums = rows.select("_text", "_lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    n = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        n[own["bucket"].to_numpy(), k] = own["n"]
    p = (n + 0.5) / (n.sum(axis=0) + 0.5 * BUCKETS) if languages else n
    return Model(languages, np.log(p).astype(np.float32))


def mixture(like: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood by expectation-maximisation, for many documents at once.

    `like` has a row of likelihoods (relative to the row's best) per run of words, `starts` where each document's runs
    start, `allowed` the languages each document may use.
    """
    n = np.diff(np.append(starts, len(like)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = like * np.repeat(share, n, axis=0).astype(np.float32)
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        share = np.add.reduceat(part, starts, axis=0, dtype=np.float64) / n[:, None]
    total = (like * np.repeat(share, n, axis=0)).sum(axis=1) + 1e-30
    return share, np.add.reduceat(np.log(total, dtype=np.float64), starts)


def infer(like: np.ndarray, starts: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over the chosen set of each document, and the size of that set.

    Sets grow by the language of the next largest proportion, for as long as that gains more than the penalty.
    """
    n = np.diff(np.append(starts, len(like)))
    langs = like.shape[1]
    full, _ = mixture(like, starts, np.ones((len(starts), langs)))
    order = np.argsort(-full, axis=1, kind="stable")
    best, chosen, size = np.full(len(starts), -np.inf), np.zeros_like(full), np.ones(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for m in range(1, langs + 1):
        own = like if len(open_) == len(starts) else like[np.repeat(starts[open_], n[open_]) + np.arange(n[open_].sum()) - np.repeat(np.cumsum(n[open_]) - n[open_], n[open_])]
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :m], 1.0, axis=1)
        share, ll = mixture(own, np.cumsum(n[open_]) - n[open_], allowed, rounds=1 if m == 1 else 12)
        ll = ll - penalty * (m - 1) * np.log1p(n[open_])
        better = ll > best[open_]
        open_, share, ll = open_[better], share[better], ll[better]
        if not len(open_):
            break
        best[open_], size[open_], chosen[open_] = ll, m, share
    return chosen, size


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), run_words: int = 4,
             penalty: float = 2.0) -> DataFrame:
    """`keep` columns and (lang_pred string, score double, languages array<string>, shares array<double>) per row.

    lang_pred is the language of the largest proportion, score that proportion; languages and shares are the chosen set,
    largest first. A text that is null or has no letter, or any text under a model without languages, is `und` with
    score 0 and an empty set. Whole texts count, in one pass of bounded memory per batch; repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))  # BUCKETS x languages at most
    text_at, n_keep = keep.index(text_col) if text_col in keep else len(keep), len(keep)
    rows = docs.select(*[docs[c] for c in dict.fromkeys([*keep, text_col])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_keep]) + ", lang_pred string, score double, languages array<string>, shares array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = shared.value
        log_p = np.concatenate([log_p, np.zeros((1, len(langs)), np.float32)])
        seen: dict[str | bytes, int] = {}
        store = np.empty((1 << 12, max(1, len(langs))), np.float32)

        def known(words: list[str]) -> np.ndarray:
            nonlocal seen, store
            new = {w: _name(w) for w in set(words).difference(seen)}
            if len(seen) + len(new) > REMEMBERED:
                seen, new = {}, {w: _name(w) for w in set(words)}
            fresh = {name: w for w, name in new.items() if name not in seen}
            if fresh:
                upto = len(seen) + len(fresh)
                if upto > len(store):
                    store = np.concatenate([store, np.empty((max(upto - len(store), len(store)), store.shape[1]), np.float32)])
                store[len(seen) : upto] = likelihoods(list(fresh.values()), log_p)
                seen.update(zip(fresh, range(len(seen), upto)))
            return store[np.fromiter((seen[w] if w in seen else seen[new[w]] for w in words), np.int64, len(words))]

        for batch in batches:
            n = batch.num_rows
            pred, score, sets, shares = ["und"] * n, [0.0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
            pending: list[tuple[int, np.ndarray]] = []
            size = 0

            def settle(pending=pending, pred=pred, score=score, sets=sets, shares=shares) -> None:
                if not pending:
                    return
                like = np.concatenate([x for _, x in pending])
                starts = np.cumsum([0, *(len(x) for _, x in pending[:-1])])
                like = np.exp(like - like.max(axis=1, keepdims=True))
                found, count = infer(like, starts, penalty)
                for (i, _), p, m in zip(pending, found, count, strict=True):
                    top = np.argsort(-p, kind="stable")[:m]
                    pred[i], score[i] = langs[top[0]], float(min(1.0, p[top[0]]))
                    sets[i], shares[i] = [langs[k] for k in top], [float(p[k]) for k in top]
                pending.clear()

            texts = batch.column(text_at)
            for i in range(n if langs else 0):
                words = words_of(texts[i].as_py())
                if words:
                    x = np.concatenate([known(words[k : k + 100_000]) for k in range(0, len(words), 100_000)])
                    x = np.add.reduceat(x, np.arange(0, len(x), run_words), axis=0)
                    pending.append((i, x))
                    size += len(x)
                    if size > 200_000:
                        settle()
                        size = 0
            settle()
            out = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *out], names=[*batch.schema.names[:n_keep], "lang_pred", "score", "languages", "shares"])

    return rows.mapInArrow(giving_back(run), schema)


def language_id(docs: DataFrame, per_lang: int = 3000) -> DataFrame:
    """Predict every row of docs (doc_id, text, lang), with a model fitted on rows whose crc32 of doc_id mod 4 is not 2.

    Rows without an id are predicted but not learned from. See `identify` for texts that are null or without letters.
    """
    kept = pick(docs, ["doc_id", "text", "lang"])
    rest = remainder("doc_id", 4)
    model = fit(kept, "doc_id", "text", "lang", (rest != 2) & (rest >= 0), per_lang)
    return identify(kept.withColumn("held_out", rest == 2), model, keep=("doc_id", "held_out"))
