"""Stupid-backoff scores of documents under the n-gram counts of the corpus itself, computed relationally.

Documents are tokenized once, into packed batches of some BATCH_TOKENS tokens. Each batch is exploded into its distinct
n-grams, with how often it has them, and these are dealt by ranges of their hash: a task of that join has all n-grams of
its range from all batches, so it holds that part of the count table, and answers each batch with the counts of its
n-grams, in their order. The batches meet their answers, and the logarithms are summed per document.

An n-gram reaches a task once per batch, however frequent it is, so no frequent word or pair gathers anywhere. Hashes
move sorted, as differences in byte planes, compressed: some six bytes an n-gram; as rows of a DataFrame they would take
eight bytes for the hash alone, twice. There are as many pieces as batches have ranges with an n-gram in them, so never
more than n-grams. Hashes have 64 bits and are not verified.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcq.llm.common import giving_back, parts_for, pick

#: Tokens of a batch and of a range of hashes, about; words whose hashes a worker remembers at most.
BATCH_TOKENS, RANGE_TOKENS, REMEMBERED = 2_500_000, 2_000_000, 400_000
SCORES = "doc_id long, n_tokens long, n_backoff long, log_score double"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashes of the lower-cased words between ASCII white space."""
    words = (text or "").lower().encode().split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs, spread over all 64 bits."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _split(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Byte planes of the narrowest form, which compress better than the numbers."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.itemsize, x.view(np.uint8).reshape(-1, x.itemsize).T.copy()


def _whole(planes: tuple[int, np.ndarray]) -> np.ndarray:
    return planes[1].T.copy().view(f"<u{planes[0]}").ravel()


def _deltas(ascending: np.ndarray) -> tuple[int, np.ndarray]:
    return _split(np.diff(ascending, prepend=np.uint64(0)))


def _ascending(planes: tuple[int, np.ndarray]) -> np.ndarray:
    return np.cumsum(_whole(planes), dtype=np.uint64)


def _batch(ids: list[int | None], found: list[np.ndarray]) -> bytes:
    """Packed: ids, which of them are null, words per document, the words, their ranks by frequency, and each token's rank."""
    words, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(words))
    null = np.array([i is None for i in ids])
    lens = np.array([len(x) for x in found], np.int64)
    return _pack(np.array([i or 0 for i in ids], np.int64), null, lens, _deltas(words), _split(rank), _split(rank[at]))


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, null, lens, and the hash of each token."""
    ids, null, lens, words, rank, at = _unpack(data)
    by_rank = np.empty(rank[1].shape[1], np.uint64)
    by_rank[_whole(rank)] = _ascending(words)
    return ids, null, lens, by_rank[_whole(at)]


def tokenized(docs: DataFrame) -> DataFrame:
    """(id long, data binary) of docs (doc_id, text): a row per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, found, size, made = _Hashes(), [], [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([_batch(ids, found)], pa.binary())], names=["id", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                found.append(word_hashes(text.as_py(), hashes))
                size += len(found[-1])
                if size >= BATCH_TOKENS:
                    yield out()
                    ids, found, size, made = [], [], 0, made + 1
        if ids:
            yield out()

    return docs.mapInArrow(giving_back(run), "id long, data binary")


def _grams(lens: np.ndarray, own: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to `order`: the hash of the n-gram that ends at each token, and which tokens have one."""
    place = np.arange(len(own), dtype=np.int32) - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)
    last = own
    yield own, np.ones(len(own), bool)
    for n in range(2, order + 1):
        h = np.empty_like(own)
        h[1:] = _mix(last[:-1], own[1:])
        last = h
        yield h, place >= n - 1


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The rows (id, range, data) of each range, of a task whose rows are sorted by it."""
    now, rows = None, []
    for batch in batches:
        for key, r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if r != now and rows:
                yield now, rows
                rows = []
            now = r
            rows.append((key, data.as_py()))
    if rows:
        yield now, rows


def _rows(rows: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "range", "data"])


ROWS = "id long, range int, data binary"


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """(doc_id, n_tokens long, n_backoff long, log_score double) for every row of docs (doc_id, text).

    A token scores c(context, w) / c(context) by the longest n-gram of at most `order` words of its document that ends in
    it and occurs `min_count` times or more in all documents, times alpha for each longer one that does not; a single
    word scores c(w) / N whatever its count. log_score sums the natural logarithms, n_backoff counts the n-grams that
    were too rare. Null, empty and blank texts have no token and score 0. Every row counts in the corpus, repeated ones
    too, and gives a row; null ids are kept; no documents give no rows; other columns are ignored. A task holds a batch,
    or the n-grams of a range of hashes.
    """
    own = pick(docs, ["doc_id", "text"])
    n = own.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+"))), F.lit(0))).first()[0]
    ranges, parts = parts_for(n * order, RANGE_TOKENS, 12), parts_for(n, BATCH_TOKENS, 4)
    corpus = tokenized(own).repartition(parts, "id")  # both the questions and the scores read this one shuffle
    log_n, log_alpha = float(np.log(max(n, 1))), float(np.log(alpha))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, lens, own = _tokens(data.as_py())
                for k, (h, there) in enumerate(_grams(lens, own, order)):
                    values, times = np.unique(h[there], return_counts=True)
                    r = ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(r, prepend=-1, append=ranges)).tolist()
                    yield _rows((key, int(r[i]) * order + k, _pack(_deltas(values[i:j]), _split(times[i:j]))) for i, j in zip(cuts[:-1], cuts[1:], strict=True))

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, asked in _by_range(rows):
            parts = [_unpack(d) for _, d in asked]
            keys = [_ascending(p[0]) for p in parts]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate([_whole(p[1]) for p in parts])).astype(np.int64)
            ends = np.cumsum([len(x) for x in keys])
            yield _rows((key, r, _pack(_split(total[at[e - len(x) : e]]))) for (key, _), x, e in zip(asked, keys, ends.tolist(), strict=True))

    def score(batch: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for data in batch.column("data"):
            ids, null, lens, own = _tokens(data.as_py())
            got: dict[int, list[tuple[int, bytes]]] = {k: [] for k in range(order)}
            for r, d in zip(answers.column("range").to_pylist(), answers.column("data"), strict=True):
                got[r % order].append((r, d.as_py()))
            value, backed, before = np.zeros(len(own)), np.zeros(len(own), np.int32), np.ones(len(own), np.int64)
            for k, (h, there) in enumerate(_grams(lens, own, order)):
                c = np.zeros(len(h), np.int64)
                if there.any():
                    c[there] = np.concatenate([_whole(_unpack(d)[0]) for _, d in sorted(got[k])])[np.unique(h[there], return_inverse=True)[1]]
                if k == 0:
                    value = np.log(np.maximum(c, 1)) - log_n
                else:
                    seen = there & (c >= min_count)
                    value = np.where(seen, np.log(np.maximum(c, 1)) - np.log(before), value + log_alpha * there)
                    backed = np.where(seen, 0, backed + there)
                before = np.ones(len(own), np.int64)
                before[1:] = np.maximum(c[:-1], 1)
            doc = np.repeat(np.arange(len(lens)), lens)
            sums = [np.bincount(doc, x, len(lens)) for x in (backed, value)]
            out.append(pa.table([pa.array(ids, mask=null), pa.array(lens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=["doc_id", "n_tokens", "n_backoff", "log_score"]))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())]).empty_table()

    asked = corpus.mapInArrow(giving_back(ask), ROWS).repartition(ranges, "range").sortWithinPartitions("range")
    answers = asked.mapInArrow(giving_back(answer), ROWS)
    return corpus.groupBy("id").cogroup(answers.groupBy("id")).applyInArrow(score, SCORES)


#: By words, bigrams and trigrams, as by the default order.
SQL = """
WITH t AS (
  SELECT doc_id, unnest(w) AS w3, generate_subscripts(w, 1) AS p
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents)),
b AS (SELECT *, lag(w3) OVER (PARTITION BY doc_id ORDER BY p) AS w2, lag(w3, 2) OVER (PARTITION BY doc_id ORDER BY p) AS w1 FROM t),
u AS (SELECT w3 AS w, count(*) AS c FROM t GROUP BY 1),
g AS (SELECT w2, w3, count(*) AS c FROM b WHERE w2 IS NOT NULL GROUP BY 1, 2),
h AS (SELECT w1, w2, w3, count(*) AS c FROM b WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM t),
k AS (
  SELECT b.doc_id, u3.c AS c3, coalesce(u2.c, 1) AS c2, coalesce(g.c, 0) AS c23, coalesce(g0.c, 1) AS c12, coalesce(h.c, 0) AS c123, least(p, 3) AS longest
  FROM b JOIN u u3 ON u3.w = b.w3 LEFT JOIN u u2 ON u2.w = b.w2 LEFT JOIN g ON g.w2 = b.w2 AND g.w3 = b.w3
  LEFT JOIN g g0 ON g0.w2 = b.w1 AND g0.w3 = b.w2 LEFT JOIN h ON h.w1 = b.w1 AND h.w2 = b.w2 AND h.w3 = b.w3),
s AS (
  SELECT doc_id, count(*) AS n_tokens, sum(CASE WHEN c123 >= 2 THEN 0 WHEN c23 >= 2 THEN longest - 2 ELSE longest - 1 END) AS n_backoff,
         sum(CASE WHEN c123 >= 2 THEN ln(c123 / c12) WHEN c23 >= 2 THEN ln(c23 / c2) + (longest - 2) * ln(0.4) ELSE ln(c3 / n) + (longest - 1) * ln(0.4) END) AS log_score
  FROM k CROSS JOIN n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff, round(coalesce(log_score, 0.0), 4) AS log_score
FROM documents d LEFT JOIN s USING (doc_id)
"""

#: By words and bigrams.
SQL_OF_BIGRAMS = """
WITH t AS (
  SELECT doc_id, unnest(w) AS w2, generate_subscripts(w, 1) AS p
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents)),
b AS (SELECT *, lag(w2) OVER (PARTITION BY doc_id ORDER BY p) AS w1 FROM t),
u AS (SELECT w2 AS w, count(*) AS c FROM t GROUP BY 1),
g AS (SELECT w1, w2, count(*) AS c FROM b WHERE w1 IS NOT NULL GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE b.w1 IS NOT NULL AND g.c < 2) AS n_backoff,
         sum(CASE WHEN b.w1 IS NULL THEN ln(u2.c / n) WHEN g.c >= 2 THEN ln(g.c / u1.c) ELSE ln(0.4 * u2.c / n) END) AS log_score
  FROM b CROSS JOIN n JOIN u u2 ON u2.w = b.w2 LEFT JOIN u u1 ON u1.w = b.w1 LEFT JOIN g ON g.w1 = b.w1 AND g.w2 = b.w2
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(log_score, 0.0), 4) AS log_score
FROM documents d LEFT JOIN s USING (doc_id)
"""
