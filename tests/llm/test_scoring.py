import math
import re
from collections import Counter

import duckdb
import pytest

from graphcq.llm import scoring
from tests.llm.helpers import docs, hard_rows, no_docs


def brute(rows, order, alpha=0.4, least=2):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        score, backed = 0.0, 0
        for i in range(len(w)):
            n = min(order, i + 1)
            while n > 1 and counts[tuple(w[i - n + 1 : i + 1])] < least:
                n, backed, score = n - 1, backed + 1, score + math.log(alpha)
            gram = tuple(w[i - n + 1 : i + 1])
            score += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
        out.append((doc_id, len(w), backed, round(score, 4)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    rows = hard_rows()
    got = [(r.doc_id, r.n_tokens, r.n_backoff, round(r.log_score, 4)) for r in scoring.backoff_scores(docs(spark, rows).repartition(3), order=order).collect()]
    assert Counter(map(str, got)) == Counter(map(str, brute(rows, order)))


def test_batches_do_not_matter(spark, monkeypatch):
    rows = hard_rows(3)
    whole = {str(tuple(r)[:3]) for r in scoring.backoff_scores(docs(spark, rows)).collect()}
    assert {str(tuple(r)[:3]) for r in scoring.backoff_scores(docs(spark, rows).repartition(7)).collect()} == whole


def test_planes_round_trip():
    import numpy as np

    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (scoring._ascending(scoring._deltas(x)) == x).all()
    assert len(scoring._ascending(scoring._deltas(x[:0]))) == 0
    for y in (x % np.uint64(200), x % np.uint64(70_000), x[:0].astype(np.int64)):
        assert (scoring._whole(scoring._split(y)) == y).all()


def test_sql_agrees(spark):
    rows = [r for r in hard_rows(5) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    for order, sql in ((3, scoring.SQL), (2, scoring.SQL_OF_BIGRAMS)):
        got = sorted((r.doc_id, r.n_tokens, r.n_backoff, round(r.log_score, 4)) for r in scoring.backoff_scores(docs(spark, rows), order).collect())
        assert got == sorted(con.execute(sql).fetchall())


def test_registered_queries(spark, tmp_path):
    import __spark_entry__ as entry

    rows = hard_rows(6)
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for order, name in ((3, "op1_backoff_scores"), (2, "bigram_backoff_scores")):
        got = [(r.doc_id, r.n_tokens, r.n_backoff, r.log_score) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        assert Counter(map(str, got)) == Counter(map(str, brute(rows, order)))


def test_no_documents(spark):
    assert scoring.backoff_scores(no_docs(spark)).count() == 0
