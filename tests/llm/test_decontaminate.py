import random
import re

import pytest

from graphcq.llm import decontaminate
from tests.llm.helpers import docs, hard_rows, no_docs, prose


def shingles(text, width):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, items, threshold=0.8, width=5):
    best = {}
    for d, text in rows:
        own = shingles(text, width)
        for i, t in items:
            ss = shingles(t, width)
            if d is not None and i is not None and ss and len(own & ss) >= threshold * len(ss) - 1e-9:
                new = (len(own & ss) / len(ss), len(ss), len(own & ss))
                best[d, i] = max(best.get((d, i), (0,)), new)
    return sorted((d, i, n, m, round(c, 6)) for (d, i), (c, n, m) in best.items())


def table(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, hash string, n int")


def corpus(seed=0):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([3, 5, 6, 9, 16, 17, 33, 60]))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "?!"), (None, prose(rng, 9)), (3, items[4][1]), (103, "same same same same same same same same")]
    rows = hard_rows()
    for k in range(60):
        i, t = items[k % 30]
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):  # near the threshold, above and below
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + k, f"{prose(rng, rng.randrange(0, 300))}. {' '.join(w).upper()}, {prose(rng, rng.randrange(0, 300))}"))
    rows += [(2000, items[0][1]), (2001, "Same, same same same same same same same!"), (2002, prose(rng, 15_000) + " " + items[7][1])]
    return rows, items


@pytest.mark.parametrize(("threshold", "width"), [(0.8, 5), (0.5, 3), (1.0, 5)])
def test_against_brute_force(spark, threshold, width):
    rows, items = corpus()
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs(spark, rows), table(spark, items), threshold, width).collect())
    want = brute(rows, items, threshold, width)
    assert got == want and len(want) > 20


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows, items = corpus(1)
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs(spark, rows), table(spark, items)).collect())
    assert got == brute(rows, items)


def test_empty_tables(spark):
    rows, items = corpus()
    assert decontaminate.contaminated(no_docs(spark), table(spark, items)).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), table(spark, items).where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    rows, items = corpus()
    plan = decontaminate.contaminated(docs(spark, rows), table(spark, items))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
