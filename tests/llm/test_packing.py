import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphcq.llm import packing
from graphcq.llm.queries import tokenizer_path
from tests.llm.helpers import docs, hard_rows, no_docs

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, pieces, tokenizer, capacity):
    """Every id of every document, in its place, once; sequences gapless and not too long."""
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    want = []
    for doc_id, text in rows:
        ids = whole(tokenizer, text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(p)[:5]) for p in pieces)
    return len(bins)


@pytest.mark.parametrize("items_per_task", [5, 60_000])
@pytest.mark.parametrize("capacity", [16, 256])
def test_round_trip(spark, tokenizer, capacity, items_per_task):
    rows = hard_rows()
    got = packing.pack(docs(spark, rows).repartition(3), PATH, capacity, items_per_task=items_per_task, slack=2).collect()
    n = check(rows, got, tokenizer, capacity)
    assert n >= sum(p.length for p in got) / capacity


def test_rounds_come_near_one_task(spark, tokenizer):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 120))) for i in range(600)]
    one = packing.pack(docs(spark, rows), PATH, 256)
    many = packing.pack(docs(spark, rows), PATH, 256, items_per_task=40)
    a, b = (check(rows, x.collect(), tokenizer, 256) for x in (one, many))
    assert a <= b <= 1.03 * a + 1


def test_items_that_never_fit_together_end(spark, tokenizer):
    rows = [(i, " ".join(["word"] * 150)) for i in range(60)]
    got = packing.pack(docs(spark, rows), PATH, 256, items_per_task=8).collect()
    assert check(rows, got, tokenizer, 256) == 60


def test_words_one_by_one_give_the_whole_texts_ids(tokenizer):
    ids, rng = packing._Ids(tokenizer), random.Random(0)
    signs = "ªµºßŒaB'sdtΣİςJ̌ é́.,!<|>\n\t\x1c\xa0 ̇ǰ1²٣ñ中'll've‍ .!!%%%"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "Stop!!! it's GOING, well... we'll", "x" * 500, "ſtraße ΑΣ ΑΣΑ."]
    for t in texts:
        assert packing.text_ids(t, ids) == whole(tokenizer, t)[:-1].tobytes(), t


def test_the_older_words_stay_right(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    ids = packing._Ids(tokenizer)
    text = "one two three, four! five one two. six seven one"
    assert packing.text_ids(text, ids) == whole(tokenizer, text)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit(lengths):
    first, offset, used = packing.best_fit(np.array(lengths, np.int64), 40)
    fill, ends = defaultdict(int), defaultdict(list)
    for b, o, n in zip(first.tolist(), offset.tolist(), lengths, strict=True):
        fill[b] += n
        ends[b].append((o, n))
    assert all(n <= 40 for n in fill.values())
    for b, places in ends.items():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
    assert used.tolist() == [fill[b] for b in first.tolist()]
    # No two bins could be one.
    sizes = sorted(fill.values())
    assert len(sizes) < 2 or sizes[0] + sizes[1] > 40


def test_no_documents(spark):
    assert packing.pack(no_docs(spark), PATH).count() == 0
