"""The pipeline's stages against plain versions of their decisions, over the smallest tables."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphcq.llm.queries import QUERIES, tokenizer_path
from graphcq.llm.simhash import fingerprint
from tests.llm.helpers import docs, hard_rows, no_docs
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_linededup import brute as cleaned
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute as groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_stages_one_by_one(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs(spark, [(10_000, None), (10_001, "12 34"), (10_002, "")]).select(frame.columns)
    frame = frame.union(extra)
    names = frame.columns
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, SF).write.parquet(str(tmp_path / str(k)))
        out.append(frame)
        frame = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert frame.columns == names
    start, one, two, three, four = map(rows_of, out)
    # Language ID: what has no letters goes, clean documents stay.
    assert Counter(one) == Counter(r for r in start if r[1] and any(c.isalpha() for c in r[1]))
    # Line dedup.
    assert Counter((d, t) for d, t, *_ in two) == Counter((d, t) for d, t, *_ in cleaned(one, 10))
    assert out[2].where(F.col("n_chars") != F.char_length("text")).count() == out[0].where(F.col("n_chars") != F.char_length("text")).count()
    # Near-duplicates: the smallest id of each group.
    component = {eval(x)[0]: eval(x)[2] for x in groups([(d, t) for d, t, *_ in two], 4)}
    assert [r[0] for r in three] == sorted({component[r[0]] for r in two})
    # Decontamination.
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in leaks([(d, t) for d, t, *_ in three], items)}
    assert four == [r for r in three if r[0] not in bad] and bad
    # Packing.
    from tokenizers import Tokenizer

    check([(d, t) for d, t, *_ in four], frame.collect(), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 4096)


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame((out := stage(spark, frame, SF)).collect(), out.schema)
    assert sorted(map(str, got.drop("sequence_id", "offset").collect())) == sorted(map(str, frame.drop("sequence_id", "offset").collect()))


def test_hard_rows_pass_every_stage(spark):
    frame = docs(spark, hard_rows())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, frame, SF)
        rows = found.collect()
        if k < 4:
            assert found.columns == frame.columns
        if k == 2:
            # One row of each group, though some have no id and some share one.
            of_text = {t: fingerprint(t) for _, t in hard_rows()}
            kept = [of_text[r.text] for r in rows]
            assert not any((a ^ b).bit_count() <= 4 for n, a in enumerate(kept) for b in kept[n + 1 :])


def test_rows_without_id_and_repeated_ids_are_judged(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["stone", "river", "cloud", "amber", "lantern", "quiet"]) + str(rng.randrange(50)) for _ in range(60)) for _ in range(4)]
    frame = docs(spark, [(None, texts[0]), (7, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[3]), (2, texts[3])])
    got = corpus_pipeline.drop_near_duplicates(spark, frame, SF)
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == sorted([(7, texts[0]), (-1, texts[1]), (2, texts[2]), (2, texts[3])])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    frame = docs(spark, [(None, f"{texts[0]} {item}"), (None, texts[1]), (2, f"{item} {texts[2]}"), (2, texts[3])])
    got = corpus_pipeline.decontaminate_documents(spark, frame, SF)
    assert got.columns == frame.columns and sorted((r.doc_id or -1, r.text) for r in got.collect()) == sorted([(-1, texts[1]), (2, texts[3])])


def test_empty_documents(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), SF).count() == 0


def test_queries_are_registered():
    numbers = defaultdict(list)
    for name in QUERIES:
        numbers[int(name[2:].split("_")[0])].append(name)
    assert sorted(numbers) == list(range(1, 11)) and all(len(v) == 1 for v in numbers.values())
