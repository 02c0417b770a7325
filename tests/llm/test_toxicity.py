import random
import zlib
from collections import Counter

import pytest

from graphcq.llm import toxicity
from tests.llm.helpers import docs, hard_rows, no_docs, prose

INSULTS = ["blorgen", "snark", "vextil"]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 80)).split()
        toxic = int(rng.random() < 0.15)
        for _ in range(rng.randrange(2, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "a", "us"]))
        text = " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)
        rows.append((i, text))
        marks.append((i, toxic))
    return rows, marks


def table(spark, marks):
    return spark.createDataFrame([(i, 1, t, "x") for i, t in marks], "doc_id long, quality int, toxic int, score string")


def test_held_out_accuracy(spark):
    rows, marks = corpus()
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), table(spark, marks)).collect()}
    own = [(i, t) for i, t in marks if held_out(i)]
    assert all(got[i].held_out for i, _ in own) and len(own) > 60 and sum(t for _, t in own) > 5
    high = [got[i].score for i, t in own if t]
    low = [got[i].score for i, t in own if not t]
    assert sum(a > b for a in high for b in low) >= 0.98 * len(high) * len(low)
    assert sum(got[i].predicted == t for i, t in own) >= 0.95 * len(own)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, marks = corpus(300)
    other = [(i, 1 - t if held_out(i) else t) for i, t in marks]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs(spark, rows), table(spark, m)).collect()) for m in (marks, other))
    assert a == b


def test_hard_rows(spark):
    rows, marks = corpus(300)
    hard = [(None if i is None else 9000 + i, t) for i, t in hard_rows()]
    got = toxicity.toxicity(docs(spark, rows + hard), table(spark, [*marks, (None, 1), (3, None), (4, 7), (9000, None), (77777, 1)])).collect()
    assert len(got) == 300 + len(hard)
    none = next(r for r in got if r.doc_id == 9041)
    assert 0 < none.score < 0.5 and none.clauses == 0 and none.predicted == 0


def test_no_labels_and_no_documents(spark):
    rows, marks = corpus(30)
    assert len({r.score for r in toxicity.toxicity(docs(spark, rows), table(spark, marks).where("false")).collect()}) == 1
    assert toxicity.toxicity(no_docs(spark), table(spark, marks)).count() == 0


STEMS = {"blorg": 5.0, "snark$": 4.0}


def weigh(text):
    return toxicity.Scorer(toxicity.Grammar(STEMS)).evidence(text)[0]


def test_grammar():
    assert weigh("he said nothing") == 0
    plain = weigh("a blorgen thing")
    assert plain == pytest.approx(5.0)
    assert weigh("snark") == pytest.approx(4.0) and weigh("snarky") == 0  # a whole word
    assert weigh("you blorgen thing") == pytest.approx(plain * (1 + toxicity.TARGET_GAIN))
    assert weigh("not a blorgen thing") == pytest.approx(plain * toxicity.NEGATED)
    assert weigh("not really meant as any blorgen") == pytest.approx(plain)  # out of the negator's reach
    assert weigh("it was called a blorgen thing") == pytest.approx(plain * toxicity.REPORTED)
    assert weigh("a blorgen thing. someone said so") == pytest.approx(plain)  # another clause
    assert weigh("i will kill you") == pytest.approx(toxicity.THREAT)
    assert weigh("i will not kill you") == pytest.approx(toxicity.THREAT * toxicity.NEGATED) or weigh("i will not kill you") < toxicity.THREAT
    assert weigh("kill you") == 0 and weigh("i will kill time") == 0
    assert weigh("blorgen. blorgus") == pytest.approx(2 * plain)


SYMBOLS = ["insult", "target", "negator", "intent", "harm", "saying", "other"]


def by_definition(symbols):
    """What the grammar says of each place, without states: threats first, then what stands around."""
    out, reach = list(symbols), toxicity.REACH
    for i, x in enumerate(symbols):
        if x == "target":
            since = max((j for j in range(i) if out[j] == "threat"), default=-1)
            lower = max((j for j in range(i) if out[j] == "threat"), default=-1)
            harms = [h for h in range(max(i - reach, lower + 1), i) if symbols[h] == "harm" and any(symbols[w] == "intent" for w in range(max(0, h - reach), h))]
            out[i] = "threat" if harms and since < min(harms) else x
    said, result = "saying" in out or "speech" in out, []
    for i, x in enumerate(out):
        if x in ("insult", "threat"):
            aimed = x == "insult" and any(out[j] in ("target", "threat") for j in range(max(0, i - reach), min(len(out), i + reach + 1)))
            denied = any(out[j] == "negator" for j in range(max(0, i - reach), i))
            result.append(("aimed" if aimed else x, denied, said))
        else:
            result.append(None)
    return result


def test_composed_machine_has_one_path_and_it_is_as_defined():
    rng, machine = random.Random(3), toxicity.grammar()
    for n in range(1500):
        symbols = rng.choices(SYMBOLS, k=rng.randrange(0, 14))
        if n % 4 == 0:
            symbols.insert(0, "speech")
        assert machine.paths(symbols) == [by_definition(symbols)], symbols


def test_composition_is_the_cascade():
    rng = random.Random(4)
    aim, deny = toxicity.Transducer((0, 0, 0), toxicity._aim, lambda s: not s[2]), toxicity.Transducer(0, toxicity._deny, lambda s: True)
    both = aim.then(deny)
    for _ in range(300):
        symbols = rng.choices(SYMBOLS, k=rng.randrange(0, 9))
        assert both.paths(symbols) == [z for y in aim.paths(symbols) for z in deny.paths(y)]


def test_grammar_decides_where_stems_alone_do_not():
    rng = random.Random(5)
    sums, labels = [], []
    scorer = toxicity.Scorer(toxicity.Grammar(STEMS))
    for i in range(400):
        words, toxic = prose(rng, 30).split(), i % 4 == 0
        words[10:10] = ["blorgen"] if toxic else ["not", "a", "blorgen"]
        sums.append(scorer.sums(" ".join(words))[0])
        labels.append(float(toxic))
    import numpy as np

    learned = toxicity._weighed(toxicity.Grammar(STEMS), np.array(sums), np.full(400, 31.0), np.array(labels))
    assert learned.denied < toxicity.NEGATED
    fitted = toxicity.Scorer(learned)
    assert fitted.score("so this is a blorgen thing " * 1)[0] > 0.5 > fitted.score("so this is not a blorgen thing")[0]


def test_words_beside_insults_are_learned(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(1500):
        words, kind = prose(rng, 40).split(), 1 if i % 4 == 0 else 2 if i % 37 == 1 else 0
        words[20:20] = [[], ["blorgen"], ["hardly", "blorgen"]][kind]
        rows.append((i, " ".join(words)))
        marks.append((i, int(kind == 1)))
    learned = toxicity.fit(docs(spark, rows), table(spark, marks))
    assert learned.negators - toxicity.NEGATORS == {"hardly"} and learned.targets == toxicity.TARGETS
    fitted = toxicity.Scorer(learned)
    assert fitted.score(rows[4][1])[0] > 0.5 > fitted.score(rows[38][1])[0]


def test_direct_speech():
    plain = 5.0
    for text in ('he said: "a blorgen thing"', '"a blorgen thing", he said', 'he said "a blorgen thing"', "«a blorgen thing!» dijo", "„a blorgen thing“, sagte er", "she wrote: a blorgen thing", 'he said: "well. a blorgen thing"'):
        assert weigh(text) == pytest.approx(plain * toxicity.REPORTED), text
    for text in ('"fine", he said. a blorgen thing', 'he said: "fine". a blorgen thing', 'a blorgen thing" he left', '"a blorgen thing" is here', 'he said so. "a blorgen thing"'):
        assert weigh(text) == pytest.approx(plain), text


def test_stems_are_pruned():
    kept = toxicity._prune({"blo": (5.0, 90.0, 20), "blor": (5.2, 80.0, 20), "blorgen$": (9.0, 50.0, 9), "xyz": (4.5, 40.0, 8)})
    assert kept == {"blo": 5.0, "blorgen$": 9.0, "xyz": 4.5}


def test_copies_are_one_witness(spark):
    rows, marks = corpus(300)
    text = prose(random.Random(9), 40) + " qwertyuiop"
    copies = [(2000 + i, text) for i in range(60)]
    grammar = toxicity.fit(docs(spark, rows + copies), table(spark, marks + [(i, 1) for i, _ in copies]))
    assert not any(s.startswith("qwe") for s in grammar.stems)
    assert any(s.startswith("blo") for s in grammar.stems)
    assert Counter(s.rstrip("$")[:3] for s in grammar.stems).keys() >= {"blo", "sna", "vex"}
