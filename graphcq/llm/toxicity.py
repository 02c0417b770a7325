"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of clauses, a clause a string of word classes: insult, target, negator, intent, harm, saying, direct
speech, other. Four transducers read it one after another, each what the one before wrote; they are composed into one
machine, whose states and arcs are made as they are reached:

1. threat: intent, then harm, then a target, each within REACH words, writes a threat in the target's place;
2. target: an insult within REACH words of a target, on either side, is written as aimed. What comes later is not known
   yet: the machine goes on with both guesses, and the promise that proves wrong has no way to an accepting state;
3. negation: an insult or a threat within REACH words after a negator is written as denied;
4. reported speech: in a clause with a verb of saying anywhere, or one of direct speech (in quotation marks, or behind a
   colon, that a verb of saying introduces or follows), all is written as reported; again by two guesses.

Each clause has one accepted path. What it writes weighs the insult's own weight times a factor per class written.
Insults are the longest learned stem that a word starts with, weighed by the log ratio of its rates per word in toxic and
other documents; the factors, and words that strengthen or weaken an insult beside them, are learned on the same bounded
sample, from a prior. A document's score is logistic in the logarithms of the summed weight and of its length, as any
stem turns up by chance in a long text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcq.llm.common import durable, giving_back, pick
from graphcq.llm.sample import by_hash, remainder

# Fixed closed-class words of the grammar, in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself they them he she him her u ur du dich dir dein ihr euch sie tu toi ton ta vous votre ils elles usted tú te ti tus ellos ellas".split())
NEGATORS = frozenset("not no never without nobody isn't aren't wasn't don't doesn't nicht kein keine nie niemals ohne ne pas jamais sans nunca sin ningún ninguna".split())
SAYING = frozenset("said says say wrote writes claimed quoted called sagte sagt schrieb behauptete dit écrit déclaré dijo dice escribió".split())
INTENT = frozenset("i we will gonna going ich wir werde werden je nous vais allons yo nosotros voy vamos".split())
HARM = frozenset("kill hurt destroy beat stab shoot burn murder töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n\"«»“”„]+")
QUOTES = re.compile(r"[\"«»“”„]")
STOP = re.compile(r"[.!?;\n]")
#: Shortest and longest stem; words in which a negator or intent still counts.
SHORT, LONG, REACH = 3, 8, 3
#: Prior factors of what is aimed, denied and reported, and the weight of a threat; learned ones stay within these bounds.
TARGET_GAIN, NEGATED, REPORTED, THREAT = 0.25, 0.5, 0.6, 3.0
FACTORS = {"aimed": (1.0, 1.25, 1.5, 2.0), "denied": (0.0, 0.25, 0.5, 0.75, 1.0), "reported": (0.0, 0.3, 0.6, 0.8, 1.0)}
#: What the composed machine writes: plain insults and threats, those of them aimed (only insults), denied, reported.
KINDS = [(threat, aimed, denied, reported) for reported in (0, 1) for denied in (0, 1) for threat, aimed in ((0, 0), (0, 1), (1, 0))]


@dataclass(frozen=True)
class Grammar:
    stems: dict[str, float]  # a word's start -> weight; a whole word ends in "$"
    bias: float = -3.0
    slope: float = 1.0
    length: float = 0.0
    aimed: float = 1 + TARGET_GAIN
    denied: float = NEGATED
    reported: float = REPORTED
    targets: frozenset[str] = TARGETS
    negators: frozenset[str] = NEGATORS


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in range(SHORT, min(LONG, len(word) - 1) + 1)] + [word + "$"]


def insult(word: str, stems: dict[str, float]) -> float:
    """Weight of the longest known stem of `word`: the whole, or a part that it goes on after."""
    if (w := stems.get(word + "$")) is not None:
        return w
    for n in range(min(LONG, len(word) - 1), SHORT - 1, -1):
        if (w := stems.get(word[:n])) is not None:
            return w
    return 0.0


class Transducer:
    """Arcs state, symbol -> [(state, symbol)], made from `step` when first walked; None of them: the path ends there."""

    def __init__(self, start, step, accepts) -> None:
        self.start, self.accepts, self._step, self.arcs = start, accepts, step, {}

    def walk(self, state, symbol) -> list[tuple]:
        key = state, symbol
        if key not in self.arcs:
            self.arcs[key] = self._step(state, symbol)
        return self.arcs[key]

    def then(self, other: Transducer) -> Transducer:
        """Composition: `other` reads what this one writes."""
        def step(state, symbol):
            return [((p, q), z) for p, y in self.walk(state[0], symbol) for q, z in other.walk(state[1], y)]

        return Transducer((self.start, other.start), step, lambda s: self.accepts(s[0]) and other.accepts(s[1]))

    def paths(self, symbols) -> list[list]:
        """What the accepted paths write."""
        live = [(self.start, None)]
        for x in symbols:
            live = [(to, (out, y)) for at, out in live for to, y in self.walk(at, x)]
        found = []
        for at, out in live:
            if self.accepts(at):
                written = []
                while out:
                    out, y = out
                    written.append(y)
                found.append(written[::-1])
        return found


def _threat(state, x):
    intent, harm = state
    if x == "target" and harm:
        return [((max(0, intent - 1), 0), "threat")]
    harm = REACH if x == "harm" and intent else max(0, harm - 1)
    intent = REACH if x == "intent" else max(0, intent - 1)
    return [((intent, harm), x)]


def _aim(state, x):
    """(words since a target, words that must have none, words within which one must come)."""
    since, never, must = state
    if x in ("target", "threat"):
        return [] if never else [((1, 0, 0), x)]
    if must == 1:
        return []
    since, never, must = since and (since + 1) % (REACH + 1), max(0, never - 1), max(0, must - 1)
    if x != "insult":
        return [((since, never, must), x)]
    if state[0] or must:  # a target before it, or on its way
        return [((since, never, must), "aimed")]
    return [((since, REACH, 0), "insult"), ((since, never, REACH), "aimed")]


def _deny(left, x):
    if x == "negator":
        return [(REACH, x)]
    return [(max(0, left - 1), (x, bool(left)) if x in ("insult", "aimed", "threat") else x)]


def _report(state, x):
    """plain: nothing is reported; due: what reports is yet to come; done: it came."""
    says = x in ("saying", "speech")
    out = []
    for to in {"start": ("plain", "due"), "plain": ("plain",), "due": ("due",), "done": ("done",)}[state]:
        if not (to == "plain" and says):
            to = "done" if to == "due" and says else to
            out.append((to, (*x, to != "plain") if isinstance(x, tuple) else None))
    return out


def grammar() -> Transducer:
    """The composition of the four transducers."""
    threat, aim = Transducer((0, 0), _threat, lambda s: True), Transducer((0, 0, 0), _aim, lambda s: not s[2])
    deny, report = Transducer(0, _deny, lambda s: True), Transducer("start", _report, lambda s: s != "due")
    return threat.then(aim).then(deny).then(report)


def clauses_of(text: str) -> list[tuple[list[str], bool]]:
    """The words of each clause, and whether it is direct speech: in quotation marks, with a verb of saying in the clause
    right before or after them, or behind a colon that such a clause ends in. A mark that is not closed quotes nothing."""
    own, marks, at = [], [""], 0
    for m in CLAUSE.finditer(text):
        if (words := WORD.findall(text, at, m.start())) or not own:
            own.append(words)
            marks.append(m.group())
        else:  # no words between: marks of one place
            marks[-1] += m.group()
        at = m.end()
    own.append(WORD.findall(text, at))
    says = [not SAYING.isdisjoint(words) for words in own]
    speech = [i > 0 and ":" in marks[i] and "\n" not in marks[i] and says[i - 1] for i in range(len(own))]
    opened, led = None, False
    for i, mark in enumerate(marks):  # before clause i
        parts = QUOTES.split(mark)
        for before, after in zip(parts, parts[1:]):
            if opened is None:
                opened, led = i, i > 0 and says[i - 1] and not STOP.search(before)
                continue
            if led or says[i] and not STOP.search(after):
                speech[opened:i] = [True] * (i - opened)
            opened = None
    return list(zip(own, speech, strict=True))


class _Insults(dict):
    def __init__(self, stems: dict[str, float]) -> None:
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> float:
        if len(self) >= 300_000:
            self.clear()
        self[word] = w = insult(word, self.stems)
        return w


class Scorer:
    """Evidence and scores of texts under a grammar; only clauses with an insult or a word of harm are walked."""

    def __init__(self, grammar_: Grammar) -> None:
        self.grammar, self.insults, self.machine = grammar_, _Insults(grammar_.stems), grammar()
        self.written: dict[tuple, list] = {}
        g = grammar_
        self.factors = np.array([(THREAT if threat else 1.0) * (g.aimed if aimed else 1.0) * (g.denied if denied else 1.0) * (g.reported if reported else 1.0) for threat, aimed, denied, reported in KINDS])

    def symbol(self, word: str) -> str:
        g = self.grammar
        return "insult" if self.insults[word] else "harm" if word in HARM else "intent" if word in INTENT else "target" if word in g.targets else "negator" if word in g.negators else "saying" if word in SAYING else "other"

    def clause(self, words: list[str], said: bool) -> list[tuple[int, int]]:
        """(index of KINDS, place of the word) of what a clause writes."""
        symbols = tuple(["speech"] * said + [self.symbol(w) for w in words])
        if (kinds := self.written.get(symbols)) is None:
            (path,) = self.machine.paths(symbols)
            names = {"insult": (0, 0), "aimed": (0, 1), "threat": (1, 0)}
            kinds = [(KINDS.index((*names[y[0]], int(y[1]), int(y[2]))), i - said) for i, y in enumerate(path) if y]
            if len(self.written) >= 50_000:
                self.written.clear()
            if len(symbols) < 100:
                self.written[symbols] = kinds
        return kinds

    def sums(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """Summed weight (threats: number) per KINDS, how many clauses write any, and the number of words."""
        low = (text or "").lower()
        words = WORD.findall(low)
        found, out, hits = {w for w in set(words) if self.insults[w] or w in HARM}, np.zeros(len(KINDS)), 0
        if found:
            for own, said in clauses_of(low):
                if not found.isdisjoint(own):
                    kinds = self.clause(own, said)
                    for k, i in kinds:
                        out[k] += 1.0 if KINDS[k][0] else self.insults[own[i]]
                    hits += bool(kinds)
        return out, hits, len(words)

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Summed weight of the clauses, and how many have one."""
        sums, hits, _ = self.sums(text)
        return float(sums @ self.factors), hits

    def score(self, text: str | None) -> tuple[float, int]:
        sums, hits, words = self.sums(text)
        g = self.grammar
        z = g.bias + g.slope * np.log1p(sums @ self.factors) + g.length * np.log1p(words)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), hits


#: Odd factors that permute 32-bit hashes, three to a band.
_FACTORS = np.array([0x9E3779B1 + 0x2545F4 * 2 * i for i in range(12)], np.uint32)


def _bands(words: list[str]) -> list[int]:
    """Four hashes, one of which near copies almost surely share: each of three least hashes of four words in a row."""
    h = np.array([zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))], np.uint32)
    least = [(h * f).min() for f in _FACTORS]
    return [zlib.crc32(np.array(least[i : i + 3]).tobytes()) for i in range(0, 12, 3)]


def _witnesses(sample: DataFrame) -> set[int]:
    """Keys of one document per group of near copies and label. The sample is bounded, and so is what comes back of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["_key"], "toxic": f["_toxic"], "bands": [_bands(WORD.findall(t.lower())) for t in f["_text"]]})

    group: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while (up := group.setdefault(x, x)) != x:
            group[x] = x = group[up] if up in group else up
        return x

    rows = sorted((r["key"], r["toxic"], tuple(r["bands"])) for r in sample.mapInPandas(run, "key long, toxic int, bands array<long>").collect())
    for _, _, bands in rows:
        first = root((0, bands[0]))
        for i, b in enumerate(bands[1:], 1):
            group[root((i, b))] = first
            first = root(first)
    chosen: dict[tuple, int] = {}
    for key, toxic, bands in rows:
        chosen.setdefault((root((0, bands[0])), toxic), key)
    return set(chosen.values())


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, least_docs: int = 6, least_gain: float = 30.0,
        least_weight: float = 3.0) -> Grammar:
    """Learn stems, words beside them, factors and the logistic function on about `rows` distinct labelled documents, at their natural rate.

    The sample is drawn by hash of id and text, without those whose crc32 of doc_id modulo 5 is 0. A stem counts
    once per group of near copies; it is kept if at least `least_docs` groups with label 1 have it, its
    log-likelihood ratio against the labels is `least_gain` or more, and the log ratio of its rates per word `least_weight`
    or more: weak stems of common words would add up over long texts. No usable labels give an empty grammar, and then
    every text the same low score. The rows bound how many stems there can be.
    """
    marks = labels.select(labels["doc_id"].alias("_id"), labels["toxic"].cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    marks = marks.where(remainder("_id", 5) > 0).groupBy("_id").agg(F.max("_toxic").alias("_toxic")).withColumn("_all", F.lit(0))
    # Which documents are drawn is settled on keys; they are about `rows`: broadcast, so that of the texts only theirs move.
    own = docs.select(docs["doc_id"].alias("_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_key"), docs["text"].alias("_text")).where("_text is not null")
    labelled = own.select("_id", "_key").join(marks, "_id")
    drawn = durable(by_hash(labelled, "_key", "_all", rows, 1).select("_key", "_toxic").dropDuplicates(["_key"]))
    sample = durable(own.select("_key", "_text").join(F.broadcast(drawn), "_key").dropDuplicates(["_key"]))
    witnesses = docs.sparkSession.sparkContext.broadcast(_witnesses(sample))  # `rows` keys at most

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n: Counter[tuple[str, int]] = Counter()
            times: Counter[tuple[str, int]] = Counter()
            f = f[f["_key"].isin(witnesses.value)].drop_duplicates("_key")
            for text, toxic in zip(f["_text"], f["_toxic"], strict=True):
                words = Counter(WORD.findall(text.lower()))
                own: Counter[str] = Counter()
                for w, m in words.items():
                    for stem in stems_of(w):
                        own[stem] += m
                n.update((x, int(toxic)) for x in own)
                n["", int(toxic)] += 1
                times["", int(toxic)] += sum(words.values())
                for x, m in own.items():
                    times[x, int(toxic)] += min(m, 1 + sum(words.values()) // 50)  # a word that is repeated on and on says no more
            if n:
                keys = list(n)
                yield pd.DataFrame({"stem": [k[0] for k in keys], "toxic": [k[1] for k in keys], "n": [n[k] for k in keys], "times": [times[k] for k in keys]})

    def by_label(y: int, c: str):
        return F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0))

    counts = durable(sample.mapInPandas(count, "stem string, toxic int, n long, times long").groupBy("stem").agg(
        by_label(1, "n").alias("t"), by_label(0, "n").alias("c"), by_label(1, "times").alias("tt"), by_label(0, "times").alias("cc")))
    whole = counts.where("stem = ''").first()
    if not whole or not whole["t"] or not whole["c"]:
        return Grammar({})
    rate = whole["t"] / (whole["t"] + whole["c"])
    weight = F.log((F.col("tt") + 0.5) / (whole["tt"] + 1)) - F.log((F.col("cc") + 0.5) / (whole["cc"] + 1))
    strong = counts.where((F.col("stem") != "") & (F.col("t") >= least_docs)).select("stem", "t", "c", _gain(F.col("t"), F.col("c"), (F.col("t") + F.col("c")) * rate).alias("gain"), weight.alias("weight"))
    top = strong.where((F.col("t") > (F.col("t") + F.col("c")) * rate) & (F.col("gain") >= least_gain) & (F.col("weight") >= least_weight)).collect()
    found = {r["stem"]: (r["weight"], r["gain"], r["t"]) for r in top}
    stems = _prune(found)
    # A whole word that says nothing, though the words that go on after it do.
    bare = [f"{x}$" for x in stems if not x.endswith("$")]
    stems |= {r["stem"]: 0.0 for r in counts.where(F.col("stem").isin(bare)).where(weight < least_weight).select("stem").collect()}
    plain = _learned(sample, Grammar(stems))
    beside = _beside(sample, plain, witnesses, least_docs, least_gain)
    if not (beside[0] or beside[1]):
        return plain
    return _learned(sample, replace(plain, targets=TARGETS | beside[1], negators=NEGATORS | beside[0]))


def _learned(sample: DataFrame, known: Grammar) -> Grammar:
    """`known` with factors and logistic function fitted on the sample (_text, _toxic), whose sums come to the driver."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(known)
        for b in batches:
            rows = [own.sums(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64()), b.column(1)], names=["sums", "n", "y"])

    got = sample.select("_text", "_toxic").mapInArrow(weigh, "sums array<double>, n long, y int").toPandas()  # a short row each
    return _weighed(known, np.array(got["sums"].tolist()).reshape(-1, len(KINDS)), got["n"].to_numpy(float), got["y"].to_numpy(float))


def _gain(t, c, expected):
    """Log-likelihood ratio of t toxic and c other documents, of which so many were expected to be toxic."""
    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    return 2 * (part(t, expected) + part(c, t + c - expected))


def _beside(sample: DataFrame, known: Grammar, witnesses, least_docs: int, least_gain: float) -> dict[int, frozenset[str]]:
    """Words within REACH of an insult whose documents are more (1) or less (0) often toxic than `known` expects of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(known)
        for f in frames:
            out: dict[str, np.ndarray] = {}
            f = f[f["_key"].isin(witnesses.value)].drop_duplicates("_key")
            for text, toxic in zip(f["_text"], f["_toxic"], strict=True):
                words = WORD.findall(text.lower())
                at = [i for i, w in enumerate(words) if scorer.insults[w]]
                if at:
                    told = np.array([toxic, 1 - toxic, min(max(scorer.score(text)[0], 0.01), 0.99)], float)
                    for w in {w for i in at for w in words[max(0, i - REACH) : i + REACH + 1] if not scorer.insults[w]}:
                        out[w] = out[w] + told if w in out else told
            if out:
                rows = np.array(list(out.values()))
                yield pd.DataFrame({"word": list(out), "t": rows[:, 0], "c": rows[:, 1], "e": rows[:, 2]})

    counts = sample.mapInPandas(run, "word string, t double, c double, e double").groupBy("word").agg(*[F.sum(x).alias(x) for x in "tce"])
    counts = counts.where((F.col("t") + F.col("c") >= least_docs) & (_gain(F.col("t"), F.col("c"), F.col("e")) >= least_gain))
    told = counts.select("word", (F.col("t") > F.col("e")).alias("more")).collect()  # as many as the sample has words, at most
    return {y: frozenset(r["word"] for r in told if r["more"] == bool(y)) for y in (0, 1)}


def _weighed(known: Grammar, sums: np.ndarray, n: np.ndarray, y: np.ndarray) -> Grammar:
    """The factors of most likelihood, one after another, less a little for each that leaves its prior; and the logistic function."""
    best, best_value = known, -np.inf
    for name in (None, *FACTORS):
        for value in FACTORS.get(name, (None,)):
            tried = replace(best, **{name: value}) if name else best
            x = np.stack([np.ones(len(y)), np.log1p(sums @ Scorer(tried).factors), np.log1p(n)], axis=1)
            b = _logistic(x, y)
            z = np.clip(x @ b, -30, 30)
            like = float((y * z - np.log1p(np.exp(z))).sum()) - 3.0 * sum(getattr(tried, k) != getattr(known, k) for k in FACTORS)
            if like > best_value + 1e-9:
                best, best_value = replace(tried, bias=float(b[0]), slope=float(max(b[1], 1e-3)), length=float(b[2])), like
    return best


def _prune(found: dict[str, tuple[float, float, int]]) -> dict[str, float]:
    """Drop a stem if the one it extends says as much: most of its witnesses are already the shorter stem's, as pure."""
    kept: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        weight, gain, _ = found[stem]
        base = stem.rstrip("$")
        shorter = next((base[:n] for n in range(min(LONG, len(base) - (not stem.endswith("$"))), SHORT - 1, -1) if base[:n] in kept), None)
        if shorter is None or weight > found[shorter][0] + 1.0:
            kept[stem] = weight
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method for a lightly ridged logistic regression; the first column is the constant."""
    b = np.zeros(x.shape[1])
    if not len(x):
        b[0] = -3.0
        return b
    ridge = np.array([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, known: Grammar, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`keep` columns and (score double, predicted int, clauses int) per row: clauses counts the toxic ones.

    Null and empty texts have no clause and get the score of no evidence. Whole texts are scored, one at a time; repeated
    rows each give a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # as large as the bounded sample allows
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double, predicted int, clauses int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            out = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], "score", "predicted", "clauses"])

    return rows.mapInArrow(giving_back(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 12_000) -> DataFrame:
    """Score every row of docs (doc_id, text), learning from labels (doc_id, toxic): see `fit` and `score`.

    Returns (doc_id, held_out boolean, score double, predicted int, clauses int); held_out is true where crc32 of doc_id
    modulo 5 is 0, and false for null ids, which are not learned from.
    """
    own = pick(docs, ["doc_id", "text"])
    return score(own.withColumn("held_out", remainder("doc_id", 5) == 0), fit(own, labels, rows), keep=("doc_id", "held_out"))
