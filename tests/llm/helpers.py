"""Small tables with whatever an operator must bear: nulls, empty and very long texts, repeated rows, clashing names."""

import random

#: Names that operators use inside; as extra columns they must not matter.
CLASHING = ["key", "sum", "pos", "line", "score", "bin", "item", "shift", "shard", "slot", "arc", "cell", "fp", "u", "v", "w", "h", "hash", "rank", "id", "range", "data", "n", "term", "spans", "first", "n_lines"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def docs(spark, rows):
    """rows: (doc_id, text), or with lang and source."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHING)))
    return spark.createDataFrame(full, SCHEMA)


def no_docs(spark):
    return docs(spark, [(0, "")]).where("false")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    names = [f"{a}{b}" for a in "ba de fi go ku la me ni po ru sa te vi wo".split() for b in "nar lim dos tek ram sul pin gor mak ven tos lur dem zin fal hok bir cas jun wet".split()]
    return " ".join(rng.choice(names[: min(vocabulary, len(names))]) for _ in range(words))


def hard_rows(seed=0):
    """(doc_id, text) rows: prose, repeated rows and texts, odd characters, and a very long text."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 90))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "1234 !!"), (44, "é ß 中文 🙂 Ünï"), (45, prose(rng, 12_000)), (46, "a" * 30_000), (None, "no id here at all"), (None, None)]
    rows += [rows[0], rows[0], (50, rows[1][1]), (51, rows[1][1]), (7, "another text under an id that is taken")]
    return rows
