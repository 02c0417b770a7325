"""Personal data by information-theoretic sanitisation; DataFrame operations only.

Patterns find protected entities: mail and IP addresses, card and phone numbers, and secrets (keys and tokens of mixed
letters and digits). Corpus co-occurrence then tells how much a term gives an entity away in its absence: the share of
the entity's information that the term carries,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N co(t, e) / (df(t) df(e))) / log(N / df(e)) = 1 + log P(e | t) / IC(e),

which is 1 if the term is only seen with the entity. A term is with an entity where it stands within REACH characters of
it, so a page of thousands of addresses gives a bounded number of pairs for each. Most entities occur once, so what a
term needs is not many occurrences of the entity but to be known itself: seen in enough documents, of which near copies
around the entity are one. How rare it must be follows from the corpus: at a threshold of 0.8 and an entity seen once,
one of N ** 0.2 occurrences or more is by the entity. Terms over a threshold are generalised, those over a higher one
removed, in the documents that hold the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcq.llm.common import connected_components, durable, is_small, pick

KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds. Possessive, and begun only where a run of their signs begins or the last match ended: that
# finds the same matches and reads long runs once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: A run of letters that is a word of its own, not part of a key.
TERM = r"(?<![\p{L}\p{N}])\p{L}{4,}+(?!\p{N})"
#: Protected by the method, beside the four kinds: long runs that change from letters to digits again and again.
SECRET, MIXED = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+", "(?:[A-Za-z]++[0-9]++){4}"
#: Every kind of entity, in the order in which spans are listed.
ENTITIES = (*KINDS, "secret")
#: Characters on either side of an entity in which terms are with it; rows of keys that may be broadcast at most.
REACH, BROADCAST_ROWS = 400, 200_000
SPAN = "struct<start:int,end:int,entity:bigint,before:string,after:string>"
#: Masks that order 64-bit hashes anew, three to a band.
MASKS = [0x9E3779B97F4A7C15 * i % 2**63 for i in range(1, 13)]


def _luhn(digits: Column) -> Column:
    """True if the digits pass the check sum that doubles every second one from the right."""
    def value(i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    terms = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _sound(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, keep, entity, reach: int = 0) -> Column:
    """Spans of the matches that `keep` holds for, with up to `reach` characters on either side, as far as the next match
    and without words that are cut. The gaps between matches, from a split, tell where each one starts."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), F.slice(gaps, 2, F.size(found)).alias("next"))

    def before(gap: Column) -> Column:
        return F.when(F.char_length(gap) > reach, F.regexp_replace(F.right(gap, F.lit(reach)), r"^[\p{L}\p{N}]+", "")).otherwise(gap) if reach else F.lit("")

    def after(gap: Column) -> Column:
        return F.when(F.char_length(gap) > reach, F.regexp_replace(F.left(gap, F.lit(reach)), r"[\p{L}\p{N}]++$", "")).otherwise(gap) if reach else F.lit("")

    sized = F.transform(pairs, lambda p: F.struct(
        F.char_length(p["gap"]).alias("gap"), F.char_length(p["match"]).alias("len"), keep(p["match"]).alias("ok"), entity(p["match"]).alias("entity"),
        before(p["gap"]).alias("before"), after(p["next"]).alias("after")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["entity"].alias("entity"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sized, start, step, lambda acc: acc["out"])


#: What a text has if it has a span of a kind; cheaper to look for.
CHEAP = {
    "email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("(?:[0-9][ -]?){13}"), "secret": lambda t: t.rlike("[0-9][A-Za-z]++[0-9]")}


def _entities(text: Column, kind: str) -> Column:
    pattern, sound = (SECRET, lambda m: m.rlike(MIXED)) if kind == "secret" else (PATTERNS[kind], lambda m: _sound(kind, m))
    spans = _spans(text, pattern, sound, lambda m: F.xxhash64(F.lit(kind), F.lower(m)), REACH)
    return F.when(CHEAP[kind](text), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sum, email, ip, card, phone, secret): the spans of each kind per row, code points from 0, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("text").alias("sum"), *[_entities(text, k).alias(k) for k in ENTITIES])


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _passages(base: DataFrame) -> DataFrame:
    """(sum, n, near, around): per distinct text with an entity its rows, its (entity, term) pairs, and what is around entities."""
    spans = F.concat(*ENTITIES)
    some = base.where(F.size(spans) > 0).select("sum", spans.alias("spans"))
    some = some.groupBy("sum").agg(F.count("*").alias("n"), F.any_value("spans").alias("spans"))
    around = F.transform("spans", lambda s: F.concat_ws(" | ", s["before"], s["after"]))
    near = F.transform("spans", lambda s: F.transform(_terms(F.concat_ws(" | ", s["before"], s["after"])), lambda t: F.struct(s["entity"].alias("entity"), t.alias("term"))))
    return some.select("sum", "n", F.array_distinct(F.flatten(near)).alias("near"), F.array_join(around, " | ").alias("around"))


def disclosing_terms(docs: DataFrame, base: DataFrame, threshold: float, least_docs: int, passages: DataFrame | None = None) -> DataFrame:
    """(entity, term, disclosure): the terms over `threshold`, of docs (text) and their `base_spans`.

    All rows count in N, df and co. A term counts if `least_docs` documents or more have it; of those that have it near the
    entity, near copies are one. Terms are counted in all texts; what is rare is settled after that, not before.
    """
    n = base.count()
    own = _passages(base) if passages is None else passages
    pairs = own.select("sum", "n", F.explode("near").alias("p")).join(_witnesses(own.select("sum", F.col("around").alias("text"))), "sum")
    pairs = pairs.groupBy("p", "witness").agg(F.sum("n").alias("n")).groupBy("p").agg(F.sum("n").alias("co"), F.count("*").alias("witnesses"))
    pairs = pairs.select("p.entity", "p.term", "co", "witnesses")
    sizes = own.select("n", F.explode(F.array_distinct(F.transform("near", lambda p: p["entity"]))).alias("entity")).groupBy("entity").agg(F.log(float(n) / F.sum("n")).alias("ic"))
    pairs = durable(pairs.join(sizes.where(F.col("ic") > 0), "entity"))
    known = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    scored = pairs.join(known, "term").where(F.col("df") - F.col("co") + F.col("witnesses") >= least_docs)
    return scored.select("entity", "term", (F.log(F.col("co") / F.col("df")) / F.col("ic") + 1).alias("disclosure")).where(F.col("disclosure") >= threshold)


def _witnesses(texts: DataFrame) -> DataFrame:
    """(sum, witness) of texts (sum, text): near copies, which share a band, and what they link have one witness.

    A band is three least hashes of four words in a row: of four bands near copies almost surely share one, others none.
    """
    def least(mask: int) -> Column:
        return F.array_min(F.transform("grams", lambda g: g.bitwiseXOR(F.lit(mask))))

    words = texts.dropDuplicates(["sum"]).select("sum", F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)).alias("words"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - 3))
    grams = words.select("sum", F.transform(places, lambda i: F.xxhash64(F.slice("words", i, 4))).alias("grams"))
    bands = [F.xxhash64(F.lit(k), *map(least, MASKS[k : k + 3])) for k in range(0, len(MASKS), 3)]
    linked = connected_components(grams.select(F.col("sum").alias("u"), F.explode(F.array(*bands)).alias("v")))
    return texts.select("sum").distinct().join(linked.select(F.col("v").alias("sum"), F.col("component").alias("witness")), "sum")


def find(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, least_docs: int = 3) -> DataFrame:
    """(doc_id, sum, email, ip, card, phone, secret, term): spans per row of docs (doc_id, text); other columns are ignored.

    Spans are array<struct<start, end, entity>>; those of `term` have disclosure and remove instead of an entity: they are
    to be removed at `remove` or more and generalised below, and may lie within an entity. A null text is empty. `sum` is a
    checksum of the text, by which rows meet their terms: repeated rows, and equal texts under other ids, each give a row
    with the same spans. Rows of a null id count and get terms like others. No documents give no rows.
    """
    own = pick(docs, ["doc_id", "text"])
    base = durable(base_spans(own))
    passages = durable(_passages(base))
    telling = durable(disclosing_terms(own, base, generalise, least_docs, passages))
    held = passages.select("sum", F.explode(F.array_distinct(F.transform("near", lambda p: p["entity"]))).alias("entity"))
    marks = durable(held.join(telling, "entity").groupBy("sum", "term").agg(F.max("disclosure").alias("d")))
    by_text = marks.groupBy("sum").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("marks"))  # no more than the text has
    by_text = F.broadcast(by_text) if is_small(marks, BROADCAST_ROWS) else by_text
    spans = _spans(F.col("text"), TERM, lambda m: F.map_contains_key("marks", F.lower(m)), lambda m: F.coalesce(F.round(F.element_at("marks", F.lower(m)) * 1_000_000), F.lit(0)).cast("long"))
    spans = F.transform(spans, lambda s: F.struct(s["start"], s["end"], (s["entity"] / 1_000_000).alias("disclosure"), (s["entity"] >= remove * 1_000_000).alias("remove")))
    added = own.select("text", F.xxhash64("text").alias("sum")).join(by_text, "sum").select("sum", spans.alias("term")).groupBy("sum").agg(F.any_value("term").alias("term"))
    added = durable(added)  # so that the join below is of plain shuffles, which are split where one text has very many rows
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double,remove:boolean>>")
    plain = [F.transform(k, lambda s: F.struct(s["start"], s["end"], s["entity"])).alias(k) for k in ENTITIES]
    return base.join(added, "sum", "left").select("doc_id", "sum", *plain, F.coalesce("term", none).alias("term"))


def sanitise(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): the texts with entities replaced by their kind, terms by [TERM] or nothing; null texts stay null.

    Where spans overlap, all that any of them covers goes.
    """
    found = find(docs) if found is None else found
    found = found.dropDuplicates(["doc_id", "sum"])

    def masked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.lit(f"[{kind.upper()}]").alias("mask")))

    terms = F.transform("term", lambda s: F.struct(s["start"], s["end"], F.when(s["remove"], "").otherwise("[TERM]").alias("mask")))
    spans = F.concat(*map(masked, ENTITIES), terms)
    own = pick(docs, ["doc_id", "text"]).withColumn("sum", F.xxhash64("text"))
    marks = found.select(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum"), F.array_sort(spans).alias("spans"))
    own = own.join(marks, own["doc_id"].eqNullSafe(marks["_id"]) & (own["sum"] == marks["_sum"]), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, s["mask"]).alias("out"))).otherwise(acc)

    clean = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.char_length("text"))))
    return own.select("doc_id", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_found) of `find`'s rows."""
    def written(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*[written(k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("secret"), written("term")), ",").alias("spans"), F.size("secret").cast("long").alias("n_secret"),
        F.size("term").cast("long").alias("n_term"), sum(F.size(k) for k in (*ENTITIES, "term")).cast("long").alias("n_found"))
