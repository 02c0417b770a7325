import hashlib
import math
import random
import re
from collections import Counter

import pytest

from graphcq.llm import pii
from tests.llm.helpers import docs, hard_rows, no_docs, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, match):
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in match.split("."))
    digits = [int(c) for c in match if "0" <= c <= "9"]
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(doc_id, text):
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if sound(k, m.group())] for k, p in PATTERNS.items()]
    flat = ",".join(s for x in found for s in x)
    return (doc_id, *map(len, found), hashlib.sha256(flat.encode()).hexdigest(), flat)


def odd_rows():
    rng = random.Random(0)
    signs = ["a", "b@", "@", "c.d", ".", "x@y.z", "1", "23", "4111 1111-1111 1111", "255", ".256", "1.2.3.4", "+", "+1 (988) 555-2485", " ", "-", "--", "  ", "é", "🙂", "_", "%", "٣", "(", ")", "\n", "4539578763621486"]
    rows = [(3000 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(30)))) for i in range(400)]
    rows += [(1, "a@b.c_d@e.f x@y@z.com 1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255 4111  1111 a@b"), (2, "1" * 50_000), (3, "a@b.c " * 700), (4, "1 " * 20_000), (5, "a" * 20_000 + "@"), (6, "1.2.3.4 " * 500)]
    return rows


def test_base_spans_against_brute_force(spark):
    rows = hard_rows() + odd_rows()
    got = pii.digest(pii.find(docs(spark, rows))).collect()
    assert Counter(str(tuple(r)[:6]) for r in got) == Counter(str(brute(*r)[:6]) for r in rows)
    for r in got:
        if not r.n_term:
            assert hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256


def disclosing():
    """Documents that name a person's address and project, and many that do not."""
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 30)} write to bob@corp.example.com about Zanzibar {prose(rng, 30)} thing") for i in range(6)]
    rows += [(100 + i, f"{prose(rng, 40)} thing") for i in range(60)]
    return rows + [(300, "Zanzibar alone, and ann@other.example.com"), (301, None), (302, ""), (2, rows[2][1])]


def test_terms_that_disclose(spark):
    rows = disclosing()
    found = pii.find(docs(spark, rows))
    by_id = {r.doc_id: r for r in found.collect()}
    for i in range(6):
        text = rows[i][1]
        named = [text[s.start : s.end] for s in by_id[i].term]
        assert "Zanzibar" in named and "thing" not in named
        assert all(s.remove == (s.disclosure >= 0.95) for s in by_id[i].term)
    # The term alone is not touched where the entity is not.
    assert by_id[300].term == [] and by_id[100].term == []
    row = next(r for r in pii.digest(found).collect() if r.doc_id == 0)
    assert row.n_email == 1 and "term:" in row.spans and row.spans.startswith("email:")


def test_disclosure_is_the_share_of_information(spark):
    rows = disclosing()[:-4]
    own = docs(spark, rows).select("doc_id", "text")
    got = {r.term: r.disclosure for r in pii.disclosing_terms(own, pii.base_spans(own), -9.0, 3).collect()}
    words = [set(re.findall(r"[^\W\d_]{4,}", t.lower())) for _, t in rows]
    has = ["bob@" in t for _, t in rows]
    n, df_e = len(rows), sum(has)
    for term, d in got.items():
        co, df = sum(h and term in w for h, w in zip(has, words, strict=True)), sum(term in w for w in words)
        assert d == pytest.approx(math.log(co * n / (df * df_e)) / math.log(n / df_e))
    assert got["zanzibar"] == pytest.approx(1.0) and got["thing"] == pytest.approx(0.0)


def test_witnesses_are_near_copies_and_nothing_else(spark):
    rng = random.Random(4)
    words = prose(rng, 300).split()
    near = [" ".join(words[:k] + ["altered"] + words[k + 1 :]) for k in (0, 60, 150, 299)]
    # Long texts over one small vocabulary, so that nearly all have its words, and so the least of their hashes, in common.
    others = [prose(rng, 300, 120) for _ in range(40)]
    frame = docs(spark, list(enumerate(near + near[:2] + others))).selectExpr("xxhash64(text) as sum", "text")
    got = {r.text: r.witness for r in pii._witnesses(frame).join(frame, "sum").collect()}
    assert len({got[t] for t in near}) == 1 and len({got[t] for t in others}) == 40
    rows = [(i, f"{t} bob@corp.example.com Zanzibar") for i, t in enumerate(others[:3])] + [(100 + i, t) for i, t in enumerate(others[3:])]
    found = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    assert all("Zanzibar" in [rows[i][1][s.start : s.end] for s in found[i].term] for i in range(3))


def test_terms_that_disclose_the_group_of_rare_entities(spark):
    rng = random.Random(5)
    rows = [(i, f"{prose(rng, 40)} write to {name}@corp.example.com about Zanzibar {prose(rng, 20)}") for i, name in enumerate(["ann", "bob", "eve"])]
    rows += [(100 + i, f"{prose(rng, 40)} {i}@mail.example.com") for i in range(100)] + [(500 + i, prose(rng, 40)) for i in range(2900)]
    found = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    for i in range(3):
        named = {rows[i][1][s.start : s.end]: s.disclosure for s in found[i].term}
        assert named["Zanzibar"] == pytest.approx(0.863, abs=0.001)  # log(3003 / 3) / log(3003)
    assert not any(found[100 + i].term for i in range(100))  # a domain that says little of its addresses


def brute_terms(rows, generalise=0.8, least_docs=3, reach=400):
    """The spans of terms per row, straight from the definition; texts are far from being copies of each other."""
    term = re.compile(r"(?<![^\W_])[^\W\d_]{4,}(?![^\W_])")
    kinds = {**PATTERNS, "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"}
    near, n_e, df, co, texts_with = [], Counter(), Counter(), Counter(), {}
    for _, text in rows:
        text, own = text or "", set()
        df.update({w.lower() for w in term.findall(text)})
        entities = set()
        for kind, pattern in kinds.items():
            spans = [m.span() for m in re.finditer(pattern, text)]
            for i, (a, b) in enumerate(spans):
                m = text[a:b]
                if not (re.search("(?:[A-Za-z]+[0-9]+){4}", m) if kind == "secret" else sound(kind, m)):
                    continue
                left, right = text[spans[i - 1][1] if i else 0 : a], text[b : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
                if len(left) > reach:
                    left = re.sub(r"^[^\W_]+", "", left[-reach:])
                if len(right) > reach:
                    right = re.sub(r"[^\W_]+$", "", right[:reach])
                own |= {((kind, m.lower()), w.lower()) for w in term.findall(left + " | " + right)}
        entities = {e for e, _ in own}
        n_e.update(entities)
        co.update(own)
        for p in own:
            texts_with.setdefault(p, set()).add(text)
        near.append((text, own))
    n, out = len(rows), []
    for text, own in near:
        telling = set()
        for e, w in own:
            ic = math.log(n / n_e[e])
            if ic > 0 and df[w] - co[e, w] + len(texts_with[e, w]) >= least_docs and 1 + math.log(co[e, w] / df[w]) / ic >= generalise:
                telling.add(w)
        out.append([f"term:{m.start()}:{m.end()}" for m in term.finditer(text) if m.group().lower() in telling])
    return out


def test_all_spans_against_brute_force(spark):
    rng = random.Random(9)
    names = [f"{a}{b}{c}" for a in "karl mira tovo" .split() for b in "bek dul fas gim hov".split() for c in "ana eno ito uwe".split()]
    rows = []
    for i in range(400):
        words = prose(rng, rng.randrange(20, 160)).split()
        words += rng.choices(names, k=rng.randrange(3))
        if rng.random() < 0.4:
            words += rng.choices(["ann@mail1.example.com", f"u{i}@mail2.example.com", f"10.0.{i % 250}.7", "token = 9f8e7d6c5b4a3f2e1d0c9b8a", "4539578763621486", "+1 (988) 555-2485"], k=2)
        rng.shuffle(words)
        rows.append((i if i % 50 else None, " ".join(words)))
    rows += [(7, rows[7][1]), (8, None), (9, "")]
    got = {}
    for r in pii.digest(pii.find(docs(spark, rows))).collect():
        got.setdefault(r.doc_id, []).append((r.n_term, r.spans))
    want = {}
    for (doc_id, text), terms in zip(rows, brute_terms(rows), strict=True):
        base = brute(doc_id, text)[-1]
        secret = [f"secret:{m.start()}:{m.end()}" for m in re.finditer("9f8e7d6c5b4a3f2e1d0c9b8a", text or "")]
        want.setdefault(doc_id, []).append((len(terms), ",".join([*([base] if base else []), *secret, *terms])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(n for v in got.values() for n, _ in v) > 50 and any(n for n, _ in got[None])


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'x token = "{key}" y'), (2, "averyverylongwordindeedwithoutdigits"), (3, "12345678901234567890123"), (4, f"é{key}é")]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs(spark, rows))).collect()}
    assert got[1].spans == "secret:11:51" and got[1].n_secret == got[1].n_found == 1 and got[4].spans == "secret:1:41"
    assert got[2].n_found == got[3].n_secret == 0
    assert {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}[1] == 'x token = "[SECRET]" y'


def test_sanitise(spark):
    rows = disclosing()
    got = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "bob@" not in got[0] and "Zanzibar" not in got[0] and "[EMAIL]" in got[0] and got[0].endswith("thing")
    assert got[300] == "Zanzibar alone, and [EMAIL]" and got[301] is None and got[302] == ""
    assert got[100] == rows[6][1]
    assert pii.sanitise(docs(spark, rows)).count() == len(rows)


def test_native(spark):
    plan = pii.digest(pii.find(docs(spark, disclosing())))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_no_documents(spark):
    assert pii.find(no_docs(spark)).count() == 0
