from __future__ import annotations

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from blockframe.llm import pii


def naive(text: str):
    """The fixed patterns, written down as they are defined."""
    spans = []
    for kind, pattern in enumerate(
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), kind, m.end()))
    return sorted(spans)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aA0123459.@+-() _%é", max_size=60))
def test_base_spans_any_text(text):
    assert pii.base_spans(text) == naive(text)


def test_base_spans_of_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert pii.base_spans(r.text) == naive(r.text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1(" * 100_000, "@" * 300_000):
        pii.base_spans(text)
        pii.candidate_spans(text[:20_000], [])


def contextual_docs():
    random.seed(8)
    docs = []
    for i in range(40):  # seeds after a label, in varying company
        number = "".join(random.choice("0123456789") for _ in range(7))
        docs.append(f"Dear {random.choice(['sir', 'madam'])} my phone: +1 (555) {number[:3]}-{number[3:]} today {i}")
    for _ in range(10):  # local numbers after the same label, which the fixed patterns miss
        docs.append(f"order {random.choice(['sent', 'kept'])} with phone: 0{random.randint(10, 99)} {random.randint(1000000, 9999999)} as agreed")
    for i in range(30):
        docs.append(f"the invoice total was {random.randint(10**6, 10**7)} units on line {i}")
    return docs


def test_patterns_find_what_the_base_misses(spark):
    docs = contextual_docs()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    patterns = pii.learn_patterns(df)
    assert ("phone", "phone: _") in {tuple(r) for r in patterns.collect()}
    found = {r.doc_id: (r.base_spans, r.spans) for r in pii.find(df, patterns).collect()}
    for i, text in enumerate(docs):
        base, spans = found[i]
        assert [tuple(x) for x in base] == [("email ip card phone".split()[k], s, e) for s, k, e in naive(text)]
        added = len(spans) - len(base)
        assert added == (1 if 40 <= i < 50 else 0)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "mail a.b@c.de now", "x")], "doc_id long, text string, spans string")
    patterns = pii.learn_patterns(df)
    assert patterns.collect() == []
    rows = sorted(pii.find(df, patterns).collect(), key=lambda r: (r.doc_id, len(r.spans)))
    assert [[tuple(s) for s in r.spans] for r in rows] == [[], [], [("email", 5, 13)]]
    clean = sorted((r.doc_id, r.text) for r in pii.redact(df, patterns).where("text is not null").collect())
    assert clean == [(2, ""), (2, "mail <EMAIL> now")]
    assert pii.find(df.limit(0), pii.learn_patterns(df.limit(0))).collect() == []


def test_found_instances_induce_patterns(spark):
    """Numbers that a label's pattern finds occur after other words too, where no seed does; so do numbers only found there."""
    r = random.Random(3)
    docs = contextual_docs()
    found = [re.search(r"phone: (0\d+ \d+)", x).group(1) for x in docs[40:50]]
    docs += [f"please ring the office at {x} before noon" for x in found]
    docs += [f"please ring the office at 0{r.randint(10, 99)} {r.randint(1000000, 9999999)} before noon" for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    patterns = pii.learn_patterns(df)
    assert ("phone", "office at _") in {tuple(x) for x in patterns.collect()}
    one = pii.learn_patterns(df, rounds=1)
    assert ("phone", "office at _") not in {tuple(x) for x in one.collect()}
    added = {x.doc_id for x in pii.find(df, patterns).collect() if len(x.spans) > len(x.base_spans)}
    assert added == set(range(40, 50)) | set(range(80, 93))


def test_many_patterns_are_joined(spark, monkeypatch):
    docs = contextual_docs()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(docs)] + [(99, None, None), (5, docs[45], None)], "doc_id long, text string, more string")
    patterns = pii.learn_patterns(df)
    want = sorted((x.doc_id, x.spans) for x in pii.find(df, patterns).collect())
    clean = sorted((x.doc_id, x.text or "") for x in pii.redact(df, patterns).collect())
    monkeypatch.setattr(pii, "SENT", 0)
    joined = pii.find(df, patterns)
    assert joined.columns == ["doc_id", "text", "more", "base_spans", "spans"]
    assert sorted((x.doc_id, x.spans) for x in joined.collect()) == want
    assert sorted((x.doc_id, x.text or "") for x in pii.redact(df, patterns).collect()) == clean


def test_query_base_spans(spark, sf):
    from hashlib import sha256

    from blockframe.llm.queries import op4_pii

    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        base = [(pii.KINDS[k], s, e) for s, k, e in naive(texts[x.doc_id])]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert x.base_sha256 == sha256(listed.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert set(listed.split(",")) <= set(x.spans.split(","))


def _slow_candidates(text, base):
    taken, found = [(s, e) for s, _, e in base], []
    for kind, (_, pattern) in enumerate(pii._CANDIDATES):
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e in taken):
                found.append((m.start(), kind, m.end()))
                taken.append((m.start(), m.end()))
    return sorted(found)


def test_candidates_equal_a_comparison_of_all_and_are_linear():
    rng = random.Random(9)
    pieces = ["a@b.co ", "x [at] y [dot] com ", "555-0199 222 ", "1.2.3.4 ", "2001:db8:0:1:2:3:4:5 ", "4111 1111 1111 1111 ", "+1 555 123 4567 ", "12345678901234 ", "word ", "(555) 010 9999", "a(at)b.c"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        base = pii.base_spans(text)
        assert pii.candidate_spans(text, base) == _slow_candidates(text, base)
    text = "call 555 0199 222 now; " * 100_000
    start = time.perf_counter()
    assert len(pii.candidate_spans(text, pii.base_spans(text))) == 100_000
    assert time.perf_counter() - start < 5
