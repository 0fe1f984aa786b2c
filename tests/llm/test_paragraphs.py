from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from blockframe.llm import paragraphs, passages

LEAST = passages.UNIT + passages.REACH - 1


def placed(text):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\S+", text or "")]


def repeated_runs(rows, least=LEAST):
    """(row, start, end, words) of all maximal runs of words that another row repeats."""
    words = [placed(t) for _, t in rows]
    met = defaultdict(set)
    for i, x in enumerate(words):
        for j in range(len(x) - least + 1):
            met[tuple(w for *_, w in x[j : j + least])].add(i)
    for i, x in enumerate(words):
        j = 0
        while j <= len(x) - least:
            k = j
            while k <= len(x) - least and len(met[tuple(w for *_, w in x[k : k + least])]) > 1:
                k += 1
            if k > j:
                yield i, x[j][0], x[k + least - 2][1], x[j : k + least - 1]
            j = k + 1


def spans(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def held(found, words):
    return sum(any(r.start <= s and e <= r.end for r in found) for s, e, _ in words)


def check_runs(rows, got):
    n = 0
    for i, _, _, words in repeated_runs(rows):
        n += 1
        # at either end fewer than REACH words may lie beyond the outermost shared window
        assert held(got[rows[i][0]], words) >= len(words) - 2 * (passages.REACH - 1)
    return n


def test_query_finds_every_repeated_run(spark, sf):
    from blockframe.llm.queries import op5_paragraphs

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = spans(op5_paragraphs(spark, sf))
    assert check_runs(rows, got) > 20
    texts = dict(rows)
    for i, found in got.items():
        for r in found:
            assert len(texts[i][r.start : r.end].split()) == r.n_words
            assert any(not k.removed for k in got[r.keeper])


def vocabulary(r, n=3000):
    return [f"v{r.randrange(10**9)}" for _ in range(n)]


def test_passages_inside_lines_and_over_line_breaks(spark):
    r = random.Random(5)
    known = vocabulary(r)
    passage = [r.choice(known) for _ in range(LEAST)]
    rows = []
    for i in range(60):
        words = [r.choice(known) for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() if i % 2 else w for w in passage]
        wrap = r.choice([7, 12, 10_000])
        rows.append((i, "\n".join(" ".join(words[j : j + wrap]) for j in range(0, len(words), wrap))))
    got = spans(paragraphs.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert set(got) == set(range(0, 60, 3))
    assert check_runs(rows, got) == 20
    # besides, windows that reach a word or two beyond the passage are alike in some
    assert all(any(r.keeper == 0 and r.removed == (i > 0) for r in found) for i, found in got.items())
    assert not any(r.removed for r in got[0])


def mutated(words, random_, edits):
    words = list(words)
    for _ in range(edits):
        words[random_.randrange(len(words))] = f"w{random_.randrange(10**6)}"
    return words


@pytest.mark.parametrize("sizes", [{}, {"PAIR_LIMIT": 3, "BLOCK": 5, "PART": 7}])
def test_near_paragraphs_match_all_pairs(spark, monkeypatch, sizes):
    """One paragraph a text, so that components of all pairs are known; a crowd of near copies among them."""
    for name, size in sizes.items():
        monkeypatch.setattr(paragraphs, name, size)
    r = random.Random(9)
    known = vocabulary(r)
    base = [[r.choice(known) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(mutated(r.choice(base), r, r.choice([0, 1, 1, 2, 3, 4]))) for _ in range(150)]
    crowd = [r.choice(known) for _ in range(40)]
    texts += [" ".join(mutated(crowd, r, r.choice([1, 1, 2, 3]))) for _ in range(400)]
    sets = [frozenset(" ".join(w[j : j + 5]) for j in range(len(w) - 4)) for w in (t.split() for t in texts)]
    group = list(range(len(texts)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    members = defaultdict(set)
    for a in range(len(texts)):
        members[top(a)].add(a)
    want = {frozenset(m) for m in members.values() if len(m) > 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    units = paragraphs.whole_texts(docs)
    by_node = units.select("id", "node").join(paragraphs.linked(units, docs, True), "node", "left").collect()
    found = defaultdict(set)
    for x in by_node:
        found[x.node if x.component is None else x.component].add(x.id)
    assert {frozenset(m) for m in found.values() if len(m) > 1} == want


def test_edge_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, "x"), (2, "", "x"), (3, "\n\n" + line, "x"), (3, "\n\n" + line, "x"), (None, line.upper() + " ", "x"), (4, " ".join(f"z{i}" for i in range(200_000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keeper string")
    out = paragraphs.duplicate_passages(df).collect()
    assert sorted(((r.doc_id or -1), r.start, r.end, r.n_words, r.removed, r.keeper, r.n_rows) for r in out) == [
        (-1, 0, len(line), 30, True, 3, 1), (3, 2, 2 + len(line), 30, False, 3, 2),
    ]
    assert paragraphs.duplicate_passages(df.limit(0)).collect() == []
    assert paragraphs.duplicate_passages(df.where("doc_id = 4")).collect() == []


def test_units_of_a_text():
    text = "A b\nc D e\n\n" + " ".join(f"w{i}" for i in range(100))
    odd = "\u0130X \u1e9e\u3000y\x85z \U0001f600 \u2028 q"
    hashes, owner, starts, ends, lines = passages.Cutter().split([text, odd, "", text])
    for i, x in enumerate([text, odd, "", text]):
        mine = owner == i
        assert [x[s:e] for s, e in zip(starts[mine], ends[mine], strict=True)] == x.split()
    assert (hashes[owner == 0] == hashes[owner == 3]).all() and len(set(hashes.tolist())) == 105 + 6
    assert np.diff(lines[:6]).tolist() == [0, 1, 0, 0, 2]
    (found,) = passages.Cutter().units(pa.array([text, "", None, "one"]))
    flat = len(found["n"]) - found["windows"]
    assert found["n"][:flat].sum() == 106 and set(found["row"].tolist()) == {0, 3}
    starts = np.sort(found["first"][flat:][found["row"][flat:] == 0])
    assert (np.diff(starts) <= passages.REACH).all() and starts[0] < passages.REACH
    # the same words have the same name, wherever they stand
    (again,) = passages.Cutter().units(pa.array(["x y z " + text]))
    assert set(found["node"][flat:].tolist()) & set(again["node"].tolist())
    assert len(set(found["node"].tolist())) == len(found["node"])
    (none,) = passages.Cutter(whole=True).units(pa.array(["", None, " "]))
    assert none["n"].tolist() == [0, 0, 0] and len(set(none["node"].tolist())) == 1
