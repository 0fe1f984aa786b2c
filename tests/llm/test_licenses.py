from __future__ import annotations

import random
import re

from blockframe.llm import licenses
from blockframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w = words(text)
    return [(i, label) for i in range(len(w)) for p, label in PHRASES.items() if tuple(w[i : i + len(p)]) == p]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def labels(text):
    """Labels of notices whose words stand in a text without a change."""
    w = f" {' '.join(words(text))} "
    return {label for label, all_ in licenses.NOTICES.items() for n in all_ if f" {' '.join(words(n))} " in w}


def test_query_base_and_exact_notices(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_licenses"](spark, folder).collect()}
    assert set(got) == set(docs)
    added = 0
    for i, text in docs.items():
        found, r = base(text), got[i]
        assert (r.n_words, r.n_base) == (len(words(text)), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        own = {label for _, label in found}
        assert r.base_labels == ",".join(sorted(own)) and set(r.labels.split(",")) - {""} >= own | (labels(text) - {"agpl", "lgpl"})
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1 and (r.score == 1) >= bool(found)
        added += r.labels != r.base_labels
    assert added > 0  # the method finds labels that no phrase has


def spell(notice, change, rng):
    w = words(notice)
    for _ in range(change):
        kind, at = rng.choice("sdi"), rng.randrange(1, len(w) - 1)
        if kind == "s":
            w[at] = "zebra"
        elif kind == "d":
            del w[at]
        else:
            w.insert(at, "zebra")
    return w


def test_changed_notices_by_brute_force(spark):
    """Each notice with some changes inside other prose: found wherever its words are alike enough."""
    rng, rows, want = random.Random(4), [], {}
    for label, all_ in licenses.NOTICES.items():
        for notice in all_:
            for change in (0, 1, 2, 4):
                w = spell(notice, change, rng)
                share = 1 - edits(w, words(notice)) / max(len(w), len(words(notice)))
                text = " ".join([f"lorem{rng.randrange(99)}" for _ in range(30)] + w + [f"ipsum{rng.randrange(99)}" for _ in range(30)])
                want[len(rows)] = (label, share, max((1 - edits(w, words(n)) / max(len(w), len(words(n))), k) for k, ns in licenses.NOTICES.items() for n in ns)[0])
                rows.append((len(rows), text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    hits = [(i, label) for i, (label, share, best) in want.items() if share >= 0.85 and share == best]
    assert len(hits) > 40
    for i, label in hits:
        assert label in got[i].labels, rows[i]
    clean = spark.createDataFrame([(1, "the terms of the sale are subject to the law of the land and permission to use it is not granted under any conditions")], "doc_id long, text string")
    assert licenses.scan(clean).first().labels == []


def test_odd_rows(spark):
    long = "word " * 100_000 + "Released under the MIT License. " * 300 + "Licensed under CC BY-NC 4.0 " * 50
    rows = [(1, None), (2, ""), (3, "..."), (4, "MIT  License mit-license"), (4, "Apache License"), (4, "Apache License"), (None, "GNU General Public License"), (5, long), (6, "mit"), (7, "ÀMIT license mit lICENSE")]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], "doc_id long, text string, labels string, base array<int>")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    by = sorted(((r.doc_id, r.n_words, len(r.base), r.labels, r.score) for r in got), key=repr)
    assert (1, 0, 0, [], 0.0) in by and (2, 0, 0, [], 0.0) in by and (3, 0, 0, [], 0.0) in by and (6, 1, 0, [], 0.0) in by
    assert [x for x in by if x[0] == 4] == [(4, 2, 1, ["apache"], 1.0)] * 2 + [(4, 4, 2, ["mit"], 1.0)]
    assert (None, 4, 1, ["gpl"], 1.0) in by and (7, 4, 1, ["mit"], 1.0) in by
    assert (5, 100_000 + 1500 + 350, 300, ["cc-by-nc", "mit"], 1.0) in by
    assert licenses.scan(df.limit(0)).collect() == []


def test_best_notice_of_a_place_wins(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-SA 4.0"), (2, "licensed under CC BY 4.0."), (3, "Licensed under CC BY-NC 4.0")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {1: ["cc-by-sa"], 2: ["cc-by"], 3: ["cc-by-nc"]}
