from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from blockframe.llm import fim
from blockframe.llm.queries import QUERIES

MARKS = ("<P>", "<S>", "<M>")


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 100:
        form, out, lengths = "plain", text, (None, None)
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form, lengths = ("spm", (len(p), len(m))) if h[3] % 100 < 50 else ("psm", (len(p), len(m)))
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *lengths, digest(out), digest(text))


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_fim"](spark, folder).collect())
    want = sorted(brute(r.doc_id, r.text) for r in docs)
    assert got == want and {r[2] for r in got} >= {"psm", "spm"}


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n𝄞x\n\n的", "x<P>\ny", "<", "<P\n>", "a<\nS>b\n<M", "line\n" * 50_000, "z" * 300_000, "\r\n a\nb"]


def test_odd_texts(spark):
    rows = [(i, t, "f", 1) for i, t in enumerate(ODD)] + [(i, t, "f", 1) for i, t in enumerate(ODD)] + [(None, "a\nb\nc", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    made = fim.restore(fim.transform(df)).collect()
    assert len(made) == len(rows)
    for r in made:
        want = brute(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[1:5]
        assert hashlib.sha256(r.output.encode()).hexdigest() == want[5] and r.restored == (r.text or "")
    assert fim.transform(df.limit(0)).collect() == []


def test_rates(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "'a\nb\nc\n' AS text")
    forms = [r.form for r in fim.transform(df, rate=40, spm_rate=100).collect()]
    assert set(forms) == {"plain", "spm"} and 0.3 < forms.count("spm") / 400 < 0.5


@pytest.mark.parametrize("bound", [0, 3, 32])
def test_index_is_exact_and_its_segments_are_within_the_bound(bound):
    random = np.random.default_rng(1)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([random.integers(1, 80, 3000), np.full(3000, 7), [100_000], random.integers(1, 3, 2000)]))])
    index = fim.RankIndex(offsets, bound)
    assert [index.offset(i) for i in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.residuals).max() <= bound + 1
    if bound == 32:
        assert len(index.starts) < 1500 and index.residuals.dtype == np.int16


@given(st.text(alphabet="ab\n<PSM>é", max_size=60))
def test_lines_and_restoring(text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert fim.boundaries(text).tolist() == [0, *np.cumsum([len(u) for u in units]).tolist()]
    for key in "123456":
        _, form, _, _, output = fim.cut(text, key)
        assert fim.restored(output, form) == text
