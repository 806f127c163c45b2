from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import licenses, queries
from lettermill.llm.decontaminate import words_of
from tests.llm.helpers import DOCS, LONG, ODD, documents, texts_of

MIT = licenses.TEMPLATES["MIT-permission"]


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 5))
def test_winnowing_equals_the_plain_rule(keys, window):
    array = np.array(keys, np.uint64)
    w = min(window, len(keys)) if keys else window
    expected = {k for at in range(len(keys) - w + 1) for k in range(at, at + w) if keys[k] == min(keys[at : at + w])}
    assert licenses.winnow(array, window).tolist() == sorted(expected)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(words_of(MIT)) - 6), st.integers(6, 20))
def test_any_run_long_enough_shares_a_fingerprint(start, size):
    index = licenses.TemplateIndex({"t": MIT})
    run = " ".join(words_of(MIT)[start : start + size])
    assert index.hits(index.items.numbers(f"zz yy {run} xx ww"))


def test_spans_coverage_and_edits(spark):
    edited = MIT.replace("free of charge", "at no charge").replace("documentation files", "docs")
    texts = [
        (1, f"Header.\n{MIT}\nBody"), (2, f"x {edited} y"), (3, "Released under the\nMIT   License. And Released under the MIT License!"),
        (4, "the license of this software is free"), (5, " ".join(MIT.split()[:12])),
    ]
    found = licenses.scan_licenses(documents(spark, texts)).collect()
    rows = {(r["doc_id"], r["template"]): r for r in found}
    assert rows[1, "MIT-permission"]["coverage"] == 1.0
    assert texts[0][1][rows[1, "MIT-permission"]["start"] : rows[1, "MIT-permission"]["end"]] == rows[1, "MIT-permission"]["passage"]
    assert 0.8 < rows[2, "MIT-permission"]["coverage"] < 1.0
    assert sum(r["doc_id"] == 3 and r["template"] == "MIT" for r in found) == 2
    assert {r["doc_id"] for r in found} == {1, 2, 3}


def test_query_finds_every_notice(spark, sf_dir):
    found = {(r["doc_id"], r["template"]) for r in queries.op2_license_scan(spark, sf_dir).collect()}
    short = {k: " ".join(words_of(v)) for k, v in licenses.TEMPLATES.items()}
    plain = {i: f" {' '.join(words_of(t))} " for i, t in texts_of(sf_dir).items()}
    expected = {(i, k) for i, t in plain.items() for k, v in short.items() if f" {v} " in t}
    assert expected <= found
    # What is more has most of a template's words in a row.
    assert all(sum(w in plain[i] for w in short[k].split()) >= 0.75 * len(short[k].split()) for i, k in found)


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, (30, LONG + MIT), (30, LONG + MIT), (None, MIT)], "coverage")
    found = licenses.scan_licenses(docs).collect()
    assert sorted((r["doc_id"] for r in found if r["template"] == "MIT-permission"), key=repr) == [30, 30, None]
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.scan_licenses(docs, {"none": "two words"}).count() == 0
