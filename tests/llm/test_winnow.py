"""Fingerprints against their definition."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskrules.llm import winnow
from riskrules.llm.queries import op12_fingerprints
from riskrules.llm.shared import read


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    read(spark, "/root/testdata/sf0.001", "benchmark")


def gram(text):
    h = [0, 0]
    for c in text:
        h = [(x * b + ord(c) + 1) % winnow.PRIME for x, b in zip(h, winnow.BASES)]
    return h[0] << 31 | h[1]


def by_definition(text, k=winnow.K, width=winnow.WIDTH):
    if not text:
        return []
    k = min(k, len(text))
    h = [gram(text[i : i + k]) for i in range(len(text) - k + 1)]
    width = min(width, len(h))
    chosen = {max((j for j in range(i, i + width)), key=lambda j: (-h[j], j)) for i in range(len(h) - width + 1)}
    return [(h[j], j) for j in sorted(chosen)]


def hexed(found):
    return "".join(f"{h:016x}{at:08x}" for h, at in found)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abé𝄞 ", max_size=60), max_size=5), st.integers(1, 7), st.integers(1, 9))
def test_prints_by_definition(texts, k, width):
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    cuts = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    got = winnow.as_text(winnow.prints(points, cuts, k, width), len(texts)).to_pylist()
    assert got == [hexed(by_definition(t, k, width)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", max_size=80), st.text(alphabet="ab", max_size=80), st.text(alphabet="ab", min_size=47, max_size=60))
def test_shared_passages_line_up(lead, tail, passage):
    """A passage of k + width - 1 code points is found, at places that line it up."""
    a, b = hexed(by_definition(lead + passage)), hexed(by_definition(passage + tail))
    assert any(p - q == len(lead) for p, q in winnow.shared_places(a, b))
    assert all((lead + passage)[p : p + 16] == (passage + tail)[q : q + 16] for p, q in winnow.shared_places(a, b))


def test_query_against_definition(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 7 - 90, "".join(rng.choice("abc é𝄞\n") for _ in range(rng.choice([0, 1, 5, 15, 16, 40, 47, 48, 300]))), "x") for i in range(70)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "same text " * 30, "x"), (1003, "same text " * 30, "x"), (2**62, "far " * 40, "x"), (-(2**62), "near", "x"), (1004, "ab" * 400_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12_fingerprints(spark, str(tmp_path)).collect()}
    texts = [(i, t or "") for i, t, _ in sorted(rows, key=lambda r: -r[0])]
    assert len(got) == len(rows)
    small = [j for j, (i, _) in enumerate(texts) if i not in (1004, 1005)]
    for j in small:
        i, t = texts[j]
        nxt = texts[(j + 1) % len(texts)][1]
        if len(nxt) > 10_000:
            continue
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        a, b, c = by_definition(t), by_definition(edit), by_definition(nxt)
        assert tuple(got[i])[1:] == (len(t), hashlib.sha256(edit.encode()).hexdigest(), hexed(a), hexed(b), alike(a, b), alike(a, c))
    assert got[1004]["n_chars"] == 800_000 and got[1003]["near_next"] == 1.0


@pytest.mark.parametrize("rows", [[], [(5, "alone in here")], [(None, "b"), (None, "a"), (3, "c")], [(4, "dd"), (4, "dd"), (4, "cc")], [(None, None)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.against_next(df)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_chars"]) for r in got.collect() if r["doc_id"] is not None) == sorted(
        (False, i, len(t)) for i, t in rows if i is not None
    )
    assert got.count() == len(rows)
    if len(rows) == 1 and rows[0][0]:
        t = rows[0][1]
        assert got.first()["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest()


def test_fingerprints_keep_other_columns(spark):
    rows = [(1, "hello " * 50, "old"), (2, None, "old"), (3, "hello " * 50, None)]
    got = winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"))
    assert got.columns == ["doc_id", "text", "fingerprint"]
    assert [r["fingerprint"] for r in got.orderBy("doc_id").collect()] == [hexed(by_definition(t or "")) for _, t, _ in rows]
