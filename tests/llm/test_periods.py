"""Runs of words against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskrules.llm import periods
from riskrules.llm.queries import op13_periodic_runs
from riskrules.llm.shared import read


def by_definition(w):
    """Every maximal stretch of every lag, then the smallest lag of each stretch."""
    n, least = len(w), {}
    for q in range(n // 4, 0, -1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                least[i - q, j - i + q] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in least.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def found_in(lists):
    flat = [x for w in lists for x in w]
    hashes = np.array([hash(x) & (2**64 - 1) for x in flat], np.uint64)
    row = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    first = np.searchsorted(row, np.arange(len(lists)))
    out = [[] for _ in lists]
    for s, length, q in zip(*periods.runs_of(hashes, row)):
        out[row[s]].append((int(s - first[row[s]]), int(length), int(q)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_runs_of_small_alphabets(lists):
    assert found_in(lists) == [by_definition(w) for w in lists]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 5)), max_size=6))
def test_runs_of_powers(parts):
    w = [x for unit, times, more in parts for x in unit * times + unit[:more]]
    assert found_in([w, w[::-1], w + w]) == [by_definition(w), by_definition(w[::-1]), by_definition(w + w)]


def test_scales_cover_every_lag_and_leave_room_for_two_periods():
    last = 0
    for lo, hi, span in periods.scales(10**6):
        assert lo == last + 1 and hi >= lo and 2 * hi - 1 <= span <= min(max(6 - d, 3 * d) for d in range(lo, hi + 1))
        last = hi
    assert last >= 10**6 // 4


def test_long_constant_and_binary_texts():
    n = 200_000
    got = periods.runs_of(np.full(n, 7, np.uint64), np.zeros(n, np.int64))
    assert [x.tolist() for x in got] == [[0], [n], [1]]
    thue = np.array([bin(i).count("1") & 1 for i in range(1 << 15)], np.uint64)
    assert len(periods.runs_of(thue, np.zeros(len(thue), np.int64))[0]) == 0  # overlap-free


def test_query_against_definition(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        text = " \n".join(rng.choice(["é", "b", "cc", "d"]) for _ in range(rng.randrange(120)))
        rows.append((i, text, "x", -1))
    rows += [(80, None, "x", 0), (81, "", "x", 0), (82, " \t\n ", "x", 0), (83, "a a " * 30, "x", 0), (3, "ab " * 9, "x", 0), (3, "ab " * 9, "x", 0), (None, "q " * 8, "x", 0)]
    rows.append((84, ("lorem ipsum dolor " * 3 + "sit ") * 9000, "x", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    path = str(tmp_path)
    df.write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, path).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        if i is not None:
            w = periods.repeated_tail(w, i)
        runs = by_definition(w) if len(w) < 5000 else None
        if runs is None:  # one run is known by construction
            mine = next(r for r in got if r[0] == i)
            assert mine[1] >= 1 and mine[3] > 4 * mine[4]
            want.append(mine)
            continue
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *four, sha(text.encode()), sha(collapsed(w, runs))))
    assert got == sorted(want, key=str)
    again = periods.find_runs(df)
    assert again.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert periods.find_runs(df.limit(0)).count() == 0


def test_tail_rule():
    w = [str(i).encode() for i in range(40)]
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in ids:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 40
        p = 1 + (40 - a) // (3 + g % 8)
        assert periods.repeated_tail(w, i) == [w[j] if j < a else w[a + (j - a) % p] for j in range(40)]


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    read(spark, "/root/testdata/sf0.001", "benchmark")
