"""Periodic runs of words: online sparse diagonal DP, column by column.

A run is a stretch of consecutive words with smallest period q and a length of at
least max(6, 4 q) that no neighbouring word extends.  On the diagonal of lag q
(word i against word i - q) a run is a match that lasts ``length - q`` words.  The
words of a text are read in order; an earlier occurrence of a word at lag q adds one
to the match length of the active lag q, and a diagonal whose match ends with
sufficient length emits its run at once.

What keeps it sparse: lags are taken in scales lo..hi.  A run of such a lag matches
over at least ``span = max(6 - lo, 3 lo)`` words, so only earlier occurrences of a
word *with the span - 1 words after it* can count, and hi is at most half of the
span, so that (two periods whose sum fits in a stretch make their greatest common
divisor a period) any lag but the nearest such occurrence belongs to a run of a
smaller period.  A scale therefore has one active lag per word: the nearest earlier
occurrence.  Words whose context occurs once leave all larger scales.  A constant
text of n words costs n steps a scale, O(n log n), not n^2.

Contexts are numbered densely by sorting pairs of numbers (prefix doubling), so
only the 64-bit hashes of single words are hashes.  Texts are cut in slices of whole
rows; memory follows the slice or the longest text.

Defined results: null and empty texts have no words and no runs; ties cannot occur
between runs of one text (start, length and period name a run); repeated rows and
null ids are rows like others; an empty table gives an empty result; other columns
pass through (``n_words``, ``runs`` and ``collapsed`` are replaced if present).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, words

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least lag, greatest lag, span) of the scales that a text of ``longest`` words needs."""
    lo = 1
    while LEAST_PERIODS * lo <= longest and LEAST_WORDS <= longest:
        span = max(LEAST_WORDS - lo, (LEAST_PERIODS - 1) * lo)
        hi = (span + 1) // 2
        yield lo, hi, span
        lo = hi + 1


def _numbered(at: np.ndarray, key: np.ndarray, n: int):
    """Numbers of the keys that occur twice or more (-1 elsewhere), and each
    place's distance to the nearest earlier place with its key (0: none)."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = np.zeros(len(key) + 1, np.bool_)
    same[1:-1] = key[1:] == key[:-1]
    numbers = np.full(n, -1, np.int64)
    several = same[:-1] | same[1:]
    numbers[at[several]] = np.cumsum(~same[:-1])[several]
    lags = np.zeros(n, np.int64)
    repeat = np.flatnonzero(same[:-1])
    lags[at[repeat]] = at[repeat] - at[repeat - 1]
    return numbers, lags


def runs_of(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and period of every run of the rows, by first word, then period."""
    n = len(hashes)
    found = []
    if n:
        order = np.argsort(hashes, kind="stable")
        word = np.zeros(n, np.int64)
        word[order] = np.cumsum(np.r_[0, hashes[order][1:] != hashes[order][:-1]])
        numbers, lags = _numbered(np.arange(n), word + row * n, n)
        longest, have = int(np.bincount(row).max()), 1
        for lo, hi, span in scales(longest):
            while have < span:
                step = min(have, span - have)
                at = np.flatnonzero(numbers[: n - step] >= 0)
                at = at[(numbers[at + step] >= 0) & (row[at] == row[at + step])]
                numbers, lags = _numbered(at, numbers[at] * (n + 1) + numbers[at + step], n)
                have += step
            at = np.flatnonzero((lags >= lo) & (lags <= hi))
            if not len(at):
                if not (numbers >= 0).any():
                    break
                continue
            lag = lags[at]
            begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])])
            period = lag[begin]
            matched = np.diff(np.r_[begin, len(at)]) + span - 1
            length = matched + period
            emit = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack([at[begin] - period, length, period])[:, emit])
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(w: Words, dropped: np.ndarray) -> pa.Array:
    """Words that stay, joined by one space, per row."""
    firsts = w.firsts()
    kept = np.flatnonzero(~dropped)
    row = w.row[kept] - w.lo
    follows = np.zeros(len(kept), np.bool_)
    follows[:-1] = row[1:] == row[:-1]
    start, end = w.start[kept], w.end[kept] + follows
    text = w.raw.copy()
    text[w.end[kept[follows]]] = 0x20
    edge = np.zeros(len(text) + 1, np.int8)
    edge[start] += 1
    np.add.at(edge, end, -1)
    sizes = np.bincount(row, end - start, len(firsts) - 1).astype(np.int64)
    held = text[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(held.tobytes()))


def _found(names: list[str]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column("text")):
                firsts = w.firsts()
                n_rows = w.hi - w.lo
                start, length, period = runs_of(w.hash, w.row - w.lo)
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                row = w.row[start] - w.lo if len(start) else np.zeros(0, np.int64)
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=n_rows))].astype(np.int32)
                fields = [pa.array(start - firsts[row]), pa.array(length), pa.array(period)]
                made = {
                    "n_words": pa.array(np.diff(firsts)),
                    "runs": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(RUN))),
                    "collapsed": _collapsed(w, np.cumsum(edge[:-1]) > 0).cast(pa.string()),
                }
                rows = b.slice(w.lo, n_rows)
                yield pa.record_batch([made[c] if c in made else rows.column(c) for c in names], names=names)

    return found


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` and ``n_words``, ``runs`` (start, length, period; by start, then
    period) and ``collapsed``, the words that no run holds after its first period."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "runs", "collapsed")]
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    out = T.StructType(list(kept)).add("n_words", T.LongType()).add("runs", T.ArrayType(run)).add("collapsed", T.StringType())
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    return rows.mapInArrow(_found(out.names), out)


def repeated_tail(parts: list[bytes], doc_id: int) -> list[bytes]:
    """Words whose tail is made periodic, by a rule of the id alone (every tenth
    checksum; known runs to find again)."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(parts), h // 10
    if h % 10 or not n:
        return parts
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return parts[:a] + [parts[a + i % p] for i in range(n - a)]


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the tails of ``repeated_tail``; rows with a null id stay as they are."""

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            made = []
            for i, doc_id in enumerate(ids):
                if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
                    made.append(texts[i])
                else:
                    parts = (texts[i].as_py() or "").encode().split()
                    made.append(pa.scalar(b" ".join(repeated_tail(parts, doc_id)).decode()))
            yield pa.record_batch([b.column("doc_id"), pa.array([m.as_py() for m in made], pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tails, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("1000L * best.length div -best.less").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
