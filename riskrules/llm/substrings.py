"""Exact removal of repeated passages: seed and extend on winnowed anchors.

Every window of ``window`` consecutive words names one anchor: its least hashed
run of about a quarter as many words (leftmost on ties), a function of the window's
words alone.  Equal windows therefore meet at equal anchors, and an anchor's
neighbouring windows form one cell, the anchor extended both ways as far as
windows name it.

1. Seeds: anchors are joined by hash; those of two or more documents stay, as a
   fixed-size bit filter.
2. Extension: cells of shared anchors.  Equal cells of many documents collapse
   into one with the smallest id (aggregation, combined map-side: a passage in a
   third of all documents costs one partial row per task).  All windows of a cell
   repeat in every document but that first one.  For the first, cells of anchors
   that have several distinct cells are opened into windows, and the windows that
   another cell holds with a smaller id are kept as a bit mask.  Neighbouring cells
   of a document form chains (cells of opened anchors stand alone); equal chains of
   many documents collapse first, cells are taken from the distinct chains only, and
   a document meets its verdict once a distinct chain, not once a cell.  Cells of one document
   without a repeated window have no verdict; chains of such cells stay behind.
3. Maximal repeats: the repeated windows are merged per document and their words
   removed.

Nothing is emitted per pair of documents.

Defined results: null text has no words; a document with fewer words than the
window loses none; rows with a null id lose nothing and make others lose
nothing; rows that repeat an id are judged each by its own text and are not
"earlier" for each other; an empty table gives an empty result; other columns
pass through (``n_words`` and ``n_removed`` are replaced if the input has them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import key_filter, passes, shared_table
from .words import WORD_BASE, grams, mix, spans_hash, words

#: A chain's key is the hash of its cells with the hash of its anchors.
CHAIN = (
    "chain long, anchors long, doc_id long, tkey long, starts array<int>, "
    "cells array<struct<anchor: long, cell: long, at: int, windows: int, wins: binary>>"
)
#: A chain ends after a cell whose hash is divisible by the first number (so that
#: chains of different documents fall into step), at the latest after the second.
CHAIN_CUT, CHAIN_MOST = 16, 256


def anchor_words(window: int) -> int:
    """Words of an anchor: a quarter of a window (shorter anchors name longer
    cells), and more if a cell's mask (63 bits) asks it."""
    return max(window // 4, window - 61, 1)


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours, leftmost on ties."""
    at = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(values[b] < values[a], b, a)
        span *= 2
    if width > span:
        a, b = at[: len(at) - (width - span)], at[width - span :]
        at = np.where(values[b] < values[a], b, a)
    return at


def cells_of(h: np.ndarray, row: np.ndarray, window: int):
    """Cells of hashed words: row, start, windows, anchor hash, cell hash; and
    the hash of every window."""
    n = len(h)
    if n < window:
        return None
    k = anchor_words(window)
    g = grams(h, k)
    at = leftmost_min(g, window - k + 1)
    inside = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(inside):
        return None
    named = at[inside]
    first = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (inside[1:] != inside[:-1] + 1)])
    start, count = inside[first], np.diff(np.r_[first, len(inside)])
    anchor = g[named[first]]
    body = spans_hash(h, WORD_BASE, start, start + count + window - 1)
    shape = (count * 4096 + (named[first] - start)).astype(np.uint64)
    return row[start], start, count, anchor, mix(body + mix(shape)), grams(h, window)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _seeds(window: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for w in words(b.column("text")):
                if (c := cells_of(w.hash, w.row, window)) is not None:
                    yield pa.record_batch([_long(c[3]), _long(c[4]), pa.array(ids[c[0]].astype(np.int64))], names=["anchor", "cell", "doc_id"])

    return seeds


def chains_of(row: np.ndarray, place: np.ndarray, cell: np.ndarray, single: np.ndarray) -> np.ndarray:
    """First cells of the chains: neighbouring cells of a row, ``single`` ones alone."""
    new = np.ones(len(row), np.bool_)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | single[1:] | single[:-1] | (cell[:-1] % CHAIN_CUT == 0)
    at = np.arange(len(row))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.flatnonzero(new | (since % CHAIN_MOST == 0))


def _cells(window: int, shared, mixed):
    names, parts = ["chain", "anchors", "doc_id", "tkey", "starts", "cells"], ["anchor", "cell", "at", "windows", "wins"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tkey"))
            for w in words(b.column("text")):
                if (c := cells_of(w.hash, w.row, window)) is None:
                    continue
                place = np.flatnonzero(passes(shared.value, c[3]))
                if not len(place):
                    continue
                row, start, count, anchor, cell = (x[place] for x in c[:5])
                # windows are listed only where an anchor has several distinct cells
                several = passes(mixed.value, anchor)
                opened = np.where(several, count, 0)
                inside = np.arange(int(opened.sum())) - np.repeat(np.cumsum(opened) - opened, opened)
                wins = c[5][np.repeat(start, opened) + inside]
                cuts = pa.py_buffer((np.r_[0, np.cumsum(opened)] * 8).astype(np.int32))
                held = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, cuts, pa.py_buffer(wins)])
                first = chains_of(row, place, cell, several)
                ends = np.r_[first[1:], len(row)]
                at = (start - np.repeat(start[first], ends - first)).astype(np.int32)
                part = [_long(anchor), _long(cell), pa.array(at), pa.array(count.astype(np.int32)), held]
                held_cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.StructArray.from_arrays(part, parts))
                head = row[first]
                begin = (start[first] - w.firsts()[head - w.lo]).astype(np.int32)
                chain, anchors = (mix(spans_hash(x, WORD_BASE, first, ends) + (ends - first).astype(np.uint64)) for x in (cell, anchor))
                # a row holds all places of a chain in its text: periodic words repeat one cell many times
                order = np.lexsort((begin, anchors, chain, head))
                same = [x[order][1:] == x[order][:-1] for x in (head, chain, anchors)]
                new = np.flatnonzero(np.r_[True, ~(same[0] & same[1] & same[2])])
                one = order[new]
                starts = pa.ListArray.from_arrays(pa.array(np.r_[new, len(order)].astype(np.int32)), pa.array(begin[order]))
                cols = [_long(chain[one]), _long(anchors[one]), pa.array(ids[head[one]]), pa.array(keys[head[one]]), starts]
                yield pa.record_batch([*cols, held_cells.take(pa.array(one))], names=names)

    return cells


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct cells into their windows."""
    for b in batches:
        if not b.num_rows:
            continue
        wins = b.column("wins")
        off = np.frombuffer(wins.buffers()[1], np.int32)[wins.offset : wins.offset + len(wins) + 1] // 8
        n = np.diff(off)
        at = np.repeat(np.arange(b.num_rows), n)
        vals = np.frombuffer(wins.buffers()[2], np.int64)[off[0] : off[-1]]
        j = (np.arange(len(vals)) - np.repeat(off[:-1] - off[0], n)).astype(np.int32)
        cols = [b.column(c).take(pa.array(at)) for c in ("anchor", "cell", "first_id")]
        yield pa.record_batch([*cols, pa.array(j), pa.array(vals)], names=["anchor", "cell", "first_id", "j", "win"])


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, tkey, found``: places and bit masks of the windows whose words also
    start in a document with a smaller id.

    tkey is the hash of the row's text; bit j of a mask is the window that starts
    j words after ``start``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("tkey", F.xxhash64("text"))
    ends = [f("doc_id").alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))] + [f("cell").alias(n) for f, n in ((F.min, "cell_lo"), (F.max, "cell_hi"))]
    seeds = rows.mapInArrow(_seeds(window), "anchor long, cell long, doc_id long").groupBy("anchor").agg(*ends)
    seeds = shared_table(seeds.where("lo < hi").select("anchor", (F.col("cell_lo") < F.col("cell_hi")).alias("mixed")), "anchors")
    shared, mixed = key_filter(seeds, "anchor"), key_filter(seeds.where("mixed"), "anchor")
    occ = shared_table(rows.mapInArrow(_cells(window, shared, mixed), CHAIN), "occurrences")
    key = ["chain", "anchors"]
    ends = [F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")]
    chains = shared_table(occ.groupBy(*key).agg(*ends, F.first("cells").alias("cells")), "chains")
    parts = chains.select(*key, "first_id", "last_id", F.explode("cells").alias("c"))
    ends = [F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")]
    cells = shared_table(parts.groupBy("c.anchor", "c.cell").agg(*ends, F.first("c.wins").alias("wins")), "distinct")
    opened = cells.where(F.octet_length("wins") > 0).mapInArrow(_open, "anchor long, cell long, first_id long, j int, win long")
    less = opened.groupBy("anchor", "win").agg(F.min("first_id").alias("least"), F.max("first_id").alias("most")).where("least < most")
    masks = (
        opened.join(less.drop("most"), ["anchor", "win"])
        .where("least < first_id")
        .groupBy("anchor", "cell")
        .agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    )
    # a cell of one document without a repeated window has no verdict, and a chain of such cells none either
    judged = cells.select("anchor", "cell", "first_id", "last_id").join(masks, ["anchor", "cell"], "left")
    judged = judged.where("first_id < last_id OR mask IS NOT NULL").drop("last_id")
    judged = (
        parts.select(*key, "c.anchor", "c.cell", "c.at", "c.windows")
        .join(judged, ["anchor", "cell"])
        .groupBy(*key)
        .agg(F.collect_list(F.struct("at", "windows", "first_id", "mask")).alias("parts"))
    )
    # written, so that the join below has two plain shuffles and a hot chain's rows can be split
    judged = shared_table(judged, "judged")
    told = key_filter(judged, "chain")

    def with_verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(told.value, b.column("chain").to_numpy().view(np.uint64))))

    found = F.expr(
        "flatten(transform(starts, s -> filter(transform(parts, p -> struct(s + p.at AS start, "
        "IF(p.first_id < doc_id, shiftleft(1L, p.windows) - 1L, p.mask) AS mask)), f -> f.mask IS NOT NULL)))"
    )
    return (
        occ.select(*key, "doc_id", "tkey", "starts")
        .mapInArrow(with_verdict, "chain long, anchors long, doc_id long, tkey long, starts array<int>")
        .join(judged, key)
        .select("doc_id", "tkey", found.alias("found"))
        .where(F.size("found") > 0)
        .groupBy("doc_id", "tkey")
        .agg(F.flatten(F.collect_list("found")).alias("found"))
    )


def covered(found: pa.StructArray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in the windows of (start, mask) pairs."""
    start, mask = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "mask"))
    row, j = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
    edge = np.bincount(start[row] + j, minlength=n + 1) - np.bincount(np.minimum(start[row] + j + window, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _remove(window: int, join_all: bool, names: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = [], b.column("__found")
            n_words, n_removed = [], []
            col = b.column("text")
            for i in range(b.num_rows):
                text, windows = col[i].as_py(), found[i].values
                parts = (text or "").encode().split()
                n_words.append(len(parts))
                if windows is None or not len(windows):
                    n_removed.append(0)
                    texts.append(b" ".join(parts).decode() if join_all else text)
                    continue
                kept = np.flatnonzero(~covered(windows, len(parts), window))
                n_removed.append(len(parts) - len(kept))
                texts.append(b" ".join([parts[j] for j in kept]).decode())
            made = {"text": pa.array(texts, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.record_batch([made[c] if c in made else b.column(c) for c in names], names=names)

    return remove


def remove_repeats(docs: DataFrame, window: int = 50, *, join_all: bool = False) -> DataFrame:
    """``docs`` without the words of repeated windows, and ``n_words, n_removed``.

    A text that loses words becomes its kept words joined by one space; others
    stay as they are (``join_all``: their words are joined by one space too).
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    found = repeated_windows(docs, window).select(
        F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey"), F.col("found").alias("__found")
    )
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    on = (rows["doc_id"].cast("long") == found["__id"]) & (F.xxhash64(rows["text"].cast("string")) == found["__tkey"])
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in rows.schema.fields])
    out = out.add("n_words", T.LongType()).add("n_removed", T.LongType())
    joined = rows.join(found, on, "left").drop("__id", "__tkey").withColumn("text", F.col("text").cast("string"))
    return joined.mapInArrow(_remove(window, join_all, out.names), out)
