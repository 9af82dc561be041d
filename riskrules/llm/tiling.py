"""Benchmark decontamination by greedy string tiling.

1. Seeds: the SHORTEST-word runs of the benchmark are a fixed-size bit filter;
   one pass over the documents keeps the stretches of each text that are covered
   by possible seeds (its residue) and joins them with the benchmark by seed.
2. A pair (document, item) is tiled if it shares enough seeds to reach the
   coverage at all: tiles of SHORTEST words covering the share COVERED of the
   item need at least a seed for every SHORTEST words of it.
3. Tiling: the longest common runs of unmarked words are found by running
   Karp-Rabin hashes and marked, longest first, until none of SHORTEST words is
   left.  A document is contaminated if the tiles cover COVERED of the words of an
   item, in whatever order the item's parts occur in it.

Items shorter than SHORTEST words are looked up as exact runs of all their words.

Words are runs of letters, marks and digits in lower case, so case and punctuation
(Unicode's too) do not hide a copy; characters of scripts written without spaces
are words of their own.  Only residues travel: clean text never leaves its task, and
neither side is broadcast except the filter.

Defined results: null or empty texts are clean; items without words take
no part; rows that repeat a doc_id share the result;
rows with a null doc_id are kept; repeated items are reported each; empty tables
leave everything clean; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import key_filter, passes, shared_table
from .words import MARKS, WORD_BASE, grams, mix, spans_hash, words

#: Words of the shortest tile, and the share of an item's words that condemns.
SHORTEST, COVERED = 5, 0.8


#: What a text is folded by: unseen format characters, other marks than ASCII's, and scripts without spaces.
FOLDS = [
    (r"\p{Cf}", ""),
    (r"[^\x00-\x7F\p{L}\p{N}\p{M}]", " "),
    (r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 "),
]


def _folded(col: pa.Array) -> Iterator:
    col = pc.utf8_lower(pc.fill_null(col, ""))
    for pattern, to in FOLDS:
        col = pc.replace_substring_regex(col, pattern, to)
    return words(col, separator=MARKS)


def _whole_runs(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of the runs of n words, apart from those of other lengths."""
    return mix(grams(h, n) ^ mix(np.array([n], np.uint64)))


def _items(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id")
            for w in _folded(b.column("text")):
                cuts = w.firsts()
                seeds, tokens = [], []
                for i in range(w.hi - w.lo):
                    h = w.hash[cuts[i] : cuts[i + 1]]
                    tokens.append(h.tobytes())
                    seeds.append((_whole_runs(h, len(h)) if 0 < len(h) < shortest else grams(h, shortest)).view(np.int64))
                cols = [ids.slice(w.lo, w.hi - w.lo), pa.array(np.diff(cuts)), pa.array(tokens, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))]
                yield pa.record_batch(cols, names=["item_id", "n", "tokens", "seeds"])

    return run


def _residues(shortest: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("rid").to_numpy(zero_copy_only=False)
            for w in _folded(b.column("text")):
                n = len(w.hash)
                if n < shortest:
                    continue
                g = grams(w.hash, shortest)
                hit = np.flatnonzero(passes(known.value, g) & (w.row[: n - shortest + 1] == w.row[shortest - 1 :]))
                if not len(hit):
                    continue
                rows, at = np.unique(w.row[hit], return_index=True)
                out = []
                for r, p in zip(rows.tolist(), np.split(hit, at[1:]), strict=True):
                    runs = np.split(p, np.flatnonzero(np.diff(p) > shortest) + 1)
                    # a zero ends each stretch: no tile runs over it
                    tokens = np.concatenate([np.append(w.hash[q[0] : q[-1] + shortest], np.uint64(0)) for q in runs])
                    out.append((r, np.unique(g[p]).view(np.int64), tokens.tobytes()))
                r, seeds, tokens = zip(*out, strict=True)
                cols = [ids.take(pa.array(r)), pa.array(keys[list(r)]), pa.array(seeds, pa.list_(pa.int64())), pa.array(tokens, pa.binary())]
                yield pa.record_batch(cols, names=["doc_id", "rid", "seeds", "tokens"])

    return run


def _short_runs(lengths: list[int], known):
    """Texts into the keys of short items that they may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in _folded(b.column("text")):
                for n in lengths:
                    if len(w.hash) < n:
                        continue
                    g = _whole_runs(w.hash, n)
                    hit = np.flatnonzero(passes(known.value, g) & (w.row[: len(g)] == w.row[n - 1 :]))
                    if len(hit):
                        found = np.unique(np.rec.fromarrays([w.row[hit], g[hit].view(np.int64)], names="row,seed"))
                        yield pa.record_batch([b.column("doc_id").take(pa.array(found.row)), pa.array(np.ascontiguousarray(found.seed))], names=["doc_id", "seed"])

    return run


def tiles(item: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs ``(place in item, place in text, length)``,
    greedily longest first (ties: earliest in item, then in text)."""
    free_i, free_t = item != 0, text != 0
    found: list[tuple[int, int, int]] = []
    s = max(shortest, 1 << (len(item).bit_length() - 1))
    while True:
        # running hashes of all runs of s unmarked words
        matches = []
        if s <= min(len(item), len(text)):
            places = defaultdict(list)
            for p, h in _runs(text, free_t, s):
                places[h].append(p)
            for p, h in _runs(item, free_i, s):
                for q in places.get(h, ()):
                    n = s
                    if p and q and free_i[p - 1] and free_t[q - 1] and item[p - 1] == text[q - 1]:
                        continue  # part of the run that starts one word earlier
                    while p + n < len(item) and q + n < len(text) and free_i[p + n] and free_t[q + n] and item[p + n] == text[q + n]:
                        n += 1
                    matches.append((-n, p, q))
        heapify(matches)
        while matches:
            n, p, q = heappop(matches)
            n = -n
            free = free_i[p : p + n] & free_t[q : q + n]
            if free.all():
                free_i[p : p + n] = free_t[q : q + n] = False
                found.append((p, q, n))
                continue
            # what longer tiles left of it takes its turn by its own length
            edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8))).tolist()
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                if hi - lo >= s:
                    heappush(matches, (lo - hi, p + lo, q + lo))
        if s == shortest:
            return found
        s = max(shortest, s // 2)


def _runs(tokens: np.ndarray, free: np.ndarray, s: int) -> Iterator[tuple[int, int]]:
    taken = np.r_[0, np.cumsum(~free)]
    at = np.arange(len(tokens) - s + 1)
    at = at[taken[at + s] == taken[at]]
    return zip(at.tolist(), spans_hash(tokens, WORD_BASE, at, at + s).tolist(), strict=True)


def _tile(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cover = []
            for item, text in zip(b.column("item_tokens"), b.column("tokens"), strict=True):
                a, t = (np.frombuffer(x.as_buffer(), np.uint64) for x in (item, text))
                cover.append(sum(n for _, _, n in tiles(a, t, shortest)) / len(a))
            yield pa.record_batch([b.column("doc_id"), b.column("item_id"), pa.array(cover, pa.float64())], names=["doc_id", "item_id", "coverage"])

    return run


def coverages(docs: DataFrame, benchmark: DataFrame, *, shortest: int = SHORTEST, covered: float = COVERED) -> DataFrame:
    """``doc_id, item_id, coverage`` of the pairs that reach ``covered``."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = shared_table(bench.mapInArrow(_items(shortest), "item_id long, n long, tokens binary, seeds array<long>"), "items")
    short = items.where((F.col("n") > 0) & (F.col("n") < shortest)).select("item_id", "n", F.explode("seeds").alias("seed"))
    lengths = [r["n"] for r in short.select("n").distinct().collect()]  # fewer than shortest
    items = items.where(F.col("n") >= shortest).withColumn("ikey", F.xxhash64("item_id", "tokens"))
    seeds = items.select("item_id", "ikey", "n", F.explode("seeds").alias("seed"))
    seeds = seeds.groupBy("item_id", "ikey", "n", "seed").agg(F.count(F.lit(1)).alias("times"))
    known = key_filter(seeds, "seed")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text")).where("doc_id IS NOT NULL")
    found = shared_table(rows.mapInArrow(_residues(shortest, known), "doc_id long, rid long, seeds array<long>, tokens binary"), "residues")
    shared = found.select("doc_id", "rid", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = (
        shared.groupBy("doc_id", "rid", "item_id", "ikey")
        .agg(F.sum("times").alias("shared"), F.first("n").alias("n"))
        .where(F.col("shared") >= F.ceil(F.lit(covered) * F.col("n") / shortest))
        .select("doc_id", "rid", "item_id", "ikey")
    )
    tiled = (
        pairs.join(found.select("doc_id", "rid", "tokens").dropDuplicates(["doc_id", "rid"]), ["doc_id", "rid"])
        .join(items.select("ikey", F.col("tokens").alias("item_tokens")).dropDuplicates(["ikey"]), "ikey")
        .select("doc_id", "item_id", "tokens", "item_tokens")
        .mapInArrow(_tile(shortest), "doc_id long, item_id long, coverage double")
    )
    tiled = tiled.where(F.col("coverage") >= covered)
    if not lengths:
        return tiled
    runs = rows.select("doc_id", "text").mapInArrow(_short_runs(lengths, key_filter(short, "seed")), "doc_id long, seed long")
    whole = runs.join(short.select("item_id", "seed").distinct(), "seed").select("doc_id", "item_id", F.lit(1.0).alias("coverage"))
    return tiled.unionByName(whole.distinct())


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, kept, coverage, item_ids``: one row per document row; ``item_ids``
    are the items it holds, ``coverage`` the largest of theirs (0 if none)."""
    hits = coverages(docs, benchmark).groupBy(F.col("doc_id").alias("__id")).agg(
        F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(hits, rows["doc_id"] == hits["__id"], "left")
    return joined.select(
        "doc_id", F.col("__id").isNull().alias("kept"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    hits = coverages(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(hits, docs["doc_id"].cast("long") == hits["__id"], "left_anti")
