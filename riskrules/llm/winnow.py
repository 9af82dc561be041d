"""Document fingerprints by winnowing, and their likeness between texts.

Every run of ``k`` code points has a rolling hash: two polynomials modulo 2^31 - 1,
together 62 bits.  Of every window of ``width`` neighbouring hashes the least is
chosen, the rightmost on ties; a chosen hash is kept once, with its place.  The
choice depends on the window's code points alone, which gives the guarantees:

* texts that share ``k + width - 1`` consecutive code points share a fingerprint
  hash, at places that line the passage up (``shared_places``);
* no match of fewer than ``k`` code points is reported.

A fingerprint is a string of entries of 24 hex digits (16 of the hash, 8 of its
place, in code points), by place.  The likeness of two fingerprints is twice the
number of hashes they share over the number of their distinct hashes (0 to 1).

``against_next`` also fingerprints an edited copy of each text, whose second half is
the beginning of the next document's text (descending ids; after the last, the
first).  Ids are cut into ranges by an approximate histogram (its size is that of
the partition count), every text moves once, to its range, and the head of a range
is copied to the range before it.  Ranges are sorted and read as streams, so a worker
holds a slice of texts or the longest single one.

Defined results: a null text is empty; an empty text has an empty fingerprint, and
two empty fingerprints have likeness 1 (an empty and another one: 0); a text of fewer
than ``k`` code points is one run; a text with fewer than ``width`` runs is one
window; rows that repeat an id are ordered by their text; rows with a null id come
last; one document alone is its own next; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import default_partitions
from .words import string_buffers

#: Code points of a run, and runs of a window.
K, WIDTH = 16, 32
#: Modulus and the two bases of the rolling hash.
PRIME, BASES = (1 << 31) - 1, (1_000_000_007, 1_315_423_911)
#: Code points handled at once.
SLICE = 1 << 18
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
ENTRY = 24


def rolled(points: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of k values, from runs of half the length (k values longer
    than the rest are missing at the end)."""
    have, length, one = None, 0, points
    size, power = 1, base % PRIME
    while k:
        if k & 1:
            # the run of `length` values already built is followed by `size` more
            have = one if have is None else (have[: len(one) - length] * power + one[length:][: len(have)]) % PRIME
            length += size
        k >>= 1
        if k:
            one = (one[: len(one) - size] * power + one[size:]) % PRIME
            size, power = size * 2, power * power % PRIME
    return have


def run_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """62-bit hash of each run of k code points (none, if there are fewer)."""
    if len(points) < k:
        return np.zeros(0, np.int64)
    values = points.astype(np.int64) + 1
    high, low = (rolled(values, k, b) for b in BASES)
    return high << 31 | low


def rightmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours, rightmost on ties."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] <= values[a], b, a)
        span += step
    return at


def prints(points: np.ndarray, cuts: np.ndarray, k: int = K, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and place of the chosen runs of texts points[cuts[i]:cuts[i + 1]]."""
    sizes = np.diff(cuts)
    n_runs = np.maximum(sizes - k + 1, 0)
    h = run_hashes(points, k)
    end = np.repeat(cuts[:-1] + n_runs, sizes)[: len(h)]
    at = np.arange(len(h))
    chosen = []
    if len(h) >= width:
        first = at[: len(h) - width + 1]
        chosen.append(rightmost_min(h, width)[first[first + width <= end[: len(first)]]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    alone = np.flatnonzero((n_runs[row[: len(h)]] < width) & (at < end))
    if len(alone):
        order = alone[np.lexsort((-alone, h[alone], row[alone]))]
        chosen.append(order[np.r_[True, row[order][1:] != row[order][:-1]]])
    place = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    who, value, where = row[place], h[place], place - cuts[row[place]]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        whole = np.array([run_hashes(points[cuts[i] : cuts[i + 1]], int(sizes[i]))[0] for i in short])
        who, value, where = np.r_[who, short], np.r_[value, whole], np.r_[where, np.zeros(len(short), np.int64)]
        order = np.argsort(who, kind="stable")
        who, value, where = who[order], value[order], where[order]
    return who, value, where


def as_text(found: tuple[np.ndarray, np.ndarray, np.ndarray], n_rows: int) -> pa.Array:
    """Fingerprint strings of the rows."""
    who, value, where = found
    raw = np.empty((len(who), ENTRY // 2), np.uint8)
    raw[:, :8] = value.astype(">u8").view(np.uint8).reshape(-1, 8)
    raw[:, 8:] = where.astype(">u4").view(np.uint8).reshape(-1, 4)
    hexed = np.empty((len(who), ENTRY), np.uint8)
    hexed[:, 0::2], hexed[:, 1::2] = DIGITS[raw >> 4], DIGITS[raw & 15]
    cuts = np.r_[0, np.cumsum(np.bincount(who, minlength=n_rows))] * ENTRY
    return pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(hexed.tobytes())).cast(pa.string())


def entries(fingerprint: str) -> list[tuple[int, int]]:
    """(hash, place) of a fingerprint string."""
    parts = (fingerprint[i : i + ENTRY] for i in range(0, len(fingerprint), ENTRY))
    return [(int(p[:16], 16), int(p[16:], 16)) for p in parts]


def shared_places(a: str, b: str) -> list[tuple[int, int]]:
    """Places (in the first and in the second text) of the hashes two fingerprints share."""
    second: dict[int, list[int]] = {}
    for value, place in entries(b):
        second.setdefault(value, []).append(place)
    return [(place, other) for value, place in entries(a) for other in second.get(value, ())]


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])][: len(row)]
    return row[new], value[new]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n_rows: int) -> np.ndarray:
    """Likeness per row of two lists of (row, hash)."""
    a, b = _distinct(*a), _distinct(*b)
    sizes = np.bincount(a[0], minlength=n_rows) + np.bincount(b[0], minlength=n_rows)
    row, value = np.r_[a[0], b[0]], np.r_[a[1], b[1]]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    twice = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
    both = np.bincount(row[twice], minlength=n_rows)
    return np.where(sizes > 0, 2.0 * both / np.maximum(sizes, 1), 1.0)


def _points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and their cuts."""
    data, off = string_buffers(col)
    sizes = pc.utf8_length(pc.fill_null(col, "")).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(data[off[0] : off[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum(sizes)]


def _gather(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.r_[0, np.cumsum(size)]
    return points[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], size)], cuts


def edited(points: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text but the last with its second half replaced by the beginning of the next."""
    sizes = np.diff(cuts)
    half = sizes[:-1] // 2
    start = np.stack([cuts[:-2], cuts[1:-1]], 1).ravel()
    size = np.stack([sizes[:-1] - half, np.minimum(half, sizes[1:])], 1).ravel()
    made, ends = _gather(points, start, size)
    return made, ends[::2]


def _slices(col: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes, without the last row (it is only a next one)."""
    _, off = string_buffers(col)
    lo, last = 0, len(col) - 1
    while lo < last:
        hi = min(last, max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1))
        yield lo, hi
        lo = hi


def _compared(k: int, width: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in _slices(t.column("text")):
            n = hi - lo
            points, cuts = _points(t.column("text").slice(lo, n + 1))
            who, value, where = prints(points, cuts, k, width)
            made, ends = edited(points, cuts)
            other = prints(made, ends, k, width)
            mine, follows = who < n, who > 0
            sha = [hashlib.sha256(made[i:j].tobytes().decode("utf-32-le").encode()).hexdigest() for i, j in zip(ends[:-1], ends[1:])]
            own = (who[mine], value[mine], where[mine])
            cols = [
                t.column("doc_id").slice(lo, n), pa.array(np.diff(cuts)[:n]), pa.array(sha, pa.string()), as_text(own, n), as_text(other, n),
                pa.array(likeness(own[:2], other[:2], n)), pa.array(likeness(own[:2], (who[follows] - 1, value[follows]), n)),
            ]
            out = pa.record_batch(cols, names=names)
            yield out.filter(pc.equal(t.column("extra").slice(lo, n), 0))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                t = b if last is None else pa.concat_batches([last, b])
                yield from rows_of(t)
                # a range ends with a copied head, which has no row of its own
                last = pa.RecordBatch.from_pydict({c: t.column(c).slice(t.num_rows - 1).take(pa.array([0])) for c in t.schema.names}, schema=t.schema)

    return compared


def _ranges(bounds: np.ndarray, heads: dict[int | None, int]):
    """Rows with the number of their range (rising as ids fall), and copies of the heads."""
    named = np.array(sorted(i for i in heads if i is not None), np.int64)
    to = np.array([heads[i] for i in named.tolist()], np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            part = np.where(null, len(bounds), len(bounds) - np.searchsorted(bounds, value, "right")).astype(np.int32)
            zeros = np.zeros(len(part), np.int32)
            yield pa.record_batch([pa.array(part), pa.array(zeros), *b.columns], names=["part", "extra", *b.schema.names])
            at = np.searchsorted(named, value)
            at = np.minimum(at, max(len(named) - 1, 0))
            head = ~null & (named[at] == value) if len(named) else np.zeros(len(part), np.bool_)
            dest = to[at] if len(named) else zeros
            if None in heads:
                head, dest = head | null, np.where(null, heads[None], dest)
            place = np.flatnonzero(head)
            if len(place):
                copied = b.take(pa.array(place))
                yield pa.record_batch([pa.array(dest[place].astype(np.int32)), pa.array(np.ones(len(place), np.int32)), *copied.columns], names=["part", "extra", *b.schema.names])

    return ranges


def in_descending_ranges(rows: DataFrame) -> DataFrame:
    """``part, extra, doc_id, text``: descending ids as sorted partitions, each ending with a
    copy of the head of the next one (``extra`` 1); the last ends with the head of the first."""
    n = default_partitions(rows.sparkSession)
    ids = rows.select("doc_id")
    shares = [i / n for i in range(1, n)]
    bounds = np.zeros(0, np.int64)
    if shares:
        # n - 1 ids, from a sketch whose size follows n
        cut = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("cut")).first()["cut"]
        bounds = np.unique(np.array(cut or [], np.int64))
    numbered = ids.mapInArrow(_ranges(bounds, {}), "part int, extra int, doc_id long")
    # at most n rows: the first id of each range
    first = sorted((r["part"], r["head"]) for r in numbered.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    heads = {head: first[i - 1][0] for i, (_, head) in enumerate(first)}
    placed = rows.mapInArrow(_ranges(bounds, heads), "part int, extra int, doc_id long, text string")
    return placed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(
        "part", "extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"
    )


def against_next(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited copy, and the likeness of the
    text's fingerprint to the copy's and to the next document's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_descending_ranges(rows).mapInArrow(_compared(k, width), schema)


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """``docs`` and ``fingerprint`` (replaced, if the input has it)."""
    kept = [f for f in docs.schema.fields if f.name != "fingerprint"]
    names = [*(f.name for f in kept), "fingerprint"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _slices(pa.concat_arrays([b.column("text").cast(pa.string()), pa.array([""])])):
                rows = b.slice(lo, hi - lo)
                points, cuts = _points(rows.column("text").cast(pa.string()))
                yield pa.record_batch([*rows.columns, as_text(prints(points, cuts, k, width), hi - lo)], names=names)

    out = T.StructType([*kept, T.StructField("fingerprint", T.StringType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(made, out)
