"""Quality filter by importance resampling.

Two generative models of hashed n-grams, one of target text and one of raw text,
give each document a log-ratio per n-gram.  N-grams are taken over words and over
word shapes (how a word begins, ends and continues, its length, and whether it
repeats one of the words before), so text never seen is still judged.

* Target model: the documents labelled good in a bounded sample of the labels
  (LABELS rows, least hashed ids): a fitted classifier's sample.
* Raw model: every document.
* Weights: the document's log-ratio summed over its n-grams, each less the decision
  point of the labelled sample, at a temperature of 1 (other temperatures, and the
  cut without noise, are parameters); Gumbel noise from a hash of the id makes the k largest keys a
  sample without replacement by weight.  A short document has little evidence, so
  chance has its say; a long one is nearly decided.  k, unless given, is the number of documents on the
  good side, counted over all documents, so the size of the sample follows the
  corpus.  The k-th key is found by counting keys per 65,536th of a shrinking
  range: a few grouped counts, never a global sort.

Defined results: null or empty texts have no n-grams and a ratio of 0, the raw
mean, and weigh as one n-gram; a k over the number of rows keeps all, a k of 0 none; rows with a null id take a fixed noise; equal keys at the end of the sample
are all kept; rows that repeat an id share their noise; without good labels every
document is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table
from .words import Words, mix, words

#: Labelled rows of the sample; buckets of a model; temperature of the weights.
LABELS, BUCKETS, TEMPERATURE = 20_000, 1 << 16, 1.0
#: How far back a word may repeat, and the share of good labels that must pass.
BACK, GOOD_PASS = 3, 0.995


def _classes() -> np.ndarray:
    c = np.full(256, 6, np.uint64)  # other marks
    c[97:123] = 0
    c[65:91] = 1
    c[48:58] = 2
    c[[ord(x) for x in ".,;:!?"]] = 3
    c[[ord(x) for x in "'\"()-"]] = 4
    c[128:] = 0
    return c


CLASS = _classes()


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram: words, and runs of one to three shapes."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = CLASS[w.raw[w.start]], CLASS[w.raw[w.end - 1]]
    size = w.end - w.start
    second = CLASS[w.raw[np.maximum(w.start, w.end - 2)]]
    long = np.minimum(np.floor(np.log2(size)), 6).astype(np.uint64)
    again = np.zeros(n, np.uint64)
    for d in range(BACK, 0, -1):
        same = (w.hash[d:] == w.hash[:-d]) & (w.row[d:] == w.row[:-d]) if n > d else np.zeros(0, np.bool_)
        again[d:][same] = d
    shape = ((((first * np.uint64(7) + last) * np.uint64(7) + second) * np.uint64(7) + long) * np.uint64(4) + again) + np.uint64(1)
    rows, keys = [w.row, w.row], [mix(w.hash), mix(shape)]
    run = mix(shape)
    for d in (1, 2):
        if n > d:
            run = mix(run[:-1] * np.uint64(3) + mix(shape)[d:])
            inside = w.row[d:] == w.row[:-d]
            rows.append(w.row[d:][inside])
            keys.append(run[inside])
    row, key = np.concatenate(rows), np.concatenate(keys)
    return row, (key >> np.uint64(64 - 16)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        good = b.column("quality").to_numpy(zero_copy_only=False) == 1
        for w in words(b.column("text")):
            row, bucket = features(w)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[row]], minlength=BUCKETS)
    yield pa.record_batch([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def _score(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for b in batches:
            for w in words(b.column("text")):
                row, bucket = features(w)
                n = np.bincount(row - w.lo, minlength=w.hi - w.lo)
                total = np.bincount(row - w.lo, weights=table[bucket], minlength=w.hi - w.lo)
                part = b.slice(w.lo, w.hi - w.lo)
                score = pa.array(np.round(total / np.maximum(n, 1), 9))
                yield pa.record_batch([part.column("doc_id"), part.column("rid"), part.column("quality"), pa.array(n), score], names=["doc_id", "rid", "quality", "n_grams", "log_ratio"])

    return run


def labelled_sample(labels: DataFrame) -> DataFrame:
    """At most LABELS rows ``__id, quality``, least hashed ids first."""
    rows = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality")).where("__id IS NOT NULL AND quality IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("__id"), "__id", "quality").limit(LABELS)
    return sample.groupBy("__id").agg(F.min("quality").alias("quality"))


def decision_point(sample: DataFrame) -> float:
    """Log-ratio between the classes of the labelled sample: where the most is
    told apart, but no higher than GOOD_PASS of the good rows allow."""
    got = sample.select("quality", "log_ratio").toArrow()  # at most LABELS rows
    q, s = got.column("quality").to_numpy(), got.column("log_ratio").to_numpy()
    if not (q == 1).any():
        return float("-inf")
    ceiling = float(np.quantile(s[q == 1], 1 - GOOD_PASS, method="lower"))
    if not (q == 0).any():
        return ceiling
    order = np.argsort(s, kind="stable")
    bad = np.cumsum(q[order] == 0) / (q == 0).sum()
    good = np.cumsum(q[order] == 1) / (q == 1).sum()
    k = int(np.argmax(bad - good))
    after = s[order][min(k + 1, len(s) - 1)]
    return min(float(s[order][k] + after) / 2, ceiling)


def kth_largest(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest double of a column, by grouped counts of
    a shrinking range."""
    lo, hi = -(2.0**40), 2.0**40
    scale = 1 << 16
    keys = keys.where(F.col(key).isNotNull())
    above = 0
    for _ in range(6):
        width = (hi - lo) / scale
        digit = F.floor((F.col(key) - F.lit(lo)) / F.lit(width))
        counts = keys.where((F.col(key) >= F.lit(lo)) & (F.col(key) < F.lit(hi))).groupBy(digit.alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.max(key).alias("most"), F.min(key).alias("least")
        )
        got = counts.toArrow().sort_by([("d", "descending")])  # at most 65,537 rows
        n = np.cumsum(got.column("n").to_numpy()) + above
        at = int(np.searchsorted(n, k))
        if at >= len(n):
            return float("-inf")
        lo_v, hi_v = got.column("least")[at].as_py(), got.column("most")[at].as_py()
        if lo_v == hi_v:
            return lo_v
        above = int(n[at - 1]) if at else above
        lo, hi = lo_v, np.nextafter(hi_v, np.inf)
    return lo


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, k: int | None = None) -> DataFrame:
    """``doc_id, n_grams, log_ratio, key, kept`` of every document.

    ``log_ratio`` is the mean of its n-grams.  ``k``: size of the sample (by default the
    documents on the good side of the decision point).  ``temperature`` 0 cuts at the
    point without noise: the key is then the summed log-ratio over it.
    """
    return _resampled(docs, labels, temperature, k).drop("rid")


def _resampled(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, k: int | None = None) -> DataFrame:
    """``resample`` with ``rid``, a hash of the text."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))
    sample = shared_table(labelled_sample(labels), "labels")
    # LABELS rows at most, two numbers each
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample["__id"], "left").select("doc_id", "rid", "text", "quality")
    counts = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = counts.toArrow()  # one row per bucket
    model = np.ones((2, BUCKETS))
    for i, c in enumerate(("raw", "target")):
        model[i, got.column("bucket").to_numpy()] += got.column(c).to_numpy()
    ratio = np.log(model[1] / model[1].sum()) - np.log(model[0] / model[0].sum())
    schema = "doc_id long, rid long, quality int, n_grams long, log_ratio double"
    scored = shared_table(rows.mapInArrow(_score(spark.sparkContext.broadcast(ratio)), schema), "scored")
    point = decision_point(scored.where("quality IS NOT NULL"))
    if point == float("-inf"):
        return scored.select("doc_id", "rid", "n_grams", "log_ratio", F.lit(0.0).alias("key"), F.lit(True).alias("kept"))
    # uniform in (0, 1) from 52 bits of a hash of the id
    unit = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("gumbel")), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = (F.col("log_ratio") - F.lit(point)) * F.greatest("n_grams", F.lit(1))
    key = weight / F.lit(temperature) - F.log(-F.log(unit)) if temperature else weight
    keyed = scored.withColumn("key", key)
    if k is None:
        k = scored.where(F.col("log_ratio") >= F.lit(point)).count()
    least = kth_largest(keyed, "key", k) if k else float("inf")
    return keyed.select("doc_id", "rid", "n_grams", "log_ratio", "key", (F.col("key") >= F.lit(least)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows (id and text) that the resampling leaves out."""
    out = _resampled(docs, labels).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("rid").alias("__rid")).distinct()
    same = (docs["doc_id"].cast("long") == out["__id"]) & (F.xxhash64(docs["text"].cast("string")) == out["__rid"])
    return docs.join(out, same, "left_anti")
