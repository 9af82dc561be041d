"""Language of pages by Bayesian fusion of four kinds of evidence.

* Text: a naive Bayes model of hashed byte trigrams, counted over all labelled
  documents; the page's log-likelihoods are tempered (neighbouring trigrams are
  not independent) and become a posterior.
* Markup: the language the page declares, P(declared | language).
* Address: the last label of the host, P(suffix | language).
* Host: a prior smoothed up its hierarchy, host, registered name, all pages.

The last three tables are grouped aggregations of the text posteriors over all
pages, in whole millionths (so sums don't depend on their order); a page's own
posterior is taken out of its host's counts again.  Hot hosts only add up:
partial sums per task.

Defined results: a page without text is judged by markup, address and host; null
or odd addresses have empty host and suffix, a missing declaration is the value
''; ties take the first language in alphabetical order; without any labelled
document the language is null; rows that repeat a page_id are judged one by one;
other columns are not read.  The text model is a table of MOST_LANGUAGES languages
at most (64 KB each); more distinct labels raise, since they are no languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import Page, host_of, main_text
from .shared import shared_table
from .words import LOWER, string_buffers

#: Trigram buckets; temper of the text; whole posterior; pseudo-counts of pages.
BUCKETS, TEMPER, WHOLE = 1 << 14, 0.2, 1_000_000
MOST_LANGUAGES = 1024
SMOOTH_HOST, SMOOTH_TABLE = 5.0, 1.0


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams of a text, A-Z folded."""
    t = LOWER[raw].astype(np.uint32)
    if len(t) < 3:
        return np.zeros(0, np.int64)
    key = t[:-2] << np.uint32(16) | t[1:-1] << np.uint32(8) | t[2:]
    return (key * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def _count(languages: list[str]):
    at = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            raw, off = string_buffers(b.column("text"))
            lang = np.array([at.get(x, -1) for x in b.column("lang").to_pylist()])
            for i in np.flatnonzero(lang >= 0):
                counts[lang[i]] += np.bincount(trigrams(raw[off[i] : off[i + 1]]), minlength=BUCKETS)
        i, j = np.nonzero(counts)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])], names=["lang", "bucket", "n"])

    return run


class Model:
    """Languages and the log-probabilities of their trigrams (a fixed-size table)."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    def posterior(self, raw: np.ndarray) -> np.ndarray:
        """Text posterior in whole millionths; uniform without text."""
        ll = TEMPER * self.log_p[:, trigrams(raw)].sum(1)
        p = np.exp(ll - ll.max())
        return np.floor(p / p.sum() * WHOLE).astype(np.int64)


def train(docs: DataFrame) -> Model:
    """Trigram model of the documents' language labels (all of them)."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"documents name more than {MOST_LANGUAGES} languages; clean the labels first")
    counts = np.full((len(languages), BUCKETS), 0.5)
    got = rows.mapInArrow(_count(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            p = [m.posterior(np.frombuffer(main_text(Page(h or "")).encode("utf-8", "replace"), np.uint8)) for h in b.column("html").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in ("page_id", "declared", "suffix", "host", "name")), pa.array(p, pa.list_(pa.int64()))], names=["page_id", "declared", "suffix", "host", "name", "p"])

    return run


def declared_language(html: Column) -> Column:
    """Primary subtag of the lang attribute of the page's html element."""
    return F.lower(F.coalesce(F.regexp_extract(html, r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-zA-Z]+)", 1), F.lit("")))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]


def _array(n: int, names: str) -> Column:
    return F.array(*[F.col(f"s{i}").cast("double") / WHOLE for i in range(n)]).alias(names)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, host, declared, text_lang, lang, confidence`` of every page."""
    spark = pages.sparkSession
    model = train(docs)
    n = len(model.languages)
    host = host_of(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = rows.withColumns({
        "declared": declared_language(F.col("html")),
        "suffix": F.element_at(F.split("host", r"\."), -1),
        "name": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1),
    })
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    shown = spark.sparkContext.broadcast(model)
    scored = shared_table(rows.mapInArrow(_score(shown), "page_id long, declared string, suffix string, host string, name string, p array<long>"), "language")
    whole = scored.agg(*_sums(n)).select(_array(n, "g"))
    by = {c: scored.groupBy(c).agg(*_sums(n)).select(c, _array(n, f"{c}_n")) for c in ("declared", "suffix", "host", "name")}
    kinds = {c: by[c].count() for c in ("declared", "suffix")}
    joined = scored.withColumn("g", whole.scalar())
    for c, table in by.items():
        joined = joined.join(table, c, "left")

    # one expression whatever the number of languages: sizes once a page, then a pass over the places
    size = {c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) for c in ("g", "host_n", "name_n")}
    joined = joined.withColumns({f"{c}_size": x for c, x in size.items()})

    def fused(whole_p: Column, i: Column) -> Column:
        own = whole_p / WHOLE
        g = F.col("g")[i]
        top = (g + 1.0) / (F.col("g_size") + float(n))

        def smoothed(counts: str, above: Column) -> Column:
            others = F.greatest(F.col(f"{counts}_size") - 1.0, F.lit(0.0))
            return (F.greatest(F.col(counts)[i] - own, F.lit(0.0)) + SMOOTH_HOST * above) / (others + SMOOTH_HOST)

        prior = smoothed("host_n", smoothed("name_n", top))
        log = F.log(own + 1e-9) + F.log(prior + 1e-9)
        for c, k in kinds.items():
            log = log + F.log((F.greatest(F.col(f"{c}_n")[i] - own, F.lit(0.0)) + SMOOTH_TABLE) / (g - own + SMOOTH_TABLE * k))
        return log

    langs = F.array(*[F.lit(x) for x in model.languages])
    out = joined.withColumn("log", F.transform("p", fused))
    best = F.array_max("log")
    share = F.lit(1.0) / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return out.select(
        "page_id", "host", "declared",
        F.element_at(langs, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"),
        F.element_at(langs, F.array_position("log", best).cast("int")).alias("lang"),
        share.alias("confidence"),
    )
