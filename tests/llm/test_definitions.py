"""Language fusion and importance resampling against their definitions on random tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskrules.llm import langid, quality
from riskrules.llm.words import words

M64 = (1 << 64) - 1


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


# ---- language -----------------------------------------------------------------------------


def trigrams(text):
    raw = text.encode().lower()
    return [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 18 for i in range(len(raw) - 2)]


def fused_by_definition(docs, pages):
    """Language and confidence of pages ``(id, host, declared, text)``."""
    langs = sorted({la for la, t in docs if la is not None and t is not None})
    counts = {la: Counter() for la in langs}
    for la, t in docs:
        if la is not None and t is not None:
            counts[la].update(trigrams(t))
    size = {la: sum(c.values()) + 0.5 * langid.BUCKETS for la, c in counts.items()}
    posterior = {}
    for i, _, _, text in pages:
        ll = [langid.TEMPER * sum(math.log((counts[la][t] + 0.5) / size[la]) for t in trigrams(text)) for la in langs]
        e = [math.exp(x - max(ll)) for x in ll]
        posterior[i] = [x / sum(e) for x in e]

    def table(key):
        out = defaultdict(lambda: [0.0] * len(langs))
        for page in pages:
            out[key(page)] = [a + b for a, b in zip(out[key(page)], posterior[page[0]])]
        return out

    keys = {
        "declared": lambda p: p[2], "suffix": lambda p: p[1].split(".")[-1], "host": lambda p: p[1],
        "name": lambda p: ".".join(p[1].split(".")[-2:]) if "." in p[1] else "",
    }
    tables = {k: table(f) for k, f in keys.items()}
    whole = table(lambda p: 0)[0]
    result = {}
    for page in pages:
        logs = []
        for la in range(len(langs)):
            own = posterior[page[0]][la]

            def prior(kind, above):
                c = tables[kind][keys[kind](page)]
                return (max(c[la] - own, 0) + langid.SMOOTH_HOST * above) / (max(sum(c) - 1, 0) + langid.SMOOTH_HOST)

            p = prior("host", prior("name", (whole[la] + 1) / (sum(whole) + len(langs))))
            x = math.log(own + 1e-9) + math.log(p + 1e-9)
            for kind in ("declared", "suffix"):
                c = tables[kind][keys[kind](page)][la]
                x += math.log((max(c - own, 0) + langid.SMOOTH_TABLE) / (whole[la] - own + langid.SMOOTH_TABLE * len(tables[kind])))
            logs.append(x)
        best = max(logs)
        result[page[0]] = (langs[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs))
    return result


def random_text(rng, language, n):
    return " ".join("".join(rng.choice("abcdefgh" if language == "aa" else "efghijkl" if language == "bb" else "hijklmnop") for _ in range(5)) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_fusion_is_its_definition(spark, seed):
    rng = random.Random(seed)
    docs = [(la, random_text(rng, la, 30)) for la in ("aa", "bb", "cc") for _ in range(4)] + [(None, "x y z"), ("aa", None)]
    hosts = {"aa": ["a.one.net", "b.one.net"], "bb": ["b.one.net", "two.org"], "cc": ["two.org", "local"]}
    pages = []
    for i in range(45):
        la = rng.choice(("aa", "bb", "cc"))
        text = random_text(rng, la, rng.choice((0, 1, 2, 6)))
        pages.append((i, rng.choice(hosts[la]), rng.choice((la, la, "xx", "")), text))
    pages += [(100, "a.one.net", "aa", pages[0][3]), (101, "", "", "")]
    shown = [
        (i, f"https://{h}/x" if h else None, f"<html{f' lang={d}' if d else ''}><body><article><p>{t}</p></article></body></html>")
        for i, h, d, t in pages
    ]
    got = langid.identify(
        spark.createDataFrame(shown, "page_id long, url string, html string"), spark.createDataFrame(docs, "lang string, text string")
    ).collect()
    want = fused_by_definition(docs, pages)
    assert len(got) == len(pages)
    for r in got:
        lang, share = want[r["page_id"]]
        assert r["confidence"] == pytest.approx(share, abs=2e-3)
        assert r["lang"] == lang or share < 0.51


def test_many_languages_stay_one_expression(spark):
    docs = spark.range(0, 300, 1, 2).select(F.format_string("l%03d", F.col("id")).alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    pages = docs.select(
        F.substring("lang", 2, 3).cast("long").alias("page_id"), F.lit("http://x.net").alias("url"),
        F.concat(F.lit("<html><article><p>"), "text", F.lit("</p></article>")).alias("html"),
    )
    got = langid.identify(pages, docs).collect()
    # every text is its own language's only one
    assert len(got) == 300 and all(r["text_lang"] == f"l{r['page_id']:03d}" for r in got)


def test_more_labels_than_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(x, "abc def") for x in "abc"], "lang string, text string")
    assert langid.train(docs).languages == ["a", "b", "c"]
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.train(docs.unionByName(spark.createDataFrame([("d", "abc")], "lang string, text string")))


# ---- quality ------------------------------------------------------------------------------


def ngrams_by_definition(text):
    """Buckets of the words, and of the runs of one to three shapes."""
    pieces = (text or "").split()
    (w,) = words(pa.array([text or ""])) if text else (None,)
    if w is None or not pieces:
        return []
    kind = {**{c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: 2 for c in "0123456789"}}
    kind |= {c: 3 for c in ".,;:!?"} | {c: 4 for c in "'\"()-"}
    shapes, out = [], []
    for i, x in enumerate(pieces):
        again = next((d for d in range(1, quality.BACK + 1) if i >= d and pieces[i - d] == x), 0)
        first, last, second = (kind.get(c, 6) for c in (x[0], x[-1], x[max(0, len(x) - 2)]))
        long = min(int(math.log2(len(x))), 6)
        shapes.append(mix((((first * 7 + last) * 7 + second) * 7 + long) * 4 + again + 1))
        out.append(mix(int(w.hash[i])))
    run = shapes
    for d in range(3):
        out += run
        run = [mix((h * 3 + s) & M64) for h, s in zip(run, shapes[d + 1 :])]
    return [x >> 48 for x in out]


def made_texts(rng, n):
    good, bad = [f"word{i}" for i in range(40)], ["Buy!", "NOW", "$$$", "win", "win"]
    rows = []
    for i in range(n):
        share = 0.1 if i % 3 else 0.6
        rows.append((i, " ".join(rng.choice(bad) if rng.random() < share else rng.choice(good) for _ in range(rng.choice((1, 3, 8, 60))))))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_resampling_is_its_definition(spark, seed):
    rng = random.Random(seed)
    rows = [*made_texts(rng, 150), (500, None), (501, ""), (502, "word1"), (502, "word1")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 150, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    grams = [ngrams_by_definition(t) for _, t in rows]
    good = dict(labels)
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for (i, _), g in zip(rows, grams):
        np.add.at(raw, g, 1)
        if good.get(i) == 1:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((i, len(g), float(np.mean(ratio[g])) if g else 0.0) for (i, _), g in zip(rows, grams))
    out = quality.resample(docs, marks).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_grams"]) for r in out] == [w[:2] for w in want]
    assert np.allclose([r["log_ratio"] for r in out], [w[2] for w in want], atol=1e-8)
    # the key is the summed log-ratio over one point, and noise that hangs on the id alone
    unit = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("gumbel")), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    noise = {r[0]: r[1] for r in docs.select("doc_id", (-F.log(-F.log(unit)))).collect()}
    points = [r["log_ratio"] - (r["key"] - noise[r["doc_id"]]) / max(r["n_grams"], 1) for r in out]
    assert np.allclose(points, points[0], atol=1e-9)
    k = sum(r["log_ratio"] >= points[0] - 1e-12 for r in out)
    least = sorted((r["key"] for r in out), reverse=True)[k - 1]
    assert 0 < k < len(out) and all(r["kept"] == (r["key"] >= least) for r in out)


def test_sample_size_and_cut_are_parameters(spark):
    rows = made_texts(random.Random(9), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    for k, n in ((0, 0), (17, 17), (120, 120), (1000, 120)):
        assert quality.resample(docs, marks, k=k).where("kept").count() == n
    cut = quality.resample(docs, marks, temperature=0).collect()
    assert all(r["kept"] == (r["key"] >= 0) for r in cut) and 0 < sum(r["kept"] for r in cut) < 120
    # at a high temperature the sample is mostly chance: short of the best, but no row twice
    hot = quality.resample(docs, marks, temperature=1e9, k=60).where("kept")
    assert hot.count() == hot.select("doc_id").distinct().count() == 60
    assert {r["doc_id"] for r in hot.collect()} != {r["doc_id"] for r in quality.resample(docs, marks, temperature=0, k=60).where("kept").collect()}
