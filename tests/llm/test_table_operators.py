"""Search, groups, language, quality and the pipeline on small tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskrules.llm import langid, neardup, quality, topk
from riskrules.llm.shared import key_filter, passes, read
from riskrules.llm.words import shingles, words

DOCS = "doc_id long, text string, extra string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    read(spark, SF, "benchmark")


def test_key_filter_holds_all_keys(spark):
    bits = key_filter(spark.range(1000).select(F.xxhash64("id").alias("k")), "k").value
    keys = np.array([r[0] for r in spark.range(1000).select(F.xxhash64("id")).collect()]).view(np.uint64)
    assert passes(bits, keys).all() and passes(bits, keys * np.uint64(7)).sum() < 100
    assert not passes(key_filter(spark.range(0).select("id"), "id").value, keys).any()


def test_topk_against_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(700)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (702, None), (703, []), (704, [1.0, None]), (705, [float("nan")] * 6), (706, [float("inf")] * 6), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and i < 702]
    assert set(got) == {i for i, _ in ok if i % 50 == 0}
    for i, q in ok:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i))[:5]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert topk.search(df.limit(0), F.lit(True), 5).count() == 0
    assert topk.search(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).count() == 2


def sets(rows, k):
    out = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        out.setdefault(i, []).append(s)
    return out


def groups_by_definition(rows, k):
    nodes = [(i, s) for i, many in sets(rows, k).items() if i is not None for s in many]
    label = {i: i for i, _ in nodes}
    while True:
        before = dict(label)
        for i, a in nodes:
            for j, b in nodes:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


@pytest.mark.parametrize("k", [2, 5])
def test_neardup_groups_by_definition(spark, k):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(4)]
    rows, n = [], 0
    for b in base:
        for _ in range(22):
            t = list(b)
            for _ in range(rng.randrange(9)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(999)}"
            rows.append(((n * 37) % 997 - 40, " ".join(t), "e"))
            n += 1
    rows += [(2000, rows[0][1], "e"), (2001, rows[0][1].upper(), "e"), (2002, None, "e"), (2003, "", "e"), (2004, "one", "e"), (2005, "One", "e"), (None, "one", "e"), (2006, "one two", "e")]
    got = neardup.groups(spark.createDataFrame(rows, DOCS), k=k).collect()
    want, size = groups_by_definition(rows, k), sets(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == len(size[r["doc_id"]][0])
    assert neardup.groups(spark.createDataFrame([], DOCS), k=k).count() == 0


def test_neardup_ids_at_both_ends_and_repeated_ids(spark):
    """Ids span the 64-bit range; rows of one id with different texts are one document."""
    rng = random.Random(4)
    texts = [[f"t{i}w{rng.randrange(500)}" for _ in range(60)] for i in range(6)]

    def near(i):
        t = list(texts[i])
        t[rng.randrange(60)] = "new"
        return " ".join(t)

    lo, hi = -(2**63), 2**63 - 1
    rows = [(lo, near(0)), (hi, near(0)), (hi - 1, near(1)), (lo + 5, near(1))]
    # 5 links its two texts' groups; through 1 and 7 four ids are one component
    rows += [(5, near(2)), (5, near(3)), (1, near(2)), (7, near(3)), (7, near(4)), (9, near(4)), (11, near(5)), (11, near(5))]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    want = {lo: lo, hi: lo, lo + 5: lo + 5, hi - 1: lo + 5, 1: 1, 5: 1, 7: 1, 9: 1, 11: 11}
    assert got == {(i, c, i == c) for i, c in want.items()}


def test_pairs_headed_by_other_documents_meet(spark):
    """Links whose key groups all start with documents akin to neither end."""
    rng, rows = random.Random(11), []
    for pair in range(6):
        a = [f"w{pair}x{x}" for x in range(200)]
        b = a[:185] + [f"v{pair}x{x}" for x in range(15)]
        (w,) = words(pa.array(a))
        g = shingles(w, 1)[1]
        least = [a[int(np.argmin(g * m + add))] for m, add in zip(neardup.MULT, neardup.ADD, strict=True)]
        heads = [least[i : i + neardup.WIDTH] for i in range(0, neardup.SYMBOLS, neardup.WIDTH)]
        rng.shuffle(b)
        rows += [(100 * pair + i, " ".join(s), "e") for i, s in enumerate([*heads, a, b])]
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, DOCS), k=1).collect()}
    want = groups_by_definition(rows, 1)
    assert got == {i: want[i] for i in got} and sum(got[100 * p + 21] == 100 * p + 20 for p in range(6)) == 6


def counted(df, seen):
    """``df``, adding to ``seen`` each row that is worked out."""

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


def test_pairs_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    links = counted(spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(99, 98), (98, 99)], "a long, b long"), seen)
    labels = {r["id"]: r["label"] for r in neardup.components(links).collect()}
    assert labels == dict.fromkeys(range(40), 0) | {98: 98, 99: 98} and seen.value == 41
    seen = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([(i, "one two three four") for i in range(8)], "doc_id long, text string")
    pairs = counted(spark.createDataFrame([(0, i) for i in range(1, 8)], "a long, b long"), seen)
    got = neardup.compared(pairs, texts, 2, 80, 100).collect()
    assert sorted(tuple(r) for r in got) == [(0, i, True) for i in range(1, 8)] and seen.value == 7


def test_large_sets_of_partners_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = spark.createDataFrame([(i, "one two three four" if i < 30 else f"other {i}") for i in range(40)], "doc_id long, text string")
    pairs = [(0, i) for i in range(1, 40)] + [(30, 31), (1, 2)]
    got = neardup.compared(spark.createDataFrame(pairs, "a long, b long"), texts, 2, 80, 100).collect()
    assert sorted(tuple(r) for r in got) == sorted([(0, i, True) for i in range(1, 30)] + [(1, 2, True)])


def test_index_meets_every_pair_within_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(neardup.SYMBOLS, neardup.RADIUS, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, neardup.RADIUS).astype(np.uint16)
        ka, kb = neardup.index_keys(np.stack([a, b]))
        assert set(ka.tolist()) & set(kb.tolist())


def test_language_of_pages(spark):
    docs, pages = read(spark, SF, "documents"), read(spark, SF, "pages")
    extra = spark.createDataFrame([(-1, None, None), (-2, "http://www.thered.example.net/", ""), (-3, "odd", "<html lang='FR-ca'><p>1")], "page_id long, url string, html string")
    out = langid.identify(pages.select("page_id", "url", "html").unionByName(extra), docs).toPandas().set_index("page_id")
    urls = {r[0]: r[1] for r in pages.select("page_id", "url").collect()}
    known = [(out.lang[i], u.split("/")[3]) for i, u in urls.items() if u.split("/")[3] in ("en", "de", "fr", "es")]
    assert len(known) > 20 and sum(a == b for a, b in known) >= 0.95 * len(known)
    assert out.declared[-3] == "fr" and out.lang.notna().all()
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert langid.identify(pages, docs.limit(0)).where("lang IS NULL").count() == pages.count()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    out = quality.resample(docs, labels.where("doc_id % 2 = 0")).join(labels, "doc_id").where("doc_id % 2 = 1").toPandas()
    assert (out.kept[out.quality == 1]).mean() >= 0.97 and (out.kept[out.quality == 0]).mean() <= 0.1


def test_quality_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b c", "x"), (3, "a b c", "x")], DOCS)
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert quality.resample(docs, labels).count() == 5
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == 5
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_quality_judges_rows_of_a_repeated_id(spark):
    docs, labels = read(spark, SF, "documents").select("doc_id", "text"), read(spark, SF, "labels")
    kept = quality.resample(docs, labels).select("doc_id", "kept")
    good = kept.where("kept AND doc_id IS NOT NULL").agg(F.min("doc_id")).first()[0]
    bad = kept.where("NOT kept").agg(F.min("doc_id")).first()[0]
    text = docs.where(F.col("doc_id") == bad).first()["text"]
    more = docs.unionByName(spark.createDataFrame([(good, text)], "doc_id long, text string"))
    judged = quality.resample(more, labels).where(F.col("doc_id") == good)
    left = quality.keep_good(more, labels).where(F.col("doc_id") == good)
    assert judged.where("NOT kept").count() == 1 and left.count() == judged.where("kept").count() == 1


def test_kth_largest(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 50) for _ in range(3000)] + [7.5] * 40
    df = spark.createDataFrame([(x,) for x in xs], "key double")
    for k in (1, 2, 500, 1500, 3040):
        assert quality.kth_largest(df, "key", k) == sorted(xs, reverse=True)[k - 1]


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF).persist()
        assert out.count() <= seen.count()
        if name != "pieces":
            assert out.columns == docs.columns
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in seen.select("doc_id").collect()}
            seen = out
    texts = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == texts
    whole = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in whole.select("doc_id").collect()} == set(texts)


def test_names_of_queries():
    import __spark_entry__ as E

    names = [q for q in E.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert os.path.isdir("/root/testdata")
