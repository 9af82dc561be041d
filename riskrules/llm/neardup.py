"""Near-duplicate groups: MinHash signatures and a multi-index Hamming join.

A document is its set of distinct word shingles.  A signature holds SYMBOLS
b-bit minima; the Hamming distance of two signatures counts unequal symbols.
Signatures are split into CHUNKS; a pair within RADIUS unequal symbols has, by
the pigeonhole principle, a chunk with at most ERRORS of them, so the keys
"chunk with any ERRORS symbols left out" meet for every such pair.  At a
similarity of 0.8 a pair has 20 unequal symbols of 100 in the mean and lies
beyond the radius of 39 with a chance below 1e-5.

Links are confirmed on the full sets.  No group is expanded into all pairs:

1. equal sets are one node, with a number of its own (ids may be any 64-bit values);
2. a document is compared with the least id of each of its key groups, the one
   that shares most keys first; confirmed links make components;
3. the same comparisons also tell which documents are akin (similarity NEAR or
   more), and kinship makes clusters: both ends of most links are akin to the
   ends of the key groups they share.  In clusters that still span several
   components, the documents outside the largest component are compared with all
   others, block by block: a unit of work holds two blocks of sets and lets out
   links only.  Clusters inside one component cost nothing;
4. a key group may be headed by a document akin to neither end of a link.  Key
   groups that span several clusters are dealt the same way, as blocks of
   signatures: all their pairs of different clusters within RADIUS, whose sizes
   allow the similarity, are compared.  So every pair within the radius is
   compared or lies in one component.

Comparisons with a single document are dealt by (document, block of partners):
one set is held at a time and partners stream past it.  Components come from
label propagation with pointer jumping over written tables.

Defined results: null or empty texts have empty sets and are linked to nothing;
a text shorter than a shingle is one shingle, its whole sequence; rows with a
null id are linked to nothing, get a null component and are kept; rows that
repeat an id are one document for links, each with the set of its own text (a link
of any of them is a link of the document); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import key_filter, passes, shared_table
from .words import mix, shingles, words

SYMBOLS, CHUNKS, ERRORS = 100, 20, 1
WIDTH = SYMBOLS // CHUNKS
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Partners of one held set, and documents of a cluster's and of a key's block, in a unit of work.
BLOCK, CLUSTER_BLOCK, KEY_BLOCK = 512, 256, 2048
#: Similarity from which two documents are akin.
NEAR = 0.35
LEAVE = list(combinations(range(WIDTH), WIDTH - ERRORS))
_seeds = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64))
MULT, ADD = _seeds[:SYMBOLS] | np.uint64(1), _seeds[SYMBOLS:]
SIGNED = "doc_id long, tkey long, n long, set_a long, set_b long, sig binary"


def signatures(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16-bit symbols (rows, SYMBOLS) of the non-empty sets laid end to end."""
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.empty((len(sizes), SYMBOLS), np.uint16)
    for i in range(SYMBOLS):
        out[:, i] = mix(np.minimum.reduceat(g * MULT[i] + ADD[i], at)) >> np.uint64(48)
    return out


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("tkey")
            for w in words(b.column("text"), lower=True):
                sizes, g = shingles(w, k)
                full = np.flatnonzero(sizes)
                set_a, set_b = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                sig = [b""] * len(sizes)
                if len(full):
                    at = np.r_[0, np.cumsum(sizes[full])[:-1]]
                    set_a[full] = np.add.reduceat(mix(g), at)
                    set_b[full] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for r, s in zip(full, signatures(g, sizes[full]), strict=True):
                        sig[r] = s.tobytes()
                cols = [ids.slice(w.lo, w.hi - w.lo), keys.slice(w.lo, w.hi - w.lo), pa.array(sizes), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(sig, pa.binary())]
                yield pa.record_batch(cols, names=[f.split()[0] for f in SIGNED.split(", ")])

    return sign


def _symbols(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), SYMBOLS)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk with every allowed set of errors left out."""
    chunks = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.uint64)
    keys = []
    for c in range(CHUNKS):
        for n, keep in enumerate(LEAVE):
            packed = reduce(lambda a, x: (a << np.uint64(16)) | x, (chunks[:, c, j] for j in keep))
            keys.append(mix(packed + mix(np.array([c * len(LEAVE) + n + 1], np.uint64))))
    return np.stack(keys, 1)


def _keys(shared=None):
    """Rows into (key, other columns), a row per key of the signature."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            others = [x for x in b.schema.names if x != "sig"]
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                k = index_keys(_symbols(part.column("sig")))
                row = np.repeat(np.arange(part.num_rows), k.shape[1])
                k = k.ravel()
                if shared is not None:
                    keep = passes(shared.value, k)
                    k, row = k[keep], row[keep]
                at = pa.array(row)
                yield pa.record_batch([pa.array(k.view(np.int64)), *(part.column(x).take(at) for x in others)], names=["key", *others])

    return keys


def _compare(k: int, num: int, den: int):
    """Stream of (held set, then its partners) rows into akin pairs and links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for b in batches:
            a, block, other = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "block", "b"))
            for w in words(b.column("text"), lower=True):
                sizes, g = shingles(w, k)
                end = np.cumsum(sizes)
                links = []
                for r in range(w.lo, w.hi):
                    mine = g[end[r - w.lo] - sizes[r - w.lo] : end[r - w.lo]]
                    if other[r] < 0 and group != (a[r], block[r]):
                        group, held = (a[r], block[r]), mine
                    elif other[r] >= 0 and group == (a[r], block[r]):
                        at = np.searchsorted(held, mine)
                        both = int((held[np.minimum(at, len(held) - 1)] == mine).sum()) if len(held) else 0
                        union = len(mine) + len(held) - both
                        if both >= NEAR * union and both:
                            links.append((a[r], other[r], den * both >= num * union))
                if links:
                    x, y, z = zip(*links, strict=True)
                    yield pa.record_batch([pa.array(np.array(x, np.int64)), pa.array(np.array(y, np.int64)), pa.array(z, pa.bool_())], names=["a", "b", "linked"])

    return compare


def compared(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``a, b, linked`` of the pairs that are akin; linked: their full sets reach
    the similarity num / den.

    ``texts`` has one row per node (``doc_id, text``), whose numbers are not negative: b = -1
    marks the row of the held set, which sorts first.
    """
    pairs = shared_table(pairs.select("a", "b"), "pairs")
    # partners of one block are dealt without a number; a larger set takes more than BLOCK pairs
    blocks = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("long")
    large = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    dealt = pairs.join(large, "a", "left").select("a", "b", F.coalesce(blocks, F.lit(0).cast("long")).alias("block"))
    held = dealt.select("a", "block").distinct().select("a", F.lit(-1).cast("long").alias("b"), "block")
    rows = (
        dealt.withColumn("doc_id", F.col("b"))
        .unionByName(held.withColumn("doc_id", F.col("a")))
        .join(texts, "doc_id")
        .select("a", "block", "b", "text")
    )
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(_compare(k, num, den), "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the smallest id reachable over ``links`` (a, b)."""
    # both directions of a row at once: the links are worked out a single time
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared_table(links.select(F.inline(ways)).distinct(), "links")
    labels = shared_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while before is not None:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = shared_table(new.join(up, "label").select("id", F.least("label", "up").alias("label")), "labels")
        now = labels.agg(total).first()[0]
        if now == before:
            break
        before = now
    return labels


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between documents."""
    la, lb = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    more = components(links.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    more = more.select(F.col("id").alias("label"), F.col("label").alias("to"))
    return shared_table(labels.join(more, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")


def _cross_links(k: int, num: int, den: int):
    """Rows of a unit of work (two blocks of a cluster) into links between
    documents with different labels; one side of each is outside ("left")."""

    def of_unit(held: list) -> Iterator[tuple[int, int]]:
        ids, labels, left, own = (np.array([h[i] for h in held]) for i in range(4))
        sets = [h[4] for h in held]
        sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i in np.flatnonzero(left):
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            both = np.bincount(owner[at], minlength=len(sets))
            union = sizes + sizes[i] - both
            hit = (labels != labels[i]) & (both > 0) & (den * both >= num * union)
            for j in np.flatnonzero(hit & (~left | (own != own[i]) | (ids > ids[i]))):
                yield int(ids[i]), int(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        unit, held = None, []
        for b in batches:
            c = {x: b.column(x).to_pylist() for x in ("cluster", "p", "q", "doc_id", "label", "left", "block")}
            for w in words(b.column("text"), lower=True):
                sizes, g = shingles(w, k)
                end = np.cumsum(sizes)
                for r in range(w.lo, w.hi):
                    now = (c["cluster"][r], c["p"][r], c["q"][r])
                    if now != unit:
                        if held and (found := list(of_unit(held))):
                            yield out(found)
                        unit, held = now, []
                    held.append((c["doc_id"][r], c["label"][r], c["left"][r], c["block"][r], g[end[r - w.lo] - sizes[r - w.lo] : end[r - w.lo]].copy()))
        if held and (found := list(of_unit(held))):
            yield out(found)

    return run


def _dealt(placed: DataFrame, block: int) -> DataFrame:
    """Rows ``cluster, doc_id, label`` of the clusters with several labels, dealt
    over units of work (cluster, p, q): the documents outside the largest label
    ("left") meet all others there."""
    per = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("size"))
    main = per.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), F.max("size").alias("most"), F.max_by("label", F.struct("size", "label")).alias("main")
    )
    blocks = [F.ceil(F.col(c) / block).cast("int") for c in ("most", "rest")]
    main = main.where("parts > 1").withColumn("rest", F.col("all") - F.col("most"))
    main = main.select("cluster", "main", blocks[0].alias("n_main"), blocks[1].alias("n_left"))
    rows = placed.join(main, "cluster").withColumn("left", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("left"), F.col("n_left")).otherwise(F.col("n_main"))).cast("int")
    rows = rows.withColumn("block", own)
    # units: (left block, main block) as (p, -1 - q); (left block, left block) as p <= q
    lefts, mains = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("n_left", "n_main"))
    of_left = F.concat(
        F.transform(mains, lambda j: F.struct(F.col("block").alias("p"), (-j - 1).alias("q"))),
        F.transform(lefts, lambda j: F.struct(F.least("block", j).alias("p"), F.greatest("block", j).alias("q"))),
    )
    of_main = F.transform(lefts, lambda i: F.struct(i.alias("p"), (-F.col("block") - 1).alias("q")))
    units = rows.withColumn("unit", F.explode(F.when(F.col("left"), of_left).otherwise(of_main)))
    return units.select("cluster", "unit.p", "unit.q", "doc_id", "label", "left", "block")


def _clusters(akin: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, doc_id, label`` of every labelled document."""
    # kinship between components: whole components are in one cluster anyway
    la, lb = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    across = akin.join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    clusters = components(across).select(F.col("id").alias("label"), F.col("label").alias("cluster"))
    placed = labels.select(F.col("id").alias("doc_id"), "label").join(clusters, "label", "left")
    return shared_table(placed.select(F.coalesce("cluster", "label").alias("cluster"), "doc_id", "label"), "clusters")


def _cluster_links(placed: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between the components that lie in one cluster."""
    units = _dealt(placed, CLUSTER_BLOCK).join(texts, "doc_id")
    return (
        units.repartition("cluster", "p", "q")
        .sortWithinPartitions("cluster", "p", "q", "doc_id")
        .mapInArrow(_cross_links(k, num, den), "a long, b long")
    )


def _close_pairs(num: int, den: int):
    """Rows of a unit of work (two blocks of a key group) into pairs of different
    labels within RADIUS, of sizes that allow the similarity num / den."""

    def of_unit(parts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, labels, left, own, n, sig = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
        for i in np.flatnonzero(left):
            sizes = den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])
            at = np.flatnonzero((labels != labels[i]) & sizes & (~left | (own != own[i]) | (ids > ids[i])))
            at = at[(sig[at] != sig[i]).sum(1) <= RADIUS]
            if len(at):
                yield np.minimum(ids[at], ids[i]), np.maximum(ids[at], ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        unit, held, found = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            c, p, q, *cols = (b.column(x).to_numpy(zero_copy_only=False) for x in ("cluster", "p", "q", "doc_id", "label", "left", "block", "n"))
            cols.append(_symbols(b.column("sig")))
            new = np.flatnonzero((c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, len(c)], strict=True):
                if unit != (now := (c[lo], p[lo], q[lo])):
                    if held:
                        found.extend(of_unit(held))
                    unit, held = now, []
                held.append([x[lo:hi] for x in cols])
            if found:
                yield out(found)
                found = []
        if held and (found := list(of_unit(held))):
            yield out(found)

    return run


def _near_in_units(placed: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: pairs of different labels of a cluster that lie within RADIUS."""
    units = _dealt(placed, KEY_BLOCK).join(sigs, "doc_id")
    pairs = units.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "doc_id").mapInArrow(_close_pairs(num, den), "a long, b long")
    return pairs.distinct()


def _meeting(sigs: DataFrame, placed: DataFrame, shared, num: int, den: int) -> DataFrame:
    """``a, b``: pairs of different clusters that share a key and lie within RADIUS."""
    clustered = sigs.join(placed.select("doc_id", F.col("cluster").alias("label")), "doc_id").select("doc_id", "label", "sig")
    clustered = shared_table(clustered, "clustered")
    keyed = "key long, doc_id long, label long"
    spans = clustered.mapInArrow(_keys(shared), keyed).groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    spans = shared_table(spans.where("least < most").select("key"), "spans")
    met = clustered.mapInArrow(_keys(key_filter(spans, "key")), keyed).join(spans, "key")
    met = shared_table(met.select(F.col("key").alias("cluster"), "doc_id", "label"), "met")
    return _near_in_units(met, sigs, num, den)


def _across(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    la, lb = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    return pairs.join(la, "a").join(lb, "b").where("la <> lb").select("a", "b")


def groups(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Documents are linked if den * shared >= num * union of their k-word shingles.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    signed = shared_table(rows.mapInArrow(_sign(k), SIGNED), "signed")
    taking_part = signed.where("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "set_a", "set_b"]
    nodes = taking_part.groupBy(*same).agg(F.min(F.struct("doc_id", "tkey")).alias("least"), F.min("sig").alias("sig"))
    # a signature becomes CHUNKS * WIDTH keys, so its table is dealt over as many
    # parts as the session shuffles into and a task aggregates few of them; the
    # numbers of the nodes are fixed by writing them
    nodes = nodes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set_a", "set_b")
    nodes = shared_table(nodes.select(*same, "sig", "least.doc_id", "least.tkey", F.monotonically_increasing_id().alias("node")), "nodes")
    sigs = nodes.select(F.col("node").alias("doc_id"), "n", "sig")

    ends = sigs.select("doc_id", "sig").mapInArrow(_keys(), "key long, doc_id long").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    ends = shared_table(ends.where("least < most").drop("most"), "ends")
    shared = key_filter(ends, "key")
    held = sigs.select("doc_id", "sig").mapInArrow(_keys(shared), "key long, doc_id long").join(ends, "key")
    star = held.where("doc_id <> least").select("doc_id", F.col("least").alias("end"))
    star = shared_table(star.groupBy("doc_id", "end").agg(F.count(F.lit(1)).alias("keys")), "star")

    wanted = key_filter(star.select("doc_id").union(star.select("end")).distinct(), "doc_id")
    texts = shared_table(_texts(rows, nodes, wanted), "texts")
    best = star.groupBy("doc_id").agg(F.max_by("end", F.struct("keys", -F.col("end"))).alias("end"))
    first = shared_table(compared(best.select(F.col("end").alias("a"), F.col("doc_id").alias("b")), texts, k, num, den), "akin")
    labels = components(first.where("linked"))
    all_ids = texts.select(F.col("doc_id").alias("id"))
    labels = shared_table(all_ids.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")

    rest = _across(labels, star.select(F.col("end").alias("a"), F.col("doc_id").alias("b")))
    rest = shared_table(compared(rest, texts, k, num, den), "akin")
    labels = _relabel(labels, rest.where("linked"))
    placed = _clusters(first.union(rest), labels)
    labels = _relabel(labels, _cluster_links(placed, texts, k, num, den))
    met = _meeting(sigs, placed, shared, num, den)
    labels = _relabel(labels, compared(met, texts, k, num, den).where("linked"))

    labels = nodes.select(F.col("node").alias("id")).join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    labels = shared_table(labels, "labels")
    if not (twice := _in_several(taking_part, nodes, same)).isEmpty():
        labels = _relabel(labels, twice)
    placed = nodes.select(*same, "doc_id", F.col("node").alias("id")).join(labels, "id")
    component = placed.groupBy("label").agg(F.min("doc_id").alias("component"))
    found = shared_table(placed.select(*same, "label").join(component, "label").select(*same, "component"), "found")
    own = taking_part.select("doc_id", *same).join(found, same).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _in_several(taking_part: DataFrame, nodes: DataFrame, same: list[str]) -> DataFrame:
    """``a, b``: nodes that hold rows of one id, as links to the least of them."""
    sets = F.struct(*same)
    ids = taking_part.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo <> hi").select("doc_id")
    held = taking_part.join(ids, "doc_id", "left_semi").select("doc_id", *same).distinct()
    held = held.join(nodes.select(*same, "node"), same).select("doc_id", "node")
    least = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return shared_table(held.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "repeated")


def _texts(rows: DataFrame, nodes: DataFrame, wanted) -> DataFrame:
    """``doc_id, text``: a text of each node that takes part in a comparison, by its number."""

    def of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(wanted.value, b.column("node").to_numpy().view(np.uint64))))

    kept = nodes.select("node", "doc_id", "tkey").mapInArrow(of_nodes, "node long, doc_id long, tkey long")
    kept = shared_table(kept, "compared")
    held = key_filter(kept, "tkey")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(held.value, b.column("tkey").to_numpy().view(np.uint64))))

    picked = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(pick, "doc_id long, tkey long, text string")
    return picked.join(kept, ["doc_id", "tkey"]).groupBy(F.col("node").alias("doc_id")).agg(F.first("text").alias("text"))
