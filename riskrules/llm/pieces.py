"""SentencePiece encoding with n-best segmentations, and decoding.

The lattice of a text holds every piece of the model's vocabulary that occurs in
it.  No piece carries a word mark after another character, so the lattice falls
apart before each run of word marks (and around characters that no longer piece
holds): a text's segmentation is that of its segments.

1. Forward: Viterbi scores of all distinct segments of a slice at once, in numpy
   (a trie walked in step for all segments), with back pointers; a backward pass
   gives each segment's loss of its second-best segmentation.
2. N-best: the n best of a text differ only in the n - 1 segments with the least
   loss; for these, A* runs backward from the segment's end with the forward
   scores as exact heuristic, so only states on n-best paths are expanded, and
   the segment lists are merged by a heap.

Characters without a piece become byte pieces at a penalty below every piece.
Alternatives are stored as edits of the best segmentation, so a result row stays
about as long as its text.  Decoding joins piece bytes columnwise.

Defined results: null text is empty and has no pieces; equal scores prefer the
longer last piece; a text has fewer alternatives if it has fewer segmentations;
decoding returns the model's normalised text (this model: the text itself, a
literal U+2581 reads as a space); rows pass one by one, repeated or null ids
too; an empty table gives an empty result; other columns pass through (names of
the result columns are replaced).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Segments longer than this take the scalar path; characters of a slice, segments
#: solved in step, and ids decoded at once.
WIDE, SLICE, STEP, DECODE = 48, 600_000, 8_192, 200_000
ALTERNATIVES = T.ArrayType(T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("edits", T.ArrayType(T.StructType([
        T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]))),
]))
MADE = {"n_pieces": T.LongType(), "score": T.DoubleType(), "ids": T.ArrayType(T.IntegerType()), "alternatives": ALTERNATIVES}
_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALT = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


class Vocabulary:
    """Pieces and scores of a model, and a hashed trie over code points."""

    BITS = 21

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.score = np.array([m.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        self.pieces = {m.id_to_piece(i): i for i in plain}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.penalty = min((self.score[i] for i in plain if self.score[i] > -1e8), default=0.0) - 10.0
        self.longest = max(map(len, self.pieces), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a word mark after another character")
        shared = {c for p in self.pieces if len(p) > 1 for c in p}
        self.alone = "" if "\n" in shared else "\n"
        self._bytes(n)
        self._trie()
        self.nbest_of: dict[tuple[str, int], list] = {}

    def _bytes(self, n: int) -> None:
        raw = []
        back = {i: bytes([b]) for b, i in self.byte.items()}
        for i in range(n):
            p = back.get(i)
            if p is None:
                p = b"" if self.model.is_control(i) else self.model.id_to_piece(i).replace(MARK, " ").encode()
            raw.append(p)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    def _trie(self) -> None:
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for p, i in self.pieces.items():
            at = 0
            for c in map(ord, p):
                nxt = nodes.get((at, c))
                if nxt is None:
                    nxt = nodes[(at, c)] = len(piece)
                    piece.append(-1)
                at = nxt
            piece[at] = i
        size = 1 << self.BITS
        self.keys, self.next = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for (at, c), nxt in nodes.items():
            key = at << 21 | c
            slot = self._slot(np.array([key], np.int64))[0]
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.next[slot] = key, nxt
        self.piece = np.array(piece, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def follow(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie nodes, -1 where there is none."""
        key = node.astype(np.int64) << 21 | char
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.next[slot], -1)
        lost = np.flatnonzero((got != key) & (got >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) % len(self.keys)
            got = self.keys[slot[lost]]
            hit = got == key[lost]
            out[lost[hit]] = self.next[slot[lost[hit]]]
            lost = lost[~hit & (got >= 0)]
        return out

    def ids_of(self, char: str) -> list[int]:
        """Pieces of a character without a piece of its own."""
        if len(self.byte) == 256:
            return [self.byte[b] for b in char.encode()]
        return [self.unknown]

    def segments(self, text: str) -> list[str]:
        """Parts of a normalised text between which no piece reaches over."""
        if MARK + MARK not in text and "\0" not in text:
            text = text.replace(MARK, "\0" + MARK)
            if self.alone:
                text = text.replace(self.alone, "\0" + self.alone + "\0")
            return [s for s in text.split("\0") if s]
        other = MARK + self.alone
        return re.findall(f"{MARK}*[^{other}]+|{MARK}+|[{other}]", text)

    # One segment at a time -------------------------------------------------

    def edges(self, seg: str) -> list[list[tuple[int, int, float]]]:
        """Edges of the lattice by their end: (start, piece or -1, score)."""
        by_end: list[list[tuple[int, int, float]]] = [[] for _ in range(len(seg) + 1)]
        pieces, score = self.pieces, self.score
        for i in range(len(seg)):
            single = False
            for j in range(i + 1, min(len(seg), i + self.longest) + 1):
                p = pieces.get(seg[i:j])
                if p is not None:
                    by_end[j].append((i, p, float(score[p])))
                    single |= j == i + 1
            if not single:
                by_end[i + 1].append((i, -1, self.penalty))
        return by_end

    def nbest(self, seg: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a segment: (score, ids), best first."""
        key = (seg, n)
        if key in self.nbest_of:
            return self.nbest_of[key]
        by_end = self.edges(seg)
        forward = [0.0] + [float("-inf")] * len(seg)
        for j in range(1, len(seg) + 1):
            forward[j] = max((forward[i] + s for i, _, s in by_end[j]), default=float("-inf"))
        # states from the end: least (-(suffix score + forward score), place, order)
        order, found = 0, []
        heap = [(-forward[-1], len(seg), 0, 0.0, None)]
        while heap and len(found) < n:
            f, j, _, g, path = heapq.heappop(heap)
            if j == 0:
                ids = []
                while path is not None:
                    (i, p), path = path
                    ids += [p] if p >= 0 else self.ids_of(seg[i])
                found.append((-f, ids))
                continue
            for i, p, s in by_end[j]:
                if forward[i] > float("-inf"):
                    order += 1
                    heapq.heappush(heap, (-(g + s + forward[i]), i, order, g + s, ((i, p), path)))
        if len(self.nbest_of) > 20_000:
            self.nbest_of.clear()
        self.nbest_of[key] = found
        return found

    # All segments of a slice -----------------------------------------------

    def solve(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best ids of each segment (flat ids, offsets), best score, second-best loss."""
        n = np.array([len(s) for s in segs], np.int64)
        best, loss = np.zeros(len(segs)), np.full(len(segs), np.inf)
        counts = np.zeros(len(segs), np.int64)
        solved = []
        lower = 0
        for width in (4, 6, 8, 10, 12, 16, 24, WIDE):
            group = np.flatnonzero((n > lower) & (n <= width))
            lower = width
            for i in range(0, len(group), STEP):
                at = group[i : i + STEP]
                flat, counts[at], best[at], loss[at] = self._solve([segs[k] for k in at], n[at], width)
                solved.append((at, flat))
        for k in np.flatnonzero(n > WIDE):
            two = self.nbest(segs[k], 2)
            best[k], counts[k] = two[0][0], len(two[0][1])
            if len(two) > 1:
                loss[k] = two[0][0] - two[1][0]
            solved.append((np.array([k]), np.array(two[0][1], np.int32)))
        offsets = np.r_[0, np.cumsum(counts)]
        out = np.empty(int(offsets[-1]), np.int32)
        for at, flat in solved:
            c = counts[at]
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(c) - c, c)
            out[np.repeat(offsets[at], c) + inside] = flat
        return out, offsets, best, loss

    def _solve(self, segs: list[str], n: np.ndarray, width: int):
        """Forward and backward passes in step over segments of at most ``width``."""
        u = len(segs)
        chars = np.zeros((u, width), np.int64)
        chars[np.arange(width) < n[:, None]] = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32)
        forward = np.full((u, width + 1), -np.inf)
        forward[:, 0] = 0.0
        came, piece = np.zeros((u, width + 1), np.int32), np.full((u, width + 1), -1, np.int32)
        steps = []
        for i in range(width):
            row = np.flatnonzero(n > i).astype(np.int32)
            if not len(row):
                break
            node = np.zeros(len(row), np.int64)
            single = np.zeros(u, np.bool_)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                if j > i + 1:
                    more = n[row] >= j
                    row, node = row[more], node[more]
                node = self.follow(node, chars[row, j - 1])
                live = node >= 0
                row, node = row[live], node[live]
                if not len(row):
                    break
                p = self.piece[node]
                ends = p >= 0
                w, p = row[ends], p[ends]
                if len(w):
                    if j == i + 1:
                        single[w] = True
                    s = self.score[p]
                    steps.append((i, j, w, s))
                    self._relax(forward, came, piece, w, i, j, s, p)
            w = np.flatnonzero((n > i) & ~single).astype(np.int32)
            if len(w):
                s = np.full(len(w), self.penalty)
                steps.append((i, i + 1, w, s))
                self._relax(forward, came, piece, w, i, i + 1, s, np.full(len(w), -1, np.int32))
        rows = np.arange(u)
        best = forward[rows, n]
        # walk back for all segments at once, marking the start of each best edge by its end
        on = np.full((u, width + 1), -1, np.int32)
        place, walked = n.copy(), []
        w = rows
        while len(w):
            start = came[w, place[w]]
            on[w, place[w]] = start
            walked.append((w, start, piece[w, place[w]]))
            place[w] = start
            w = w[start > 0]
        of, start, ids = (np.concatenate(x) for x in zip(*walked, strict=True))
        order = np.lexsort((start, of))
        of, start, ids = of[order], start[order], ids[order]
        if (ids < 0).any():
            spelt = [[p] if p >= 0 else self.ids_of(segs[x][i]) for x, i, p in zip(of.tolist(), start.tolist(), ids.tolist(), strict=True)]
            of = np.repeat(of, [len(x) for x in spelt])
            ids = np.array([p for x in spelt for p in x], np.int32)
        backward = np.full((u, width + 1), -np.inf)
        backward[rows, n] = 0.0
        for i, j, w, s in reversed(steps):
            backward[w, i] = np.maximum(backward[w, i], s + backward[w, j])
        second = np.full(u, -np.inf)
        for i, j, w, s in steps:
            off = on[w, j] != i
            w = w[off]
            second[w] = np.maximum(second[w], forward[w, i] + s[off] + backward[w, j])
        return ids, np.bincount(of, minlength=u), best, best - second

    @staticmethod
    def _relax(forward, came, piece, w, i, j, s, p) -> None:
        value = forward[w, i] + s
        up = value > forward[w, j]
        w = w[up]
        forward[w, j], came[w, j], piece[w, j] = value[up], i, p[up]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _merge(v: Vocabulary, segs: list[str], names: np.ndarray, counts: np.ndarray, loss: np.ndarray, total: float, n: int) -> list[dict]:
    """Second to n-th best segmentation of a text, as edits of the best."""
    if n < 2 or not len(names):
        return []
    k = min(n - 1, len(names))
    own = loss[names]
    least = np.argpartition(own, k - 1)[:k] if k < len(names) else np.arange(len(names))
    # among equal losses the earliest segments, so results don't depend on the slice
    edge = own[least].max()
    if not np.isfinite(edge):
        places = np.flatnonzero(np.isfinite(own))[:k]
    else:
        under = np.flatnonzero(own < edge)
        places = np.sort(np.r_[under, np.flatnonzero(own == edge)[: k - len(under)]])
    if not len(places):
        return []
    lists = [v.nbest(segs[names[p]], n) for p in places]
    start = tuple([0] * len(places))
    heap, seen, out = [(0.0, start)], {start}, []
    token_at = np.cumsum(counts[names]) - counts[names]
    while heap and len(out) < n:
        cost, ranks = heapq.heappop(heap)
        edits = [{"at": int(token_at[p]), "drop": int(counts[names[p]]), "ids": x[r][1]} for p, x, r in zip(places, lists, ranks, strict=True) if r]
        out.append({"score": total - cost, "edits": edits})
        for m in range(len(places)):
            if ranks[m] + 1 < len(lists[m]):
                nxt = (*ranks[:m], ranks[m] + 1, *ranks[m + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum(x[0][0] - x[r][0] for x, r in zip(lists, nxt, strict=True)), nxt))
    return out[1:]


def encode_texts(v: Vocabulary, texts: list[str], n: int) -> tuple[list[np.ndarray], list[float], list[list[dict]]]:
    """Ids, score and alternatives of each text."""
    index: dict[str, int] = {}
    named = []
    for t in texts:
        segs = v.segments(v.model.normalize(t)) if t else []
        named.append(np.array([index.setdefault(s, len(index)) for s in segs], np.int64))
    segs = list(index)
    flat, off, best, loss = v.solve(segs)
    counts = np.diff(off)
    ids, scores, alternatives = [], [], []
    for names in named:
        c = counts[names]
        inside = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        ids.append(flat[np.repeat(off[names], c) + inside])
        scores.append(float(best[names].sum()))
        alternatives.append(_merge(v, segs, names, counts, loss, scores[-1], n))
    return ids, scores, alternatives


def decode_ids(v: Vocabulary, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of rows of ids, without the leading word mark; broken UTF-8 becomes U+FFFD."""
    n = v.raw_len[flat]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    raw = v.raw[np.repeat(v.raw_at[flat], n) + inside].tobytes()
    ends = np.r_[0, np.cumsum(n)][offsets]
    return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _slices(col: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, first = [], 0, 0
    for i, t in enumerate(col):
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _encoder(path: str, n: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for first, texts in _slices(b.column("text")):
                ids, scores, alternatives = encode_texts(v, texts, n)
                sizes = np.array([len(x) for x in ids], np.int64)
                off = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                made = {"n_pieces": pa.array(sizes), "score": pa.array(scores, pa.float64()), "ids": pa.ListArray.from_arrays(off, pa.array(flat)), "alternatives": pa.array(alternatives, _ALT)}
                part = b.slice(first, len(texts))
                yield pa.record_batch([made[c] if c in made else part.column(c) for c in names], names=names)

    return run


def _decoder(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = b.column("ids")
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            off = off - off[0]
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(off, off[at] + DECODE, "right")) - 1)
                text = pa.array(decode_ids(v, flat[off[at] : off[to]], off[at : to + 1] - off[at]), pa.string())
                part = b.slice(at, to - at)
                yield pa.record_batch([text if c == "decoded" else part.column(c) for c in names], names=names)
                at = to

    return run


def encode(docs: DataFrame, model: str, *, n_best: int = 3) -> DataFrame:
    """``docs`` with ``n_pieces, score, ids, alternatives`` of each text."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in MADE]).withColumn("text", docs["text"].cast("string"))
    out = T.StructType(list(kept.schema.fields))
    for name, kind in MADE.items():
        out = out.add(name, kind)
    return kept.mapInArrow(_encoder(model, n_best, out.names), out)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text read back from ``ids``."""
    rows = encoded.drop("decoded")
    out = T.StructType(list(rows.schema.fields)).add("decoded", T.StringType())
    return rows.mapInArrow(_decoder(model, out.names), out)


def round_trip(docs: DataFrame, model: str, *, n_best: int = 3) -> DataFrame:
    """``decode(encode(docs).drop("text"))`` in one pass: the ids go from the
    encoder to the decoder inside one worker."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in (*MADE, "decoded")]).withColumn("text", docs["text"].cast("string"))
    out = T.StructType([f for f in kept.schema.fields if f.name != "text"])
    for name, kind in MADE.items():
        out = out.add(name, kind)
    encoder = _encoder(model, n_best, list(out.names))
    out = out.add("decoded", T.StringType())
    decoder = _decoder(model, out.names)
    return kept.mapInArrow(lambda batches: decoder(encoder(batches)), out)
