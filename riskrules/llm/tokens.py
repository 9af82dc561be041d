"""Token-id files: whole texts to ids, stored as independent rANS blocks.

1. Texts are encoded with a public byte-level BPE (the tokenizers library) and an
   end id is appended; ids of all documents are written once to a shared table.
2. One pass over it counts every id of the whole corpus; the frequencies are
   scaled once and shared by all blocks.
3. Documents are range-dealt in rising doc_id order, packed into blocks of whole
   documents (at least BLOCK_TOKENS ids, or one longer document) and written; a
   block row holds its documents' ids and lengths, the coded stream, checkpoints
   and a checksum, and can be decoded alone.
4. Reading decodes blocks in parallel; global starts come from sums of the block
   sizes (per part, then over the few parts), never from one sorted stream.

Encoding cost: a byte-level BPE never merges across the tokenizer's word splits,
and a single space between two other characters always starts a split, so a text
is cut there and each distinct piece is encoded once per worker, in a cache of
bounded size; unknown pieces of several texts are learned together.  Texts with other white space than single spaces and single line
feeds between other characters, or with the text of an added token, go to the
library whole; pieces that tell such a text are never remembered.

Defined results: null or empty text is the end id alone; rows with a null
doc_id sort first; rows that repeat an id are ordered by
a hash of their texts; an empty table
gives an empty file; other columns are not read.  The text of an added token
(``<|endoftext|>``) becomes that token, as the library does with
``add_special_tokens=False``; a document longer than a block is a block of its own.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .shared import shared_table

#: Least ids of a block (unless its part ends), pieces a worker remembers.
BLOCK_TOKENS, CACHE = 1 << 19, 1_500_000
SPACE = re.compile(r"\s")
#: Marks that end a piece (an apostrophe may begin a split of its own), words spelt in
#: one call, pieces of texts with unknown ones that are held.
MARKS, JOINED, WAITING = "".join(c for c in string.punctuation if c != "'"), 32, 20_000
IDS = "doc_id long, tkey long, ids binary"
BLOCK = "part int, seq int, doc_ids binary, no_id binary, lens binary, n long, stream binary, at binary, states binary, crc long"
READ = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1
    stands for itself, other bytes are numbered from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, n = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in own else n))
        n += b not in own
    return letters


class Encoder:
    """A tokenizer file with a bounded memory of pieces, as id bytes."""

    def __init__(self, path: str, kind: np.dtype | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = kind or np.dtype("<u4")
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.newline = self.whole("\n")
        self.between = self._between()
        self.known = self._start()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # an added token that may lie across pieces is looked for in every text
        self.wide = [c for c in added if " " in c or "\n" in c]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _start(self) -> dict[str, bytes]:
        return {"\n": self.newline}

    def _between(self) -> tuple[str, int] | None:
        """A letter that no merge holds and no word is spelt with, and its id: words
        joined by it are merged each by itself.  None if the model has no such letter."""
        model = json.loads(self.library.to_str())["model"]
        odd = ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")
        letter = self.letters[0]
        at = self.library.token_to_id(letter)
        if at is None or any(model.get(x) for x in odd) or any(letter in x for m in model["merges"] for x in m):
            return None
        return letter, at

    def _spell(self, words: list[str]) -> None:
        """Learn words of letters (after at most one space): each is one split of the
        tokenizer and goes to its model directly, JOINED at a time."""
        letters, tokenize = self.letters, self.library.model.tokenize
        spelt = [letters[32] * (w[0] == " ") + w.removeprefix(" ") if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in words]
        if self.between is None:
            self.known.update((w, np.array([t.id for t in tokenize(s)], self.kind).tobytes()) for w, s in zip(words, spelt, strict=True))
            return
        letter, mark = self.between
        ids = []
        for i in range(0, len(spelt), JOINED):
            ids += [t.id for t in tokenize(letter.join(spelt[i : i + JOINED]))]
            ids.append(mark)
        ids, size = np.array(ids, self.kind), self.kind.itemsize
        raw, ends = ids.tobytes(), (np.flatnonzero(ids == mark) * size).tolist()
        begins = [0, *(e + size for e in ends)]
        self.known.update((w, raw[i:j]) for w, i, j in zip(words, begins, ends, strict=False))

    def _learn(self, pieces: set[str]) -> None:
        """Encode unknown pieces: words of letters, with the run of marks that ends them
        (a split of its own), by ``_spell``; others go to the library whole.
        A piece that tells that its text does (it is empty, a lone space, or holds
        white space inside or an added token) stays unknown."""
        known = self.known
        others, words, marked, runs = [], set(), [], set()
        for p in pieces:
            word = p.rstrip(MARKS)
            if not word.removeprefix(" ").isalpha() or (len(word) < len(p) and self.added.search(p)):
                inside = p.removeprefix(" ")
                if inside and not SPACE.search(inside) and not self.added.search(p):
                    others.append(p)
                continue
            if word not in known:
                words.add(word)
            if len(word) < len(p):
                run = p[len(word) :]
                marked.append((p, word, run))
                if run not in known:
                    runs.add(run)
        self._spell(list(words))
        others += runs.difference(others)
        for p, e in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            known[p] = array(self.kind.char, e.ids).tobytes()
        for p, word, run in marked:
            known[p] = known[word] + known[run]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        if len(self.known) > CACHE:
            self.known = self._start()
        known, out = self.known, [b""] * len(texts)
        waiting, unknown, held = [], set(), 0

        def settle() -> None:
            self._learn(unknown)
            for i, pieces in waiting:
                try:
                    out[i] = b"".join(map(known.__getitem__, pieces))
                except KeyError:
                    out[i] = self.whole(texts[i])

        for i, text in enumerate(texts):
            if "\0" in text or any(c in text for c in self.wide):
                out[i] = self.whole(text)
                continue
            # odd white space leaves a piece that is empty, a lone space or holds white
            # space itself, and no such piece is ever known
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            try:
                out[i] = b"".join(map(known.__getitem__, pieces))
            except KeyError:
                # learned together with those of other texts
                waiting.append((i, pieces))
                unknown.update(set(pieces).difference(known))
                held += len(pieces)
                if held > WAITING:
                    settle()
                    waiting, unknown, held = [], set(), 0
        settle()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, kind: np.dtype) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, kind)
    return _encoders[path]


def _kind(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _encode(path: str, end_id: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kind), np.array([end_id], kind).tobytes()
        for b in batches:
            col = b.column("text")
            for i in range(0, b.num_rows, 128):
                texts = [t or "" for t in col.slice(i, 128).to_pylist()]
                ids = [x + end for x in enc.ids(texts)]
                yield pa.record_batch([b.column("doc_id").slice(i, 128), b.column("tkey").slice(i, 128), pa.array(ids, pa.binary())], names=["doc_id", "tkey", "ids"])

    return run


def _count(size: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(size, np.int64), [], 0
        for b in batches:
            for v in b.column("ids"):
                held.append(np.frombuffer(v.as_buffer(), kind))
                waiting += len(held[-1])
                if waiting > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=size)
                    held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    return run


def _pack(freq, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = rans.Table(freq.value), TaskContext.get().partitionId()
        ids, held, size, seq = [], [], 0, 0

        def block():
            coded = rans.encode(np.concatenate(held), table)
            values = np.array([i or 0 for i in ids], np.int64)
            missing = np.array([i is None for i in ids], np.uint8)
            row = {"part": part, "seq": seq, "doc_ids": values.tobytes(), "no_id": missing.tobytes(), "lens": np.array([len(h) for h in held], np.int64).tobytes(), **coded}
            return pa.RecordBatch.from_pylist([{k: row[k] for k in _BLOCK.names}], schema=_BLOCK)

        for b in batches:
            for i, v in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                ids.append(i)
                held.append(np.frombuffer(v.as_buffer(), kind))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield block()

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_BLOCK, _READ = (pa.schema([(n, _TYPES[t]) for n, t in map(str.split, s.split(", "))]) for s in (BLOCK, READ))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0) -> None:
    """Write the ids of every text: ``path/blocks`` and ``path/frequencies``."""
    size = Encoder(tokenizer).size
    size, kind = max(size, end_id + 1), _kind(max(size, end_id + 1))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    ids = shared_table(rows.mapInArrow(_encode(tokenizer, end_id, kind), IDS), "ids")
    counted = ids.select("ids").mapInArrow(_count(size, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.write.parquet(f"{path}/frequencies")
    freq = _frequencies(docs.sparkSession, path, size)
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tkey")
    ordered.mapInArrow(_pack(freq, kind), BLOCK).write.parquet(f"{path}/blocks")


def _frequencies(spark: SparkSession, path: str, size: int):
    """The shared table: at most one row per id of the vocabulary."""
    counts = np.zeros(size, np.int64)
    got = spark.read.parquet(f"{path}/frequencies").toArrow()
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return spark.sparkContext.broadcast(rans.scaled(counts))


def _unpack(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq.value)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids = rans.decode(r["n"], r["stream"], r["at"], r["states"], table)
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc"]:
                    raise ValueError(f"block {r['part']}/{r['seq']}: checksum differs")
                lens = np.frombuffer(r["lens"], np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                doc_ids = pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=np.frombuffer(r["no_id"], np.bool_))
                n = len(lens)
                cols = [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["seq"], np.int32)), doc_ids, pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64())]
                yield pa.record_batch(cols, schema=_READ)

    return run


def read_tokens(spark: SparkSession, path: str, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the files."""
    freq = _frequencies(spark, path, max(Encoder(tokenizer).size, end_id + 1))
    blocks = spark.read.parquet(f"{path}/blocks")
    docs = blocks.mapInArrow(_unpack(freq), READ)
    sizes = blocks.select("part", "seq", "n")
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per written part
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    places = sizes.withColumn("place", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(base, "part")
    return docs.join(places.select("part", "seq", (F.col("base") + F.col("place")).alias("place")), ["part", "seq"]).select(
        "doc_id", (F.col("place") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
