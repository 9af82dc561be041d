r"""Chat formatting by columnar byte assembly.

One row per turn goes in.  Rows are dealt by conversation and sorted by turn;
each Arrow batch is then assembled column-wise: segment lengths, cumulative
offsets and scatter indices are computed in numpy, and headers and contents
are copied into one preallocated buffer that becomes the Arrow output.  A
conversation that spans batches comes out in consecutive parts, so memory is
bounded by a batch, not by a conversation.

Template: ``<|start|>`` role ``\n`` text ``<|end|>\n`` for each turn.  Control
strings inside roles and texts (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) get one ``%`` after their first character, and ones that already
carry ``%`` there get one more, so unescaping removes exactly one: reversible.

Defined results: null text or role is empty; turns of equal number are ordered
by role, then text (repeated rows all stay); a null ``conv_id`` is one
conversation; rows without ``conv_id`` order by null turn first; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, HEAD_END, END = b"<|start|>", b"\n", b"<|end|>\n"
#: One ``%`` more than the text had, after the first character.
ESCAPE = (r"([<\[])(%*)(\||/?s>|/?INST\])", r"\1%\2\3")
UNESCAPE = (re.compile(r"([<\[])%(%*)(\||/?s>|/?INST\])"), r"\1\2\3")
TURN = re.compile(r"<\|start\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
LOSS_ROLES = ("assistant",)
#: Bytes of text assembled at once.
PART = 1 << 22
FORMATTED = "conv_id long, n_turns long, formatted binary, loss_start array<long>, loss_end array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _content(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and length of each value of a string column (null: empty)."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off[:-1], np.diff(off)


def assemble(segments: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of segments side by side in one buffer.

    A segment is a constant (bytes) or a column ``(raw, start, length)``.
    Returns the buffer and the offsets, ``(rows, segments + 1)``.
    """
    rows = next(len(s[1]) for s in segments if isinstance(s, tuple))
    lengths = np.stack([np.full(rows, len(s)) if isinstance(s, bytes) else s[2] for s in segments], 1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape) if rows else np.zeros(lengths.shape, np.int64)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for k, s in enumerate(segments):
        if isinstance(s, bytes):
            out[starts[:, k, None] + np.arange(len(s))] = np.frombuffer(s, np.uint8)
        else:
            raw, at, n = s
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(starts[:, k], n) + inside] = raw[np.repeat(at, n) + inside]
    return out, np.concatenate([starts, ends[:, -1:]], 1)


def _escaped(col: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(col, ""), *ESCAPE)


def _role(col: pa.Array) -> pa.Array:
    """Roles share the header line: ``%`` and line feeds are percent-coded first."""
    col = pc.replace_substring(pc.fill_null(col, ""), "%", "%25")
    return _escaped(pc.replace_substring(col, "\n", "%0A"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows of about PART bytes, or one longer row."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PART, "right")))
            yield b.slice(at, to - at)
            at = to


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        roles, ids = b.column("role"), b.column("conv_id")
        buffer, at = assemble([START, _content(_role(roles)), HEAD_END, _content(_escaped(b.column("text"))), END])
        id_values, id_null = np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_null(ids))
        first = np.r_[True, (id_values[1:] != id_values[:-1]) | (id_null[1:] != id_null[:-1])]
        head = np.flatnonzero(first)
        turns = np.diff(np.r_[head, b.num_rows])
        base = np.repeat(at[head, 0], turns)
        loss = np.asarray(pc.fill_null(pc.is_in(roles, pa.array(LOSS_ROLES)), False))
        # offsets of the loss texts inside their conversation's part
        loss_off = np.r_[0, np.cumsum(np.add.reduceat(loss.astype(np.int64), head))].astype(np.int32)
        cuts = pa.py_buffer(np.r_[at[head, 0], at[-1, -1]].astype(np.int64))
        formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, cuts, pa.py_buffer(buffer)])
        spans = [pa.ListArray.from_arrays(pa.array(loss_off), pa.array((at[:, k] - base)[loss])) for k in (3, 4)]
        yield pa.record_batch([ids.take(pa.array(head)), pa.array(turns), formatted.cast(pa.binary()), *spans], names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations, in parts: ``conv_id, n_turns, formatted`` and the
    byte spans of ``formatted`` under the loss mask (``loss_start, loss_end``).

    The parts of a conversation are consecutive rows of one partition, in order.
    """
    rows = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    return (
        rows.repartition(F.col("conv_id"))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_format, FORMATTED)
    )


def unescape(text: str) -> str:
    return UNESCAPE[0].sub(UNESCAPE[1], text)


def unrole(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class _Digest:
    """Running digests of one conversation, fed part by part."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, starts, ends) -> None:
        text = formatted.decode()
        self.chars += len(text)
        for role, content in TURN.findall(text):
            self.n_turns += 1
            self.turns.update(f"{unrole(role)}\n{unescape(content)}\n".encode())
        for lo, hi in zip(starts, ends, strict=True):
            masked = unescape(formatted[lo:hi].decode())
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def table(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    now, done = None, []
    for b in batches:
        for r in b.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                done += [now.row()] if now else []
                now = _Digest(r["conv_id"])
            now.add(r["formatted"], r["loss_start"], r["loss_end"])
        if done:
            yield table(done)
            done = []
    if now:
        yield table([now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss mask parsed from the formatted bytes, as digests per conversation."""
    return formatted.mapInArrow(_digest, DIGEST)
