"""Static range asymmetric numeral system over interleaved lanes, in numpy.

One frequency table is shared by all blocks.  A block codes its symbols in LANES
interleaved states: symbol i belongs to lane i mod LANES, and one numpy step
advances all lanes.  Every CHECK steps the lane states and the place in the word
stream are kept, so a reader can start there; a checksum covers the symbols.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Scale of the frequencies (bits), lanes of a block, steps between checkpoints.
SCALE, LANES, CHECK = 20, 2048, 64
LOW = np.uint64(1 << 32)
_S, _32 = np.uint64(SCALE), np.uint64(32)
_MASK = np.uint64((1 << SCALE) - 1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies summing to 2^SCALE, at least 1 for every symbol of the alphabet.

    Shares are rounded down; what is left goes to the most frequent symbol (a
    single-symbol alphabet still leaves 1 for its neighbour, so none reaches the
    whole scale).
    """
    n = len(counts)
    total = int(counts.sum())
    room = (1 << SCALE) - n
    share = counts.astype(np.float64) / total * room if total else np.zeros(n)
    freq = 1 + np.floor(share).astype(np.int64)
    freq[int(np.argmax(counts))] += (1 << SCALE) - int(freq.sum())
    return freq


class Table:
    """Frequencies, their running sums, and the symbol of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(symbols: np.ndarray, table: Table) -> dict:
    """A block: word stream, checkpoints (stream places and lane states), checksum."""
    n = len(symbols)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words, places, states = [], [], []
    freq, cum = table.freq, table.cum
    for t in range(steps - 1, -1, -1):
        s = symbols[t * LANES : (t + 1) * LANES]
        x, f = state[: len(s)], freq[s]
        out = x >> (np.uint64(64) - _S) >= f
        if out.any():
            words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(out, x >> _32, x)
        else:
            words.append(np.zeros(0, np.uint32))
        q = x // f
        state[: len(s)] = (q << _S) + (x - q * f) + cum[s]
        if t % CHECK == 0:
            places.append(t)
            states.append(state.copy())
    words.reverse()
    ends = np.cumsum([0, *map(len, words)])
    places.reverse()
    states.reverse()
    return {
        "n": n,
        "stream": np.concatenate(words).tobytes() if words else b"",
        "at": ends[places].astype(np.int64).tobytes() if places else b"",
        "states": np.concatenate(states).tobytes() if states else b"",
        "crc": zlib.crc32(symbols.astype("<u4").tobytes()),
    }


def decode(n: int, stream: bytes, at: bytes, states: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols from checkpoint ``first`` up to checkpoint ``last`` (or the end)."""
    steps = -(-n // LANES)
    stop = steps if last is None else min(steps, last * CHECK)
    words = np.frombuffer(stream, np.uint32)
    pos = int(np.frombuffer(at, np.int64)[first]) if steps else 0
    state = np.frombuffer(states, np.uint64)[first * LANES : (first + 1) * LANES].copy() if steps else np.zeros(0, np.uint64)
    freq, cum, slots = table.freq, table.cum, table.slots
    begin = first * CHECK * LANES
    out = np.empty(max(0, min(n, stop * LANES) - begin), np.uint32)
    for t in range(first * CHECK, stop):
        m = min(LANES, n - t * LANES)
        x = state[:m]
        slot = x & _MASK
        s = slots[slot]
        out[t * LANES - begin : t * LANES - begin + m] = s
        x = freq[s] * (x >> _S) + slot - cum[s]
        low = x < LOW
        k = int(low.sum())
        if k:
            x[low] = (x[low] << _32) | words[pos : pos + k].astype(np.uint64)
            pos += k
        state[:m] = x
    return out
