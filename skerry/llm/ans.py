"""Static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

A block codes up to ``BLOCK_IDS`` ids. Id ``t * lanes + j`` belongs to step ``t`` of lane ``j``, every
lane has a 64-bit state of its own, and all lanes write 32-bit words into one stream. Every
``CHECKPOINT_STEPS`` steps the states and the place in the stream are kept, so a block can be entered
there, and all its segments are decoded side by side. A segment's ids have a CRC-32.

All blocks share one table of frequencies that add up to ``2 ** SCALE_BITS``; an id that the corpus
holds has a frequency of at least one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
BLOCK_IDS = 1 << 20
LANES = 1024
CHECKPOINT_STEPS = 256
#: States lie in [LOW, LOW << 32).
LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"rANS"


def table(counts: np.ndarray) -> np.ndarray:
    """Frequencies by id from the corpus' counts by id; zero where the count is."""
    total = 1 << SCALE_BITS
    if (counts > 0).sum() > total:
        raise ValueError("more distinct ids than the frequencies' scale has room for")
    if not counts.sum():
        return np.zeros(len(counts), np.uint32)
    share = counts / counts.sum() * total
    freq = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    freq[freq.argmax()] += max(0, total - freq.sum())
    while (over := int(freq.sum() - total)) > 0:  # rare ids were rounded up: the others pay by their shares
        due = np.minimum(freq - 1, -(-freq * over // freq.sum())).clip(0)
        due[np.cumsum(due) > over] = 0
        if not due.any():
            due[freq.argmax()] = min(over, freq.max() - 1)
        freq -= due
    return freq.astype(np.uint32)


class Coder:
    """Encoder and decoder for one table of frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = np.concatenate(([0], np.cumsum(freq.astype(np.uint64))[:-1])).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - SCALE_BITS)  # from here on a word goes out first
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
        """A block of one id or more: header, checkpoints, checksums, words."""
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        steps = -(-n // lanes)
        padded = np.full(steps * lanes, ids[-1], np.uint32)  # fewer ids of padding than lanes
        padded[:n] = ids
        rows = padded.reshape(steps, lanes)
        if not self.freq[rows].all():
            raise ValueError("an id that the table does not have")
        state = np.full(lanes, LOW, np.uint64)
        scale = np.uint64(SCALE_BITS)
        out, left, marks = [], 0, []
        for t in range(steps - 1, -1, -1):
            freq, below = self.freq[rows[t]], self.below[rows[t]]
            full = state >= self.most[rows[t]]
            if full.any():
                out.append(state[full].astype(np.uint32))
                left += len(out[-1])
                state[full] >>= _WORD
            whole = state // freq
            state = (whole << scale) + (state - whole * freq) + below
            if t % every == 0:
                marks.append((left, state.copy()))
        marks.reverse()
        words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
        places = np.array([left - after for after, _ in marks], np.uint32)
        sums = np.array([zlib.crc32(padded[k * every * lanes : min((k + 1) * every * lanes, n)].astype("<u4")) for k in range(len(marks))], np.uint32)
        head = _HEAD.pack(_MAGIC, n, lanes, every, len(marks), left)
        return b"".join((head, places.astype("<u4").tobytes(), sums.astype("<u4").tobytes(), np.concatenate([s for _, s in marks]).astype("<u8").tobytes(), words.astype("<u4").tobytes()))

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the segments from ``first`` to before ``last``, all of them unless told otherwise; raises on damage."""
        magic, n, lanes, every, segments, count = _HEAD.unpack_from(block)
        size = _HEAD.size + segments * (8 + 8 * lanes) + 4 * count
        if magic != _MAGIC or len(block) != size or segments != -(-n // (lanes * every)):
            raise ValueError("not a whole block")
        at = _HEAD.size
        places = np.frombuffer(block, "<u4", segments, at).astype(np.int64)
        sums = np.frombuffer(block, "<u4", segments, at + 4 * segments)
        states = np.frombuffer(block, "<u8", segments * lanes, at + 8 * segments).reshape(segments, lanes)
        words = np.frombuffer(block, "<u4", count, size - 4 * count).astype(np.uint64)
        last = segments if last is None else last
        place, state = places[first:last].copy(), states[first:last].astype(np.uint64)
        steps = [min(every, -(-n // lanes) - k * every) for k in range(first, last)]
        out = np.empty((last - first, every, lanes), np.uint32)
        low, mask, scale = LOW, np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for t in range(max(steps, default=0)):
            live = len(steps) if t < steps[-1] else len(steps) - 1  # only a block's last segment is shorter
            x = state[:live]
            slot = x & mask
            ids = self.id_of[slot]
            x = self.freq[ids] * (x >> scale) + slot - self.below[ids]
            short = x < low
            before = np.cumsum(short, axis=1)
            take = (place[:live, None] + before - 1)[short]
            if len(take) and take.max() >= count:
                raise ValueError("the words of a block end too early")
            x[short] = (x[short] << _WORD) | words[take]
            place[:live] += before[:, -1]
            state[:live] = x
            out[:live, t] = ids
        parts = []
        for i, k in enumerate(range(first, last)):
            ids = out[i, : steps[i]].reshape(-1)[: min(n - k * every * lanes, every * lanes)]
            if zlib.crc32(ids.astype("<u4")) != sums[k]:
                raise ValueError("a segment's ids do not have their checksum")
            parts.append(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)
