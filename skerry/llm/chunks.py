"""Texts in chunks that tokenizers encode apart, so that each distinct chunk is encoded once.

A byte-level pre-tokenizer that joins one space to the word after it, and a piece model whose pieces
hold white space only at their start, both end a token where a non-blank character is followed by one
space or newline and then by another non-blank character. Texts are cut there. Nothing else is assumed
of the tokenizers: whatever stands within a chunk is left to their libraries.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Distinct chunks in one of the two generations that a worker keeps, and the longest chunk that is kept.
CHUNKS_KEPT = 1 << 19
LONGEST_KEPT = 48
_ODD = ()
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class ChunkMemo:
    """Results of ``encode(surfaces)``, a list for a list, by chunk.

    They are kept for two generations of ``most`` chunks: a chunk that is seen again moves to the younger.

    A surface is a chunk with the space or newline before it. The key of a chunk after a space leaves
    that space out, as ``str.split`` does; ``_ODD`` marks keys that only come from texts with other white
    space, which are cut by an expression instead.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = CHUNKS_KEPT):
        self.encode, self.most = encode, most
        self.by_key: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.by_surface: dict[str, object] = {}

    def results(self, texts: list[str], prefix: str = "") -> list[list]:
        """For each text, which must not be empty, the results of its chunks; ``prefix`` is put before each text."""
        if len(self.by_key) + len(self.by_surface) > self.most:
            self.old, self.by_key = self.by_key, {}
            self.by_surface.clear()
        keys = [text.replace("\n", " \n").split(" ") for text in texts]
        firsts = [k.pop(0) for k in keys]
        heads = [prefix + k for k in firsts]
        found = [list(map(self.by_key.get, k)) for k in keys]
        new = {c for k, f in zip(keys, found) if None in f for c, x in zip(k, f) if x is None}
        again = new & self.old.keys()
        self.by_key.update((c, self.old[c]) for c in again)
        new = list(new - again)
        known = [c for c in new if not is_odd(c)]
        self.by_key.update(dict.fromkeys(new, _ODD))
        self.by_key.update(zip(known, self.encode([c if c[0] == "\n" else " " + c for c in known])))
        found = [[self.by_key[c] if x is None else x for c, x in zip(k, f)] if None in f else f for k, f in zip(keys, found)]
        # where a text begins or ends in white space, or has more than one blank in a row
        others = {i: _CUT.split(prefix + t) for i, (t, first, f) in enumerate(zip(texts, firsts, found)) if _ODD in f or not heads[i] or is_odd(first)}
        new = list({s for i, h in enumerate(heads) for s in others.get(i, (h,)) if s not in self.by_surface})
        self.by_surface.update(zip(new, self.encode(new)))
        out = [[self.by_surface[s] for s in others[i]] if i in others else [self.by_surface[heads[i]], *f] for i, f in enumerate(found)]
        for memo in (self.by_key, self.by_surface):
            for chunk in [c for c in known + new if len(c) > LONGEST_KEPT]:
                memo.pop(chunk, None)
        return out


def is_odd(key: str) -> bool:
    """Whether white space beside the cut would stand next to other white space."""
    inner = key[1:] if key[:1] == "\n" else key
    return not inner or inner[0].isspace() or inner[-1].isspace()


def batches(rows, most_rows: int, most_chars: int):
    """Lists of consecutive ``(value, text)`` rows, bounded in rows and, but for single longer texts, in characters."""
    now, chars = [], 0
    for row in rows:
        size = len(row[1] or "")
        if now and (len(now) >= most_rows or chars + size > most_chars):
            yield now
            now, chars = [], 0
        now.append(row)
        chars += size
    if now:
        yield now
