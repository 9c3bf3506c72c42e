"""Exact tokenization by independent segments.

The byte-level tokenizer cuts a text at places that depend only on a few neighbouring bytes, and no token
crosses such a place. So a segment's ids are the same in every text, and the library is asked once
for each distinct segment of a task; texts for which the cuts are not proven go to it whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from touchline.llm.common import encoded

#: Entries that a task's table of known segments holds before it starts anew.
KNOWN = 400_000


def byte_bpe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern surely begin: a bool for each byte.

    A space before a sure non-space begins one; so do a line feed between two printable ASCII
    characters and the character after it; so does ASCII punctuation after an ASCII letter.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n > 1:
        here, after = data[1:], np.append(data[2:], np.uint8(0))
        before = data[:-1]
        solid = ((after > 32) & (after < 127)) | ((after >= 0xC3) & (after != 0xE1) & (after != 0xE2) & (after != 0xE3))
        last = np.zeros(n, bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True  # a text's last byte has nothing after it
        cut[1:n] |= (here == 32) & solid & ~last[1:]
        shown = (before > 32) & (before < 127)
        feed = (here == 10) & shown & (after > 32) & (after < 127) & ~last[1:] & ~cut[1:n]
        at = np.flatnonzero(feed) + 1
        cut[at] = True
        cut[at + 1] = True
        lower = before | 32
        punct = (here > 32) & (here < 127) & ~(((here | 32) >= 97) & ((here | 32) <= 122)) & ~((here >= 48) & (here <= 57))
        cut[1:n] |= (lower >= 97) & (lower <= 122) & (before < 128) & punct
    return cut


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBpe:
    """Ids by the tokenizers library, without added special tokens; strings of special tokens as by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.special = [s.encode() for s in special]
        self.model = self.library.model
        self.shown = byte_letters()
        self.space = self.shown[32]
        self.start: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.start.clear()
        self.first = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _ids(self, text: str) -> list[int]:
        """A letter run behind one space at most is a single pre-token, which the model takes directly; the rest takes the whole way."""
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            shown = text.replace(" ", self.space) if word.isascii() else text.encode().decode("latin-1").translate(self.shown)
            return [t.id for t in self.model.tokenize(shown)]
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        made, sizes = [], []
        for x in new:
            ids = self._ids(x.decode())
            made += ids
            sizes.append(len(ids))
        k, n = len(self.start), len(new)
        while k + n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(made) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(made)] = made
        self.size[k : k + n] = sizes
        self.first[k : k + n] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else 0
        self.used += len(made)
        self.start.update(zip(new, range(k, k + n), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and each text's first place among them (n + 1)."""
        cut = byte_bpe_cuts(data, offsets)
        raw = data.tobytes()
        for s in self.special:
            for m in re.finditer(re.escape(s), raw):  # such a text is one segment
                row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                cut[offsets[row] + 1 : offsets[row + 1]] = False
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, pieces = encoded(data, cuts)
        if len(self.start) > KNOWN:
            self._clear()
        found = [self.start.get(x, -1) for x in pieces]
        if -1 in found:
            self._learn([x for x, k in zip(pieces, found, strict=True) if k < 0])
            found = [self.start[x] for x in pieces]
        known = np.array(found, np.int64)[codes]
        size = self.size[known]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.first[known] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(cuts, offsets)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for all tasks of a worker process."""
    return ByteBpe(path)

