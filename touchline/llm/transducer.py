"""A tokenizer's vocabulary compiled to a deterministic transducer whose transitions carry emitted-token counts.

Byte-pair encoding of a text is decided from the left: the last token of each prefix is the one vocabulary piece that ends
there and stands after the token before it as their joint encoding would have it. What the future needs of a prefix is
finite: the longest suffix that begins a piece, and for each place where a piece may still begin the token before it and how
many tokens ago. That is a state. Reading a character gives the next state and the change of the number of tokens.
States are determinised when first reached and kept in a hash table of bounded size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MARK = "▁"
FREE = ""  # no token before, or one that cannot matter

#: Slots of the transition table, which starts anew beyond half of them.
SLOTS = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """Token counts of a sentencepiece BPE model with byte fallback and identity normalisation.

    Symbols 1 to 4 stand for characters that no longer piece holds, by what they emit: one piece, or their bytes. Others
    stand for one character each. A space and the mark are one symbol. Where no piece holds two neighbours side by side, the
    text parts: both sides are encoded as if alone (``apart``)."""

    def __init__(self, pieces: dict[str, float], slots: int = SLOTS):
        self.score, self.slots = pieces, slots
        longer = [p for p in pieces if len(p) > 1]
        letters = sorted({c for p in longer for c in p})
        self.letters = [""] * 5 + letters
        self.symbols = len(self.letters)
        code = {c: k for k, c in enumerate(letters, 5)}
        self.of = np.zeros(0x110000, np.int32)
        for lo, hi, size in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.of[lo:hi] = size
        for p in pieces:
            if len(p) == 1:
                self.of[ord(p)] = 1
        for c, k in code.items():
            self.of[ord(c)] = k
        self.of[32] = self.of[ord(MARK)]
        self.near = np.zeros((self.symbols, self.symbols), bool)
        for p in longer:
            for a, b in zip(p, p[1:], strict=False):
                self.near[code[a], code[b]] = True
        self.pairs = {a + b for p in longer for a, b in zip(p, p[1:], strict=False)}
        # the trie of pieces with failure links; a node is the longest suffix read that begins a piece
        self.next: list[dict[str, int]] = [{}]
        self.text = [""]
        for p in longer:
            node = 0
            for c in p:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.text.append(self.text[node] + c)
                node = self.next[node][c]
        self.fail = [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for c, child in self.next[node].items():
                at = self.fail[node]
                while at and c not in self.next[at]:
                    at = self.fail[at]
                self.fail[child] = self.next[at].get(c, 0)
                queue.append(child)
        self.joined: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.keys = np.full(self.slots, -1, np.int64)
        self.to = np.zeros(self.slots, np.int32)
        self.emits = np.zeros(self.slots, np.int8)
        self.held = 0
        self._state((0, ((FREE, 0),)))

    def _state(self, what: tuple) -> int:
        k = self.states.setdefault(what, len(self.known))
        if k == len(self.known):
            self.known.append(what)
        return k

    def encode(self, text: str) -> list[str]:
        """A short string's tokens by merging: the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, before: str, piece: str) -> bool:
        """Whether ``piece`` is a token after the token ``before``."""
        found = self.joined.get((before, piece))
        if found is None:
            if len(self.joined) > self.slots:
                self.joined.clear()
            found = self.joined[before, piece] = self.encode(before + piece) == ([before, piece] if before else [piece])
        return found

    def step(self, state: int, symbol: int) -> tuple[tuple, int]:
        """The next state and the tokens that the transition adds (negative if it joins several)."""
        if symbol < 5:
            return self.known[0], symbol
        node, held = self.known[state]
        before, at = {}, node
        for x in held:  # one for each suffix of the node that is a node, the longest first
            before[len(self.text[at])] = x
            at = self.fail[at]
        c = self.letters[symbol]
        while node and c not in self.next[node]:
            node = self.fail[node]
        node = self.next[node].get(c, 0)
        ends, size, piece = [], [], self.text[node]
        at = node
        while at:
            ends.append(at)
            size.append(len(self.text[at]))
            at = self.fail[at]
        for n, at in zip(size, ends, strict=True):
            piece = self.text[at]
            if piece in self.score and n - 1 in before and self.stands(before[n - 1][0], piece):
                made = before[n - 1][1] + 1
                break
        else:
            piece = c
            made = before[0][1] + (1 if c in self.score else len(c.encode()))
        kept = []
        for n, at in zip(size, ends, strict=True):
            token, ago = before[n - 1]
            kept.append((token if token and token[-1] + self.text[at][0] in self.pairs else FREE, ago - made))
        return (node, (*kept, (piece, 0))), made

    def _learn(self, key: int) -> int:
        """The slot of a new transition."""
        what, made = self.step(key // self.symbols, key % self.symbols)
        slot = self._slot(key)
        while self.keys[slot] >= 0:
            slot = (slot + 1) % self.slots
        self.keys[slot], self.to[slot], self.emits[slot] = key, self._state(what), made
        self.held += 1
        return slot

    def _slot(self, key: int) -> int:
        return ((key * int(_MIX)) & 0xFFFFFFFFFFFFFFFF) >> (65 - self.slots.bit_length())

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slots of transitions, compiling those that are new."""
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * _MIX) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)
        held = self.keys[slot]
        wrong = np.flatnonzero(held != key)
        if not len(wrong):
            return slot
        while len(wrong):
            free = held[wrong] < 0
            if free.any():
                new, back = np.unique(key[wrong[free]], return_inverse=True)
                slot[wrong[free]] = np.array([self._learn(int(k)) for k in new])[back]
                wrong = wrong[~free]
            slot[wrong] = (slot[wrong] + 1) % self.slots
            held[wrong] = self.keys[slot[wrong]]
            wrong = wrong[held[wrong] != key[wrong]]
        return slot

    def run(self, symbol: np.ndarray, apart: np.ndarray, state: np.ndarray, lo: np.ndarray, hi: np.ndarray, keep: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens added by reading symbol[lo:hi] from ``state``, for many ranges side by side. When the table is half
        full it starts anew between two symbols; the states that are still needed, those of ``keep`` too, get their new numbers in place."""
        order = np.argsort(lo - hi, kind="stable")
        size = (hi - lo)[order]
        at, now, total = lo[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        wide = max(1, self.slots // 4)  # a step adds no more transitions than this
        for k in range(0, len(order), wide):
            own = size[k : k + wide]
            live = len(own) - np.searchsorted(own[::-1], np.arange(int(own[0])), side="right")
            for n in live.tolist():
                if self.held * 2 > self.slots:
                    self._renew(now, *keep)
                a, s = at[k : k + n], now[k : k + n]
                s[apart[a]] = 0
                slot = self.find(s * self.symbols + symbol[a])
                now[k : k + n] = self.to[slot]
                total[k : k + n] += self.emits[slot]
                at[k : k + n] += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def _renew(self, *live: np.ndarray) -> None:
        """Starts the table anew; ``live`` arrays of states keep their meaning."""
        old = self.known
        self._clear()
        for states in live:
            used, back = np.unique(states, return_inverse=True)
            states[:] = np.array([self._state(old[k]) for k in used.tolist()], np.int64)[back]

    def trim(self) -> None:
        """Starts the table anew when it is half full; only between runs, as states get new numbers."""
        if self.held * 2 > self.slots:
            self._clear()


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer for all tasks of a worker process, from the model file's vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]
    return Transducer({model.id_to_piece(k): model.get_score(k) for k in plain})
