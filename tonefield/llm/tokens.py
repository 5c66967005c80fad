"""Encodings of whole texts, word by word.

The public split pattern never lets a match run across a single blank between two characters that are not white
space, so a text may be cut there and each cut piece be encoded once and remembered. Texts without such
a guarantee (runs of blanks, edges of white space) are encoded in one go.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence

#: Pieces that a worker remembers at most; memory stays bounded, results do not depend on it.
MEMORY = 600_000


#: Characters that a block holds at most, where blanks allow a cut.
BLOCK = 100_000


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """text in parts that can be encoded one by one: cut before single blanks between characters that are not white space. A part is longer than
    size only as far as it has no such blank."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class Remembered:
    """encode(list of strings) -> list of values; joined values of the pieces are the value of the text."""

    def __init__(self, encode: Callable[[list[str]], Sequence], join: Callable, memory: int = MEMORY):
        self.encode, self.join, self.memory, self.known = encode, join, memory, {}

    def __call__(self, text: str):
        if not text:
            return self.join([])
        first, *rest = text.split(" ")
        if first == "" or first[-1].isspace():
            return self.encode([text])[0]
        known = self.known
        try:
            return self.join([self.encode([first])[0], *map(known.__getitem__, rest)])
        except (KeyError, TypeError):
            pass
        new = list({x for x in rest if x not in known})
        sound = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        if len(sound) < len(new):
            return self.encode([text])[0]
        if len(known) + len(sound) > self.memory:
            known.clear()
            sound = list(set(rest))
            if not all(x and not x[0].isspace() and not x[-1].isspace() for x in sound):
                return self.encode([text])[0]
        got = dict(zip(sound, self.encode([" " + x for x in sound]), strict=True))
        value = self.join([self.encode([first])[0], *(got.get(x) or known[x] for x in rest)])
        if len(got) <= self.memory:
            known.update(got)
        return value


def public(name: str) -> str:
    """Where a public vocabulary lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BacktrackingBPE:
    """Byte-level BPE by backtracking over an Aho-Corasick automaton.

    Bytes are mapped to Latin-1, so one character is one byte and pyahocorasick finds every vocabulary entry that
    lies in a word in one pass. The longest entry at the current place is tried first; it is taken if it is
    compatible with its left neighbour (their merge would not have happened earlier; the answer is remembered
    per pair) and its end was not found to be a dead end. Otherwise the next shorter entry is tried, and when none is
    left the last token is taken back. A place that failed is never visited again, so the work is linear in the length.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.rank = ranks(path)
        self.word = sorted(self.rank, key=self.rank.__getitem__)
        if [self.rank[w] for w in self.word] != list(range(len(self.word))):
            raise ValueError("ranks must be dense")
        self.split = regex.compile(pattern)
        self.size = [len(w) for w in self.word]
        self.automaton = ahocorasick.Automaton()
        for w, r in self.rank.items():
            self.automaton.add_word(w.decode("latin-1"), (len(w) - 1, r))
        self.automaton.make_automaton()
        self.shorter = [next((self.rank[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in self.rank), -1) for w in self.word]
        self.fits: dict[int, bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        for r, w in enumerate(self.word):
            self.halves.append((r, r))
            for cut in range(len(w) - 1, 0, -1):
                a, b = self.rank.get(w[:cut], r), self.rank.get(w[cut:], r)
                if a < r and b < r and self.compatible(a, b):
                    self.merged[a, b] = r
                    self.halves[r] = (a, b)
                    break
        self.fits = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE could have left a and b side by side: taking their merges back in the order of
        their ranks, no merge across the seam would have come first."""
        bound = len(self.word) + len(self.word)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            left_last = a > b
            for _ in range(2):
                if left_last:
                    bound, inner = a, self.halves[a][1]
                    if inner != a:
                        a = inner
                        break
                else:
                    bound, inner = b + 1, self.halves[b][0]
                    if inner != b:
                        b = inner
                        break
                left_last = not left_last
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(word), self.size, self.shorter, self.fits
        longest = [0] * n
        for end, (back, r) in self.automaton.iter(word.decode("latin-1")):  # ends ascend, so the longest stays
            longest[end - back] = r
        if len(fits) > 1_000_000:
            fits.clear()
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, last, r = 0, -1, longest[0]
        while True:
            end = pos + size[r]
            if not dead[end]:
                ok = True
                if last >= 0:
                    ok = fits.get(last << 32 | r)
                    if ok is None:
                        ok = fits[last << 32 | r] = self.compatible(last, r)
                if ok:
                    out.append(r)
                    if end == n:
                        return out
                    pos, last, r = end, r, longest[end]
                    continue
            r = shorter[r]
            if r < 0:
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                r = out.pop()
                pos -= size[r]
                last = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        return [r for w in self.split.findall(text) for r in self.encode_word(w.encode("utf-8", "surrogatepass"))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.word.__getitem__, ids))
