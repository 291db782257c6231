"""Splitting texts into byte-level BPE's pre-tokens by way of cached chunks.

A text is cut at single spaces that stand between two characters that aren't white space. The pre-token pattern
never matches across such a cut (a match that holds the space begins with it), so each chunk can be encoded on
its own and texts of recurring words need one dictionary look-up a word. Other texts are cut by SAFE_CUT, which
looks at both sides of each space.

Unicode's letters and numbers are those of the regex module; a character that only one of two Unicode versions
knows as a letter may be split otherwise than by another library."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Unicode's White_Space, fixed values.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "".join(map(chr, SPACES))
SAFE_CUT = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
ODD_SPACE = re.compile("[" + "".join(c for c in SPACE if c not in " \n") + "]")


def plain(text: str) -> bool:
    """Whether every space of a text is a safe cut, as far as can be told without looking at each."""
    if "  " in text or "\n " in text or text[-1:] == " ":
        return False
    if text.isascii():
        return not ("\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text)
    return not ODD_SPACE.search(text)


def chunks(text: str) -> list[str]:
    """The chunks of a text; each but the first has lost the space that it begins with."""
    return text.split(" ") if plain(text) else SAFE_CUT.split(text)


def pattern(spec: str):
    """The compiled pre-token pattern, with White_Space for its white space."""
    import regex

    return regex.compile(spec.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Encoded(dict):
    """key -> packed ids, in two generations of a fixed number of keys: when the young one is full it becomes the old
    one, whose keys come back when they are asked for. So recurring keys stay and memory has a bound."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.encode(key)
            if len(key) > 64:
                return out
        self[key] = out
        return out


#: ASCII marks of which a run makes one pre-token; the apostrophe isn't among them, for it begins contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class TextEncoder:
    """Packed ids of whole texts, from a function that encodes one pre-token."""

    def __init__(self, piece: Callable[[str], bytes], spec: str, keep: int = 150_000, together: int = 4 << 20):
        """keep: pre-tokens that are remembered, twice; together: characters of text whose words are numbered together."""
        self.together = together
        self.split = pattern(spec).findall
        self.pieces = Encoded(piece, keep)
        self.first = Encoded(self._chunk, 20_000)
        self.later = Encoded(self._spaced, 50_000)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        """A chunk with its space: most are letters and perhaps marks, which needs no pattern."""
        head = chunk.rstrip(MARKS)
        if head.isalpha():
            word = self.pieces[" " + head]
            return word + self.pieces[chunk[len(head) :]] if len(head) < len(chunk) else word
        return self._chunk(" " + chunk)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        head, *tail = chunks(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, tail))

    def batch(self, texts: list[str]) -> list[bytes]:
        """As a call for each text; words of plain texts are numbered together, each distinct one is encoded once, and
        numpy lays the ids out."""
        out = [b""] * len(texts)
        own: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t and plain(t):
                own.append(i)
                size += len(t)
                if size > self.together:
                    self._together(texts, own, out)
                    own, size = [], 0
            elif t:
                out[i] = self(t)
        self._together(texts, own, out)
        return out

    def _together(self, texts: list[str], own: list[int], out: list[bytes]) -> None:
        if not own:
            return
        split = pc.split_pattern(pa.array([texts[i] for i in own], pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        coded = pc.dictionary_encode(split.values)
        words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        heads = offsets[:-1]
        letters = pc.utf8_is_alpha(coded.dictionary).to_pylist()
        pieces, spaced = self.pieces, self._spaced
        packed = [pieces[" " + w] if a else spaced(w) for w, a in zip(words, letters, strict=True)]
        packed += [self.first[words[k]] for k in number[heads].tolist()]
        number[heads] = len(words) + np.arange(len(own))  # a text's first chunk has no space
        each = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(each) - each
        n = each[number]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(packed), "<u4")[np.repeat(start[number] - (end - n), n) + np.arange(end[-1])].tobytes()
        bounds = np.append(0, end)[offsets].tolist()
        for i, a, b in zip(own, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[4 * a : 4 * b]
