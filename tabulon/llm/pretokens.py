"""Byte-level BPE's pre-tokens of whole Arrow columns: texts are cut in numpy, without a Python object for each word.

What is cut is the pattern of public byte-level vocabularies,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

so a pre-token begins where the class of characters (white space, letter, number, other) changes, but a last space of white
space goes to what follows it, any other last white space stands alone, and an apostrophe that begins a pre-token takes its
contraction. Nothing reaches over the end of a text.

Letters and numbers are those of the regex module, white space is Unicode's White_Space."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulon.llm.words import SPACES

SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    own = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000))
    every = own.tobytes().decode("utf-32-le")
    for kind, spec in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(spec, every):
            out[own[m.start() : m.end()]] = kind
    out[SPACES] = SPACE
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, where each begins and the last ends). Bytes that aren't UTF-8 are an error."""
    texts.validate(full=True)
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = classes()
    out = table[:256].take(data)
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = lead[(first >= least) & (first < most)]
        if len(at):
            code = (data[at] & mask).astype(np.int32)
            for k in range(1, more + 1):
                code = code << 6 | (data[at + k] & 0x3F)
            kind = table[code]
            for k in range(more + 1):
                out[at + k] = kind
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each pre-token of the texts begins."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)  # where a text begins or ends
    edge[offsets] = True
    kind = kinds_of(data)
    begins = edge[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    followed = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
    space = data[:-1] == 32
    joined = followed & space
    begins[1:] &= ~joined
    begins[:-1] |= joined
    last = np.flatnonzero(followed & ~space)  # the last byte of other white space
    for _ in range(2):
        last -= (data[last] & 0xC0) == 0x80
    begins[last] = True
    mark = np.flatnonzero(begins & (data == 39))
    mark = mark[~edge[mark + 1]]
    one, two = data[mark + 1], np.where(edge[mark + 2], 0, data[np.minimum(mark + 2, n - 1)])
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, size in ((mark[short], 2), (mark[long], 3)):
        begins[at + 1] = False
        end = at + size
        begins[end[end < n]] = True
    return np.flatnonzero(begins)


class BatchEncoder:
    """Ids of whole texts, from a function that encodes many pre-tokens: each distinct one of a batch is encoded once, and
    ``keep`` to twice as many are remembered in two generations, so that recurring ones stay and memory has a bound."""

    def __init__(self, pieces: Callable[[list[bytes]], list[bytes]], keep: int):
        self.pieces, self.keep = pieces, keep
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _packed(self, keys: list[bytes]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, keys))
        lost = [i for i, p in enumerate(out) if p is None]
        lost_keys = [keys[i] for i in lost]
        found = list(map(self.old.get, lost_keys))
        made = iter(self.pieces([k for k, p in zip(lost_keys, found, strict=True) if p is None]))
        found = [next(made) if p is None else p for p in found]
        for i, p in zip(lost, found, strict=True):
            out[i] = p
        self.young.update(zip(lost_keys, found, strict=True))
        for k in [k for k in lost_keys if len(k) > 64]:
            del self.young[k]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        data, offsets = bytes_of(texts)
        at = cuts(data, offsets)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        coded = pc.dictionary_encode(words)
        packed = self._packed(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        each = np.append(0, np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4))
        lists = pa.LargeListArray.from_arrays(pa.array(each), pa.array(np.frombuffer(b"".join(packed), "<u4")))
        taken = lists.take(coded.indices)
        ends = taken.offsets.to_numpy()
        return taken.flatten().to_numpy(), ends[np.searchsorted(at, offsets)]
