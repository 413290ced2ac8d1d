"""Token ids of many texts at once: words are cut with array operations and looked up.

A tokenizer of the kind that :mod:`tarnwork.llm.packing` names only folds case and white space
and never joins tokens across its words, so equal words have equal ids. Texts of its plain
characters are lower-cased and cut into words on their UTF-8 bytes, a chunk of texts at a time;
Arrow finds the distinct words, each goes to the tokenizer's model once, and Arrow puts the
texts' ids together. All other texts, and all texts under another tokenizer, go to the tokenizer
whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tarnwork.llm import packing
from tarnwork.llm.common import chunks

SPACE, LETTER, DIGIT, OTHER, BAD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte, and of each pair of lead byte (C2, C3) and what follows; from the characters' own patterns."""
    one = np.full(256, BAD, np.uint8)
    two = np.full((2, 256), BAD, np.uint8)
    for point in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)]:
        char = chr(point)
        kind = SPACE if char.isspace() else LETTER if char.isalpha() else DIGIT if char.isnumeric() else OTHER
        raw = char.encode()
        if len(raw) == 1:
            one[raw[0]] = kind
        else:
            two[raw[0] - 0xC2, raw[1]] = kind
    return one, two


_ONE, _TWO = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_C3 = np.arange(256, dtype=np.uint8)
_LOWER_C3[0x80:0x9F] += 32
_LOWER_C3[0x97] = 0x97


def _spelled() -> dict[int, int]:
    """The character by which a byte-level tokenizer spells each byte: printable ones stay, the others are numbered from 256 on."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in stay]
    return {b: b for b in stay} | {b: 256 + i for i, b in enumerate(rest)}


_SPELLED = _spelled()


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, where each word begins in them and the total, first word of each text and the total, which texts are plain)."""
    low, n = _LOWER[data], len(data)
    kind = _ONE[low]
    lead = np.flatnonzero((low == 0xC2) | (low == 0xC3))
    lead = lead[lead + 1 < n]
    after = low[lead + 1]
    after = np.where(low[lead] == 0xC3, _LOWER_C3[after], after)
    low[lead + 1] = after
    kind[lead] = kind[lead + 1] = _TWO[low[lead] - 0xC2, after]
    first = kind != SPACE
    first[lead + 1] = False
    before = np.empty(n, np.uint8)  # the class before; a text begins after a space
    if n:
        before[1:] = kind[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = SPACE
    first &= (kind != before) | (kind == DIGIT)
    # an apostrophe that begins a word takes some endings with it
    tick = np.flatnonzero((low == 0x27) & first)
    if len(tick):
        end = offsets[np.searchsorted(offsets, tick, "right")]
        at = lambda k: np.where(tick + k < end, low[np.minimum(tick + k, n - 1)], 0)
        a, b = at(1), at(2)
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        tick, length, end = tick[short | long], np.where(short, 2, 3)[short | long], end[short | long]
        first[tick + 1] = False
        onward = tick + length
        onward = onward[onward < end]
        first[onward] |= kind[onward] != SPACE
    bad = np.flatnonzero(kind == BAD)
    marker = np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|"))) if n else bad
    plain = np.ones(len(offsets) - 1, bool)
    plain[np.searchsorted(offsets, np.concatenate([bad, marker]), "right") - 1] = False
    inside = kind != SPACE
    starts = np.flatnonzero(first)
    place = np.cumsum(inside) - inside
    return low[inside], np.append(place[starts], int(inside.sum())), np.searchsorted(starts, offsets), plain


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer, _, self.simple = packing._tokenizer(path)
        self.model = self.tokenizer.model
        self.path = path
        self.known: dict[bytes, bytes] = {}

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > packing.CACHE_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self._tokenized(new)))
        return list(map(self.known.__getitem__, words))

    def _tokenized(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are cut and folded already: the tokenizer's model gets them as its byte-level step would spell them."""
        flat, cuts, tokenize = [], [0], self.model.tokenize
        for w in words:
            flat += [t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_SPELLED))]
            cuts.append(4 * len(flat))
        raw = packing._pack_ids(flat)
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` behind it; where each text's begin, and the total). NULL is an empty text."""
        parts, counts = [], []
        for i, j, data, offsets in chunks(texts):
            ids, n = self._chunk(texts.slice(i, j - i), data, offsets, end)
            parts.append(ids)
            counts.append(n)
        n = np.concatenate([np.zeros(1, np.int64), *counts])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum(n)

    def _chunk(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.simple:
            whole = [np.append(np.frombuffer(x, "<u4"), np.uint32(end)) for x in packing.encode([t or "" for t in texts.to_pylist()], self.path)]
            return np.concatenate(whole), np.array([len(x) for x in whole])
        text, begins, first, plain = cut(data, offsets)
        n_words = np.diff(first)
        words = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
        if not plain.all():  # the words of other texts are left out
            words = words.filter(pa.array(np.repeat(plain, n_words)))
        coded = words.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_pylist())
        others = np.flatnonzero(~plain)
        whole = [packing._pack_ids(self.tokenizer.encode(texts[int(r)].as_py(), add_special_tokens=False).ids) for r in others]
        # what the texts are put together from: ids of words, of whole texts, and the end token
        pieces = pa.array([*found, *whole, packing._pack_ids([end])], pa.large_binary())
        stop = np.cumsum(np.where(plain, n_words, 1) + 1)
        order, of_word = np.empty(stop[-1], np.int64), np.ones(stop[-1], bool)
        order[stop - 1] = len(pieces) - 1
        order[stop[others] - 2] = len(found) + np.arange(len(others))
        of_word[stop - 1] = of_word[stop[others] - 2] = False
        order[of_word] = coded.indices.to_numpy()
        _, places, ids = pieces.take(pa.array(order)).buffers()
        place = np.frombuffer(places, np.int64, len(order) + 1)[np.append(0, stop)] // 4
        return np.frombuffer(ids, "<u4", place[-1]), np.diff(place)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file, with the words that it knows already."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
