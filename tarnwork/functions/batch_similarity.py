"""String similarity of many pairs at once, on NumPy words.

The longest common subsequence of every pair is carried in 64-bit words, one column of words for
each pair, and all pairs step through their texts together (bit-parallel, with carries between
the words of long texts). Words of texts are sorted, compared and joined as integers and Arrow
lists. The partial ratio looks at windows of a coarse grid first: from one window to the next
the common subsequence changes by one at most, so a window whose neighbours leave it no
chance to beat what was found is not looked at.

The values are those of the functions on single pairs in :mod:`tarnwork.functions.similarity`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
TABLE_WORDS = 1 << 22
LANES = 1 << 17
WINDOWS = 1 << 19
#: White space as Python's ``str.split`` knows it.
_BLANKS = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]+"


class Texts:
    """Code points of many texts: ``points[start : start + length]``."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        first, last = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)[[0, -1]] if len(texts) else (0, 0)
        raw = data.slice(first, last - first).to_pybytes() if last > first else b""
        self.points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        self.length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, .. of each group of n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def lcs(pattern: Texts, row: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longest common subsequence of pattern ``row[i]`` and ``points[start[i] : start[i] + length[i]]``, for all i."""
    out = np.zeros(len(row), np.int64)
    words = 1 << np.ceil(np.log2(np.maximum(-(-pattern.length // 64), 1))).astype(np.int64)  # few kinds of lanes
    size = len(np.unique(pattern.points)) + 1
    todo = np.flatnonzero((pattern.length[row] > 0) & (length > 0))
    for w in np.unique(words[row[todo]]):
        mine = todo[words[row[todo]] == w]
        mine = mine[np.argsort(row[mine], kind="stable")]
        used, local = np.unique(row[mine], return_inverse=True)
        per = max(1, TABLE_WORDS // (size * int(w)))
        for at in range(0, len(used), per):
            a, b = np.searchsorted(local, [at, at + per])
            some = used[at : at + per]
            tables, symbols = _tables(pattern, some, int(w))
            for i in range(a, b, LANES):
                lanes = mine[i : min(i + LANES, b)]
                left = _steps(tables, symbols, local[i : i + len(lanes)] - at, points, start[lanes], length[lanes])
                out[lanes] = _zeros(left, pattern.length[row[lanes]])
    return out


def _tables(pattern: Texts, rows: np.ndarray, words: int):
    """For each pattern and symbol, the bits of the places where it stands; and a function from points to symbols."""
    n = pattern.length[rows]
    place, owner = _within(n), np.repeat(np.arange(len(rows)), n)
    chars = pattern.points[pattern.start[rows][owner] + place]
    alphabet = np.unique(chars)
    size = len(alphabet) + 1  # the last symbol stands nowhere

    def symbols(points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(alphabet, points)
        return np.where(alphabet[np.minimum(at, size - 2)] == points, at, size - 1)

    table = np.zeros((len(rows), size, words), U)
    np.add.at(table.reshape(-1), (owner * size + np.searchsorted(alphabet, chars)) * words + (place >> 6), U(1) << (place & 63).astype(U))
    return table, symbols


def _steps(tables: np.ndarray, symbols, row: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The words of each lane after its whole text: a zero bit for each symbol of the subsequence."""
    _, size, words = tables.shape
    order = np.argsort(-length, kind="stable")
    row, start, length = row[order] * size, start[order], length[order]
    low, high = int(start.min()), int((start + length).max())
    coded = symbols(points[low:high])
    start = start - low
    flat = tables.reshape(-1, words)
    state = np.full((words, len(row)), ~U(0))
    going = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")  # lanes whose text has a j-th symbol
    for j, n in enumerate(going):
        match = flat[row[:n] + coded[start[:n] + j]]
        carry = None
        for w in range(words):
            v = state[w, :n]
            u = v & match[:, w]
            total = v + u
            over = total < u
            if carry is not None:
                total += carry
                over |= (total < carry)
            state[w, :n] = total | (v - u)
            carry = over.astype(U)
    out = np.empty_like(state)
    out[:, order] = state
    return out


def _zeros(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Number of zero bits among the first ``length`` of each lane."""
    ones = np.zeros(state.shape[1], np.int64)
    for w in range(len(state)):
        bits = np.clip(length - 64 * w, 0, 64)
        mask = np.where(bits == 64, ~U(0), (U(1) << np.minimum(bits, 63).astype(U)) - U(1))
        ones += np.bitwise_count(state[w] & mask)
    return length - ones


def indel(a: Texts, b: Texts) -> np.ndarray:
    """2 * LCS / (len a + len b) of the pairs; 0 where a side is empty."""
    swap = b.length > a.length  # the longer text in the words, steps along the shorter
    common = np.zeros(len(a.length), np.int64)
    for side, one, other in ((~swap, a, b), (swap, b, a)):
        rows = np.flatnonzero(side)
        common[rows] = lcs(one, rows, other.points, other.start[rows], other.length[rows])
    return _ratio(common, a.length, b.length)


def _ratio(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (m > 0), 2 * common / np.maximum(n + m, 1), 0.0)


# ------------------------------------------------------------------------------ words


class Words:
    """The words of both sides of pairs, as ranks in the order of words."""

    def __init__(self, a: pa.Array, b: pa.Array):
        lists = [pc.split_pattern(pc.replace_substring_regex(x.fill_null(""), _BLANKS, " "), " ") for x in (a, b)]
        flat = pa.concat_arrays([x.flatten() for x in lists])
        coded = flat.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.values, self.base = coded.dictionary.take(pa.array(order)), max(1, len(order))
        codes = rank[coded.indices.to_numpy()]
        empty = len(order) > 0 and self.values[0].as_py() == ""  # the empty word comes first, if there is one
        self.keys, at = [], 0
        for x in lists:
            n = pc.list_value_length(x).to_numpy(zero_copy_only=False)
            key = np.repeat(np.arange(len(x)), n) * self.base + codes[at : at + int(n.sum())]
            self.keys.append(np.sort(key[codes[at : at + int(n.sum())] > 0] if empty else key))
            at += int(n.sum())
        self.n = len(a)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return np.bincount(keys // self.base, minlength=self.n)

    def joined(self, *parts: np.ndarray) -> Texts:
        """The words of each pair with blanks between them, part after part."""
        keys = np.concatenate(parts)
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.lexsort((keys % self.base, part, keys // self.base))
        keys = keys[order]
        offsets = np.concatenate([[0], np.cumsum(self.count(keys))]).astype(np.int32)
        return Texts(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.values.take(pa.array(keys % self.base))), " "))


def token_set(words: Words) -> np.ndarray:
    """Best ratio among the sorted common words and those with either side's others."""
    a, b = np.unique(words.keys[0]), np.unique(words.keys[1])
    both, only_a, only_b = np.intersect1d(a, b, True), np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
    n_both, n_a, n_b = words.count(both), words.count(only_a), words.count(only_b)
    base, rest_a, rest_b = words.joined(both).length, words.joined(only_a), words.joined(only_b)
    left, right = (base + rest.length + ((n_both > 0) & (n > 0)) for rest, n in ((rest_a, n_a), (rest_b, n_b)))
    # both sides begin with the common words, and a blank where others follow
    whole = np.flatnonzero((n_both == 0) | ((n_a > 0) & (n_b > 0)))
    common = base + ((n_both > 0) & (n_a > 0) & (n_b > 0))
    common[whole] += lcs(rest_a, whole, rest_b.points, rest_b.start[whole], rest_b.length[whole])
    best = np.maximum(_ratio(common, left, right), np.maximum(_ratio(base, base, left), _ratio(base, base, right)))
    best[(n_both > 0) & ((n_a == 0) | (n_b == 0))] = 1.0
    best[(words.count(a) == 0) | (words.count(b) == 0)] = 0.0
    return best


# ---------------------------------------------------------------------------- windows


def partial(a: Texts, b: Texts, floor: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter text and a window of the longer one, or ``floor`` where none is better."""
    best = floor.astype(float)
    for short, long, rows in ((a, b, np.flatnonzero(a.length <= b.length)), (b, a, np.flatnonzero(b.length <= a.length))):
        rows = rows[(short.length[rows] > 0) & (long.length[rows] > 0)]
        many = np.cumsum(short.length[rows] + long.length[rows])
        at = 0
        while at < len(rows):  # about WINDOWS windows at a time, one pair at least
            end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + WINDOWS, "right")))
            some = rows[at:end]
            best[some] = _windows(short, long, some, best[some])
            at = end
    return best


def _windows(short: Texts, long: Texts, rows: np.ndarray, best: np.ndarray) -> np.ndarray:
    width, length = short.length[rows], long.length[rows]
    n = width + length - 1
    row, k = np.repeat(np.arange(len(rows)), n), _within(n)
    begin = k + 1 - width[row]
    end = np.minimum(begin + width[row], length[row])
    begin = np.maximum(begin, 0)
    size = end - begin
    bound = np.minimum(size, width[row])  # of the common subsequence of each window
    stride = 1 << np.maximum(np.log2(np.maximum(width / 4, 8)).astype(np.int64), 3)
    best = best.copy()
    step = int(stride.max())
    while step:
        new = np.flatnonzero((k % step == 0) & ((k % (2 * step) != 0) | (stride[row] == step)) & (stride[row] >= step))
        mine = row[new]
        coarse = stride[mine] > step  # between two windows of the grid before
        before, after = new - step, np.minimum(new + step, new - k[new] + n[mine] - 1)
        edge = k[new] + step > n[mine] - 1  # none follows
        near = np.where(edge, bound[np.maximum(before, 0)], np.minimum(bound[np.maximum(before, 0)], bound[after])) + step
        bound[new] = np.where(coarse, np.minimum(bound[new], near), bound[new])
        ask = new[2 * bound[new] / (width[mine] + size[new]) > best[mine]]
        if len(ask):
            found = lcs(short, rows[row[ask]], long.points, long.start[rows[row[ask]]] + begin[ask], size[ask])
            bound[ask] = found
            np.maximum.at(best, row[ask], 2 * found / (width[row[ask]] + size[ask]))
        step >>= 1
    return best


# ----------------------------------------------------------------------------- ratios


def _distinct(a: pa.Array, b: pa.Array):
    """Distinct pairs, and which of them each pair is."""
    a, b = (x.cast(pa.string()).fill_null("").dictionary_encode() for x in (a, b))
    key = a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy()
    found, which = np.unique(key, return_inverse=True)
    return a.dictionary.take(pa.array(found // max(1, len(b.dictionary)))), b.dictionary.take(pa.array(found % max(1, len(b.dictionary)))), which


def ratios(a: pa.Array, b: pa.Array) -> np.ndarray:
    a, b, which = _distinct(a, b)
    return indel(Texts(a), Texts(b))[which]


def token_set_ratios(a: pa.Array, b: pa.Array) -> np.ndarray:
    a, b, which = _distinct(a, b)
    return token_set(Words(a, b))[which]


def two_ratios(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(plain, token-set) ratio of each pair."""
    a, b, which = _distinct(a, b)
    return indel(Texts(a), Texts(b))[which], token_set(Words(a, b))[which]


def all_ratios(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain, token-set, weighted) ratio of each pair."""
    a, b, which = _distinct(a, b)
    x, y, words = Texts(a), Texts(b), Words(a, b)
    plain, sets = indel(x, y), token_set(words)
    return plain[which], sets[which], _weighted(a, b, x, y, words, plain, sets)[which]


def weighted_ratios(a: pa.Array, b: pa.Array) -> np.ndarray:
    return all_ratios(a, b)[2]


def _weighted(a: pa.Array, b: pa.Array, x: Texts, y: Texts, words: Words, plain: np.ndarray, sets: np.ndarray) -> np.ndarray:
    n, m = x.length, y.length
    filled = (n > 0) & (m > 0)
    spread = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    out = np.zeros(len(n))
    alike = np.flatnonzero(filled & (spread < 1.5))
    if len(alike):
        few = Words(a.take(pa.array(alike)), b.take(pa.array(alike)))
        by_words = indel(few.joined(few.keys[0]), few.joined(few.keys[1]))
        out[alike] = np.maximum(plain[alike], 0.95 * np.maximum(by_words, sets[alike]))
    rows = np.flatnonzero(filled & (spread >= 1.5))
    if len(rows):
        part_a, part_b = a.take(pa.array(rows)), b.take(pa.array(rows))
        few = Words(part_a, part_b)
        scale = np.where(spread[rows] <= 8, 0.9, 0.6)
        known = np.maximum(plain[rows], 0.95 * scale * _partial_token(few, plain[rows] / (0.95 * scale)))
        # only a partial ratio above what is known already can count
        out[rows] = np.maximum(known, scale * _or_zero(partial, Texts(part_a), Texts(part_b), known / scale))
    return out


def _or_zero(measure, a: Texts, b: Texts, floor: np.ndarray) -> np.ndarray:
    """A measure where it beats its floor, else 0: the floor itself is in the maximum already."""
    floor = np.minimum(floor, 1.0) * (1 - 1e-12)
    found = measure(a, b, floor)
    return np.where(found > floor, found, 0.0)


def _partial_token(words: Words, floor: np.ndarray) -> np.ndarray:
    """1 where a word is shared; else the best partial ratio of the sorted words, repeated or not, or 0 where ``floor`` is not reached."""
    a, b = np.unique(words.keys[0]), np.unique(words.keys[1])
    out = np.where(words.count(np.intersect1d(a, b, True)) > 0, 1.0, 0.0)
    rest = out == 0
    for left, right in ((words.keys[0], words.keys[1]), (a, b)):
        mine = [k[rest[k // words.base]] for k in (left, right)]
        found = _or_zero(partial, words.joined(mine[0]), words.joined(mine[1]), floor)
        out = np.where(rest, np.maximum(out, found), out)
        if len(a) == len(words.keys[0]) and len(b) == len(words.keys[1]):
            break  # no word is repeated
    return out
