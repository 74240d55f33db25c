"""Arrow text columns as byte arrays: word and chunk bounds, hashes and a bounded store of what distinct chunks stand for.

Everything here works on whole batches with numpy; Python sees a chunk only when it is new to the worker's store. A chunk of up to SHORT bytes is known
by a 64-bit key that holds its bytes and length, scrambled one to one. The hash of a longer one only says where to look: a store keeps the bytes of its
chunks and compares them on every hit, eight at a time, and chunks whose hash is another's already are kept apart by their bytes. So results are
exact whatever the hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that a kernel works on at a time; a single longer text is worked on alone.
BLOCK = 1 << 20
#: Chunks of up to so many bytes are their own keys.
SHORT = 7
#: Chunks of more bytes are hashed and compared one by one.
LONG = 256

_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, as if zeros followed the data."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive slices of a string column, of about `limit` bytes; null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run doesn't go on into the next text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_text = np.zeros(n + 1, bool)
    new_text[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (new_text[:-1] | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (new_text[1:] | ~after)) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key of each data[start:end], never 0: of up to SHORT bytes one that no other chunk has, of more bytes a hash."""
    words = words_at(data) if words is None else words
    size = ends - starts
    key = (words[starts] & _MASK[np.minimum(size, SHORT)]) | np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        key[long] = long_hashes(data, starts[long], ends[long], words) >> np.uint64(8) | np.uint64((SHORT + 1) << 56)
    return mixed(key)


def long_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    size = ends - starts
    h = mixed(words[starts] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    left, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(left):
        more = size[left] - k
        h[left] = mixed(h[left] * np.uint64(0x9E3779B97F4A7C15) + (words[starts[left] + k] & _MASK[np.minimum(more, 8)]))
        left, k = left[more > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at each place of a are those at the place of b; a and b as words_at gives them."""
    same = (a[a_at] ^ b[b_at]) & _MASK[np.minimum(size, 8)] == 0
    left, k = np.flatnonzero(same & (size > 8)), 8
    while len(left) and k < LONG:
        more = size[left] - k
        alike = (a[a_at[left] + k] ^ b[b_at[left] + k]) & _MASK[np.minimum(more, 8)] == 0
        same[left[~alike]] = False
        left, k = left[alike & (more > 8)], k + 8
    for i in left.tolist():
        x, y, n = int(a_at[i]), int(b_at[i]), int(size[i])
        same[i] = bool((a[x + k : x + n - 7 : 8] == b[y + k : y + n - 7 : 8]).all() and a[x + n - 8] == b[y + n - 8])
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each chunk, the same for equal bytes and another for others; and for each number the first chunk that has it."""
    words = words_at(data) if words is None else words
    keys = hashes(data, starts, ends, words) if keys is None else keys
    size = ends - starts
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    long = np.flatnonzero(size > SHORT)
    at = first[number[long]]
    same = (size[long] == size[at]) & same_bytes(words, starts[long], words, starts[at], size[long])
    if not same.all():
        n, odd, more = len(first), {}, []
        for i in long[~same].tolist():
            own = data[starts[i] : ends[i]].tobytes()
            if own not in odd:
                odd[own] = n + len(odd)
                more.append(i)
            number[i] = odd[own]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return number, first


def distinct_per_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, words: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many distinct chunks each of n texts has; `text` says which one each chunk is in."""
    order = np.lexsort((keys, text))
    a, b, key = order[:-1], order[1:], keys[order]
    again = (key[1:] == key[:-1]) & (text[a] == text[b])
    size = ends - starts
    long = np.flatnonzero(again & (size[b] > SHORT))
    a, b = a[long], b[long]
    found = np.bincount(text, minlength=n) - np.bincount(text[order[1:][again]], minlength=n)
    for t in np.unique(text[b[(size[a] != size[b]) | ~same_bytes(words, starts[a], words, starts[b], size[b])]]).tolist():  # two chunks share a hash
        found[t] = len({data[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(text == t)})
    return found


def mixed(h: np.ndarray) -> np.ndarray:
    """The numbers scrambled, one to one; 0 stays 0."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many chunks start in each text."""
    return np.diff(np.searchsorted(starts, offsets))


class HashIndex:
    """64-bit keys to numbers; open addressing in numpy arrays."""

    def __init__(self, limit: int):
        self.mask = np.uint64((1 << max(4, (limit * 3).bit_length())) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 where unknown."""
        slot = h & self.mask
        key = self.keys[slot]
        found = np.where(key == h, self.values[slot], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot = (slot[left] + np.uint64(1)) & self.mask if len(slot) != len(left) else (slot + np.uint64(1)) & self.mask
            key, want = self.keys[slot], h[left]
            hit = key == want
            found[left[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], slot[on]
        return found

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Takes in distinct keys that are not there yet."""
        left, slot = np.arange(len(h)), h & self.mask
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = self.keys[slot] == h[left]
            self.values[slot[won]] = numbers[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & self.mask


class ByteIndex:
    """Byte strings to numbers 0, 1, ... in order of arrival, by hash and comparison of the bytes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.index = HashIndex(limit)
        self.clear()

    def clear(self) -> None:
        self.index.clear()
        self.n, self.used, self.odd = 0, 0, {}
        self.starts, self.sizes, self.raw = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, np.uint8)
        self.words = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The numbers of the chunks, -1 where unknown."""
        code = self.index.find(h)
        size = ends - starts
        hit = np.flatnonzero((code >= 0) & (size > SHORT))
        if not len(hit):
            return code
        own, size = code[hit], size[hit]
        same = (self.sizes[own] == size) & same_bytes(words, starts[hit], self.words, self.starts[own], size)
        if not same.all():
            for i in hit[~same].tolist():
                code[i] = self.odd.get(data[starts[i] : ends[i]].tobytes(), -1)
        return code

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers distinct chunks that are not there yet."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        size = ends - starts
        total = int(size.sum())
        self.starts, self.sizes = _room(self.starts, self.n + len(h)), _room(self.sizes, self.n + len(h))
        self.starts[number], self.sizes[number] = self.used + np.cumsum(size) - size, size
        if self.used + total + 8 > len(self.raw):
            self.raw = _room(self.raw, self.used + total + 8)
            self.words = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        self.raw[self.used : self.used + total] = gathered(data, starts, size)
        self.used, self.n = self.used + total, self.n + len(h)
        _, first = np.unique(h, return_index=True)
        first = first[self.index.find(h[first]) < 0]
        self.index.add(h[first], number[first])
        if len(first) < len(h):
            for i in np.setdiff1d(np.arange(len(h)), first).tolist():
                self.odd[data[starts[i] : ends[i]].tobytes()] = int(number[i])
        return number


class ChunkStore:
    """Numbers chunks and keeps what `solve` says of each: an array of numbers of any length; it returns a list of them, or all of them joined and their sizes. Emptied when full, by number or by bytes."""

    def __init__(self, solve: Callable[[list[bytes]], list | tuple], kind, limit: int, most_bytes: int = 1 << 26):
        self.solve, self.kind, self.keys, self.most_bytes = solve, kind, ByteIndex(limit), most_bytes
        self._reset()

    def _reset(self) -> None:
        self.keys.clear()
        self.starts, self.sizes, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, self.kind), 0

    def codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The chunks' numbers, good until the next call."""
        words = words_at(data)
        h = hashes(data, starts, ends, words)
        code = self.keys.find(data, starts, ends, h, words)
        lost = np.flatnonzero(code < 0)
        if not len(lost):
            return code
        number, first = distinct(data, starts[lost], ends[lost], h[lost], words)
        if self.keys.n and (self.keys.n + len(first) > self.keys.limit or self.keys.used > self.most_bytes):
            self._reset()
            lost = np.arange(len(h))
            number, first = distinct(data, starts, ends, h, words)
        if len(first) * 2 > int(self.keys.index.mask):  # one block with more chunks than a store should hold
            self.keys = ByteIndex(len(first))
        at = lost[first]
        raw = data.tobytes()
        values = self.solve([raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        if isinstance(values, tuple):
            flat, sizes = values
        else:
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.concatenate([np.asarray(v, self.kind) for v in values]) if len(values) else []
        total = int(sizes.sum())
        own = self.keys.add(data, starts[at], ends[at], h[at])
        self.starts, self.sizes, self.flat = _room(self.starts, self.keys.n), _room(self.sizes, self.keys.n), _room(self.flat, self.used + total)
        self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        code[lost] = own[number]
        return code

    def gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all chunks, one after the other, and how many each has."""
        return gathered(self.flat, self.starts[code], self.sizes[code]), self.sizes[code]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n at least."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, len(a) * 2) - len(a), a.dtype)])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after the other."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    full = sizes > 0
    if not full.all():
        starts, sizes = starts[full], sizes[full]
    step = np.ones(total, np.int64)
    first = np.cumsum(sizes) - sizes
    step[0] = starts[0]
    step[first[1:]] = starts[1:] - (starts[:-1] + sizes[:-1]) + 1
    return flat[np.cumsum(step)]


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([np.zeros(1, np.result_type(values, np.int64)), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


# Classes of bytes for cuts that no pre-token crosses.
_WS, _LETTER, _PUNCT, _OTHER = 1, 2, 3, 0
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WS
for _b in range(33, 127):
    _c = chr(_b)
    _CLASS[_b] = _LETTER if _c.isalpha() else _OTHER if _c.isdigit() or _c == "'" else _PUNCT
_ODD_LEAD = np.zeros(256, bool)  # lead bytes of the characters outside ASCII that are white space
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


#: The patterns of pre-tokens that pretoken_cuts is right for.
_LETTERS_OR_SIGNS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SINGLE_DIGITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT_PATTERNS = frozenset({_LETTERS_OR_SIGNS, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", _SINGLE_DIGITS})

#: Those by which no white space gets into a pre-token.
DROPS_WHITE_SPACE = frozenset({_SINGLE_DIGITS})


def whole_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the texts that aren't empty: chunks for patterns that pretoken_cuts doesn't know."""
    full = offsets[:-1] < offsets[1:]
    return offsets[:-1][full], offsets[1:][full]


def pretoken_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks that together are the texts, cut where a pre-token always begins.

    For the usual patterns of byte-level BPE (contractions, an optional space before letters, digits or signs, white space):
    a white-space byte between two characters that aren't white space begins a pre-token, and one other than the space also ends
    one; an ASCII letter and an ASCII sign other than the apostrophe never share one.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    odd = _ODD_LEAD[data]
    ws = kind == _WS
    solid_next = np.zeros(n, bool)  # the next character is surely not white space
    solid_next[:-1] = ~(ws[1:] | odd[1:])
    solid_prev = np.zeros(n, bool)  # the same of the one before
    solid_prev[1:] = ~ws[:-1]
    solid_prev[2:] &= ~odd[:-2]
    solid_prev[3:] &= ~odd[:-3]
    lone = ws & solid_next & solid_prev
    cut = lone.copy()
    cut[1:] |= lone[:-1] & (data[:-1] != 32)
    letter, punct = kind == _LETTER, kind == _PUNCT
    cut[1:] |= letter[:-1] & punct[1:]
    cut[1:] |= punct[:-1] & letter[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    # across texts nothing holds: what stands at a text's first and last byte was judged with a neighbour of another text
    cut[begins] = True
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    tail = last[ws[last] & ~np.isin(last, begins)]
    cut[tail] = False  # white space that ends a text may belong to a longer run
    second = begins + 1
    second = second[second < n]
    first_ws = second[ws[second - 1] & ~np.isin(second, begins)]
    cut[first_ws] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)
