"""Token ids of whole texts by a public tokenizer, with each distinct stretch of text encoded once per worker."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .kernel import U, Words, pieces, words_of

#: Distinct stretches that a worker keeps, about 30 bytes each: the first ones it meets, which are the frequent ones.
CACHE = 1_500_000
#: Stretches of at most so many bytes are kept.
KEPT_BYTES = 64
#: New stretches encoded in one string, and the mark between them.
RUN, MARK = 1000, "~"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ONE = np.zeros(256, bool)
_ONE[0x20] = True
_encoders: dict[tuple, Encoder] = {}


class _Memory:
    """Ids by two 64-bit hashes of a stretch, in sorted arrays; additions wait in a small table and are merged."""

    def __init__(self, dtype: np.dtype):
        self.tables = [tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64)) for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, dtype), 0

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each stretch; -1 where it is new."""
        at, n = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for k, c, a, m in self.tables:
            if len(k):
                i = np.minimum(np.searchsorted(k, key), len(k) - 1)
                hit = (k[i] == key) & (c[i] == check)
                at[hit], n[hit] = a[i[hit]], m[i[hit]]
        return at, n

    def put(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Write ids behind the used part of the pool; they stay only if ``keep`` follows."""
        n = np.array([len(x) for x in ids], np.int64)
        total = int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if ids:
            self.pool[self.used : self.used + total] = np.concatenate(ids)
        return self.used + np.cumsum(n) - n, n

    def keep(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        self.used += int(n.sum())
        main, late = self.tables
        late = tuple(np.concatenate(x) for x in zip(late, (key, check, at, n), strict=True))
        if len(late[0]) > 50_000 + len(main[0]) // 4:
            late = tuple(np.concatenate(x) for x in zip(main, late, strict=True))
            order = np.argsort(late[0], kind="stable")
            self.tables = [tuple(x[order] for x in late), tuple(x[:0] for x in late)]
        else:
            order = np.argsort(late[0], kind="stable")
            self.tables = [main, tuple(x[order] for x in late)]


def _any_of_each(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each document has a flagged byte."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] > total[offs[:-1]]


def _white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 bytes ``a b c`` are one white space character of three bytes."""
    general = (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def _spaces_within_runs(buf: np.ndarray) -> np.ndarray:
    """Places of spaces that stand next to another space, or have white space on both sides."""
    at = np.flatnonzero(buf == 0x20)
    wide = np.concatenate([np.zeros(3, np.uint8), buf, np.zeros(3, np.uint8)])
    b3, b2, b1, a1, a2, a3 = (wide[at + 3 + k] for k in (-3, -2, -1, 1, 2, 3))
    two = lambda x, y: (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    before = _BLANK[b1] | two(b2, b1) | _white(b3, b2, b1)
    after = _BLANK[a1] | two(a1, a2) | _white(a1, a2, a3)
    return at[before & after | (b1 == 0x20) | (a1 == 0x20)]


class Encoder:
    """Ids of whole texts, equal to encoding each text without special tokens.

    ``cut`` names where the tokenizer's own pre-tokenizer always ends a piece, so that the stretches between can be
    encoded one by one: "blank" (ASCII white space, which the tokenizer drops) or "space" (before each single space).
    The latter takes a run of any Unicode white space but its last character as one piece, so a space within such a run
    is no cut. Texts with one, with two spaces in a row, a space at an end, or the string of a special token are encoded
    whole. Stretches are told apart by 128 bits of hashes.
    """

    def __init__(self, path: str, cut: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_file(path), cut
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.mark,) = self.tokenizer.encode(f" {MARK}", add_special_tokens=False).ids
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = _Memory(self.dtype)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, new: list[str]) -> list[np.ndarray]:
        """Each stretch's ids. Most are encoded together, a mark that none of them holds between them."""
        lead = " " if self.cut == "space" else ""
        out: list[np.ndarray | None] = [None] * len(new)
        easy = [i for i, x in enumerate(new) if MARK not in x and x.startswith(lead) and x.strip()]
        for lo in range(0, len(easy), RUN):
            run = easy[lo : lo + RUN]
            ids = self.whole([(f" {MARK}{'' if lead else ' '}").join([new[i] for i in run])])[0]
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(run) - 1:  # else the mark went into a longer token
                for i, x in zip(run, np.split(ids, ends), strict=True):
                    out[i] = x if i == run[0] else x[1:]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([new[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _stretches(self, buf: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
        """Stretches of each document, and which documents must be encoded whole."""
        odd = np.zeros(len(buf), bool)
        data = buf.tobytes()
        for x in self.special:
            at = data.find(x)
            while at >= 0:
                odd[at] = True
                at = data.find(x, at + 1)
        if self.cut == "blank":
            return words_of(buf, offs, _BLANK), _any_of_each(odd, offs)
        w = words_of(buf, offs, _ONE)
        odd[_spaces_within_runs(buf)] = True
        space = buf == 0x20
        filled = offs[1:] > offs[:-1]
        for ends in (offs[:-1][filled], offs[1:][filled] - 1):
            odd[ends] |= space[ends]
        first = np.zeros(len(w.starts), bool)
        first[w.first[:-1][np.diff(w.first) > 0]] = True
        w.starts = w.starts - ~first
        return w, _any_of_each(odd, offs)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all documents of a piece, and each document's range."""
        w, odd = self._stretches(buf, offs)
        key, check = w.hashes(lower=False), w.hashes(lower=False, salt=1)
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        if (check[first][place] != check).any():
            odd = np.ones(len(offs) - 1, bool)
        at, n = self.memory.find(distinct, check[first])
        new = np.flatnonzero(at < 0)
        if len(new):
            data = buf.tobytes()
            new = new[np.argsort((w.ends - w.starts)[first[new]] > KEPT_BYTES, kind="stable")]  # long ones last
            spans = zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)
            at[new], n[new] = self.memory.put(self._new([data[a:b].decode() for a, b in spans]))
            if len(self.memory) < CACHE:
                kept = new[(w.ends - w.starts)[first[new]] <= KEPT_BYTES]
                self.memory.keep(distinct[kept], check[first[kept]], at[kept], n[kept])
        each = n[place]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = self.memory.pool[np.repeat(at[place] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = upto[w.first]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            texts = [buf[offs[i] : offs[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]
            for i, x in zip(np.flatnonzero(odd), self.whole(texts), strict=True):
                parts[i] = x
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            ids = np.concatenate(parts)
        return ids, bounds

    def encode_column(self, column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of runs of rows; a null text has no ids."""
        for lo, hi, buf, offs in pieces(column, most):
            yield lo, hi, *self.encode(buf, offs)


def encoder(path: str, cut: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives the task."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]


# CRC-32 of joined parts from the parts' own values: polynomial arithmetic modulo the CRC's polynomial.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


_squares = [1 << 30]
for _ in range(63):
    _squares.append(_times(_squares[-1], _squares[-1]))
_shifts: dict[int, int] = {}


def crc_join(crc: int, nxt: int, n_bytes: int) -> int:
    """CRC-32 of a string of value ``crc`` followed by ``n_bytes`` bytes of value ``nxt``."""
    if n_bytes not in _shifts:
        if len(_shifts) > 100_000:
            _shifts.clear()
        shift, k, n = 1 << 31, 3, n_bytes
        while n:
            if n & 1:
                shift = _times(_squares[k], shift)
            n >>= 1
            k += 1
        _shifts[n_bytes] = shift
    return _times(_shifts[n_bytes], crc) ^ nxt


def ids_crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
