"""Counts of documents and of their lines, from the bytes of an Arrow text column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .kernel import U, Words, mix, windows, words_of

# Frequent words of four languages.
COMMON_WORDS = (
    "the of and to a in is that for it as was with be by on not he his but "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les en un du une que est pour qui dans par plus pas au sur ce "
    "el y los del se las por para con no su al lo como más o pero sus le ha"
).split()
COMMON = list(dict.fromkeys(COMMON_WORDS))
SYMBOLS = "#*$%&|<>"
#: Character classes: lower, upper, digit, white space, sentence marks, symbols, other ASCII, other scripts.
CLASSES = 8


def _class_table() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    for k, chars in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, [32, *range(9, 14)]), (4, map(ord, ".,;:!?'\"()-")), (5, map(ord, SYMBOLS))):
        out[list(chars)] = k
    out[0xC0:] = 7
    out[0x80:0xC0] = CLASSES  # later bytes of a character don't count
    return out


_CLASS = _class_table()


def _hash_text(words: list[str]) -> np.ndarray:
    data = [x.encode() for x in words]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    buf = np.frombuffer(b"".join(data), np.uint8)
    return Words(buf, offs, offs[:-1], offs[1:], np.arange(len(offs))).hashes(lower=True)


_common = _hash_text(COMMON)
_common_order = np.argsort(_common)
_common_sorted = _common[_common_order]


def common_index(h: np.ndarray) -> np.ndarray:
    """For each lower-case word hash the place of its word in COMMON, or len(COMMON)."""
    k = np.minimum(np.searchsorted(_common_sorted, h), len(COMMON) - 1)
    return np.where(_common_sorted[k] == h, _common_order[k], len(COMMON))


@dataclass
class Texts:
    """Documents of one piece of a batch with their words, lines and repeated windows."""

    buf: np.ndarray
    offs: np.ndarray

    def __post_init__(self):
        self.n = len(self.offs) - 1
        self.words = words_of(self.buf, self.offs)
        self.kind = _CLASS[self.buf]
        self.h = self.words.hashes(lower=False)
        self.n_words = np.diff(self.words.first)
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)
        self._lines()
        self._windows()

    def _lines(self) -> None:
        """Lines that hold a word: line_start, line_end (bytes), line_doc, line_first (words before), repeats_line."""
        breaks = np.flatnonzero(self.buf == 10)
        starts = np.unique(np.concatenate([self.offs[:-1], breaks + 1]))
        starts = starts[starts < len(self.buf)]
        ends = np.concatenate([starts[1:], [len(self.buf)]]) if len(starts) else starts
        ends = ends - ((ends > starts) & (self.buf[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
        first, last = np.searchsorted(self.words.starts, starts), np.searchsorted(self.words.starts, ends)
        keep = last > first
        self.line_start, self.line_end, self.line_first, self.line_last = starts[keep], ends[keep], first[keep], last[keep]
        self.line_doc = np.searchsorted(self.offs, self.line_start, "right") - 1
        spans = Words(self.buf, self.offs, self.line_start, self.line_end, np.zeros(1, int))
        key = mix(spans.hashes(lower=False) + mix(self.line_doc.astype(U) + U(1)))
        self.repeats_line = np.zeros(len(key), bool)
        if len(key):
            order = np.argsort(key, kind="stable")
            self.repeats_line[order[1:]] = key[order[1:]] == key[order[:-1]]

    def _windows(self) -> None:
        """repeated: for each word, whether a five-word window found twice or more in its document covers it."""
        s = windows(self.h, 5)
        inside = self.word_doc[: len(s)] == self.word_doc[4:] if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        key = mix(s[at] + mix(self.word_doc[at].astype(U) + U(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        self.repeated = np.zeros(len(self.h), bool)
        for j in range(5):
            self.repeated[at[twice] + j] = True

    def per_doc(self, flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of ``flags`` between consecutive ``bounds``."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def class_counts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Characters of each class in byte spans: one row per span."""
        out = np.zeros((len(starts), CLASSES), np.int64)
        for k in range(CLASSES):
            total = np.concatenate([[0], np.cumsum(self.kind == k)])
            out[:, k] = total[ends] - total[starts]
        return out
