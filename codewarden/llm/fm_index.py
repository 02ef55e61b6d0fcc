"""A full-text index over a delimited vocabulary, searched for words one edit away.

The words, sorted and distinct, stand one behind the other in a text, each closed by a delimiter that
sorts before all letters. All suffixes are ranked; those that agree up to their delimiter go by their
word, which keeps the delimiters' ranks in the order of the words. Any string that ends words, or
stands in them, is then an interval of suffix ranks, and one more letter to its left takes two look-ups
in the sorted list of (letter, rank) of the letters before the suffixes.

A search runs over many words of one length at once. It matches the right part of the words
exactly, goes on to the left with at most one edit, and ends with the delimiter, whose ranks are the
words found. Left parts are matched by an index of the reversed words: the pair of both is the
bidirectional index, and the two searches its scheme.
"""

from __future__ import annotations

import numpy as np

#: Letters that the first sort compares at once.
PACKED = 7
#: Intervals up to this size are read letter by letter; larger ones are tried with each letter.
FEW = 48
#: Words searched together.
TOGETHER = 4096


def _suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order."""
    size = len(text)
    padded = np.concatenate([text, np.zeros(PACKED, np.uint8)])
    packed, open_ = np.zeros(size, np.int64), np.ones(size, bool)
    for j in range(PACKED):
        here = padded[j : j + size]
        open_ &= here != 0
        packed = (packed << 8) | np.where(open_, here, 0)
    # Stable, so that suffixes that end alike go by their word.
    order = np.argsort(packed, kind="stable")
    new = np.ones(size, bool)
    new[1:] = (packed[order][1:] != packed[order][:-1]) | ~open_[order][1:]
    start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    rank = np.empty(size, np.int64)
    rank[order] = start
    step = PACKED
    while True:
        tied = np.zeros(size, bool)
        tied[1:] = start[1:] == start[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        some = order[at]
        key = rank[some] * np.int64(size + 1) + rank[np.minimum(some + step, size - 1)]
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[at] = some
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        start[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[some] = start[at]
        step *= 2


class DelimitedIndex:
    """``words`` are distinct byte strings without zero bytes, in order."""

    def __init__(self, words: list[bytes]):
        self.text = np.frombuffer(b"\0".join(words) + b"\0" if words else b"", np.uint8)
        self.size, self.words = len(self.text), len(words)
        ends = np.flatnonzero(self.text == 0)
        self.begin = np.concatenate([[0], ends + 1])[: self.words]
        self.length = ends - self.begin
        order = _suffix_ranks(self.text) if self.size else np.zeros(0, np.int64)
        self.before = self.text[order - 1]
        by = np.argsort(self.before, kind="stable")
        # One sorted list for all letters: a look-up gives letters before plus ranks before.
        self.keys = self.before[by].astype(np.int64) * self.size + by
        self.letters = np.unique(self.text[self.text > 0])

    def extend(self, letter, low, high):
        """Intervals of one more letter to the left."""
        base = letter.astype(np.int64) * self.size
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def _all_left(self, low, high):
        """(state, letter, low, high) for every letter that stands left of an interval, but delimiters."""
        width = high - low
        small = np.flatnonzero(width <= FEW)
        large = np.flatnonzero(width > FEW)
        owner = np.repeat(small, width[small])
        first = np.cumsum(width[small]) - width[small]
        at = np.arange(len(owner)) - np.repeat(first, width[small]) + low[owner]
        pairs = np.unique(owner * 256 + self.before[at])
        tried = (large[:, None] * 256 + self.letters[None, :].astype(np.int64)).ravel()
        pairs = np.concatenate([pairs, tried])
        state, letter = pairs >> 8, pairs & 255
        state, letter = state[letter > 0], letter[letter > 0]
        new_low, new_high = self.extend(letter, low[state], high[state])
        there = new_low < new_high
        return state[there], letter[there], new_low[there], new_high[there]

    def one_edit(self, asked: np.ndarray, loose: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, word) for all words that differ from a row, a word's letters, by exactly
        one edit within its first ``loose`` letters. Of equal edits, such as any letter of a run, the
        leftmost stands for all, so every pair comes once."""
        found = [
            self._search(asked[a : a + TOGETHER], loose, a) for a in range(0, len(asked), TOGETHER)
        ]
        rows, words = zip(*found, strict=True) if found else ((), ())
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *words])

    def _search(self, asked: np.ndarray, loose: int, offset: int):
        row = np.arange(len(asked))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.words)
        for i in range(asked.shape[1] - 1, loose - 1, -1):
            row, low, high = self._narrow(asked, i, row, low, high)
        one = (row[:0], low[:0], high[:0])  # what has its edit behind it
        for i in range(loose - 1, -2, -1):
            state, letter, new_low, new_high = self._all_left(low, high)
            other = letter != asked[row[state], i] if i >= 0 else np.ones(len(state), bool)
            edited = (row[state][other], new_low[other], new_high[other])
            # A letter more: it stands between i and i + 1.
            one = tuple(np.concatenate(x) for x in zip(one, edited, strict=True))
            if i < 0:
                break
            one = self._narrow(asked, i, *one)
            # Another letter in place of i, or none.
            gone = asked[row, i - 1] != asked[row, i] if i else np.ones(len(row), bool)
            less = (row[gone], low[gone], high[gone])
            one = tuple(np.concatenate(x) for x in zip(one, edited, less, strict=True))
            row, low, high = self._narrow(asked, i, row, low, high)
        low, high = self.extend(np.zeros(len(one[0]), np.int64), one[1], one[2])
        there = low < high  # whole words are one each
        return one[0][there] + offset, low[there]

    def _narrow(self, asked, i, row, low, high):
        low, high = self.extend(asked[row, i], low, high)
        there = low < high
        return row[there], low[there], high[there]

    def begins_with(self, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Which ``words`` begin with the letters in the same row of ``heads``."""
        same = self.length[words] >= heads.shape[1]
        for j in range(heads.shape[1]):
            if not same.any():
                break
            at = np.minimum(self.begin[words] + j, self.size - 1)
            same &= self.text[at] == heads[:, j]
        return same
