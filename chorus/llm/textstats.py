"""Counts of words, lines, symbols and repeats of many texts at a time, from
their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from chorus.llm.common import ByteHashes, mix64, row_sums, rows_of, word_bounds

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[list(b".!?:;")] = True


def _later_copies(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the same (row, key) came before."""
    both = mix64(key ^ mix64(row.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    again = np.zeros(len(both), dtype=bool)
    s = both[order]
    again[order[1:]] = s[1:] == s[:-1]
    return again


def _in_groups(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the same (row, key) comes twice or more."""
    both = mix64(key ^ mix64(row.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(both), dtype=bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return hit


def line_bounds(data: np.ndarray, offsets: np.ndarray):
    """``(row, start, end)`` of the lines of every row; every row has one at
    least."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    start = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.empty_like(start)
    if len(row):
        end[:-1] = np.where(row[1:] == row[:-1], start[1:] - 1, offsets[row[:-1] + 1])
        end[-1] = offsets[row[-1] + 1]
    return row, start, end


class TextStats:
    """All counts of a block of texts; ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` by text, and the
    lines that hold a word with their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_bounds(data, offsets)
        hashes = ByteHashes(data)
        n = len(offsets) - 1
        self.n_words = np.diff(first)
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
        chars = inside[ends] - inside[starts]
        self.word_chars = row_sums(chars, first)
        self.n_symbols = row_sums(SYMBOLS[data], offsets)
        # words in windows of three that come twice or more in the text
        w, owner = hashes.ranges(starts, ends), rows_of(first)
        covered = np.zeros(len(w), dtype=bool)
        if len(w) > 2:
            at = np.flatnonzero(owner[2:] == owner[:-2])
            key = mix64(mix64(w[at] * np.uint64(3) + w[at + 1]) * np.uint64(5) + w[at + 2])
            hit = at[_in_groups(owner[at], key)]
            covered[hit] = covered[hit + 1] = covered[hit + 2] = True
        self.n_repeat_words = row_sums(covered, first)
        # lines that hold a word
        row, ls, le = line_bounds(data, offsets)
        a, b = np.searchsorted(starts, ls), np.searchsorted(starts, le)
        some = b > a
        row, ls, le, a, b = row[some], ls[some], le[some], a[some], b[some]
        again = _later_copies(row, hashes.ranges(ls, le)) if len(row) else np.zeros(0, dtype=bool)
        self.n_dup_lines = np.bincount(row[again], minlength=n)
        self.line_row, self.line_words = row, b - a
        size = np.maximum(le - ls, 1)

        def share(mask):
            total = np.concatenate(([0], np.cumsum(mask)))
            return (total[le] - total[ls]) / size

        letters = np.maximum(share(LETTER[data]), 1e-9)
        cov = np.concatenate(([0], np.cumsum(covered)))
        last = data[ends[b - 1] - 1] if len(b) else np.zeros(0, np.uint8)
        self.line_features = np.stack([
            np.ones(len(row)),
            np.minimum(self.line_words, 20) / 20,
            (self.line_words < 4).astype(float),
            np.minimum(share(SYMBOLS[data]) * 10, 1.0),
            np.minimum(share(data == 124) * 20, 1.0),
            np.minimum(share(data == 33) * 20, 1.0),
            (share(UPPER[data]) / letters > 0.5).astype(float),
            np.minimum(share(DIGIT[data]) * 5, 1.0),
            again.astype(float),
            (cov[b] - cov[a]) / np.maximum(self.line_words, 1),
            SENTENCE_END[last].astype(float),
        ], axis=1) if len(row) else np.zeros((0, 11))
