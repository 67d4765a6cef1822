"""Counts over whole texts, computed for a slice of rows at once."""

from __future__ import annotations

import numpy as np

from isoframe.llm.common import WHITE, apart_hash, mix, same_bytes, shingle_hashes, word_spans

#: Fixed: the symbols of the quality contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Slice:
    """Words and lines of a slice of texts; per-row sums come from running totals."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.firsts = word_spans(data, offsets, WHITE)
        self.words = apart_hash(data, self.starts, self.ends)
        self.n_words = np.diff(self.firsts)
        self.row = np.repeat(np.arange(self.n), self.n_words)

    def bytes_in(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each row."""
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.offsets])

    def words_in(self, values: np.ndarray) -> np.ndarray:
        """Sum of per-word values of each row."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.firsts])

    def word_chars(self) -> np.ndarray:
        return self.bytes_in(~WHITE[self.data] & ((self.data & 0xC0) != 0x80))

    def symbols(self) -> np.ndarray:
        return self.bytes_in(SYMBOLS[self.data])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``width`` words within a row."""
        hashes = shingle_hashes(self.words, width)
        at = np.flatnonzero(self.row[: len(hashes)] == self.row[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        return at, hashes[at]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each line (split at newlines only) that has a word."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.union1d(self.offsets[:-1][np.diff(self.offsets) > 0], breaks + 1)
        starts = starts[starts < len(self.data)]
        ends = np.minimum(np.append(starts[1:], len(self.data)), len(self.data))
        ends = ends - ((ends > starts) & (self.data[ends - 1] == 0x0A)) if len(starts) else ends
        has_word = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[has_word], ends[has_word]
        return np.searchsorted(self.offsets, starts, "right") - 1, starts, ends

    def duplicate_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier line of the row, byte for byte."""
        row, starts, ends = self.lines()
        hashes = apart_hash(self.data, starts, ends)
        total = np.bincount(row, minlength=self.n)
        order = np.lexsort((hashes, row))
        r, h = row[order], hashes[order]
        again = np.flatnonzero((r[1:] == r[:-1]) & (h[1:] == h[:-1]))
        x, y = order[again], order[again + 1]
        same = same_bytes(self.data, starts[x], ends[x], self.data, starts[y], ends[y])
        out = np.bincount(row[x[same]], minlength=self.n)
        for k in np.unique(row[x[~same]]).tolist():  # different lines of one hash: count that row's lines themselves
            here = [self.data[a:b].tobytes() for a, b in zip(starts[row == k].tolist(), ends[row == k].tolist(), strict=True)]
            out[k] = len(here) - len(set(here))
        return total, out

    def _repeated(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of the (row, hash) pairs occur twice or more."""
        key = mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        out = np.zeros(len(key), bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    def repeated_words(self, width: int = 3) -> np.ndarray:
        """Words of each row inside windows that the row holds twice or more."""
        at, hashes = self.windows(width)
        at = at[self._repeated(self.row[at], hashes)]
        delta = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + width, -1)
        return self.words_in(np.cumsum(delta[:-1]) > 0)

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of each row, and the count of its most frequent word."""
        key = mix(self.words + mix(self.row.astype(np.uint64) + np.uint64(1)))
        kinds, first, counts = np.unique(key, return_index=True, return_counts=True)
        rows = self.row[first]
        most = np.zeros(self.n, np.int64)
        np.maximum.at(most, rows, counts)
        return np.bincount(rows, minlength=self.n), most

    def features(self) -> np.ndarray:
        """One row of document statistics for each text (see FEATURES)."""
        size = np.maximum(np.diff(self.offsets), 1)
        words = np.maximum(self.n_words, 1)
        length = self.ends - self.starts
        last = self.data[self.ends - 1] if len(self.ends) else np.zeros(0, np.uint8)
        chars = np.maximum(self.word_chars(), 1)
        lines, dup = self.duplicate_lines()
        kinds, most = self.distinct_words()
        same = np.zeros(len(self.words), bool)
        same[1:] = (self.words[1:] == self.words[:-1]) & (self.row[1:] == self.row[:-1])
        letters = np.maximum(self.bytes_in(_LETTER[self.data]), 1)
        with_symbol = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[self.data])])[np.stack([self.starts, self.ends])], axis=0)[0] > 0
        mean_length = self.words_in(length) / words
        columns = [
            np.log1p(self.n_words), np.log1p(np.diff(self.offsets)), mean_length,
            np.sqrt(np.maximum(self.words_in(length.astype(np.int64) ** 2) / words - mean_length**2, 0)),
            self.symbols() / chars, self.words_in(with_symbol) / words,
            self.bytes_in(_UPPER[self.data]) / letters, self.bytes_in(_DIGIT[self.data]) / chars, self.bytes_in(_PUNCT[self.data]) / chars,
            self.bytes_in(self.data >= 0xC0) / chars, self.words_in(np.isin(last, list(b".,;:"))) / words, self.words_in(np.isin(last, list(b"!?"))) / words,
            self.words_in(length <= 3) / words, self.words_in(length >= 12) / words, self.words_in(length == 1) / words,
            self.words_in(same) / words, kinds / words, most / words,
            self.repeated_words(3) / words, dup / np.maximum(lines, 1), lines / words, size / np.maximum(lines, 1),
            self.bytes_in(WHITE[self.data]) / size, self.bytes_in(self.data == 0x7C) / words,
        ]
        return np.stack([np.asarray(c, np.float64) for c in columns], axis=1) if self.n else np.zeros((0, len(columns)))


FEATURES = (
    "log_words", "log_bytes", "word_length", "word_length_deviation", "symbols", "words_with_symbol", "upper", "digits",
    "punctuation", "non_ascii", "ends_stop", "ends_exclaim", "short_words", "long_words", "single_letters", "same_as_before",
    "distinct_words", "most_frequent", "repeated_words", "duplicate_lines", "lines", "line_bytes", "white", "bars",
)
