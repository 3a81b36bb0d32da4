"""Word shingles of documents as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tidemark.llm import textcore as X

SIZE = 5


def by_row(row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The order by row (below 2**16), then by code; one sort of 64-bit numbers."""
    order = np.argsort((row.astype(X.U) << X.U(48)) | (codes >> X.U(16)))
    # codes that agree in their upper 48 bits, in one row, may stand the wrong way round
    r, c = row[order], codes[order]
    return order if not ((r[1:] == r[:-1]) & (c[1:] < c[:-1])).any() else np.lexsort((codes, row))


class Sets:
    """The shingle sets of a chunk of documents, each sorted.

    With fewer words than the shingle size the whole sequence is the one shingle;
    without words the set is empty.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int = SIZE):
        starts, ends, first = X.words(data, off)
        spans = X.Runs(X.word_hashes(data, starts, ends, True))
        words = np.diff(first)
        count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
        begin = X.ranges(first[:-1], count)
        row = np.repeat(np.arange(len(words)), count)
        length = np.repeat(np.minimum(words, size), count)
        codes = spans.hash(begin, length)
        order = by_row(row, codes)
        codes, row = codes[order], row[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
        self.codes, self.row = codes[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(len(words) + 1))
        self.sizes = np.diff(self.first)
        total = np.zeros(len(self.codes) + 1, X.U)
        with np.errstate(over="ignore"):
            np.cumsum(X.mix(self.codes ^ X.U(0x5851F42D4C957F2D)), dtype=X.U, out=total[1:])
            #: Identity of each set, whatever its order
            self.identity = X.mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(X.U))
