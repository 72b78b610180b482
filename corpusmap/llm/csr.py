"""Sparse matrices by compressed rows, with Gustavson's row products. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Products of single entries that are held at a time.
PRODUCTS = 1 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Csr:
    """Row i holds the columns `cols[starts[i]:starts[i + 1]]`, in order, with their `values`."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.cols, self.values, self.width = starts, cols, values, width
        self.sizes = np.diff(starts)

    @classmethod
    def incidence(cls, sizes: np.ndarray, cols: np.ndarray, width: int) -> Csr:
        """Ones where row i meets its next `sizes[i]` columns of `cols`."""
        return cls(np.concatenate([[0], np.cumsum(sizes)]), cols, np.ones(len(cols), np.int64), width)

    @property
    def height(self) -> int:
        return len(self.sizes)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), self.sizes)

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Csr(starts, self.rows()[order], self.values[order], self.height)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """How many products of single entries each row of the product adds up."""
        sums = np.concatenate([[0], np.cumsum(other.sizes[self.cols])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def product_parts(self, other: Csr, limit: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cols, values) of the product, for some rows at a time: `limit` single products, or one row."""
        part = (np.cumsum(self.product_sizes(other)) - 1).clip(0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), self.height]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield self._row_products(other, a, b)

    def _row_products(self, other: Csr, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row i of the product: the rows of `other` that the entries of row i name, times these entries, added up."""
        here = slice(self.starts[a], self.starts[b])
        met = self.cols[here]
        sizes = other.sizes[met]
        at = ragged(other.starts[met], sizes)
        rows = np.repeat(np.repeat(np.arange(a, b), self.sizes[a:b]), sizes)
        cols, values = other.cols[at], np.repeat(self.values[here], sizes) * other.values[at]
        keys = rows * other.width + cols
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, rows, cols, values = keys[order], rows[order], cols[order], values[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
        return rows[first], cols[first], np.add.reduceat(values, first) if len(first) else values

    def __matmul__(self, other: Csr) -> Csr:
        if self.width != other.height:
            raise ValueError("the columns of one matrix are the rows of the other")
        parts = list(self.product_parts(other)) or [(np.zeros(0, np.int64),) * 3]
        rows, cols, values = (np.concatenate(x) for x in zip(*parts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=self.height))])
        return Csr(starts, cols, values, other.width)
