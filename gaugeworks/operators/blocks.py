"""A stated query set against all rows, block by block: weighted words in, the best rows of each query out.

Rows are dealt to blocks of bounded size. A task reads the rows of its block and then each query in turn, so a row is
moved once, and a pair of a query and a row is a number in a matrix of bounded size and never a row of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768  # about so many rows in a task at a time
LEAST = 2048  # fewer rows aren't worth a further block
CELLS = 2_000_000  # pairs that are scored at a time, and postings that are added at a time
COMMON = 256  # so many of a block's most common words, if a row in RARE has them, are a matrix; the others are postings
RARE = 64
SHORT = 64  # postings of a word, up to which a list isn't worth being taken apart from others
ROWS = 2048  # whose words are counted at a time


def counted(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of lists of words: ``word, row, tf`` in order of word and row, the names of the words, and the lengths of the lists."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    key = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | np.repeat(np.arange(len(sizes)), sizes)
    key, tf = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf, flat.dictionary.to_pylist(), sizes


class Block:
    """Rows by their words. ``names`` and ``sizes`` of the rows are in the order in which they came."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.names: list = []
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: list[np.ndarray] = []

    def add(self, names: pa.Array, words: pa.ListArray) -> None:
        known = self.vocabulary
        for at in range(0, len(names), ROWS):
            word, row, tf, found, sizes = counted(words.slice(at, ROWS))
            own = np.array([known.setdefault(w, len(known)) for w in found], np.int32)
            self.pieces.append((own[word], (row + len(self.names)).astype(np.int32), tf.astype(np.int32)))
            self.names += names.slice(at, ROWS).to_pylist()
            self.lengths.append(sizes)

    def close(self, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """No more rows; ``weigh`` gives the weights of words from how often they stand in a row and the row's size."""
        pa.default_memory_pool().release_unused()  # what the texts took
        n, self.sizes = len(self.names), np.concatenate(self.lengths or [np.zeros(0, np.int64)])
        df = np.zeros(len(self.vocabulary), np.int64)
        for word, _, _ in self.pieces:
            df += np.bincount(word, minlength=len(df))
        often = np.argsort(-df, kind="stable")[:COMMON]
        often = often[df[often] * RARE >= n]
        self.common = np.full(len(df), -1, np.int64)
        self.common[often] = np.arange(len(often))
        self.matrix = np.zeros((n, len(often)))
        # What the matrix has isn't kept as postings. A row and its part stand side by side, as lists are read at random.
        self.df = np.where(self.common < 0, df, 0)
        self.start = np.cumsum(self.df) - self.df
        self.posted = np.empty((int(self.df.sum()), 2), np.int64)
        # Piece by piece, each of which is let go, so that nothing beside the result is as long as all words.
        free = self.start.copy()
        self.pieces.reverse()
        while self.pieces:
            word, row, tf = self.pieces.pop()
            part = weigh(tf, self.sizes[row]).astype(np.float64)
            column = self.common[word]
            here = column >= 0
            self.matrix[row[here], column[here]] = part[here]
            word, row, part = word[~here], row[~here], part[~here]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            times = np.diff(first, append=len(word))
            at = np.repeat(free[word[first]] - first, times) + np.arange(len(word))
            self.posted[at, 0], self.posted[at, 1] = row, part.view(np.int64)
            free[word[first]] += times
        self.coarse = np.ascontiguousarray(self.matrix.T, np.float32)

    def _runs(self, words: pa.ListArray, weights: pa.ListArray | None, cells: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For runs of the queries, the first one's number, the weights of common words, and of each query its other words and their weights."""
        n = len(self.names)
        if not n:
            return
        ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = words.flatten().dictionary_encode()
        ids = np.array([self.vocabulary.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1], np.int64)[flat.indices.to_numpy(zero_copy_only=False)]
        weight = np.ones(len(ids)) if weights is None else weights.flatten().to_numpy(zero_copy_only=False)
        width = max(1, cells // n)
        for first in range(0, len(words), width):
            last = min(first + width, len(words))
            lo, hi = (ends[first - 1] if first else 0), ends[last - 1]
            query = np.searchsorted(ends[first:last], np.arange(lo, hi), side="right")
            met = ids[lo:hi] >= 0
            w, x, q = ids[lo:hi][met], weight[lo:hi][met], query[met]
            dense = self.common[w]
            asked = np.zeros((last - first, self.matrix.shape[1]))
            asked[q[dense >= 0], dense[dense >= 0]] = x[dense >= 0]
            w, x, q = w[dense < 0], x[dense < 0], q[dense < 0]
            at = np.searchsorted(q, np.arange(last - first + 1))
            yield first, asked, [(w[a:b], x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def _others(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The sums of a query's words that aren't common; at most a quarter of CELLS postings, or one list, are added at a time."""
        out = np.zeros(len(self.names))
        df = self.df[w]
        order = np.argsort(df >= SHORT, kind="stable")
        w, x, df = w[order], x[order], df[order]
        total, cells = np.cumsum(df), max(1, CELLS // 4)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + cells, cells))) if len(w) else [0]
        for a, b in zip(cuts[:-1], [*cuts[1:-1], len(w)], strict=False):
            size, start = df[a:b], self.start[w[a:b]]
            few = int(np.count_nonzero(size < SHORT))
            # Long lists are taken as they lie, short ones by the places of their postings.
            held = np.repeat(start[:few] - (np.cumsum(size[:few]) - size[:few]), size[:few]) + np.arange(size[:few].sum())
            lists = [self.posted[s:e] for s, e in zip(start[few:].tolist(), (start + size)[few:].tolist(), strict=True)]
            posted = np.concatenate([self.posted[held], *lists])
            out += np.bincount(posted[:, 0], posted[:, 1].view(np.float64) * np.repeat(x[a:b], size), minlength=len(out))
        return out

    def scores(self, words: pa.ListArray, weights: pa.ListArray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For runs of the queries, the first one's number and the sums of weight x weight of each with every row.

        The words of a query are distinct; without ``weights`` each has 1.
        """
        for first, asked, others in self._runs(words, weights, CELLS):
            out = asked @ self.matrix.T
            for i, (w, x) in enumerate(others):
                out[i] += self._others(w, x)
            yield first, out

    def top(self, words: pa.ListArray, weights: pa.ListArray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query's number, its ``k`` rows of largest sums above 0 as rounded to 6 digits, ties by row, and these sums.

        No weight is below 0. Common words are summed in single precision first; by the bound of the error of that, rows
        that may be among the best are told, and summed in double precision.
        """
        n = len(self.names)
        strips = min(n, 8 * k)
        for first, asked, others in self._runs(words, weights, 2 * CELLS):
            near = asked.astype(np.float32) @ self.coarse
            for i, (w, x) in enumerate(others):
                rest = self._others(w, x)
                score = near[i] + rest
                least = 0.0
                if strips > k:
                    # The k-th largest of the strips' largest is at most the k-th largest of all.
                    most = score[: n // strips * strips].reshape(strips, -1).max(axis=1)
                    error = (asked.shape[1] + 8) * 2.0**-23 * float(near[i].max()) + 1e-6
                    least = np.partition(most, strips - k)[strips - k] - 2 * error
                found = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score > 0)
                exact = np.round(self.matrix[found] @ asked[i] + rest[found], 6)
                order = np.lexsort((found, -exact))[:k]
                yield first + i, found[order], exact[order]


def best(score: np.ndarray, k: int, slack: float = 0.0, rounded: Callable[[np.ndarray], np.ndarray] = lambda s: s) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row, the largest first, ties by column; minus infinity never counts.

    With ``rounded``, which changes no score by more than half of ``slack``, the largest as rounded.
    """
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k, None] - slack if n > k else -np.inf
    rows, cols = np.nonzero((score >= least) & (score > -np.inf))
    order = np.lexsort((cols, -rounded(score[rows, cols]), rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k]


def dealt(rows: DataFrame, own: str, queries: DataFrame, n: int) -> DataFrame:
    """The ``n`` ``rows`` by blocks, a block to a partition, in order of ``own``; behind them all ``queries``, which every block has.

    Columns are those of both, and ``asks``, which is true for queries.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST), 2 * tasks))
    left = rows.select("*", F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartitionById(blocks, "block").sortWithinPartitions("asks", own).drop("block")
