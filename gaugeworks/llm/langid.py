"""Language identification by unigram pieces, summed over all segmentations of every word.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is
the sum over all ways to cut it into pieces, which the forward algorithm gives; a text is the product of
its words. Probabilities are learned by expectation-maximisation over the words of labelled texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_chunks

SPAN = 1 << 14  # places of a longer word that are summed at a time; a multiple of STEP
STEP = 32  # places after which the sums of the forward algorithm are scaled again
FLOOR = 1e-8  # least probability of a piece; STEP factors of it stay in the range of a double
SHORT = 8  # pieces up to so many bytes are looked up at every place, longer ones where they share their first SHORT bytes
WORDS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
HASHED = np.uint64(46)
CACHE_ENTRIES = 200_000  # of words of at most CACHED letters, so the cache is bounded in bytes too
CACHED = 48


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORDS.findall(text.lower())


class Pieces:
    """All single bytes, and all pieces of a sentencepiece file, by hash."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.pieces = sorted({p for p in texts if p} | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, self.pieces))
        self.by_length = []
        for n in range(1, self.longest + 1):
            at = [i for i, p in enumerate(self.pieces) if len(p) == n]
            key = self._keys([self.pieces[i] for i in at], n)
            order = np.argsort(key)
            hashed = np.zeros(1 << 18, dtype=bool)  # most keys that no piece has end here
            hashed[key * BASE >> HASHED] = True
            self.by_length.append((key[order], np.array(at, dtype=np.int64)[order], hashed))
        heads = sorted({p[:SHORT] for p in self.pieces if len(p) > SHORT})
        self.heads = np.sort(self._keys(heads, SHORT))

    @staticmethod
    def _keys(pieces: list[bytes], n: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, n)
        key = np.zeros(len(raw), dtype=np.uint64)
        for j in range(n):
            key = key * BASE + raw[:, j] + np.uint64(1)
        return key

    def match(self, raw: np.ndarray, size: np.ndarray) -> Matches:
        """Every piece in the rows of ``raw`` within their sizes, in order of its start and then of its length."""
        n, width = raw.shape
        key = np.zeros((n, width), dtype=np.uint64)
        starts, lengths, rows, ids = [], [], [], []

        def add(length: int, start: np.ndarray, row: np.ndarray, keys_at: np.ndarray) -> None:
            keys, of, hashed = self.by_length[length - 1]
            some = np.flatnonzero(hashed[keys_at * BASE >> HASHED])
            if len(some):
                some = some[start[some] + length <= size[row[some]]]
                at = np.minimum(np.searchsorted(keys, keys_at[some]), len(keys) - 1)
                hit = keys[at] == keys_at[some]
                some = some[hit]
                starts.append(start[some])
                lengths.append(np.full(len(some), length))
                rows.append(row[some])
                ids.append(of[at[hit]])

        for length in range(1, min(SHORT, width) + 1):
            m = width - length + 1
            key = key[:, :m] * BASE + raw[:, length - 1 :] + np.uint64(1)
            add(length, np.tile(np.arange(m), n), np.repeat(np.arange(n), m), key.ravel())
        if width > SHORT and len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
            row, start = np.nonzero(self.heads[at] == key)
            long = key[row, start]
            for length in range(SHORT + 1, min(self.longest, width) + 1):
                inside = np.flatnonzero(start + length <= size[row])
                row, start, long = row[inside], start[inside], long[inside]
                if not len(row):
                    break
                long = long * BASE + raw[row, start + length - 1] + np.uint64(1)
                add(length, start, row, long)
        start, length, row, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, rows, ids))
        order = np.argsort(start * (self.longest + 1) + length, kind="stable")
        start, length = start[order], length[order]
        edge = np.flatnonzero(np.diff(start, prepend=-1) | np.diff(length, prepend=-1))
        return Matches(start[edge], length[edge], np.append(edge, len(start)), row[order], ids[order])


class Matches(NamedTuple):
    """Groups of pieces of the same start and length: group g has rows and ids from ``ends[g]`` to ``ends[g + 1]``."""

    start: np.ndarray
    length: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    ids: np.ndarray

    def groups(self, backwards: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        every = zip(self.start.tolist(), self.length.tolist(), self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)
        for start, length, a, b in reversed(list(every)) if backwards else every:
            yield start, length, self.rows[a:b], self.ids[a:b]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def bytes_of(word: str) -> bytes:
    """A word as bytes behind a space."""
    return b" " + word.encode()


def _forward(matches: Matches, size: np.ndarray, width: int, probs: np.ndarray, reach: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """alpha[row, place, language] and the logarithms of the factors that places were divided by, [row, place // STEP, language].

    What a place holds is the sum over all segmentations up to it, divided by one factor for all places of
    a step, so a word of any length stays in the range of a double. ``first`` has what the first places hold.
    """
    n, k = len(size), probs.shape[1]
    alpha = np.zeros((n, width + 1, k))
    if first is None:
        alpha[:, 0] = 1
    else:
        alpha[:, : first.shape[1]] = first[:, : width + 1]
    scale = np.zeros((n, width // STEP + 1, k))
    step = 0

    def rescale() -> int:
        """Divide the places from the next step on, as far as they are summed, by the largest of them."""
        at = (step + 1) * STEP
        scale[:, step + 1] = scale[:, step]
        rows = np.flatnonzero(size >= at)
        most = alpha[rows, at : at + reach].max(axis=1)
        alpha[rows, at : at + reach] /= most[:, None]
        scale[rows, step + 1] += np.log(most)
        return step + 1

    for start, length, rows, ids in matches.groups():
        while start // STEP > step:
            step = rescale()
        alpha[rows, start + length] += alpha[rows, start] * probs[ids]
    while width // STEP > step:
        step = rescale()
    return alpha, scale


def _batches(words: list[bytes], cells: int = 131_072) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices, byte matrix and sizes of words of like length, of about ``cells`` bytes or a single longer word."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        width = int(sizes[order[at]])
        some = order[at : at + max(1, cells // max(width, 16))]
        some = some[sizes[some] <= width + width // 4 + 2]
        at += len(some)
        width = int(sizes[some[-1]])
        raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in some]), dtype=np.uint8)
        yield some, raw.reshape(len(some), width), sizes[some]


def log_probs(words: list[str], path: str, probs: np.ndarray) -> np.ndarray:
    """log P(word | language), a row per word: the sum over all segmentations of the whole word."""
    flat, vocab = list(map(bytes_of, words)), pieces(path)
    out = np.zeros((len(flat), probs.shape[1]))
    for some, raw, size in _batches(flat):
        if raw.shape[1] > SPAN:
            out[some] = [_log_prob_long(word[:n], vocab, probs) for word, n in zip(raw, size, strict=True)]
            continue
        alpha, scale = _forward(vocab.match(raw, size), size, raw.shape[1], probs, vocab.longest)
        each = np.arange(len(some))
        out[some] = np.log(alpha[each, size]) + scale[each, size // STEP]
    return out


def _spans(word: np.ndarray, vocab: Pieces) -> Iterator[tuple[int, Matches, int, int]]:
    """The pieces of a long word by where they start, SPAN places at a time: beginning, pieces, places, and width with their ends."""
    for at in range(0, len(word), SPAN):
        raw = word[None, at : at + SPAN + vocab.longest]
        matches = vocab.match(raw, np.array([raw.shape[1]]))
        if last := at + raw.shape[1] == len(word):
            yield at, matches, raw.shape[1], raw.shape[1]
        else:  # a span is a whole number of steps
            groups = int(np.searchsorted(matches.start, SPAN))
            yield at, Matches(matches.start[:groups], matches.length[:groups], matches.ends[: groups + 1], matches.rows, matches.ids), SPAN, SPAN + vocab.longest - 1
        if last:
            return


def _log_prob_long(word: np.ndarray, vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """The same for one word of any length: SPAN places at a time, whose sums beyond their end open the next."""
    first, total = None, np.zeros(probs.shape[1])
    for _, matches, size, width in _spans(word, vocab):
        alpha, scale = _forward(matches, np.array([size]), width, probs, vocab.longest, first)
        if size == width:
            return total + np.log(alpha[0, -1]) + scale[0, -1]
        first, total = alpha[:, SPAN:], total + scale[0, SPAN // STEP]
    raise AssertionError("a word has a last span")


def _expected_long(word: np.ndarray, weight: np.ndarray, vocab: Pieces, probs: np.ndarray | None, total: np.ndarray) -> None:
    """Add the expected uses of one word of any length: forward span by span, keeping what opens each; then back, each span anew."""
    spans = list(_spans(word, vocab)) if probs is None else []
    for _, matches, _, _ in spans:
        used = matches.ids[: matches.ends[-1]]
        for i in range(len(weight)):
            total[:, i] += np.bincount(used, minlength=len(total)) * weight[i]
    if probs is None:
        return
    firsts, first = [], None
    for _, matches, size, width in _spans(word, vocab):
        firsts.append(first)
        if size < width:
            first = _forward(matches, np.array([size]), width, probs, vocab.longest, first)[0][:, SPAN:]
    tail = None
    for k in reversed(range(len(firsts))):
        at = k * SPAN
        _, matches, size, width = next(_spans(word[at:], vocab))
        alpha, scale = _forward(matches, np.array([size]), width, probs, vocab.longest, firsts[k])
        beta = np.zeros_like(alpha[0])
        if tail is None:
            beta[size] = weight / alpha[0, size]
        else:
            beta[SPAN : SPAN + len(tail)] = tail[: len(beta) - SPAN]
        _backward(matches, alpha, beta[None], scale, probs, total)
        # Places of the next span are divided by its first factors there, and not at all here.
        ends = np.arange(min(vocab.longest, len(beta)))
        tail = beta[ends] * np.exp(-scale[0, ends // STEP])


def _backward(matches: Matches, alpha: np.ndarray, beta: np.ndarray, scale: np.ndarray, probs: np.ndarray, total: np.ndarray) -> None:
    """Complete ``beta`` from its ends and add the expected uses of all pieces to ``total``."""
    n = int(matches.ends[-1])
    uses, at = np.zeros((n, probs.shape[1])), n
    for start, length, rows, ids in matches.groups(backwards=True):
        step = probs[ids] * beta[rows, start + length]
        if start // STEP != (start + length) // STEP:  # the two places are divided by different factors
            step *= np.exp(scale[rows, start // STEP] - scale[rows, (start + length) // STEP])
        beta[rows, start] += step
        uses[at - len(ids) : at] = alpha[rows, start] * step
        at -= len(ids)
    for i in range(probs.shape[1]):
        total[:, i] += np.bincount(matches.ids[:n], uses[:, i], len(total))


def expected(words: list[str], counts: np.ndarray, path: str, probs: np.ndarray | None) -> np.ndarray:
    """Expected uses of each piece (row) in each language (column); counts[word, language].

    Without ``probs``, every occurrence of a piece counts, which starts the iteration.
    """
    vocab = pieces(path)
    k = counts.shape[1]
    total = np.zeros((len(vocab.pieces), k))
    for some, raw, size in _batches(list(map(bytes_of, words))):
        if raw.shape[1] > SPAN:
            for word, length, weight in zip(raw, size, counts[some], strict=True):
                _expected_long(word[:length], weight, vocab, probs, total)
            continue
        matches, weight = vocab.match(raw, size), counts[some]
        if probs is None:
            for i in range(k):
                total[:, i] += np.bincount(matches.ids, weight[matches.rows, i], len(total))
            continue
        alpha, scale = _forward(matches, size, raw.shape[1], probs, vocab.longest)
        each = np.arange(len(some))
        beta = np.zeros_like(alpha)
        beta[each, size] = weight / alpha[each, size]
        _backward(matches, alpha, beta, scale, probs, total)
    return total


def _normalised(total: np.ndarray) -> np.ndarray:
    total = total + 0.05
    return np.maximum(total / total.sum(axis=0), FLOOR)


def train(df: DataFrame, path: str, rows_per_lang: int = 1000, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, learned from labelled rows.

    Learns from a sample of about ``rows_per_lang`` whole texts of each language, drawn by a hash of the
    id: the one bound on rows, and a parameter. Words of any length teach. Rows without text or language are
    left out. With no rows, as of an empty table, there are no languages. What reaches the driver is a number
    per piece and language.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    per = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per)
    if not langs:
        return [], np.zeros((0, 0))
    spark = df.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, rows_per_lang / n)) for k, n in per.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < F.col("share") * 1_000_003
    sample = rows.join(F.broadcast(shares), "lang").filter(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                seen: Counter = Counter()
                for lang, text in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                    seen.update((w, lang) for w in words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "lang", "n"])

    counts = sample.mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = cut(counts.repartition(spark.sparkContext.defaultParallelism, "word"))  # small in bytes, long to compute on
    column = {k: i for i, k in enumerate(langs)}
    probs = None
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(probs)

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                words = batch.column(0).to_pylist()
                weight = np.zeros((len(words), len(column)))
                weight[np.arange(len(words)), [column[x] for x in batch.column(1).to_pylist()]] = batch.column(2).to_numpy()
                part = expected(words, weight, path, now.value)
                total = part if total is None else total + part
            if total is not None:
                at, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(total[at, lang])], ["piece", "lang", "n"])

        sums = counts.mapInArrow(step, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((len(pieces(path).pieces), len(langs)))
        total[sums.piece, sums.lang] = sums.n
        probs = _normalised(total)
    return langs, probs


@lru_cache(maxsize=1)
def _word_cache(key: str) -> tuple[dict[str, int], list[np.ndarray]]:
    return {}, [np.zeros((0, 0))]


def predict(df: DataFrame, path: str, langs: list[str], probs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: ``id_col, lang_pred, score`` and the columns of ``keep``.

    ``score`` is the posterior of the predicted language under equal priors; equal scores go to the
    first language in alphabetical order. A null text, one without a letter, or a model without
    languages gives ``und`` with score 0. A very long text is read whole, one at a time. One row per input row,
    none for an empty table; other columns are ignored.
    """
    model = df.sparkSession.sparkContext.broadcast(probs)
    key = hashlib.sha256(probs.tobytes() + path.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (table,) = _word_cache(key)[0], _word_cache(key)[1]
        for batch in batches:
            names, scores = [], []
            for _, chunk in text_chunks(batch.column(text_at)):
                docs = [words_of(t) for t in chunk] if langs else [[] for _ in chunk]
                if len(table) > CACHE_ENTRIES:
                    index.clear()
                    table = np.zeros((0, len(langs)))
                new = list({w for d in docs for w in d if w not in index})
                if new:
                    more = log_probs(new, path, model.value)
                    more[[not any(map(str.isalpha, w)) for w in new]] = np.nan
                    index.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    table = np.concatenate([table.reshape(-1, len(langs)), more])
                    _word_cache(key)[1][0] = table
                for d in docs:
                    at = np.fromiter(map(index.__getitem__, d), dtype=np.int64, count=len(d))
                    each = table[at]
                    each = each[~np.isnan(each[:, 0])] if len(d) else each
                    if not len(each):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = each.sum(axis=0)
                    best = int(np.argmax(total))
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                for w in [w for w in new if len(w) > CACHED]:
                    del index[w]
            sent = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            columns = [batch.column(i) for i in sent]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*[batch.schema.names[i] for i in sent], "lang_pred", "score"])

    kept = [id_col, *keep]
    rows = df.select(*[df[c].alias(f"_{i}") for i, c in enumerate(kept)], *[df[text_col].alias("_text")] * (text_col not in kept))
    text_at = kept.index(text_col) if text_col in kept else len(kept)  # the text is sent once, kept or not
    schema = ", ".join(f"_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)) + ", lang_pred string, score double"
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32 as text leaves 1 when divided by 3; those rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
