"""Token counts: a broadcast table of frequent pre-tokens, then a worker cache, then the library."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .pretokens import GPT_PATTERN, splitter

TABLE_ENTRIES = 65_536  # of at most MAX_PIECE characters each: the broadcast is a few MB at any input size
MAX_PIECE = 32
SAMPLE_ROWS = 20_000  # documents from which the table is chosen; no count depends on them
SAMPLE_TASKS = 8  # tasks that read the sample, each reporting at most TABLE_ENTRIES pre-tokens
WIDE = 400_000
CACHE_ENTRIES = 400_000  # of pre-tokens of at most CACHED characters, so the cache is bounded in bytes too
CACHED = 64


@lru_cache(maxsize=2)
def _json_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _model_tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _cache(path: str) -> dict[str, int]:
    return {}


def count_whole(texts: list[str], path: str) -> list[int]:
    """The library's count for each text."""
    if path.endswith(".model"):
        return [len(x) for x in _model_tokenizer(path).encode(texts, num_threads=1)]
    return [len(x.ids) for x in _json_tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def frequent_pieces(df: DataFrame, pattern: str, text_col: str = "text", entries: int = TABLE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The most frequent pre-tokens of about ``sample_rows`` whole texts drawn at random from all rows.

    The table they are for only saves time: a pre-token that it lacks is counted all the same. Each of
    SAMPLE_TASKS tasks reports the ``entries`` most frequent ones of its texts, so neither the tasks nor the
    driver hold more than that at any input size; only the drawn texts are moved, and no pre-token is shuffled.
    """
    rows = df.select(df[text_col].alias("text"))
    total = max(1, rows.count())
    drawn = rows.sample(min(1.0, sample_rows / total), seed=7) if total > sample_rows else rows
    drawn = drawn.repartition(SAMPLE_TASKS)  # about sample_rows texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(pattern), Counter()
        for batch in batches:
            for _, texts in text_chunks(batch.column(0)):
                for text in texts:
                    counts.update(p for p in split(text) if len(p) <= MAX_PIECE)
                    if len(counts) > WIDE:
                        counts = Counter(dict(counts.most_common(WIDE // 4)))
        top = counts.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    found: Counter = Counter()
    for row in drawn.mapInArrow(run, "piece string, n long").collect():  # at most SAMPLE_TASKS * entries rows
        found[row.piece] += row.n
    return sorted(found, key=lambda p: (-found[p], p))[:entries]


def count_tokens(
    df: DataFrame, path: str, pattern: str = GPT_PATTERN, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text, as the library for ``path`` counts them without added special tokens.

    Returns ``id_col, n_bytes, n_tokens, over_limit`` (more than ``limit``), one row per input row. A null
    text counts as empty; repeated rows repeat; other columns are ignored; an empty table gives an
    empty one. ``.json`` files must hold a byte-level BPE that splits by ``pattern``: the count of a text
    is then the sum over its pre-tokens. A text that holds the string of a special token goes to the
    library whole, as do all texts for ``.model`` files. Very long texts are read whole, one at a time.
    """
    by_piece = path.endswith(".json")
    frequent: dict[str, int] = {}
    if by_piece:
        pieces = frequent_pieces(df, pattern, text_col)  # at most TABLE_ENTRIES
        frequent = dict(zip(pieces, count_whole(pieces, path), strict=True))
    table = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known, split = _cache(path), table.value, splitter(pattern)
        special = [t.content for t in _json_tokenizer(path).get_added_tokens_decoder().values()] if by_piece else []
        for batch in batches:
            ids, sizes, texts = batch.column(0), batch.column(1), batch.column(2)
            for start, chunk in text_chunks(texts):
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                whole = [i for i, t in enumerate(chunk) if not by_piece or any(s in t for s in special)]
                counts = dict(zip(whole, count_whole([chunk[i] for i in whole], path), strict=True))
                docs = [[] if i in counts else split(t) for i, t in enumerate(chunk)]
                missing = list({p for doc in docs for p in doc if p not in known and p not in cache})
                cache.update(zip(missing, count_whole(missing, path) if missing else [], strict=True))
                for i, doc in enumerate(docs):
                    if i not in counts:
                        first = list(map(known.get, doc))
                        counts[i] = sum(n if n is not None else cache[p] for n, p in zip(first, doc, strict=True))
                for p in [p for p in missing if len(p) > CACHED]:
                    del cache[p]
                n = [counts[i] for i in range(len(chunk))]
                columns = [ids.slice(start, len(chunk)), sizes.slice(start, len(chunk)), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length(df[text_col]).cast("long"), F.lit(0).cast("long"))
    rows = df.select(df[id_col].alias("id"), size.alias("n_bytes"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
