"""Readers of log files as all-text DataFrames, and the store on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import PREAMBLE_WORDS

DELIMITERS = (",", ";", "\t", "|")
HEAD = 8192


class EmptyFile(ValueError):
    """A file without data rows."""


class Malformed(ValueError):
    """A file that no reader accepts."""


def _head(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    rows = _text(spark, path, encoding).limit(200).collect()  # a bounded head, for sniffing only
    return "\n".join(r[0] for r in rows)[:HEAD].lstrip("﻿")


def sniff_delimiter(head: str) -> str:
    """The delimiter that splits the first lines alike and most often; a comma if none does."""
    lines = [x for x in head.split("\n") if x.strip()][:20]
    counts = {d: [x.count(d) for x in lines] for d in DELIMITERS}
    even = {d: c[0] for d, c in counts.items() if c and c[0] > 0 and min(c) == c[0] == max(c)}
    return max(even or {d: c[0] for d, c in counts.items() if c and c[0] > 0} or {",": 1}, key=lambda d: (even or {x: sum(c) for x, c in counts.items()} or {",": 1}).get(d, 0))


def unique_names(names: list[str | None]) -> list[str]:
    """Trimmed header names; a repeated one gets ``_1``, ``_2``, …; an empty one its place."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = (name or "").strip().lstrip("﻿") or f"column_{i}"
        out.append(name if name not in seen else f"{name}_{seen[name]}")
        seen[name] = seen.get(name, 0) + 1
    return out


def is_preamble(c):
    """True for a line that may stand before the header of an SQL export: blank, a comment, or with an SQL word in its first 300 characters."""
    s = F.trim(F.regexp_replace(c, "^﻿", ""))
    words = F.split(F.substring(F.upper(s), 1, 300), r"[\s(,;]+")
    return (s == "") | s.startswith("--") | F.arrays_overlap(words, F.array(*[F.lit(w) for w in PREAMBLE_WORDS]))


def strip_preamble(lines: DataFrame) -> DataFrame:
    """``n, value`` lines from the first that isn't preamble on, without a byte order mark; none if all are."""
    first = lines.filter(~is_preamble(F.col("value"))).agg(F.min("n").alias("first"))
    kept = lines.join(F.broadcast(first), F.col("n") >= F.col("first")).drop("first")
    return kept.withColumn("value", F.regexp_replace("value", "^﻿", ""))


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``n, value``: the lines of a file in order (n grows with the line, not by one)."""
    return _text(spark, path, encoding).select(F.monotonically_increasing_id().alias("n"), "value")


def _text(spark: SparkSession, path: str, encoding: str, *more: str) -> DataFrame:
    """Lines of a text file; other encodings than UTF-8 are decoded in Arrow batches, as Spark knows only a few."""
    lines = spark.read.text(path).select("value", *more)
    if encoding.upper().replace("-", "") == "UTF8":
        return lines
    decoded = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode(encoding)), "string")
    return lines.withColumn("value", decoded(F.col("value").cast("binary")))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", preamble: bool = False) -> DataFrame:
    """A delimited file as text columns with ``row_no`` from 2 on for the first data row's place.

    Short rows are filled with nulls; a row with too many fields or an open quote rejects the file, as does
    a file without data rows. ``preamble`` skips leading SQL lines. Where quoted fields hold line ends, lines are
    put together to rows by ``join_lines``; ``row_no`` then counts rows.
    """
    lines = read_lines(spark, path, encoding).filter(F.trim("value") != "")
    if preamble:
        lines = strip_preamble(lines)
    first = lines.orderBy("n").limit(1).collect()
    if not first:
        raise EmptyFile(path)
    header = first[0].value.lstrip("﻿")
    sep = sep or ("\t" if path.lower().endswith(".tsv") else sniff_delimiter(header if preamble else _head(spark, path, encoding)))
    names = unique_names([f[1:-1] if len(f := x.strip()) > 1 and f[0] == f[-1] == '"' else f for x in _split(header, sep)])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    body = lines.filter(F.col("n") > first[0].n)
    parsed = body.select("n", "value", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "mode": "PERMISSIVE"}).alias("f"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if (odd := body.filter(quotes % 2 == 1).count()) and odd % 2 == 0:
        return _read_joined(spark, path, sep, encoding, preamble, names, schema)
    bad = parsed.filter(F.col(f"f.c{len(names)}").isNotNull() | (quotes % 2 == 1)).limit(1).collect()
    if bad:
        raise Malformed(f"{path}: {bad[0].value[:80]}")
    if not body.limit(1).collect():
        raise EmptyFile(path)
    return parsed.select((F.col("n") - first[0].n + 1).alias("row_no"), *[F.col(f"f.c{i}").alias(c) for i, c in enumerate(names)])


def join_lines(lines: DataFrame, quote: str = '"') -> DataFrame:
    """``file, block, n, value``: lines joined to rows where a line end lies inside quotes.

    ``lines`` has the same columns: the split of a file that a line is in (``block`` grows along the file) and its order
    there. A line begins a row if an even number of quotes stands before it in its file: the sum over the blocks before,
    one row a block, and over the lines before in its own. A row that goes on in the next block is known by its first
    line. So a file is read by as many tasks as it has splits, and only lines of rows of several lines are gathered.
    """
    quotes = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2
    file, inside = ["file", "block"], W.partitionBy("file", "block").orderBy("n")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # of blocks, not of lines
    odd = lines.withColumn("odd", quotes)
    blocks = odd.groupBy(*file).agg(F.sum("odd").alias("total")).withColumn("passed", F.coalesce(F.sum("total").over(before), F.lit(0)))
    seen = F.sum("odd").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("odd")
    marked = odd.join(F.broadcast(blocks.select(*file, "passed")), file).withColumn("begins", (F.col("passed") + seen) % 2 == 0)
    mine = F.struct("block", "n")
    firsts = marked.groupBy(*file).agg(F.max(F.when(F.col("begins"), mine)).alias("own")).withColumn("carried", F.last("own", ignorenulls=True).over(before))
    row = F.last(F.when(F.col("begins"), mine), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("own", row).join(F.broadcast(firsts.select(*file, "carried")), file)
    whole = F.col("begins") & (F.col("odd") == 0)
    parts = marked.filter(~whole).select("file", F.coalesce("own", "carried").alias("row"), "block", "n", "value")
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]))
    joined = parts.groupBy("file", "row").agg(text.alias("value")).select("file", "row.block", "row.n", "value")
    return marked.filter(whole).select("file", "block", "n", "value").unionByName(joined)


def _read_joined(spark: SparkSession, path: str, sep: str, encoding: str, preamble: bool, names: list[str], schema: T.StructType) -> DataFrame:
    """A delimited file whose quoted fields hold line ends. ``row_no`` counts rows, the header as 1."""
    lines = _text(spark, path, encoding, "_metadata.file_path", "_metadata.file_block_start").select(F.monotonically_increasing_id().alias("n"), "value", F.col("file_path").alias("file"), F.col("file_block_start").alias("block"))
    if preamble:
        lines = strip_preamble(lines)
    rows = join_lines(lines).filter(F.trim("value") != "")
    # Numbers along the file: rows of the blocks before, and those before in the own block.
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("rows"))
    counts = counts.withColumn("passed", F.coalesce(F.sum("rows").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a block
    at = F.row_number().over(W.partitionBy("file", "block").orderBy("n"))
    body = rows.withColumn("at", at).join(F.broadcast(counts.drop("rows")), ["file", "block"]).select((F.col("passed") + F.col("at")).alias("row_no"), "value").filter("row_no > 1")
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1"}
    parsed = body.select("row_no", "value", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options).alias("f"))
    bad = parsed.filter(F.col(f"f.c{len(names)}").isNotNull()).limit(1).collect()
    if bad:
        raise Malformed(f"{path}: {bad[0].value[:80]}")
    return parsed.select("row_no", *[F.col(f"f.c{i}").alias(c) for i, c in enumerate(names)])


def _split(line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as ``a.b`` columns, everything as text; arrays and maps as JSON."""
    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                c = F.col(".".join(f"`{p}`" for p in at))
                yield (F.to_json(c) if isinstance(f.dataType, T.ArrayType | T.MapType) else c.cast("string")).alias(".".join(at))

    return df.select(*leaves(df.schema, ()))


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON as text columns: an array of objects, one object, or one key around an array of objects.

    A document is a file, or with ``multi_line=False`` a line.
    """
    df = spark.read.json(path, multiLine=multi_line, primitivesAsString=True, mode="FAILFAST")
    if len(df.schema.fields) == 1 and isinstance(kind := df.schema.fields[0].dataType, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        df = df.select(F.explode(df.columns[0]).alias("r")).select("r.*")
    if not df.columns:
        raise EmptyFile(path)
    return flatten(df)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line as text columns; blank lines are skipped, any bad line fails."""
    df = spark.read.json(path, primitivesAsString=True, mode="FAILFAST")
    if not df.columns:
        raise EmptyFile(path)
    return flatten(df)


def read_log(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format or extension, else by the first character: ``[`` or ``{`` is JSON, or JSON lines if each line stands alone."""
    fmt = fmt or {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl"}.get(path.rsplit(".", 1)[-1].lower())
    if fmt is None:
        head = _head(spark, path).lstrip()
        whole = [x for x in head.split("\n") if x.strip()]
        fmt = "delimited" if head[:1] not in ("[", "{") else "jsonl" if head[0] == "{" and len(whole) > 1 and all(x.strip()[:1] == "{" for x in whole[:2]) else "json"
    return {"delimited": read_delimited, "json": read_json, "jsonl": read_jsonl}[fmt](spark, path, **options)


STORE = ("events", "snapshots", "devices", "invalid", "summary")


def write_store(store: dict[str, DataFrame], folder: str) -> None:
    """Write the tables of a store; events by date."""
    for name in STORE:
        if name in store:
            df = store[name].withColumn("event_date", F.to_date("ts")) if name == "events" else store[name]
            writer = df.write.mode("overwrite")
            (writer.partitionBy("event_date") if name == "events" else writer).parquet(f"{folder}/{name}")


def read_store(spark: SparkSession, folder: str, names: tuple[str, ...] = STORE) -> dict[str, DataFrame]:
    """The tables of a written store; events keep ``event_date``, by which windows are pruned."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Add ``row_no`` by an ordering column of a small table."""
    return df.withColumn("row_no", F.row_number().over(W.orderBy(order)).cast("long"))
