"""Preparation of service documents: cleaning, sections, chunks, tags."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import PERSONAL
from ..functions import columns as C

HEADING = r"^(?:#{1,3}\s+.+|[A-ZА-ЯЁ][A-ZА-ЯЁ\s]{5,})$"


MARKED = r"[\p{M}ᄀ-ᇿ]"


def compose(docs: DataFrame, col: str = "text") -> DataFrame:
    """Unicode NFC, in one pass: only texts with a combining mark or a Hangul letter are sent to an Arrow function, as Spark has no built-in for it."""
    nfc = F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore"), "string")
    marked = F.when(F.col(col).rlike(MARKED), F.col(col))
    return docs.withColumn(col, F.coalesce(nfc(marked), F.col(col)))


def clean(docs: DataFrame, col: str = "text", nfc: bool = True) -> DataFrame:
    """The text cleaned (``columns.clean_text``) and composed."""
    out = docs.withColumn(col, C.clean_text(F.col(col)))
    return compose(out, col) if nfc else out


GRAM = 4  # letters of an alias by which it is looked up; a shorter alias is looked up whole


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def identify_model(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``model`` and ``vendor``: the first alias (by ``alias_no``) in the file name, else in the first page's text.

    ``docs`` has ``document_id, file_name, first_page``. Each alias is keyed by the one of its runs of GRAM letters that
    the fewest aliases have; documents meet aliases by an equi-join on their runs, and what meets is verified in the
    whole texts. The vendor is the model's first word. Blank aliases are left out; without a match both are null.
    """
    names = aliases.select(F.lower("alias").alias("alias"), "canonical", "alias_no").filter(F.trim("alias") != "")
    size = F.least(F.length("alias"), F.lit(GRAM))
    sizes = sorted(r[0] for r in names.select(size).distinct().collect())  # at most GRAM numbers
    keyed = [names.filter(size == n).select("*", F.explode(F.array_distinct(_grams(F.col("alias"), n))).alias("gram")) for n in sizes]
    found = [docs.select("document_id", F.explode(F.array_distinct(F.concat(*[_grams(F.lower(F.coalesce(c, F.lit(""))), n) for c in ("file_name", "first_page")]))).alias("gram")) for n in sizes]
    if not sizes:
        return docs.withColumns({"model": F.lit(None).cast("string"), "vendor": F.lit(None).cast("string")})
    keys, grams = keyed[0], found[0]
    for k, g in zip(keyed[1:], found[1:], strict=True):
        keys, grams = keys.unionByName(k), grams.union(g)
    shared = keys.withColumn("aliases", F.count("*").over(W.partitionBy("gram")))
    keys = shared.groupBy("alias", "canonical", "alias_no").agg(F.min_by("gram", F.struct("aliases", "gram")).alias("gram"))
    met = grams.join(keys, "gram").groupBy(F.col("document_id").alias("d_id")).agg(F.collect_set(F.struct("alias_no", "canonical", "alias")).alias("met"))
    first = lambda c: F.array_min(F.filter("met", lambda x: F.lower(F.coalesce(c, F.lit(""))).contains(x["alias"])))["canonical"]
    out = docs.join(met, F.col("document_id") == F.col("d_id"), "left")
    out = out.withColumn("model", F.coalesce(first("file_name"), first("first_page"))).drop("d_id", "met")
    return out.withColumn("vendor", F.split("model", " ")[0])


def split_headings(docs: DataFrame) -> DataFrame:
    """``document_id, section_no, section, text``: parts below ``#`` or upper-case heading lines; before the first it is "Introduction"."""
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    heading = F.col("line").rlike(HEADING)
    order = W.partitionBy("document_id").orderBy("n")
    marked = lines.withColumn("heading", heading).withColumn("section_no", F.sum(heading.cast("int")).over(order))
    title = F.max(F.when(F.col("heading"), F.regexp_replace(F.trim("line"), r"^#+\s*|\s*#+$", "")))
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("n", "line"))))
    text = F.regexp_replace(F.concat_ws("\n", F.transform(body, lambda x: x["line"])), r"^\s+|\s+$", "")
    out = marked.groupBy("document_id", "section_no").agg(F.coalesce(title, F.lit("Introduction")).alias("section"), text.alias("text"))
    return out.filter("text <> ''")


def split_bookmarks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """``document_id, section_no, section, page, text``: the pages from each bookmark of level 1 to 3 up to the next.

    ``pages`` has ``document_id, page_no, text``; ``marks`` has ``document_id, mark_no, level, title, page``. Bookmarks
    are taken in order of ``mark_no``; one before page 1 begins there. A page belongs to the last mark of its own page or
    a page before, as marks and pages are put in one order and the mark is carried forward. Where marks go back in
    pages, a page can lie in several ranges: each such range that a later mark reopens is read by its own pages.
    """
    in_order = W.partitionBy("document_id").orderBy("mark_no")
    ranges = marks.filter("level <= 3").withColumn("until", F.lead("page").over(in_order)).withColumn("from", F.greatest("page", F.lit(1)))
    ranges = ranges.withColumn("until", F.when(F.col("until").isNotNull(), F.greatest("until", F.lit(1)))).filter(F.col("until").isNull() | (F.col("until") > F.col("from")))
    # In order of its pages, a mark's range ends where the next begins, unless the marks go back.
    by_page = W.partitionBy("document_id").orderBy("from", "mark_no")
    ranges = ranges.withColumn("next", F.lead("from").over(by_page)).withColumn("plain", F.col("until").eqNullSafe(F.col("next")))
    crossed = F.max((~F.col("plain")).cast("int")).over(W.partitionBy("document_id")) == 1
    ranges = ranges.withColumn("crossed", crossed)
    point = F.struct("mark_no", "title", "page")
    marked = ranges.filter("NOT crossed").select("document_id", F.col("from").alias("at"), F.lit(0).alias("kind"), point.alias("mark"), F.lit(None).cast("string").alias("text"))
    paged = pages.select("document_id", F.col("page_no").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marked.schema["mark"].dataType).alias("mark"), "text")
    carried = F.last("mark", ignorenulls=True).over(W.partitionBy("document_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    inside = marked.unionByName(paged).withColumn("mark", carried).filter("kind = 1 AND mark IS NOT NULL").select("document_id", "mark", F.col("at").alias("page_no"), "text")
    # Marks out of order: each range opens its own pages, one row for each page that it has.
    opened = ranges.filter("crossed").join(pages.groupBy("document_id").agg(F.max("page_no").alias("last")), "document_id")
    end = F.least(F.coalesce(F.col("until") - 1, F.col("last")), F.col("last"))
    opened = opened.filter(end >= F.col("from")).select("document_id", point.alias("mark"), F.explode(F.sequence("from", end)).alias("page_no"))
    back = opened.join(pages, ["document_id", "page_no"]).select("document_id", "mark", "page_no", "text")
    body = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    out = inside.unionByName(back).groupBy("document_id", "mark").agg(F.trim(F.concat_ws("\n\n", body)).alias("text"))
    return out.filter("text <> ''").select("document_id", F.col("mark.mark_no").alias("section_no"), F.col("mark.title").alias("section"), F.col("mark.page").alias("page"), "text")


def split_records(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``document_id, part_no, text``: the non-empty parts between matches of ``separator``."""
    parts = docs.select("document_id", F.posexplode(F.split("text", separator)).alias("at", "text"))
    parts = parts.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")
    return parts.select("document_id", (F.row_number().over(W.partitionBy("document_id").orderBy("at")) - 1).alias("part_no"), "text")


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def sized_parts(c: Column, most: int, overlap: int) -> Column:
    """A text cut to parts of at most ``most`` words where its separators allow it.

    The first of blank line, line, sentence and space that cuts the text is the separator. Parts are packed
    greedily; a new one starts with the last ``overlap`` words of the one before. An oversize part stays whole.
    """
    out = F.array(c)
    for sep in (" ", ". ", "\n", "\n\n"):
        pieces = F.split(c, "\\Q" + sep + "\\E")
        out = F.when(F.size(pieces) > 1, _packed(pieces, sep, most, overlap)).otherwise(out)
    return F.when(F.size(tokens(c)) <= most, F.array(c)).otherwise(out)


def _packed(pieces: Column, sep: str, most: int, overlap: int) -> Column:
    """Pieces joined greedily up to ``most`` words, with overlap."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("size"))

    def step(a, x):
        n, words = F.size(tokens(x)), tokens(a["now"])
        full = a["now"].isNotNull() & (a["size"] + n > most)
        last = F.concat_ws(" ", F.slice(words, -overlap, overlap)) if overlap else F.lit(None).cast("string")
        tail = F.when(F.size(words) > overlap, last).otherwise(a["now"])
        kept = F.when(F.size(words) > overlap, F.lit(overlap)).otherwise(F.size(words))
        joined = lambda old: F.when(old.isNull(), x).otherwise(F.concat(old, F.lit(sep), x))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(full, joined(tail)).otherwise(joined(a["now"])).alias("now"),
            F.when(full, kept + n).otherwise(a["size"] + n).alias("size"),
        )

    return F.aggregate(pieces, start, step, lambda a: F.array_compact(F.concat(a["done"], F.array(a["now"]))))


def split_sized(docs: DataFrame, most: int = 500, overlap: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """``document_id, keep…, part_no, text`` of ``sized_parts``."""
    return docs.select("document_id", *keep, F.posexplode(sized_parts(F.col("text"), most, overlap)).alias("part_no", "text"))


def document_id(file_name: Column, content: Column) -> Column:
    """The file's name without special characters, and eight digits of its content's hash."""
    return F.concat(F.regexp_replace(F.lower(file_name), r"[^a-z0-9]+", "_"), F.lit("_"), F.substring(F.sha2(content, 256), 1, 8))


def chunk(docs: DataFrame, strategy: str = "recursive", most: int = 500, overlap: int = 80, separator: str = "\n\n") -> DataFrame:
    """``chunk_id, document_id, section, text, tokens`` by strategy: ``hierarchical`` sections, ``per_record`` or ``recursive``."""
    if strategy == "hierarchical":
        parts = split_sized(split_headings(docs), most, overlap, ("section_no", "section"))
    elif strategy == "per_record":
        parts = split_records(docs, separator).withColumns({"section_no": F.lit(0), "section": F.lit(None).cast("string")})
    else:
        parts = split_sized(docs, most, overlap).withColumns({"section_no": F.lit(0), "section": F.lit(None).cast("string")})
    n = F.row_number().over(W.partitionBy("document_id").orderBy("section_no", "part_no")) - 1
    return parts.filter(F.trim("text") != "").withColumn("n", n).select(F.concat("document_id", F.lit("_c"), F.col("n").cast("string")).alias("chunk_id"), "document_id", "section", "text", F.size(tokens(F.col("text"))).alias("tokens"))


def enrich(chunks: DataFrame, labels: DataFrame | None = None, vendor: str | None = None, fallback: str = "reference") -> DataFrame:
    """Add ``error_codes, components, content_type``, and redact the text; codes come from the text as it was.

    ``labels`` has ``chunk_id, content_type``.
    """
    out = chunks.withColumns({"error_codes": C.codes_in(F.col("text"), vendor), "components": C.components_in(F.col("text"))})
    out = out.withColumn("text", C.redact_personal(F.col("text"), PERSONAL))
    if labels is None:
        return out.withColumn("content_type", F.lit(fallback))
    kinds = labels.select("chunk_id", F.col("content_type").alias("kind"))
    return out.join(kinds, "chunk_id", "left").withColumn("content_type", F.coalesce("kind", F.lit(fallback))).drop("kind")


def upsert_chunks(current: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all chunks of the documents that come in; doing it again changes nothing."""
    return current.join(new.select("document_id").distinct(), "document_id", "left_anti").select(current.columns).unionByName(new.select(current.columns))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """``document_id, chunks, with_codes, with_components``."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.size("error_codes") > 0).alias("with_codes"), F.count_if(F.size("components") > 0).alias("with_components"))
