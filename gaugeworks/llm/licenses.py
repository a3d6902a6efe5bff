"""License scans by diagonal voting, with DataFrame functions only.

Every run of two or three consecutive words of a document is hashed and joined to the places where the same
words stand in the license templates: base phrases by two words, passages by three. A match at word p of the
document and word t of a template votes for the diagonal p - t: all words of a verbatim passage vote for one
diagonal, and an inserted or missing word moves to a neighbouring one. Neighbouring diagonals are merged
to spans, and a span is verified: its votes are taken in the order of the template as far as they also
follow each other in the document; from first to last they may not stretch far beyond the template; the
words they cover must be most of it; and the words that tell a license from its likes must be among them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The base phrases, whose every verbatim place counts.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
# Notices and passages of public licenses, found also with small changes, and runs of three words of each that may not differ.
TEMPLATES = (
    ("gpl-3.0", "gnu general public, license version 3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "gnu general public, license version 2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "gnu general public, either version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "gnu general public, either version 2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl", "gnu general public", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "gnu lesser general", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "gnu lesser general", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "gnu affero general", "licensed under the GNU Affero General Public License"),
    ("agpl", "gnu affero general", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "version 2 0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "under the license", "unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "the mit license", "released under the MIT License"),
    ("mit", "free of charge", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "copies of the", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "source and binary", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse or promote", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "with or without", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "v 2 0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "by 4 0", "licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "by nc 4", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "by sa 4", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "attribution 4 0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "attribution noncommercial 4", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "attribution sharealike 4", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "commons attribution license", "licensed under a Creative Commons Attribution license"),
)
BASE_GRAM, GRAM = 2, 3  # words of a run
NEAR = 2  # diagonals so close are one span
VERIFIED = 0.75  # least share of a template's words
STRETCH = 1.25  # a span may be so much longer than its template

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text: A-Z in lower case, runs of digits, a-z and all beyond ASCII; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), lambda w: w != "")


def words_of(phrase: str) -> list[str]:
    """The words of a fixed phrase."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", phrase.lower())


def template_rows() -> list[tuple[int, str, bool, int, list[int], int, str]]:
    """``template, label, base, size`` (words), ``must`` (places that have to be covered), ``t``, ``gram`` of each place."""
    out = []
    for i, (label, must, phrase) in enumerate([(label, "", phrase) for label, phrase in BASE] + list(TEMPLATES)):
        n, of = BASE_GRAM if i < len(BASE) else GRAM, words_of(phrase)
        runs = [" ".join(of[t : t + n]) for t in range(len(of) - n + 1)]
        out += [(i, label, i < len(BASE), len(of), [runs.index(m) for m in must.split(", ") if m], t, run) for t, run in enumerate(runs)]
    return out


def template_places(spark: SparkSession) -> DataFrame:
    """The rows of ``template_rows`` with the ``hash`` of their words: a few hundred at any input size."""
    values = ", ".join(f"({i}, '{label}', {base}, {size}, cast(array({', '.join(map(str, must))}) AS array<int>), {t}, '{gram}')" for i, label, base, size, must, t, gram in template_rows())
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, base, size, must, t, gram)")
    return table.withColumn("hash", F.xxhash64("gram"))


def grams(of: Column) -> Column:
    """Place and words of each run that may stand in a template: only words that some template has are put together."""
    known = sorted({w for *_, phrase in (*BASE, *TEMPLATES) for w in words_of(phrase)})
    in_base = sorted({w for _, phrase in BASE for w in words_of(phrase)})

    def may(i: Column) -> Column:
        a, b, c = (F.get(of, i + k) for k in range(3))
        return a.isin(known) & b.isin(known) & (c.isin(known) | (a.isin(in_base) & b.isin(in_base)))

    def runs(i: Column) -> Column:
        two = F.concat_ws(" ", F.get(of, i), F.get(of, i + 1))
        three = F.when(F.get(of, i + 2).isNotNull(), F.concat_ws(" ", two, F.get(of, i + 2)))
        return F.struct(i.alias("p"), F.array(two, three).alias("runs"))

    places = F.when(F.size(of) > 1, F.sequence(F.lit(0), F.size(of) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, may), runs)


def votes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, template, label, base, size, must, diagonal, places``: the template places that voted for each diagonal."""
    each = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("text_key"), words(df[text_col]).alias("w"))
    each = each.select("id", "text_key", F.explode(grams(F.col("w"))).alias("g")).select("id", "text_key", "g.p", F.explode("g.runs").alias("gram"))
    each = each.filter("gram IS NOT NULL").withColumn("hash", F.xxhash64("gram"))
    met = each.join(F.broadcast(template_places(df.sparkSession)), ["hash", "gram"])  # a few hundred fixed rows
    return met.groupBy("id", "text_key", "template", "label", "base", "size", "must", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("places"))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans: ``id, text_key, label, base, start, share``.

    A base phrase stands where all its places vote for one diagonal. Passages merge diagonals up to NEAR
    apart. Of their votes, the first of each place counts if it lies behind all earlier places' votes.
    """
    key = ["id", "text_key", "template", "label", "base", "size", "must"]
    whole = voted.filter(F.col("base") & (F.size("places") == F.col("size") - (BASE_GRAM - 1)))
    whole = whole.select("id", "text_key", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    of_template = W.partitionBy("id", "text_key", "template")
    apart = F.col("diagonal") - F.lag("diagonal").over(of_template.orderBy("diagonal"))
    merged = voted.filter("NOT base").withColumn("apart", F.when(apart <= NEAR, 0).otherwise(1)).withColumn("span", F.sum("apart").over(of_template.orderBy("diagonal")))
    pairs = merged.select(*key, "span", "diagonal", F.explode("places").alias("t")).groupBy(*key, "span", "t").agg((F.min("diagonal") + F.col("t")).alias("p"))
    of_span = W.partitionBy("id", "text_key", "template", "span").orderBy("t")
    behind = F.max("p").over(of_span.rowsBetween(W.unboundedPreceding, -1))
    pairs = pairs.withColumn("behind", behind).filter(F.col("behind").isNull() | (F.col("p") > F.col("behind")))
    new = F.least(F.lit(GRAM), F.coalesce(F.col("t") - F.lag("t").over(of_span), F.lit(GRAM)))
    found = pairs.withColumn("new", new).groupBy(*key, "span").agg(
        F.sum("new").alias("covered"), F.min("p").alias("start"), (F.max("p") + GRAM).alias("end"), F.count_if(F.array_contains("must", F.col("t"))).alias("told")
    )
    found = found.withColumn("share", F.col("covered") / F.col("size"))
    found = found.filter((F.col("share") >= VERIFIED) & (F.col("told") == F.size("must")) & (F.col("end") - F.col("start") <= STRETCH * F.col("size") + NEAR))
    return whole.unionByName(found.select("id", "text_key", "label", "base", "start", "share"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in every whole text.

    Returns ``id_col, n_words, n_base`` (places of base phrases), ``first_word`` and ``last_word`` (smallest
    and largest start of those, else null), ``base_labels, labels`` (with those of the templates; distinct,
    sorted, comma-joined) and ``score`` (largest share of a template's words in a span, 0 without one). One row per input row; a
    null text is empty. Repeated rows repeat; rows that share an id but not a text are told apart by a
    hash of the text. Texts of any length are read whole. Other columns are ignored; an empty table gives an
    empty one.
    """
    found = spans(votes(df, id_col, text_col)).groupBy(F.col("id").alias("f_id"), F.col("text_key").alias("f_key")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    every = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("text_key"), F.size(words(df[text_col])).cast("long").alias("n_words"))
    out = every.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    joined = lambda c: F.coalesce(F.concat_ws(",", c), F.lit("")).alias(c)
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined("base_labels"), joined("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
