"""Error-code registries, severity classification and model aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def canonical_model(df: DataFrame, aliases: DataFrame, col: str = "model", out: str = "canonical") -> DataFrame:
    """Add the canonical name of a model: by its lower-cased text, else by that without a trailing serial number.

    ``aliases`` has ``alias`` (lower case) and ``canonical``; unknown models keep their text, without the
    serial number. Alias tables are small and Spark broadcasts them if their size allows it.
    """
    raw = F.trim(F.col(col))
    short = F.regexp_replace(raw, r"\s+[A-Z0-9]{6,}$", "")
    names = aliases.select(F.lower(F.trim("alias")).alias("alias"), "canonical")
    first = names.select(F.col("alias").alias("_a1"), F.col("canonical").alias("_c1"))
    second = names.select(F.col("alias").alias("_a2"), F.col("canonical").alias("_c2"))
    joined = df.join(first, F.lower(raw) == F.col("_a1"), "left").join(second, F.lower(short) == F.col("_a2"), "left")
    return joined.withColumn(out, F.coalesce("_c1", "_c2", short)).drop("_a1", "_c1", "_a2", "_c2")


def slugs(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``vendor_slug`` and ``model_slug``."""
    named = canonical_model(df, aliases, "model", "_canonical")
    return named.withColumn("vendor_slug", C.vendor_slug(F.col("vendor"))).withColumn("model_slug", C.model_slug(F.col("_canonical"))).drop("_canonical")


def classify(codes: DataFrame, registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """Severity of each row's ``key`` (with ``vendor, model``): registry, then overrides, then Medium.

    Adds ``severity, component, description, class_confidence, source``. Distinct keys are classified once and
    joined back. Where several vendors of the registry know a code of a model, the first by ``vendor_order``
    answers; the row's own vendor comes before all.
    """
    keys = codes.select("vendor", "model", "key").distinct()
    known = registry.select(F.col("vendor").alias("r_vendor"), F.col("model_slug").alias("r_slug"), F.col("code").alias("r_code"), "vendor_order", F.struct("severity", "component", "description").alias("found"))
    met = keys.join(known, (C.model_slug(F.col("model")) == F.col("r_slug")) & (F.col("key") == F.col("r_code")))
    rank = F.struct((F.col("vendor") != F.col("r_vendor")).cast("int"), F.col("vendor_order"), F.col("r_vendor"))
    hits = met.groupBy(F.col("vendor").alias("h_vendor"), F.col("model").alias("h_model"), F.col("key").alias("h_key")).agg(F.min_by("found", rank).alias("found"))
    extra = overrides.select(F.col("code").alias("key"), F.col("severity").alias("o_severity"), F.col("confidence").alias("o_confidence"))
    same = F.col("vendor").eqNullSafe(F.col("h_vendor")) & F.col("model").eqNullSafe(F.col("h_model")) & (F.col("key") == F.col("h_key"))
    out = codes.join(hits, same, "left").join(extra, "key", "left")
    known_ = F.col("found").isNotNull()
    return out.select(
        *codes.columns,
        F.coalesce("found.severity", "o_severity", F.lit("Medium")).alias("severity"), F.col("found.component").alias("component"), F.col("found.description").alias("description"),
        F.when(known_, F.lit(0.9)).otherwise(F.coalesce("o_confidence", F.lit(0.3))).alias("class_confidence"),
        F.when(known_, "vendor_model_registry").when(F.col("o_severity").isNotNull(), "override").otherwise("fallback").alias("source"),
    )


def load_registry(df: DataFrame, vendor: str, model: str) -> tuple[DataFrame, DataFrame]:
    """A code table (``row_no, code, description, severity, component, notes``) as registry rows and rejected rows.

    Rows without a code are skipped; a blank description or an unknown severity rejects; the last row of a code wins.
    """
    rows = df.select("row_no", F.upper(F.trim("code")).alias("code"), C.text_or_null(F.col("description")).alias("description"), C.coerce_severity(F.col("severity")).alias("severity"), F.col("severity").alias("raw_severity"), C.text_or_null(F.col("component")).alias("component"), C.text_or_null(F.col("notes")).alias("notes"))
    rows = rows.filter("code <> ''")
    reason = F.when(F.col("description").isNull(), "no description").when(F.col("severity").isNull(), "unknown severity")
    good = rows.filter(reason.isNull()).withColumn("nth", F.row_number().over(W.partitionBy("code").orderBy(F.desc("row_no")))).filter("nth = 1")
    good = good.select(F.lit(vendor).alias("vendor"), F.lit(model).alias("model"), "code", "description", "severity", "component", "notes")
    return good, rows.filter(reason.isNotNull()).select("row_no", "code", reason.alias("reason"))


REGISTRY_KEY = ["vendor", "model", "code"]


def merge_registry(current: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """Upsert incoming rows; with ``replace``, models that come in lose the codes that don't."""
    key = ["vendor", "model"] if replace else REGISTRY_KEY
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def find_conflicts(registry: DataFrame) -> DataFrame:
    """Codes that two models of a vendor describe differently: a row per pair of models and field."""
    a = registry.select("vendor", "code", *[F.col(c).alias(f"{c}_a") for c in ("model", "severity", "description", "component")])
    b = registry.select("vendor", "code", *[F.col(c).alias(f"{c}_b") for c in ("model", "severity", "description", "component")])
    pairs = a.join(b, ["vendor", "code"]).filter("model_a < model_b")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_a").alias("value_a"), F.col(f"{c}_b").alias("value_b")) for c in ("severity", "description", "component")])
    each = pairs.select("vendor", "code", "model_a", "model_b", F.explode(F.filter(fields, lambda x: ~x["value_a"].eqNullSafe(x["value_b"]))).alias("f"))
    return each.select("vendor", "code", "model_a", "model_b", "f.field", "f.value_a", "f.value_b")


def sync_models(registry: DataFrame, vendor: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Overwrite codes of a vendor's other models by those of ``model``; also ``model, changed`` of affected ones."""
    source = registry.filter((F.col("vendor") == vendor) & (F.col("model") == model)).select("code", F.struct("description", "severity", "component", "notes").alias("new"))
    now = F.struct("description", "severity", "component", "notes")
    joined = registry.join(source, "code", "left").withColumn("changes", (F.col("vendor") == vendor) & F.col("new").isNotNull() & ~F.col("new").eqNullSafe(now))
    pick = lambda c: F.when(F.col("changes"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    synced = joined.select("vendor", "model", "code", *[pick(c) for c in ("description", "severity", "component", "notes")])
    return synced, joined.filter("changes").groupBy("model").agg(F.count("*").alias("changed"))


def alias_apply(aliases: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply alias changes (``alias, canonical, kind`` add or remove, ``force``): the new table, and each ``action``.

    Adding is a no-op where the alias is there, a conflict where another canonical has it (a reassignment with
    ``force``), and an error without an alias, beyond 120 characters or for an unknown canonical. Canonical
    names can't be removed.
    """
    names = aliases.select("alias", F.col("canonical").alias("previous"))
    heads = aliases.select(F.lower("canonical").alias("head"), F.col("canonical").alias("head_name")).distinct()
    wanted = changes.select(F.lower(F.trim("alias")).alias("alias"), "canonical", "kind", "force").join(names, "alias", "left")
    wanted = wanted.join(heads, F.col("alias") == F.col("head"), "left").join(aliases.select(F.col("canonical").alias("k_canonical")).distinct(), F.col("canonical") == F.col("k_canonical"), "left")
    wanted = wanted.withColumn("previous", F.coalesce("previous", "head_name"))
    add = F.when((F.coalesce("alias", F.lit("")) == "") | (F.length("alias") > 120) | F.col("k_canonical").isNull(), "invalid").when(F.col("previous") == F.col("canonical"), "noop").when(F.col("previous").isNull(), "added").when(F.col("force"), "reassigned").otherwise("conflict")
    drop = F.when(F.col("head_name").isNotNull(), "refused").when(F.col("previous").isNull(), "noop").otherwise("removed")
    actions = wanted.withColumn("action", F.when(F.col("kind") == "add", add).otherwise(drop)).select("alias", "canonical", "kind", "previous", "action")
    gone = actions.filter("action IN ('reassigned', 'removed')").select("alias")
    new = actions.filter("action IN ('added', 'reassigned')").select("alias", "canonical")
    return aliases.select("alias", "canonical").join(gone, "alias", "left_anti").unionByName(new), actions


def models_by_slug(aliases: DataFrame) -> DataFrame:
    """``slug, names``: canonical names first, then by length and alphabet; names without a letter are left out."""
    rows = aliases.select(C.model_slug(F.col("canonical")).alias("slug"), F.col("alias").alias("name"), F.lit(1).alias("other"))
    rows = rows.union(aliases.select(C.model_slug(F.col("canonical")).alias("slug"), F.col("canonical").alias("name"), F.lit(0).alias("other")))
    rows = rows.filter(F.col("name").rlike(r"\p{L}")).groupBy("slug", "name").agg(F.min("other").alias("other"))
    order = F.struct("other", F.length("name").alias("size"), F.lower("name").alias("low"), "name")
    return rows.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]).alias("names"))


def registry_documents(registry: DataFrame) -> DataFrame:
    """Registry rows as searchable documents with a deterministic id."""
    text = F.concat_ws(" ", "code", F.concat(F.lit("("), "severity", F.lit(")")), "description", "component", "notes")
    return registry.select(F.substring(F.sha2(F.concat_ws("|", "vendor", "model", "code"), 256), 1, 32).alias("chunk_id"), "vendor", "model", F.array("code").alias("error_codes"), "severity", text.alias("text"))


def registry_counts(registry: DataFrame) -> DataFrame:
    """Codes and models of each vendor."""
    return registry.groupBy("vendor").agg(F.count("*").alias("codes"), F.count_distinct("model").alias("models"))
