"""Scalar functions of the model as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (
    CODE, CODE_PATTERNS, CODE_PREFIX, COMPONENTS, DASHED_CODE, ISO_FORMATS, NO_VALUE, PERSONAL, SEVERITY_WORDS, SLUG_PREFIXES, TIMESTAMP_FORMATS, UNIX_LEAST, Weights,
)


def text_or_null(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def usable(c: Column) -> Column:
    """Trimmed text; blank and words for a missing value become null."""
    value = F.trim(c)
    return F.when(~F.lower(value).isin(*NO_VALUE), value)


def is_unix(c: Column) -> Column:
    """True where the text is a number beyond UNIX_LEAST."""
    return F.coalesce(F.trim(c).try_cast("double") > UNIX_LEAST, F.lit(False))


def parse_ts(c: Column) -> Column:
    """A timestamp from text: Unix seconds, then the fixed formats in order, then ISO forms; else null.

    What stands behind the first number tells the forms apart: it is looked up once, and only formats with that
    mark are tried. Text without an offset is UTC (the session's time zone must be UTC).
    """
    s = F.trim(c)
    mark = F.regexp_extract(s, r"^[+-]?[0-9]+([./-])", 1)
    by_mark: dict[str, list[Column]] = {}
    for f in (*TIMESTAMP_FORMATS, *ISO_FORMATS):
        by_mark.setdefault(f.lstrip("dMy")[0], []).append(F.try_to_timestamp(s, F.lit(f)))
    seconds = F.timestamp_micros(F.round(s.try_cast("double") * 1_000_000).cast("long"))
    marks = F.array(*[F.lit(m) for m in by_mark])
    # One number per form, so that the text is classified once however many formats there are.
    form = F.when(is_unix(s), 0).otherwise(F.nullif(F.array_position(marks, mark), F.lit(0)))
    out = F.when(form == 0, seconds)
    for n, tries in enumerate(by_mark.values(), 1):
        out = out.when(form == n, F.coalesce(*tries))
    return out


def norm_code(c: Column, lenient: bool = False) -> Column:
    """The error code in a text, or null.

    A code ``NN-NNN-NN`` anywhere wins. Otherwise brackets, a leading word for "error", blanks and hyphens go,
    and the upper-cased rest must be a code as a whole. ``lenient`` also reads ``NN NNN NN`` and ``NN_NNN_NN``.
    """
    s = F.trim(F.regexp_replace(c, r"\b(\d{2})[ _](\d{3})[ _](\d{2})\b", "$1-$2-$3") if lenient else c)
    dashed = F.nullif(F.regexp_extract(s, DASHED_CODE, 0), F.lit(""))
    rest = F.trim(F.regexp_replace(s, r"\(.*?\)", ""))
    rest = F.upper(F.regexp_replace(F.trim(F.regexp_replace(rest, CODE_PREFIX, "")), r"[\s\-]+", ""))
    return F.coalesce(dashed, F.when(rest.rlike(CODE), rest))


def coerce_level(c: Column, multiplier: Column | float = 1.0) -> Column:
    """A percentage: number times multiplier, rounded half to even, within 0..100; bad numbers are null."""
    number = F.trim(c).try_cast("double")
    number = F.when(~F.isnan(number), number)
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(number * multiplier, 0)))
    return F.when(number.isNotNull(), percent).cast("int")


def coerce_count(c: Column) -> Column:
    """A whole number, rounded half to even; bad numbers are null."""
    number = F.trim(c).try_cast("double")
    return F.when(~F.isnan(number), F.bround(number, 0)).cast("long")


def coerce_severity(c: Column) -> Column:
    """The severity a word means, in any case; other words are null."""
    words = F.create_map(*[F.lit(x) for kv in SEVERITY_WORDS.items() for x in kv])
    return F.try_element_at(words, F.lower(F.trim(c)))


def vendor_slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def model_slug(canonical: Column) -> Column:
    """A slug of a canonical model name, without its vendor's name."""
    prefix = "^(?:" + "|".join(SLUG_PREFIXES) + ")"
    return vendor_slug(F.regexp_replace(F.lower(F.trim(F.coalesce(canonical, F.lit("")))), prefix, ""))


def weight_s(severity: Column, w: Weights) -> Column:
    """Weight of a severity; an unknown one counts as Medium."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in w.severity.items() for x in kv]), severity), F.lit(w.severity["Medium"]))


def coef_r(n: Column, w: Weights) -> Column:
    """1 up to one repetition, then 1 + log n, at most the profile's largest."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.least(F.lit(float(w.repeat_max)), 1 + F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(float(w.repeat_base)))))


def coef_c(multipliers: Column, w: Weights) -> Column:
    """Product of the multipliers, at most the profile's largest; none gives 1."""
    return F.least(F.lit(float(w.context_max)), F.aggregate(multipliers, F.lit(1.0), lambda a, x: a * x))


def age_days(ts: Column, ref: Column) -> Column:
    """Whole 24-hour periods from ``ts`` to ``ref``, at least 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(ref) - F.unix_micros(ts)) / F.lit(86_400_000_000)))


def coef_a(age: Column, w: Weights) -> Column:
    return F.exp(-age.cast("double") / F.lit(float(w.age_tau)))


def zone(index: Column, w: Weights) -> Column:
    return F.when(index >= w.green, "green").when(index >= w.red, "yellow").otherwise("red")


def confidence_zone(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.60, "medium").otherwise("low")


def clean_text(c: Column) -> Column:
    """Words joined over a hyphenated line end, runs of blanks and control characters as one space, at most one empty line.

    Unicode composition is a separate step (``docs.compose``), as Spark has no built-in for it.
    """
    s = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    s = F.regexp_replace(s, "(?U)[^\\S\\n]{2,}|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def codes_in(c: Column, vendor: str | None = None) -> Column:
    """All codes of a vendor's and the generic patterns in a text: upper case, distinct, sorted."""
    patterns = [*CODE_PATTERNS.get((vendor or "generic").lower(), ()), *CODE_PATTERNS["generic"]]
    found = [F.regexp_extract_all(c, F.lit(p.replace("\\d", "[0-9]")), F.lit(0)) for p in dict.fromkeys(patterns)]
    return F.array_sort(F.array_distinct(F.transform(reduce(F.concat, found), lambda x: F.upper(x))))


def components_in(c: Column, vocabulary: dict[str, tuple[str, ...]] = COMPONENTS) -> Column:
    """Components that a text names, sorted.

    The text is bound to a variable, so that it is made and lower-cased once and not for each name.
    """

    def named(low: Column) -> Column:
        return F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(n) for n in _shortest({n.lower() for n in (name, *synonyms)})]), F.lit(name)) for name, synonyms in vocabulary.items()])

    return F.array_sort(F.array_compact(F.transform(F.array(F.lower(c)), named)[0]))


def _shortest(names: set[str]) -> list[str]:
    """Names without those that hold another: where they stand, the other does."""
    return sorted(n for n in names if not any(o != n and o in n for o in names))


def redact_personal(c: Column, patterns: tuple[tuple[str, ...], ...] = PERSONAL) -> Column:
    """Matches of each pattern replaced; with a third value, which every match holds, only texts that hold it are searched."""
    out = c
    for pattern, by, *held in patterns:
        found = F.regexp_replace(out, pattern, by)
        out = F.when(c.contains(held[0]), found).otherwise(out) if held else found
    return out
