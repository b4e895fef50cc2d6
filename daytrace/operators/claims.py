"""Checks on written claims: grounded numbers, allowed words, resolvable evidence."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import catalog

# How close a number must be, and the limits of the policy.
RELATIVE, ABSOLUTE = 0.02, 0.005
SCORE_BAND, LOW_COVERAGE, HIGH_UNKNOWN, LOW_CONFIDENCE = 15, 0.6, 0.3, 0.7


def document_numbers(doc: Column) -> Column:
    """Every number of a JSON text, at any depth, as an array of doubles in document order.

    Keys, texts, true, false and null are no numbers.  Escaped characters go first, then whatever stands in quotes;
    what is left of a valid text holds its numbers alone.  Null texts and such
    that no JSON value begins have none.
    """
    bare = F.regexp_replace(F.regexp_replace(doc, r"(?s)\\.", ""), r'(?s)"[^"]*"', "")
    found = F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    none = F.array().cast("array<double>")
    return F.when(F.try_parse_json(doc).isNotNull(), found.cast("array<double>")).otherwise(none)


@cache
def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode but 0 to 9, and their values."""
    every = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(every), "".join(str(unicodedata.decimal(c)) for c in every)


def plain_digits(text: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    return F.when(text.rlike(r"(?U)[^\P{Nd}0-9]"), F.translate(text, *_digits())).otherwise(text)


def numbers_grounded(text: Column, context: Column) -> Column:
    """Whether every number in the text is near some number of the context array.  A number
    with a percent sign may match as given or as a fraction; digits may be of any script."""
    found = F.regexp_extract_all(plain_digits(text), F.lit(f"({catalog.NUMBER})"), F.lit(1))

    def near(value: Column) -> Column:
        return F.exists(
            context,
            lambda c: F.abs(value - c) <= F.greatest(F.abs(c) * RELATIVE, F.lit(ABSOLUTE)),
        )

    def ok(raw: Column) -> Column:
        value = F.rtrim(raw, F.lit("%")).cast("double")
        return near(value) | (F.endswith(raw, F.lit("%")) & near(value / 100))

    return F.forall(found, ok)


def has_rejected_term(text: Column) -> Column:
    return text.rlike(r"(?iU)\b(" + "|".join(catalog.REJECTED_TERMS) + r")\b")


def path_resolves(doc: Column, path: Column) -> Column:
    """Whether a dotted or bracketed path exists in a JSON text.  A present null counts, so the
    last step is looked up among its parent's keys or positions."""
    step = r"(\.?[^.\[\]]+|\[\d+\])$"
    last = F.regexp_extract(path, step, 1)
    parent_path = F.regexp_replace(path, step, "")
    parent = F.when(parent_path == "", doc).otherwise(
        F.call_function("get_json_object", doc, F.concat(F.lit("$."), parent_path))
    )
    index = F.regexp_extract(last, r"\[(\d+)\]", 1)
    in_list = F.json_array_length(parent) > index.try_cast("int")
    in_keys = F.array_contains(F.json_object_keys(parent), F.regexp_replace(last, r"^\.", ""))
    hit = F.when(F.startswith(last, F.lit("[")), in_list).otherwise(in_keys)
    return F.coalesce((last != "") & hit, F.lit(False))


def is_derived(path: Column) -> Column:
    out = F.lit(False)
    for p in catalog.DERIVED_PREFIXES:
        out = out | (path == p) | F.startswith(path, F.lit(p + ".")) | F.startswith(path, F.lit(p + "["))
    return out


def check_claims(claims: DataFrame) -> DataFrame:
    """Validate claims next to their context.

    Needs doc (JSON text), claim, narrative, evidence (paths), epistemic_status, confidence,
    coverage_ratio, unknown_ratio.  Numbers must be grounded in those of the whole document.  Adds ``kept``
    and the adjusted status and confidence.
    """
    claims = claims.withColumn("_numbers", document_numbers(F.col("doc")))
    resolved = F.forall("evidence", lambda p: path_resolves(F.col("doc"), p))
    grounded = numbers_grounded(F.col("claim"), F.col("_numbers")) & numbers_grounded(
        F.col("narrative"), F.col("_numbers")
    )
    rejected = has_rejected_term(F.col("claim")) | has_rejected_term(F.col("narrative"))
    only_derived = F.forall("evidence", is_derived)
    poor = (F.col("coverage_ratio") < LOW_COVERAGE) | (F.col("unknown_ratio") > HIGH_UNKNOWN)
    return claims.withColumns(
        {
            "kept": resolved & grounded & ~rejected,
            "epistemic_status": F.when(
                (F.col("epistemic_status") == "FACT") & only_derived, "INFERENCE"
            ).otherwise(F.col("epistemic_status")),
            "confidence": F.when(
                poor, F.least("confidence", F.lit(LOW_CONFIDENCE))
            ).otherwise(F.col("confidence")),
        }
    ).drop("_numbers")


def analysis_status(checked: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per analysis: claims kept, the score unless it left the reference band, and whether the
    result is whole or partial.  ``scores``: keys, day_score, reference_score."""
    counts = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("kept").alias("kept")
    )
    off = F.abs(F.col("day_score") - F.col("reference_score")) > SCORE_BAND
    return scores.join(counts, keys).select(
        *keys,
        "claims",
        "kept",
        F.when(~off, F.col("day_score")).alias("day_score"),
        F.when(off | (F.col("kept") < F.col("claims")), "partial").otherwise("ok").alias("status"),
    )
