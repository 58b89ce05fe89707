"""Checks of requests and of rows to be saved: lengths, words of a list, ranges.

A form names the checks of its fields; ``checked`` adds ``valid`` and ``error``, the first
fault in the order of the form, as one projection of built-in expressions. A field that
is no column counts as null; a null is a fault where the field is required, else its
default holds. Lengths are code points, as in ``length``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """``least`` and ``most`` bound a text's or array's length or a number; ``words`` are all that a text may be."""

    name: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    words: tuple[str, ...] = ()
    number: bool = False


LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
DIRECTIONS = ("input", "output")
SCOPES = (*DIRECTIONS, "both")

#: Fixed values. What requests and saved rows must fulfil.
TEXT = Field("text", True, 1, 100_000)
PROFILE = Field("policy_profile", False, 1, 100)
WORKSPACE = Field("workspace_id", False, 1, 100)
PATTERN_ROW = (Field("severity", True, words=LEVELS), Field("scope", words=SCOPES))
FORMS: dict[str, tuple[Field, ...]] = {
    "analyze": (TEXT, PROFILE, WORKSPACE),
    "redact": (TEXT,),
    "interaction": (Field("prompt_text", True, 1, 100_000), Field("output_text", True, 1, 100_000), PROFILE, WORKSPACE),
    "document": (Field("filename", True, 1, 300), Field("content_base64", True, 1), Field("scan_target", words=DIRECTIONS), PROFILE, WORKSPACE),
    "batch": (Field("texts", True, 1, 20), Field("scan_target", words=DIRECTIONS), PROFILE, WORKSPACE),
    "feedback": (Field("audit_log_id", True), Field("feedback_type", True)),
    "rule": (Field("name", True, 1, 100), Field("pattern", True, 1, 500), Field("description", True, 1, 200), *PATTERN_ROW, Field("threat_type", False, 1, 50), WORKSPACE),
    "review": (Field("review_status", True, words=("pending", "reviewed_true_positive", "reviewed_false_positive", "reviewed_false_negative", "dismissed")), Field("review_assignee", most=200), Field("review_notes", most=500)),
    "preset": (
        Field("name", True, 1, 100),
        Field("description", most=300),
        Field("session_flag_threshold", least=0, most=100, number=True),
        Field("session_block_threshold", least=0, most=100, number=True),
        Field("allowlist_max_severity", words=("NONE", *LEVELS)),
        WORKSPACE,
    ),
    "promotion": (Field("note", most=500), WORKSPACE),
    "approval": (Field("actor", True, 1, 200), WORKSPACE),
    "workspace": (Field("name", True, 1, 100), Field("description", most=300), Field("owner", most=200)),
    "signature": (Field("name", True, 1, 200), Field("pattern", True, 1, 1000), Field("category", False, 1, 100), Field("severity", words=LEVELS), Field("scope", words=SCOPES), Field("description", most=500), Field("source", most=200)),
    "sync": (Field("url", True, 8, 1000), Field("timeout_seconds", least=1, most=30, number=True)),
}


def fault(field: Field, rows: DataFrame) -> Column:
    """What is wrong with a field of a row, null if nothing is."""
    said = lambda what: F.lit(f"{field.name} {what}")
    if field.name not in rows.columns:
        return said("is missing") if field.required else F.lit(None).cast("string")
    value = F.col(field.name)
    kind = rows.schema[field.name].dataType.typeName()
    size = value.cast("double") if field.number else F.size(value) if kind == "array" else F.length(value)
    out = F.when(value.isNull(), said("is missing") if field.required else F.lit(None))
    if field.words:
        out = out.when(~value.isin(*field.words), said("must be one of " + ", ".join(field.words)))
    unit = "" if field.number else " entries" if kind == "array" else " characters"
    if field.least is not None:
        out = out.when((size < field.least) | size.isNull(), said(f"must be at least {field.least:g}{unit}" if field.number else f"must have at least {field.least:g}{unit}"))
    if field.most is not None:
        # NaN is above every number
        out = out.when(size > field.most, said(f"must be at most {field.most:g}{unit}" if field.number else f"must have at most {field.most:g}{unit}"))
    return out


def checked(rows: DataFrame, form: str) -> DataFrame:
    """Adds ``valid`` and ``error`` by the checks of a form."""
    d = rows.withColumn("error", F.coalesce(*[fault(f, rows) for f in FORMS[form]]))
    return d.withColumn("valid", F.col("error").isNull())
