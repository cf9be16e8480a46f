"""Redaction: PII policy from annotated DDL and masking of result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
MASK = "‹redacted›"
PII_MARKER = r"(?i)\bPII\b(?!-)"


def policy_from_ddl(ddl_lines: DataFrame, text_col: str = "line") -> DataFrame:
    """(db_id, pii_column) from DDL lines whose ``--`` comment says PII (not PII-adjacent)."""
    code = F.substring_index(F.col(text_col), "--", 1)
    has_comment = F.instr(F.col(text_col), "--") > 0
    comment = F.expr(f"substr({text_col}, instr({text_col}, '--') + 2)")
    first = F.regexp_extract(code, r"^\s*(\S+)", 1)
    name = F.lower(F.regexp_replace(F.trim(first), '^"+|"+$', ""))
    return (
        ddl_lines.filter(has_comment & comment.rlike(PII_MARKER) & (first != ""))
        .select("db_id", name.alias("pii_column"))
        .distinct()
    )


def pii_columns(df: DataFrame, policy: set[str]) -> list[str]:
    """Output columns whose normalized name is in the policy (schema only, no data)."""
    norm = {p.strip().strip('"').lower() for p in policy}
    return [c for c in df.columns if c.strip().strip('"').lower() in norm]


def redact(df: DataFrame, policy: set[str]) -> DataFrame:
    """D3: a new frame with PII values masked; NULL stays NULL; the raw frame is untouched."""
    hidden = set(pii_columns(df, policy))
    return df.select(
        *[
            (F.when(F.col(f"`{c}`").isNotNull(), F.lit(MASK)).alias(c) if c in hidden else F.col(f"`{c}`"))
            for c in df.columns
        ]
    )
