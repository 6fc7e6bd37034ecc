"""The shape of a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import columns


def finding(rows: DataFrame, *, code: str, title: str, severity: str | Column, problem: Column | str, recommendation: Column | str, evidence: Column, model: Column | None = None, table: Column | None = None, column: Column | None = None, details: Column | None = None) -> DataFrame:
    """One finding for each row; what is None is null."""
    value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    fields = {"severity": severity, "code": code, "title": title, "model": model, "table_name": table, "column_name": column, "problem": problem, "recommendation": recommendation, "evidence": evidence, "details": details}
    return rows.select(*[value(fields[name]).alias(name) for name in columns("findings")])


def text(*parts: Column | str) -> Column:
    """Parts in one string; null parts are empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
