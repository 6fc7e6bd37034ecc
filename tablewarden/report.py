"""Findings as a report: suppression, order, counts, text, JSON and exit status."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FORMATS, RULE_KEYS, one_of

#: Ranks of severities, and the version of the report's layout.
SEVERITIES = {"low": 1, "medium": 2, "high": 3}
SCHEMA_VERSION = 1
NAME, VERSION = "tablewarden", "0.1.0"
_COLUMN = {"code": "code", "column": "column_name", "model": "model", "severity": "severity", "table": "table_name"}


def rank() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), F.col("severity"))


def suppressed(findings: DataFrame, rules: tuple[Mapping[str, str], ...]) -> DataFrame:
    """Without the findings that agree with all keys of some rule; null is like ''."""
    if not rules:
        return findings
    side = findings.sparkSession.createDataFrame([[r.get(k) for k in RULE_KEYS] for r in rules], ", ".join(f"__{k} string" for k in RULE_KEYS))
    agree = F.lit(True)
    for key in RULE_KEYS:
        agree = agree & (F.col(f"__{key}").isNull() | (F.coalesce(_COLUMN[key], F.lit("")) == F.col(f"__{key}")))
    return findings.join(side, agree, "left_anti")  # rules come from a settings file


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then by code, table and column; model and evidence break ties."""
    blank = lambda name: F.coalesce(name, F.lit(""))
    return findings.orderBy(rank().desc(), "code", blank("table_name"), blank("column_name"), blank("model"), blank("evidence"))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def fails(findings: DataFrame, threshold: str) -> bool:
    least = SEVERITIES[one_of("severity", threshold, tuple(SEVERITIES))]
    return bool(findings.filter(rank() >= least).limit(1).count())


def rendered_lines(findings: DataFrame) -> DataFrame:
    """`findings` with `body`, the text of each."""
    line = lambda name, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(col, "\n", "\n  ")))
    head = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("code"), F.lit(" - "), F.col("title"))
    parts = [line(name, col) for name, col in (("model", "model"), ("table", "table_name"), ("column", "column_name"), ("problem", "problem"), ("recommendation", "recommendation"), ("evidence", "evidence"))]
    return findings.withColumn("body", F.concat_ws("\n", head, *parts))


def metadata(version: int = SCHEMA_VERSION, **more) -> dict:
    return {"schema_version": version, "generator": {"name": NAME, "version": VERSION}} | more


class Report:
    """A finished audit.  Findings are few next to the evidence; rendering brings them to the driver."""

    def __init__(self, findings: DataFrame):
        self.findings = findings

    def as_json(self) -> dict:
        rows = [r.asDict() for r in ordered(self.findings).collect()]
        tally = {s: sum(r["severity"] == s for r in rows) for s in sorted(SEVERITIES, key=SEVERITIES.get, reverse=True)}
        rename = {"table_name": "table", "column_name": "column"}
        items = [{rename.get(k, k): (json.loads(v) if k == "details" and v else v) for k, v in r.items()} for r in rows]
        return {"metadata": metadata(), "counts": {k: n for k, n in tally.items() if n}, "findings": items}

    def as_text(self) -> str:
        bodies = [r["body"] for r in ordered(rendered_lines(self.findings)).select("body").collect()]
        return "\n\n".join(bodies) if bodies else "No findings."

    def render(self, form: str = "text") -> str:
        return json.dumps(self.as_json(), indent=2) if one_of("format", form, FORMATS) == "json" else self.as_text()

    def exit_status(self, threshold: str | None = None) -> int:
        return int(threshold is not None and fails(self.findings, threshold))


def severity_ranks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITIES.items()), "severity string, rank int")
