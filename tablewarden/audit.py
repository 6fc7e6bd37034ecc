"""The audit as one call, from evidence to report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .config import AuditError, Config, resolve
from .evidence import Evidence
from .functions.names import canonicalised
from .functions.sqltext import explainable
from .operators.usages import all_usages
from .plans.explain import annotated
from .report import Report, suppressed
from .workspace import saved


def usages_of(evidence: Evidence, config: Config, runtime: DataFrame | None = None, plans: DataFrame | None = None) -> DataFrame:
    """Source usages of `evidence`, then runtime ones with their plans, with resolved table names."""
    merged = evidence.usages
    if config.explain_runtime_queries and runtime is None:
        raise AuditError("explain_runtime_queries needs a query snapshot")
    if runtime is not None:
        if config.explain_runtime_queries:
            if not runtime.filter(explainable(F.coalesce("explain_source", "source"))).limit(1).count():
                raise AuditError("no statement of the snapshot can be explained; capture with binds filled in")
            if plans is not None:
                runtime = annotated(runtime, plans)
        merged = all_usages(merged, runtime)
    known = evidence.tables.select("table_name").union(evidence.models.select("table_name"))
    return canonicalised(merged, known, evidence.search_path, ("table_name", "plan_relation_name"))


def audit(evidence: Evidence, options: Mapping[str, Any] | None = None, *, runtime: DataFrame | None = None, plans: DataFrame | None = None, config_path: str | None = None, root: str = ".") -> Report:
    """Run all rules over `evidence` and return the report, without suppressed findings."""
    config = resolve(options, config_path, root)
    given = evidence.kept()  # catalogs and counts, small next to the log
    whole = replace(given, usages=saved(usages_of(given, config, runtime, plans), "usages"))
    return Report(suppressed(rules.findings(whole, config), config.ignored_findings))
