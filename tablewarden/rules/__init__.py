"""The audit's rules: functions of Evidence and Config that return findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..config import Config
from ..evidence import Evidence
from . import association, migration, query, schema

#: In the order of reports: association, schema, query patterns, migrations.
RULES = {**association.RULES, **schema.RULES, **query.RULES, **migration.RULES}


def findings(evidence: Evidence, config: Config = Config(), codes: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """Findings of all rules, or of those in `codes`, over the tables that aren't ignored."""
    shown = evidence.without(config.ignored_tables)
    return reduce(DataFrame.unionByName, [RULES[code](shown, config) for code in codes])
