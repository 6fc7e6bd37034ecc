"""Rules over changes that migrations make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..evidence import Evidence
from .association import with_column
from .common import finding, text


def reference_without_key(e: Evidence, config: Config) -> DataFrame:
    rows = with_column(e.migrations.join(e.tables.select("table_name"), "table_name", "left_semi"), e.columns, "column_name")
    keys = e.foreign_keys.select(F.col("table_name").alias("__t"), F.col("columns").alias("__c"))
    rows = rows.join(keys, (F.col("table_name") == F.col("__t")) & (F.array("column_name") == F.col("__c")), "left_anti")
    return finding(
        rows, code="migration_reference_without_foreign_key", severity="high", title="Migration adds a reference without a foreign key", table=F.col("table_name"), column=F.col("column_name"),
        problem=text("A migration added ", F.col("table_name"), ".", F.col("column_name"), " and no foreign key covers it."), recommendation=text("Add a foreign key on ", F.col("column_name"), "."),
        evidence=text(F.col("path"), ":", F.col("line"), " ", F.col("source")),
    )


RULES = {"migration_reference_without_foreign_key": reference_without_key}
