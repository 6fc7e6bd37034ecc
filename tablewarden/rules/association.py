"""Rules over models and their associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..evidence import Evidence
from ..functions.names import singular
from ..operators.indexes import without_prefix
from .common import finding, text

IS_TRUE = ("true", "t", "1")


def belongs_to(reflections: DataFrame, polymorphic: bool) -> DataFrame:
    return reflections.filter((F.col("macro") == "belongs_to") & (F.coalesce("polymorphic", F.lit(False)) == polymorphic))


def with_column(rows: DataFrame, columns: DataFrame, column: str) -> DataFrame:
    """Rows whose table has the column that they name in `column`."""
    side = columns.select(F.col("table_name").alias("__t"), F.col("column_name").alias("__c"))
    return rows.join(side, (F.col("table_name") == F.col("__t")) & (F.col(column) == F.col("__c")), "left_semi")


def expected_key() -> Column:
    return F.coalesce(F.nullif("association_primary_key", F.lit("")), F.lit("id"))


def named() -> Column:
    return text(F.col("model"), " ", F.col("macro"), " ", F.col("name"))


def missing_index(e: Evidence, config: Config) -> DataFrame:
    rows = with_column(belongs_to(e.reflections, False).join(e.tables.select("table_name"), "table_name", "left_semi"), e.columns, "foreign_key")
    rows = without_prefix(rows, e.indexes, F.array("foreign_key"))
    return finding(
        rows, code="missing_belongs_to_index", severity="high", title="Association column without an index", model=F.col("model"), table=F.col("table_name"), column=F.col("foreign_key"),
        problem=text("No index of ", F.col("table_name"), " begins with ", F.col("foreign_key"), ", the column of an association."),
        recommendation=text("add_index :", F.col("table_name"), ", :", F.col("foreign_key")), evidence=named(),
    )


def constraint_advice() -> Column:
    """add_foreign_key with the options that differ from the defaults."""
    column = F.when(F.col("foreign_key") != F.concat(singular(F.col("target_table")), F.lit("_id")), F.concat(F.lit("column: :"), F.col("foreign_key")))
    key = F.when(expected_key() != "id", F.concat(F.lit("primary_key: :"), F.col("association_primary_key")))
    return F.concat_ws(", ", text("add_foreign_key :", F.col("table_name"), ", :", F.col("target_table")), column, key)


def missing_constraint(e: Evidence, config: Config) -> DataFrame:
    rows = with_column(belongs_to(e.reflections, False).join(e.tables.select("table_name"), "table_name", "left_semi"), e.columns, "foreign_key")
    keys = e.foreign_keys.select(F.col("table_name").alias("__t"), F.col("columns").alias("__c"), F.col("to_table").alias("__to"), F.coalesce("primary_key", F.lit("")).alias("__pk"))
    met = (F.col("table_name") == F.col("__t")) & (F.array("foreign_key") == F.col("__c")) & (F.col("target_table") == F.col("__to")) & (expected_key() == F.col("__pk"))
    return finding(
        rows.join(keys, met, "left_anti"), code="missing_foreign_key_constraint", severity="high", title="Association without a foreign key", model=F.col("model"), table=F.col("table_name"), column=F.col("foreign_key"),
        problem=text("The database doesn't check that ", F.col("table_name"), ".", F.col("foreign_key"), " refers to a row of ", F.col("target_table"), "."),
        recommendation=constraint_advice(), evidence=named(),
    )


def missing_polymorphic(e: Evidence, config: Config) -> DataFrame:
    rows = with_column(with_column(belongs_to(e.reflections, True).join(e.tables.select("table_name"), "table_name", "left_semi"), e.columns, "foreign_key"), e.columns, "foreign_type")
    rows = without_prefix(rows, e.indexes, F.array("foreign_type", "foreign_key"), F.array("foreign_key", "foreign_type"))
    return finding(
        rows, code="missing_polymorphic_composite_index", severity="high", title="Polymorphic association without a composite index", model=F.col("model"), table=F.col("table_name"),
        column=F.concat_ws(", ", "foreign_type", "foreign_key"), problem=text("Lookups in ", F.col("table_name"), " by type and id have no index over both columns."),
        recommendation=text("add_index :", F.col("table_name"), ", [:", F.col("foreign_type"), ", :", F.col("foreign_key"), "]"), evidence=text(named(), " (polymorphic)"),
    )


def destroying() -> Column:
    return (F.col("macro") == "has_many") & (F.coalesce(F.col("options")["dependent"], F.lit("")) == "destroy")


def broad_destroy(e: Evidence, config: Config) -> DataFrame:
    children = e.tables.filter(F.col("estimated_row_count") >= config.dependent_destroy_row_threshold).select(F.col("table_name").alias("__child"), "estimated_row_count")
    rows = e.reflections.filter(destroying()).join(children, F.col("target_table") == F.col("__child"))
    details = F.to_json(F.struct(F.col("estimated_row_count"), F.lit(config.dependent_destroy_row_threshold).cast("bigint").alias("row_threshold"), F.lit("estimate").alias("evidence_source")))
    return finding(
        rows, code="broad_dependent_destroy", severity="medium", title="Row-by-row destruction of a large table", model=F.col("model"), table=F.col("table_name"),
        problem=text("Destroying one row loads and destroys each of its rows in ", F.col("target_table"), "."), recommendation="Use delete_all, a cascading foreign key or a background job.",
        evidence=text(named(), " -> ", F.col("target_table"), ", about ", F.col("estimated_row_count"), " rows"), details=details,
    )


def default_scope(e: Evidence, config: Config) -> DataFrame:
    return finding(
        e.models.filter("default_scope_count > 0"), code="default_scope", severity="medium", title="Model with a default scope", model=F.col("model"), table=F.col("table_name"),
        problem="Every query of the model carries conditions that its callers don't see.", recommendation="Use named scopes.", evidence=text(F.col("default_scope_count"), " default scope(s)"),
    )


def missing_inverse(e: Evidence, config: Config) -> DataFrame:
    option = lambda key: F.coalesce(F.col("options")[key], F.lit(""))
    matters = (F.col("macro") == "has_many") & (F.lower(option("autosave")).isin(*IS_TRUE) | (option("dependent") == "destroy"))
    known = F.coalesce(F.map_contains_key("options", F.lit("inverse_of")), F.lit(False)) | F.col("inverse_name").isNotNull()
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("options", lambda k, v: k.isin("autosave", "dependent"))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ", ")
    return finding(
        e.reflections.filter(matters & ~known), code="missing_inverse_of", severity="medium", title="Association without a known inverse", model=F.col("model"), table=F.col("table_name"),
        problem="Saving or destroying through the association may load the same rows again.", recommendation=text("Set inverse_of on ", F.col("name"), "."), evidence=text(named(), " (", shown, ")"),
    )


RULES = {
    "missing_belongs_to_index": missing_index, "missing_foreign_key_constraint": missing_constraint, "missing_polymorphic_composite_index": missing_polymorphic,
    "broad_dependent_destroy": broad_destroy, "default_scope": default_scope, "missing_inverse_of": missing_inverse,
}
