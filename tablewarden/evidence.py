"""What the rules read: one lazy DataFrame for each evidence relation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import empty
from .workspace import saved


@dataclass(frozen=True)
class Evidence:
    """Relations by the names of `schemas.SCHEMAS`."""

    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    foreign_keys: DataFrame
    models: DataFrame
    reflections: DataFrame
    enums: DataFrame
    usages: DataFrame
    migrations: DataFrame
    search_path: DataFrame

    @staticmethod
    def of(spark: SparkSession, **known: DataFrame) -> Evidence:
        """Evidence of the relations given; the others are empty."""
        return Evidence(**{f.name: known.get(f.name, empty(spark, f.name)) for f in fields(Evidence)})

    def kept(self) -> Evidence:
        """Each relation written once: fourteen rules read them some fifty times, and their sizes are then known to Spark, which chooses joins by them."""
        names = [f.name for f in fields(self)]
        with ThreadPoolExecutor() as pool:  # jobs of a task or two, side by side
            return Evidence(**dict(zip(names, pool.map(lambda name: saved(getattr(self, name), name), names), strict=True)))

    def without(self, ignored: tuple[str, ...]) -> Evidence:
        """Without the catalog rows of ignored tables; findings that need no table stay."""
        keep = ~F.col("table_name").isin(list(ignored)) if ignored else F.lit(True)
        return Evidence(**{f.name: getattr(self, f.name).filter(keep) if f.name in ("tables", "columns", "indexes", "foreign_keys") else getattr(self, f.name) for f in fields(self)})
