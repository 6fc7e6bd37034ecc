"""python -m tablewarden EVIDENCE_DIR: audit the evidence relations (Parquet) in a folder.

Options come from the command line, else from TABLEWARDEN_* variables, else from
the settings file.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .audit import audit
from .config import AuditError, resolve
from .evidence import Evidence
from .report import SEVERITIES
from .schemas import SCHEMAS
from .sources import snapshot


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tablewarden", description=__doc__)
    out.add_argument("evidence")
    for name, kind in (("config", {}), ("format", {}), ("fail-on", {"choices": list(SEVERITIES)}), ("runtime-report", {}), ("explain-runtime", {"action": "store_true", "default": None})):
        out.add_argument(f"--{name}", default=os.environ.get(f"TABLEWARDEN_{name.upper().replace('-', '_')}"), **{k: v for k, v in kind.items() if k != "default"})
    return out


def relations(spark: SparkSession, folder: str) -> dict:
    found = {}
    for name, schema in SCHEMAS.items():
        try:
            found[name] = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            continue  # a relation that the folder lacks is empty
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tablewarden").getOrCreate()
    given = {"output_format": args.format, "runtime_query_report_path": args.runtime_report, "explain_runtime_queries": args.explain_runtime}
    options = {k: v for k, v in given.items() if v is not None}
    try:
        config = resolve(options, args.config)
        known = relations(spark, args.evidence)
        plans = known.pop("plans", None)
        runtime = snapshot.load(spark, config.runtime_query_report_path) if config.runtime_query_report_path else None
        evidence = Evidence.of(spark, **{k: v for k, v in known.items() if k in Evidence.__dataclass_fields__})
        report = audit(evidence, options, runtime=runtime, plans=plans, config_path=args.config)
        print(report.render(config.output_format))
        return report.exit_status(args.fail_on)
    except AuditError as error:
        print(f"tablewarden: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
