"""Commands: ``python -m tallymark.cli report|scan|providers ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import codescan, metrics, reports
from .operators.scoring import FieldConfig
from .plans.experiment import rescore_or_keep, write_report
from .sources import readers, writers


def report(spark: SparkSession, source: str, out: str, config: dict | None = None, convert: str | None = None, force: bool = False) -> bool:
    """A report of a run or of legacy results: scored again if a config is given, written as a
    run if asked. False, and nothing done, if the report is there and not forced."""
    if not force and reports.read_text(spark, out) is not None:
        return False
    preds = readers.any_results(spark, source)
    if config:
        preds = rescore_or_keep(preds, FieldConfig.parse(config))
    if convert:
        docs = readers.first_documents(preds).select(F.col("document_id").alias("id"), "content", F.col("expected_value").alias("label"))
        writers.write_run(preds.drop("content"), docs, convert)
    write_report(preds, out)
    return True


def scan(spark: SparkSession, root: str, exclude: list[str], out: str | None = None) -> list[str]:
    """Lines on the model calls below a folder: counts, the files with most of them, the first ones."""
    hits = codescan.scan_calls(readers.code_files(spark, root, exclude)).cache()
    if out:
        writers.write_scan(hits, out)
    lines = [f"{r.key} {r.value}: {r.n}" for r in metrics.scan_counts(hits, ["provider", "library", "call_type"]).orderBy("key", F.desc("n"), "value").collect()]
    lines += [f"{r.file}: {r.n}" for r in codescan.top_files(hits).collect()]
    lines += [f"{r.file}:{r.line} {r.function} ({r.confidence})" for r in codescan.first_hits(hits).collect()]
    hits.unpersist()
    return lines


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallymark")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report")
    r.add_argument("source"), r.add_argument("out"), r.add_argument("--config"), r.add_argument("--convert"), r.add_argument("--force", action="store_true")
    s = sub.add_parser("scan")
    s.add_argument("root"), s.add_argument("--exclude", action="append", default=[]), s.add_argument("--out")
    sub.add_parser("providers")
    a = p.parse_args(argv)
    if a.command == "providers":
        print("\n".join(sorted({f"{c[0]} ({c[1]})" for c in (*codescan.CALLS, *codescan.ADDRESSES)})))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "report":
        print("written" if report(spark, a.source, a.out, json.loads(a.config) if a.config else None, a.convert, a.force) else "there already")
    else:
        print("\n".join(scan(spark, a.root, a.exclude, a.out)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
