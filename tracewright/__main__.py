"""Command line: python -m tracewright report|extract|scan|verify ...

report reads records as JSON lines and prints the combined report; extract reads a note and prints its dated mentions; scan
prints which detectors fire on which line of text files; verify walks an audit trail and prints counts.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewright.operators import audit, extract, report, sensitive
from tracewright.operators.matching import Matching, occurrences, unnested
from tracewright.sources import records as sources


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="tracewright", description=__doc__.split("\n")[0])
    verbs = made.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("report", help="combined report of records in JSON lines")
    one.add_argument("path")
    one.add_argument("--field", default="item")
    one.add_argument("--normalize", action="store_true")
    one.add_argument("--fuzzy", type=float, default=None)
    one = verbs.add_parser("extract", help="dated mentions of terms in text files, each a note")
    one.add_argument("path")
    one.add_argument("--term", action="append", required=True)
    one.add_argument("--shift", type=int, default=0)
    one = verbs.add_parser("scan", help="detectors that fire in text files")
    one.add_argument("path")
    one = verbs.add_parser("verify", help="audit trail in JSON lines")
    one.add_argument("path")
    return made


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    """What to print, and the exit code."""
    if args.verb == "report":
        matching = Matching(normalize=args.normalize, fuzzy_cutoff=args.fuzzy)
        return report.text(report.findings(occurrences(unnested(sources.json_lines(spark, args.path, args.field), args.field), matching))), 0
    files = spark.read.text(args.path, wholetext=True).select(F.col("_metadata.file_path").alias("note_id"), F.col("value").alias("text"))
    if args.verb == "extract":
        found = extract.entries(files, args.term, date_shift_days=args.shift)
        return "\n".join(r["line"] for r in found.orderBy("note_id", "source_span").select(extract.entry_line().alias("line")).toLocalIterator()), 0
    if args.verb == "scan":
        lines = files.select(F.col("note_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")
        rows = [f"{r['detector_id']} {r['path']}:{r['line']}" for r in sensitive.sorted_findings(sensitive.scan_lines(lines)).toLocalIterator()]
        return "\n".join(rows), int(bool(rows))
    trail = audit.read(spark, args.path)
    ok, bad = audit.first_bad(trail).first() or (True, None)
    return audit.summary_text(audit.summary(trail).collect()) + ("\nchain verified" if ok else f"\nchain broken at seq {bad}"), int(not ok)


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("tracewright").getOrCreate()
    text, code = run(spark, args)
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
