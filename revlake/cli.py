"""Command line: compares the revision pairs of a folder of raw tables.

    spark-submit revlake/cli.py RAW [--pair ID] [--json DIR] [--csv DIR] [--annotations DIR] [--relevant-only] [--force]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from revlake.errors import RevisionError
from revlake.plans.compare import Comparison, compare
from revlake.sinks import annotations, write_csv, write_json
from revlake.sources.tables import RawTables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Compare revisions of structured documents given as raw tables.")
    p.add_argument("raw", help="folder with raw_documents, raw_pages, raw_spans, raw_drawings and raw_images")
    p.add_argument("--pair", action="append", help="only this pair; may be repeated")
    p.add_argument("--json", help="write nested JSON documents here")
    p.add_argument("--csv", help="write flat change lists here")
    p.add_argument("--annotations", help="write annotation boxes here, as Parquet")
    p.add_argument("--relevant-only", action="store_true", help="annotate changes relevant to inspection only")
    p.add_argument("--force", action="store_true", help="replace existing output")
    return p


def outputs(result: Comparison, args: argparse.Namespace) -> Iterator[tuple[str, Callable[[], None]]]:
    """The asked-for folders and what fills each."""
    if args.json:
        yield args.json, lambda: write_json(result, args.json, args.force)
    if args.csv:
        yield args.csv, lambda: write_csv(result.changes, args.csv, args.force)
    if args.annotations:
        yield args.annotations, lambda: annotations(result, args.relevant_only).write.mode("overwrite" if args.force else "errorifexists").parquet(args.annotations)


def overlaps(one: str, other: str) -> bool:
    """Whether one of two folders is, or lies in, the other."""
    a, b = (x.rstrip("/").removeprefix("file://") + "/" for x in (one, other))
    return a.startswith(b) or b.startswith(a)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("revlake").getOrCreate()
    said = lambda stage, _, message: print(f"[{stage}] {message}", file=sys.stderr)
    try:
        result = compare(RawTables.read(spark, args.raw, args.pair), progress=said)
        for folder, fill in outputs(result, args):
            if overlaps(folder, args.raw):
                raise ValueError(f"Output would replace its source: {folder}")
            fill()
    except (RevisionError, AnalysisException, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    lines = result.comparisons.select("pair_id", F.explode(F.concat(F.array(F.concat_ws(": ", "pair_id", "summary")), F.transform("notes", lambda n: F.concat(F.lit("note: "), n)))).alias("line"))
    for r in lines.orderBy("pair_id").toLocalIterator():
        print(r.line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
