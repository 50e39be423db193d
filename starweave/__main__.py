"""Run an import config: ``python -m starweave CONFIG.json --out DIR [options]``.

Reads the config document, loads each dataset (its ``Path`` or a ``--path name=location``
override), and writes the event log and, with ``--case-table``, the case table as Parquet
under ``--out``. The session comes from ``SparkSession.builder.getOrCreate()``, so on a
cluster it is the one the platform configures.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import eventlog
from .plans.names import with_derived_attributes, with_names
from .plans.spec import ImportSpec
from .sources.readers import load_sources
from .sources.sinks import write_log


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m starweave", description=__doc__.splitlines()[0])
    ap.add_argument("config", help="import config JSON file")
    ap.add_argument("--out", required=True, help="output folder (event_log/ and case_table/ below it)")
    ap.add_argument("--path", action="append", default=[], metavar="NAME=LOCATION",
                    help="dataset location override; repeatable")
    ap.add_argument("--format", default=None, choices=["parquet", "csv", "table"],
                    help="source format (default: the config's dataSourceFileType, else parquet)")
    ap.add_argument("--recursive", action="store_true", default=None,
                    help="read each location as a folder of files (default for config-named file formats)")
    ap.add_argument("--tiebreak", default="", help="comma-separated columns that complete the event order")
    ap.add_argument("--prefix", action="append", default=[], metavar="DATASET.KEY=PREFIX",
                    help="prefix of the columns reached through the edge of a key column; repeatable")
    ap.add_argument("--alias", action="append", default=[], metavar="DATASET[.KEY].COLUMN=NAME",
                    help="output name of a dataset's own column, or of one reached through the edge of KEY; repeatable")
    ap.add_argument("--case-table", action="store_true", help="also write the case table")
    ap.add_argument("--partition-by", default="", help="comma-separated event-log partition columns")
    ap.add_argument("--no-check-keys", action="store_true", help="allow duplicate join-target keys (fan-out)")
    ap.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite"])
    ap.add_argument("--explain", action="store_true",
                    help="print the formatted physical plans instead of writing anything")
    args = ap.parse_args(argv)

    with open(args.config, encoding="utf-8") as fh:
        doc = json.load(fh)
    paths = dict(p.split("=", 1) for p in args.path)
    tiebreak = tuple(c for c in args.tiebreak.split(",") if c)
    spec = ImportSpec.from_config(doc, tiebreak=tiebreak or None, check_keys=False if args.no_check_keys else None)
    if args.prefix or args.alias:
        prefixes = {tuple(k.split(".", 1)): v for k, v in (p.split("=", 1) for p in args.prefix)}
        named = [(k.split("."), v) for k, v in (a.split("=", 1) for a in args.alias)]
        spec = with_names(spec, prefixes, {(k[0], k[1] if len(k) > 2 else "", k[-1]): v for k, v in named})
        spec = with_derived_attributes(spec)
    spark = SparkSession.builder.appName("starweave-import").getOrCreate()
    sources = load_sources(spark, spec, paths, fmt=args.format, recursive=args.recursive)
    out = args.out.rstrip("/")
    partition_by = [c for c in args.partition_by.split(",") if c] or None
    log = eventlog.event_log(spec, sources)
    cases = eventlog.case_table(spec, sources) if args.case_table else None
    if args.explain:
        log.explain("formatted")
        if cases is not None:
            cases.explain("formatted")
        return 0
    write_log(log, f"{out}/event_log", partition_by=partition_by, mode=args.mode)
    if cases is not None:
        write_log(cases, f"{out}/case_table", mode=args.mode)
    return 0


if __name__ == "__main__":
    sys.exit(main())
