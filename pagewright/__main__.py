"""Command line: ``python -m pagewright process|worker|check``.

Providers are named as ``module:object``; the object is called without arguments if it is a class.
"""

from __future__ import annotations

import argparse
import importlib
import json
import platform
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .plans import documents
from .plans.service import Service
from .sources import files


def provider(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def environment() -> dict:
    """What is installed; ``ok`` if Spark can run with Arrow."""
    found: dict = {"python": platform.python_version(), "java": shutil.which("java")}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            found[name] = importlib.import_module(name).__version__
        except ImportError:
            found[name] = None
    return found | {"ok": all(found.values())}


def process(spark: SparkSession, paths: list[str], out: str, reader, engine, config: EngineConfig) -> dict:
    """Files to JSON documents in ``out``; what was read, and what failed."""
    found = files.accept_uploads(spark.read.format("binaryFile").load(paths))
    named = found.select(F.col("file_hash").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")
    parsed = documents.parse(named, reader, engine, config)
    files.write_documents(parsed.documents, out)
    totals = documents.summary(files.read_documents(spark, out)).agg(F.count(F.lit(1)).alias("documents"), F.sum("total_pages").alias("pages"), F.sum("n_blocks").alias("blocks"), F.sum("n_tables").alias("tables")).first()
    return totals.asDict() | {"errors": [r.asDict() for r in parsed.errors.limit(100).collect()]}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("process", help="files to JSON documents")
    one.add_argument("paths", nargs="+")
    one.add_argument("--out", required=True)
    two = commands.add_parser("worker", help="work through the queue of a service")
    two.add_argument("--root", required=True)
    two.add_argument("--until-empty", action="store_true")
    for p in (one, two):
        p.add_argument("--reader", required=True)
        p.add_argument("--engine")
    commands.add_parser("check", help="show what is installed")
    args = parser.parse_args(argv)
    if args.command == "check":
        found = environment()
        print(json.dumps(found))
        return 0 if found["ok"] else 1
    spark, config = SparkSession.builder.getOrCreate(), EngineConfig.from_env()
    reader, engine = provider(args.reader), provider(args.engine)
    if args.command == "process":
        result = process(spark, args.paths, args.out, reader, engine, config)
    else:
        result = {"jobs": Service(spark, args.root, reader, engine, config=config).run_worker(idle_seconds=config.worker_interval_s, until_empty=args.until_empty)}
    print(json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
