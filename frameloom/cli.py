"""Command line: python -m frameloom.cli (stats|stack|stretch|rgb) [-flag value ...] files...

Also run -job file, serve -port n, legal, version and help.  The plan is logged as a job document that
``run`` accepts.
"""

from __future__ import annotations

import argparse
import contextlib
import cProfile
import json
import logging
import os
import sys
import tracemalloc

from pyspark.sql import SparkSession

from .plans import job, presets

VERSION = "0.1.0"
COMMANDS = ("stats", "stack", "stretch", "rgb", "run", "serve", "legal", "version", "help", "?")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="frameloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, allow_abbrev=False)
    p.add_argument("command", choices=COMMANDS)
    for name, default in presets.FLAGS.items():
        p.add_argument(f"-{name}", f"--{name}", dest=name, type=type(default), default=default, help=f"default {default!r}")
    p.add_argument("files", nargs="*")
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("frameloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()


def execute(spark: SparkSession, plan: job.Op, base: str, out: str, estimator: int = 1) -> job.PipelineState:
    logging.getLogger("frameloom").info("plan: %s", json.dumps(plan.to_json()))
    return plan.run(job.PipelineState(spark, base, out, estimator))


@contextlib.contextmanager
def profiled(cpu: str, memory: str):
    """Write a profile of the driver's Python and of its memory to the files named."""
    profile = cProfile.Profile() if cpu else None
    if profile:
        profile.enable()
    if memory:
        tracemalloc.start()
    try:
        yield
    finally:
        if profile:
            profile.disable()
            profile.dump_stats(cpu)
        if memory:
            tracemalloc.take_snapshot().dump(memory)
            tracemalloc.stop()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_intermixed_args(argv)
    refused = [k for k in presets.REFUSED if getattr(args, k) != presets.FLAGS[k]]
    if refused:
        raise SystemExit(f"not supported here: {', '.join('-' + k for k in refused)}")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    log = presets.auto_name(args.log, args.out, ".log")
    if log and args.command in ("stats", "stack", "stretch", "rgb", "run"):
        handlers.append(logging.FileHandler(log, encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", handlers=handlers, force=True)
    with profiled(args.cpuprofile, args.memprofile):
        return run(args)


def run(args: argparse.Namespace) -> int:
    if args.command == "version":
        print(VERSION)
    elif args.command == "legal":
        print("frameloom is built on Apache Spark (Apache License 2.0), numpy, pandas and Apache Arrow.")
    elif args.command in ("help", "?"):
        parser().print_help()
    elif args.command == "serve":
        from . import rest

        rest.serve(session(), os.getcwd(), args.port)
    else:
        here = os.getcwd()
        if args.command == "run":
            with open(args.job, encoding="utf-8") as f:
                plan = job.from_json(json.load(f))
        else:
            flags = {k: getattr(args, k) for k in presets.FLAGS}
            plan = presets.pipeline(args.command, flags, args.files)
        execute(session(), plan, f"file://{here}", f"file://{here}", args.lsEst)
    return 0


if __name__ == "__main__":
    sys.exit(main())
