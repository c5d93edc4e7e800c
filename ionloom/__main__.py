"""python -m ionloom <info|fileinfo|extract|dta|xic> RUN ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import tools
from .functions.columns import da, ppm
from .run import open_run


def _levels(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ionloom", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, filters: bool = False, out: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("run")
        if out:
            c.add_argument("--out", required=True)
        if filters:
            c.add_argument("--ms-level", type=_levels, action="extend", default=None)
            c.add_argument("--rt-min", type=float)
            c.add_argument("--rt-max", type=float)
        return c

    command("info").add_argument("--first", type=int, default=5)
    command("fileinfo")
    command("extract", True, True).add_argument("--keep-metadata", action="store_true")
    command("dta", True, True).add_argument("--charge", type=int, default=2)
    xic = command("xic", True, True)
    xic.add_argument("--mz", type=float, required=True)
    xic.add_argument("--ppm", type=float, default=20.0)
    xic.add_argument("--da", type=float)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ionloom").getOrCreate()
    with open_run(spark, a.run) as run:
        if a.command in ("info", "fileinfo"):
            for name, table in (tools.info(run, a.first) if a.command == "info" else run.report()).items():
                print(f"# {name}")
                table.show(100, truncate=False)
            if a.command == "fileinfo":
                print(json.dumps(run.file_metadata(), indent=2, ensure_ascii=False))
        elif a.command == "extract":
            tools.extract(run, a.out, a.ms_level, a.rt_min, a.rt_max, a.keep_metadata)
        elif a.command == "dta":
            tools.to_dta(run, a.out, a.ms_level, a.rt_min, a.rt_max, a.charge)
        else:
            tools.to_xic_csv(run, a.out, a.mz, da(a.da) if a.da is not None else ppm(a.ppm), a.ms_level or [1], a.rt_min, a.rt_max)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
