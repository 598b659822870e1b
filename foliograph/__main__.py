"""Command line: python -m foliograph COMMAND PATH... [--out FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliograph.plans import commands
from foliograph.plans.shipping import ship
from foliograph.schema import FRAMES, json_schema

ONE = {"inspect": commands.inspect, "to-md": commands.to_md, "validate": commands.check, "issues": commands.issues, "census": commands.census, "from-json": commands.from_json, "convert": commands.convert, "convert-legacy": commands.convert_legacy}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliograph", description=__doc__)
    parser.add_argument("command", choices=[*ONE, "to-json", "audit", "patch", "restyle", "templates", "schema"])
    parser.add_argument("paths", nargs="*", help="input folder; for audit source and output, for patch packages and changes; for schema a frame")
    parser.add_argument("--out", help="Parquet folder to write; otherwise rows are printed")
    parser.add_argument("--section", type=int)
    parser.add_argument("--preset", default="default")
    own = parser.parse_args(args)
    if own.command == "schema":
        for name in own.paths or FRAMES:
            print(json_schema(name))
        return
    spark = SparkSession.builder.appName("foliograph").getOrCreate()
    ship(spark)
    if own.command in ONE:
        made = ONE[own.command](spark, own.paths[0])
    elif own.command == "to-json":
        made = commands.to_json(spark, own.paths[0], own.section)
    elif own.command == "audit":
        made = commands.audit(spark, own.paths[0], own.paths[1])
    elif own.command == "patch":
        made = commands.patch(spark, own.paths[0], own.paths[1])
    elif own.command == "restyle":
        made = commands.restyle(spark, own.paths[0], own.preset)
    else:
        made = commands.templates(spark)
    if own.out:
        made.write.parquet(own.out)
    else:
        made.show(50, truncate=120)


if __name__ == "__main__":
    main()
