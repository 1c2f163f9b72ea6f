"""Command line: ``python -m blockloom import|export``."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from .plans import pipeline


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="blockloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, default in (("import", "output/model"), ("export", "output/export")):
        p = commands.add_parser(name)
        p.add_argument("-m", "--model", required=True)
        p.add_argument("-c", "--config")
        p.add_argument("-o", "--output", default=default)
        p.add_argument("--generate-config", action="store_true")
        if name == "export":
            p.add_argument("--shard-size", type=int, help="MB")
            p.add_argument("--validate", action="store_true")
            p.add_argument("--importance-high", type=float, default=0.2)
            p.add_argument("--importance-medium", type=float, default=0.1)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("blockloom").getOrCreate()
    if a.generate_config:
        made = pipeline.import_template(spark, a.model) if a.command == "import" else pipeline.export_template(spark, a.model, a.importance_high, a.importance_medium)
        print(json.dumps(made, indent=2))
        return
    if not a.config:
        parser.error("--config is needed")
    config = pipeline.load_config(spark, a.config)
    if a.command == "import":
        pipeline.import_model(spark, a.model, config, a.output).select("plane_name", "uuid", "rows", "cols").show(truncate=False)
        return
    if a.shard_size:
        config["shard_size"] = a.shard_size * 1_000_000
    os.makedirs(a.output, exist_ok=True)
    made = pipeline.export_model(spark, a.model, config, a.output)
    made.show(truncate=False)
    if a.validate:
        checked = pipeline.validate(spark, a.model, config, a.output)
        checked.show(truncate=False)
        if checked.where("not ok").limit(1).count():
            raise SystemExit("the files don't hold what was planned")


if __name__ == "__main__":
    main()
