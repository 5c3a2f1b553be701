"""Command line: facts of SQL as JSON or OpenLineage events.

    python -m bagwright [options] [SQL ...]

Relations that the statements read have to be views of the session; --table name=path registers a Parquet table.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from bagwright.sources import dbt, inputs


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="bagwright", description="Facts about SQL: lineage, value domains, exactness.")
    p.add_argument("query", nargs="*", help="SQL; read from stdin if there is no other input")
    p.add_argument("-s", "--sql", action="append", default=[])
    p.add_argument("-f", "--file", action="append", default=[])
    p.add_argument("--dir", action="append", default=[])
    p.add_argument("--manifest")
    p.add_argument("--dbt-manifest")
    p.add_argument("--dbt-catalog")
    p.add_argument("-d", "--dialect", default="generic")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--target", action="append", default=[])
    p.add_argument("--format", choices=["protocol", "openlineage"], default="protocol")
    p.add_argument("--namespace")
    p.add_argument("--event-time")
    p.add_argument("--assume", action="append", default=[], choices=["binary_collation", "no_char_padding", "no_nan", "signed_zero_equivalent", "session_time_zone"])
    a = p.parse_args(argv)
    if a.format == "openlineage" and not a.namespace:
        p.error("--format openlineage needs --namespace")
    if sum(map(bool, (a.manifest, a.dbt_manifest, a.query or a.sql or a.file or a.dir))) > 1:
        p.error("give one kind of input")
    spark = spark or SparkSession.builder.getOrCreate()
    for item in a.table:
        name, _, path = item.partition("=")
        spark.read.parquet(path).createOrReplaceTempView(name)
    targets = a.target
    if a.manifest:
        found, wanted = inputs.from_manifest(spark, a.manifest)
        targets = targets or wanted
    elif a.dbt_manifest:
        project = dbt.read(a.dbt_manifest, a.dbt_catalog)
        for name, schema in project.schemas.items():
            if name not in project.models:
                spark.createDataFrame([], schema).createOrReplaceTempView(name.split(".")[-1])
        found = project.bundle(spark)
    else:
        files = [*map(Path, a.file), *(f for d in a.dir for f in inputs.find_sql(d))]
        texts = [(f.stem, f.read_text(), a.dialect) for f in files] + [(f"query_{i + 1}", q, a.dialect) for i, q in enumerate([*a.sql, *a.query])]
        found = inputs.bundle(spark, texts or [("query_1", sys.stdin.read(), a.dialect)])
    if targets:
        found = found.select(targets)
    return json.dumps(found.openlineage(a.namespace, a.event_time), indent=2) if a.format == "openlineage" else found.to_json(a.assume)


if __name__ == "__main__":
    print(main())
