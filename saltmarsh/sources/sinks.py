"""Writers for result bundles and run records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bundle(bundle: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each named output below ``root``; returns the paths."""
    paths = {name: f"{root}/{name}" for name in bundle}
    for name, df in bundle.items():
        writer = df.write.mode("errorifexists")
        if fmt == "csv":
            writer.option("header", True).csv(paths[name])
        else:
            writer.format(fmt).save(paths[name])
    return paths


def run_manifest(bundle: Mapping[str, DataFrame], counts_by: Mapping[str, str], config: Mapping[str, object]) -> DataFrame:
    """One JSON record per output: its rows, a distribution and the run settings."""
    settings = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())]))
    frames = []
    for name, df in bundle.items():
        label = F.coalesce(F.col(counts_by[name]).cast("string"), F.lit("missing"))
        counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
        # The labels are a small vocabulary; their list is one bounded row.
        record = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
            F.array_sort(F.collect_list(F.struct("label", "n"))).alias("distribution"),
        )
        frames.append(record.select(
            F.lit(name).alias("output"), F.to_json(F.struct("rows", "distribution")).alias("counts_json"),
            settings.alias("config_json"),
        ))
    return reduce(lambda a, b: a.unionByName(b), frames)
