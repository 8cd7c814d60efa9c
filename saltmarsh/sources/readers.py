"""Readers for raw, typed, titled, sniffed and segmented text tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions import text as tx
from saltmarsh.operators.ordering import row_rank
from saltmarsh.operators.quality import require_none, violations

# Columns of a measurement table, in order.
MEASUREMENT_COLUMNS = (
    "ID", "Reduced Composition", "Z", "True Composition", "Ionic conductivity (S cm-1)",
    "IC (Total)", "IC (Bulk)", "Space group", "Space group #", "a", "b", "c", "alpha", "beta",
    "gamma", "Family", "DOI", "Checked", "Ref", "Cif ID", "Cif ref_1", "Cif ref_2", "note",
    "close match", "close match DOI", "ICSD ID", "Laskowski ID", "Liion ID",
)
# Accepted spellings of the input columns of a prediction.
ROLE_ALIASES = {
    "formula": ("True Composition", "formula", "composition"),
    "id": ("ID", "sample_id", "name"),
    "family": ("Family",),
}
PASSED_COLUMNS = ("base_formula", "reference_mS_cm", "source_row")


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def first_lines(spark: SparkSession, path: str, count: int) -> list[str]:
    """The first lines of the first file of a path, by file name."""
    files = sorted(spark.read.text(path).inputFiles())
    lines = [r[0] for r in spark.read.text(files[0]).head(count)] if files else []
    if not lines:
        raise ValueError(f"{path} is empty")
    return [lines[0].lstrip("\ufeff"), *lines[1:]]


def read_raw(
    spark: SparkSession, path: str, sep: str = ",", columns: Sequence[str] | None = None, multiline: bool = True
) -> DataFrame:
    """All columns as text; an empty cell stays an empty string.

    A quoted cell may hold separators, quotes and line breaks, in the header too. Such a
    file cannot be cut between tasks; ``multiline=False`` reads large files whose cells hold
    no line breaks in pieces.
    """
    return raw_scan(spark, path, sep, columns, multiline).fillna("")


def raw_scan(spark: SparkSession, path: str, sep: str, columns: Sequence[str] | None, multiline: bool = True) -> DataFrame:
    options = {"header": True, "sep": sep, "escape": '"', "multiLine": multiline, "nullValue": "\u0000", "emptyValue": ""}
    names = list(columns) if columns else [c.strip() for c in spark.read.csv(path, **options).columns]
    return spark.read.csv(path, schema=string_schema(names), enforceSchema=bool(columns is None), **options)


def contract_rules(
    labels: Mapping[str, Sequence[str]] = {}, numeric: Sequence[str] = (), positive: Sequence[str] = ()
) -> dict[str, Column]:
    """Row rules of a typed table: known labels, no infinity, weights above zero."""
    rules: dict[str, Column] = {}
    for column, levels in labels.items():
        rules[f"{column} not a known label"] = ~F.coalesce(F.col(column).isin(*levels), F.lit(False))
    for column in numeric:
        rules[f"{column} infinite"] = F.abs(F.col(column)) == F.lit(float("inf"))
    for column in positive:
        number = F.col(column).try_cast("double")
        rules[f"{column} not positive"] = number.isNull() | (number <= 0)
    return rules


def read_checked(df: DataFrame, required: Sequence[str], rules: Mapping[str, Column], enforce: bool = True) -> DataFrame:
    """The violation counts of a table; fails on a missing column or, when
    ``enforce`` is set, on any violation."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    found = violations(df, rules)
    return require_none(found) if enforce else found


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, sep=sep, mode="FAILFAST", escape='"')


def read_titled_tsv(spark: SparkSession, path: str, must_have: str, sep: str = "\t") -> DataFrame:
    """Table whose header may follow one title row; ``Unnamed*`` columns dropped."""
    head = first_lines(spark, path, 2)
    headers = [line.split(sep) for line in head]
    titled = must_have not in headers[0]
    if titled and (len(headers) < 2 or must_have not in headers[1]):
        raise ValueError(f"{path} has no column {must_have}")
    names = [name or f"Unnamed: {i}" for i, name in enumerate(headers[1 if titled else 0])]
    # Every part file of a folder may begin with the title and header lines; the same
    # text further down is data.
    skip = head[: 2 if titled else 1]
    placed = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    begins = placed.filter("_block = 0").groupBy(F.col("_file").alias("_own")).agg(F.min("_at").alias("_first"))
    at_top = [
        (F.col("_block") == 0) & (F.col("_at") == F.col("_first") + i) & (F.col("value") == line) for i, line in enumerate(skip)
    ]
    lines = placed.join(begins, F.col("_file") == F.col("_own")).filter(~reduce(lambda a, b: a | b, at_top))
    cells = F.split("value", sep, -1)
    wide = lines.select(*[F.coalesce(F.get(cells, i), F.lit("")).alias(n) for i, n in enumerate(names)])
    return wide.select(*[F.col(f"`{n}`") for n in names if not n.startswith("Unnamed")])


def sniff(first_line: str) -> tuple[str | None, list[str] | None]:
    """Separator of a first line, and its cells when they look like a header."""
    line = first_line.lstrip("\ufeff")
    if "," not in line and "\t" not in line:
        return None, None
    sep = "\t" if "\t" in line and "," not in line else ","
    cells = [c.strip() for c in line.split(sep)]
    known = {a.lower() for aliases in ROLE_ALIASES.values() for a in aliases}
    return sep, cells if {c.lower() for c in cells} & known else None


def resolve_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias found among the columns, ignoring case."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)


def with_place(scan: DataFrame) -> DataFrame:
    """Rows of a file scan with ``_place``, which orders them by file name, then offset."""
    return scan.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("_place"))


def with_line_numbers(df: DataFrame, name: str = "line_no") -> DataFrame:
    """Number rows by their ``_place``; without one, in the order they are read."""
    placed = df if "_place" in df.columns else df.withColumn("_place", F.monotonically_increasing_id())
    return row_rank(placed, [], [F.col("_place")], name).drop("_place")


def read_flexible(spark: SparkSession, path: str, roles: Mapping[str, str] = {}) -> DataFrame:
    """Formulas from a separated file with or without header, or one per line."""
    first = first_lines(spark, path, 1)[0]
    sep, header = sniff(first)
    if sep is None:
        lines = with_place(spark.read.text(path)).select(tx.strip(F.regexp_replace("value", "\ufeff", "")).alias("formula"), "_place")
        frame = lines.filter("formula != ''")
    elif header:
        frame = with_place(raw_scan(spark, path, sep, header)).fillna("")
    else:
        width = len(first.split(sep))
        names = ["True Composition", "reference_value", *[f"extra_{i}" for i in range(3, width + 1)]][:width]
        frame = with_place(spark.read.csv(path, sep=sep, schema=string_schema(names), comment="#"))
    return flexible_columns(frame, roles)


def flexible_columns(frame: DataFrame, roles: Mapping[str, str] = {}) -> DataFrame:
    """Pick id, formula and family by alias; missing ids are generated in order."""
    found = {
        role: roles.get(role) or resolve_column(frame.columns, aliases) for role, aliases in ROLE_ALIASES.items()
    }
    if found["formula"] is None:
        if len([c for c in frame.columns if c != "_place"]) != 1:
            raise ValueError("could not determine formula column")
        found["formula"] = frame.columns[0]
    if found["id"] is None:
        frame = with_line_numbers(frame).withColumn("_id", F.format_string("pred_%04d", "line_no"))
        found["id"] = "_id"
    chosen = [
        F.col(f"`{found['id']}`").alias("id"),
        tx.strip(F.col(f"`{found['formula']}`")).alias("formula"),
    ]
    if found["family"]:
        chosen.append(tx.strip(F.col(f"`{found['family']}`")).alias("family"))
    return frame.select(*chosen, *[F.col(c) for c in PASSED_COLUMNS if c in frame.columns])


def load_states(spark: SparkSession, path: str, field: str) -> DataFrame:
    """JSON ``{field: {key: [numbers]}}`` as (key, position, value) rows."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # a rule file, checked small
    if len(text) > 1_000_000:
        raise ValueError(f"{path} is too large for a rule file")
    rows = [(k, i, float(v)) for k, vs in json.loads(text)[field].items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "key string, position int, value double")


def load_dict_of_lists(df: DataFrame, field: str) -> DataFrame:
    """Explode a map column of arrays into (key, position, value) rows."""
    entries = df.select(F.explode(F.map_entries(field)).alias("e"))
    return entries.select(F.col("e.key").alias("key"), F.posexplode("e.value").alias("position", "value"))


def load_list_of_objects(df: DataFrame, field: str) -> DataFrame:
    """Explode an array-of-objects column into rows with its optional fields."""
    return df.select(F.explode(field).alias("o")).select("o.*")


def load_dims(spark: SparkSession, path: str, map_field: str, list_field: str, object_schema: str) -> tuple[DataFrame, DataFrame]:
    """Both shapes of rule table from JSON documents."""
    schema = f"{map_field} map<string, array<double>>, {list_field} array<struct<{object_schema}>>"
    df = spark.read.schema(schema).json(path, multiLine=False)
    return load_dict_of_lists(df, map_field), load_list_of_objects(df, list_field)


def fingerprint(df: DataFrame, part: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint of a table or of each of its parts.

    Every row is hashed with SHA-256; the count and the sums of its eight 32-bit
    words identify the content without sorting or collecting rows.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    digest = F.sha2(text, 256)
    rows = df.select(*part, *[
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"w{i}") for i in range(8)
    ])
    return rows.groupBy(*part).agg(
        F.count("*").alias("row_count"), *[F.sum(f"w{i}").alias(f"word_sum_{i}") for i in range(8)]
    )


# Bytes read from a file at a time.
READ_BYTES = 8 << 20


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Length and SHA-256 of every file at ``path`` that holds anything, whatever its size.

    The listing gives paths and lengths only; the task that a file falls to streams it
    through the digest in blocks. Files are reached through ``pyarrow.fs``: local and
    shared folders, HDFS and object stores.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "length")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for name, length in zip(batch["path"], batch["length"]):
                source, local = file_system(name)
                state, left = hashlib.sha256(), int(length)
                with source.open_input_stream(local, compression=None) as stream:
                    while block := stream.read(READ_BYTES):
                        state.update(block)
                        left -= len(block)
                if left:
                    raise ValueError(f"{name} changed while it was read")
                digests.append(state.hexdigest())
            yield batch.assign(sha256=digests)

    return listing.mapInPandas(work, "path string, length bigint, sha256 string")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a location as Spark writes it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
