"""Measurement views over the benchmark tables.

The expressions are plain SQL text that Spark and DuckDB read alike, so the
oracle builds the same view from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One literature measurement per line item.
MEASUREMENT_EXPRESSIONS = {
    "id": """concat('m', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_',
        CAST(ROUND(l_extendedprice * 100) AS BIGINT))""",
    "source": """CASE l_linenumber % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'literature'
        WHEN 2 THEN 'caltech' ELSE 'liverpool' END""",
    "source_row": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "formula": """CASE
        WHEN p_partkey % 89 = 3 THEN 'Li10(Ge0.776Sn0.224)P2S12'
        WHEN p_partkey % 97 = 5 THEN 'Li2(B(C2H)3)2'
        WHEN p_partkey % 101 = 7 THEN 'Li7P3S11*'
        WHEN p_partkey % 103 = 9 THEN ''
        WHEN p_partkey % 107 = 11 THEN 'Li10Sn(PS6)2'
        WHEN p_partkey % 109 = 13 THEN 'Li7La3Zr2O12'
        WHEN p_partkey % 113 = 15 THEN 'LiNbCl4O'
        WHEN p_partkey % 127 = 17 THEN 'Li1.6Al0.6Ge1.4P3O12'
        WHEN p_partkey % 131 = 19 THEN 'Li20Sn2(PS6)4'
        WHEN p_partkey % 137 = 21 THEN 'Li6PS5Cl + 5wt%ZrCl4'
        ELSE concat('Li', 1 + p_partkey % 6,
            CASE p_size % 8 WHEN 0 THEN 'Zr' WHEN 1 THEN 'Ge' WHEN 2 THEN 'P' WHEN 3 THEN 'Y'
                WHEN 4 THEN 'In' WHEN 5 THEN 'Sn' WHEN 6 THEN 'Si' ELSE 'La' END,
            CASE p_partkey % 2 WHEN 0 THEN '' ELSE '2' END,
            CASE p_partkey % 5 WHEN 0 THEN 'Cl6' WHEN 1 THEN 'S4' WHEN 2 THEN 'O7'
                WHEN 3 THEN 'S4.5Cl1.5' ELSE 'OCl4' END)
        END""",
    "conductivity_text": """CASE
        WHEN l_suppkey % 29 = 4 THEN concat('≈', 1 + l_partkey % 9, '.5e-4')
        WHEN l_suppkey % 31 = 5 THEN 'n/a'
        WHEN l_suppkey % 37 = 6 THEN concat(1 + l_partkey % 9, '.', l_suppkey % 10, ' x 10-', 2 + l_orderkey % 6, ' # cold pressed')
        ELSE concat(CASE l_linenumber WHEN 7 THEN '<' WHEN 6 THEN '>= ' WHEN 5 THEN '~' ELSE '' END,
            1 + l_partkey % 9, '.', l_suppkey % 10, 'e-', 2 + l_orderkey % 6)
        END""",
    "doi_text": """CASE
        WHEN l_orderkey % 41 = 0 THEN 'not-a-doi'
        ELSE concat('https://doi.org/10.1021/S', CAST(FLOOR(l_orderkey / 20) AS BIGINT), '.',
            CASE WHEN l_orderkey % 17 = 0
                THEN concat('|doi: 10.1021/s', CAST(FLOOR(l_orderkey / 20) AS BIGINT) + 1) ELSE '' END)
        END""",
    "family": """CASE
        WHEN p_partkey % 13 = 0 THEN 'None'
        WHEN p_partkey % 19 = 0 THEN 'anti-perovskite'
        ELSE CASE p_type WHEN 'ECONOMY' THEN 'Halide-like' WHEN 'SMALL' THEN ' argyrodite '
            WHEN 'PROMO' THEN 'Oxide' WHEN 'STANDARD' THEN 'unknown' WHEN 'MEDIUM' THEN 'LGPS like'
            ELSE 'Other' END
        END""",
    "temperature_c": "CAST(l_quantity AS INT)",
    "method": """CASE l_returnflag WHEN 'A' THEN 'ball_milling' WHEN 'N' THEN 'solid_state'
        ELSE 'solution' END""",
    "note": """concat('source_id=', l_suppkey, '; measured_temperature_C=',
        CASE WHEN l_suppkey % 23 = 2 THEN 'RT' ELSE concat(CAST(l_quantity AS INT), '') END, '; kind=',
        CASE WHEN l_suppkey % 19 = 1 THEN 'bulk and total' WHEN l_linestatus = 'O' THEN 'Bulk' ELSE 'total' END)""",
    "checked": "CASE WHEN l_suppkey % 3 = 0 THEN '1' WHEN l_suppkey % 7 = 0 THEN 'Yes' ELSE '0' END",
    "orderkey": "CAST(l_orderkey AS BIGINT)",
    "partkey": "CAST(l_partkey AS BIGINT)",
    "suppkey": "CAST(l_suppkey AS BIGINT)",
}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when the scan has fewer splits than that.

    A table of a few files would keep most cores idle; a large one has many
    splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores, *keys) if splits < cores else df


# Columns that come from the part table alone, and keys kept for joining.
PART_COLUMNS = ("formula", "family")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part texts are built once per part; the texts of a line are built behind the
    join, so that a join that shuffles moves keys and numbers instead of texts."""
    part_side = [f"{MEASUREMENT_EXPRESSIONS[n]} AS {n}" for n in PART_COLUMNS]
    line_side = [n if n in PART_COLUMNS else f"{e} AS {n}" for n, e in MEASUREMENT_EXPRESSIONS.items()]
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", *part_side)
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(*line_side)


# Ordered user streams cut into segments by a header event.
SEGMENT_EXPRESSIONS = {
    "file": "CAST(user_id AS BIGINT)",
    "ts": "ts",
    "line_id": "CAST(event_id AS BIGINT)",
    "label": "CASE WHEN event_type = 'signup' THEN concat('group', event_id % 7) END",
    "is_header": "event_type = 'signup'",
    "text": """CASE WHEN event_type = 'signup' THEN concat('group', event_id % 7)
        ELSE concat('row', event_id, '\t', event_type, '\t', CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE concat(event_id % 90 + 1, '.5 x 10-', 1 + event_id % 4) END) END""",
    "kind": "event_type",
    "value": "value",
}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"), "user_id", "event_id")
    return events.selectExpr(*[f"{e} AS {n}" for n, e in SEGMENT_EXPRESSIONS.items()])


# A segmented file of measured formulas: the event's part gives formula and family.
TREND_LINE_EXPRESSIONS = {
    "file": "CAST(user_id AS BIGINT)",
    "ts": "ts",
    "line_id": "CAST(event_id AS BIGINT)",
    "part_no": "event_id % parts",
    "label": SEGMENT_EXPRESSIONS["label"],
    "is_header": SEGMENT_EXPRESSIONS["is_header"],
    "row_id": "concat('row', event_id)",
    "measure": """CASE WHEN event_id % 11 = 0 THEN 'bad'
        ELSE concat(event_id % 9 + 1, '.5 x 10-', 3 + event_id % 2, CASE WHEN event_id % 7 = 0 THEN ' # cold pressed' ELSE '' END) END""",
}


# Every thirteenth line has an additive behind a formula that other rows have too.
TREND_FORMULA = """concat(CASE WHEN part_no % 137 = 21 THEN 'Li7La3Zr2O12' ELSE formula END,
    CASE WHEN line_id % 13 = 0 THEN ' + 5wt%ZrCl4' ELSE '' END)"""


def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of segmented files (``file``, ``ts``, ``line_id``, ``text``) and the facts the annotations are made of."""
    from pyspark.sql import functions as F

    part = table(spark, sf_dir, "part")
    parts = part.selectExpr("p_partkey", *[f"{MEASUREMENT_EXPRESSIONS[n]} AS {n}" for n in PART_COLUMNS])
    count = part.agg(F.count("*").alias("parts"))  # one row
    lines = spread(table(spark, sf_dir, "events"), "user_id", "event_id").join(F.broadcast(count), F.lit(True)).selectExpr(
        *[f"{e} AS {n}" for n, e in TREND_LINE_EXPRESSIONS.items()]
    )
    text = F.when(F.col("is_header"), F.col("label")).otherwise(F.concat_ws("\t", "row_id", "formula", "measure"))
    rows = lines.join(parts, F.col("part_no") == F.col("p_partkey")).withColumn("formula", F.expr(TREND_FORMULA))
    return rows.withColumn("text", text).drop("p_partkey", "part_no")


def source_tables(m: DataFrame) -> dict[str, DataFrame]:
    """The measurement view reshaped into four source databases."""
    from pyspark.sql import functions as F

    c = F.col

    def of(name: str) -> DataFrame:
        return m.filter(c("source") == name)

    v1 = of("v1").select(
        c("id").alias("ID"), c("formula").alias("True Composition"), F.lit("").alias("Reduced Composition"),
        c("conductivity_text").alias("Ionic conductivity (S cm-1)"), c("family").alias("Family"),
        c("doi_text").alias("DOI"), c("checked").alias("Checked"), "note", "source_row",
    )
    literature = of("literature").select(
        F.when(c("suppkey") % 9 == 4, "retired").otherwise(" Active ").alias("status"),
        F.when(c("suppkey") % 4 == 0, "").otherwise(c("id")).alias("ID"), c("id").alias("addition_id"),
        F.when(c("suppkey") % 2 == 0, c("formula")).otherwise("").alias("True Composition"),
        F.when(c("suppkey") % 2 == 0, "").otherwise(c("formula")).alias("Reduced Composition"),
        F.when(c("suppkey") % 3 == 0, c("conductivity_text")).otherwise("").alias("stored_conductivity_s_cm"),
        F.when(c("suppkey") % 3 == 1, c("conductivity_text")).otherwise("").alias("calculated_conductivity_s_cm"),
        F.when(c("suppkey") % 3 == 2, c("conductivity_text")).otherwise("").alias("source_conductivity_s_cm"),
        c("doi_text").alias("DOI"), F.lit("").alias("note"), F.lit("arrhenius").alias("calculation_method"),
        c("temperature_c").cast("string").alias("target_temperature_c"), F.lit("").alias("structure_status"),
        F.lit("2020").alias("year"), "source_row",
    )
    caltech = of("caltech").select(
        c("id").alias("icsd_collectioncode"), c("formula").alias("compound"),
        c("doi_text").alias("conductivity_doi"), c("conductivity_text").alias("conductivity_siemens_per_cm"),
        (c("temperature_c") + 300).cast("string").alias("lowest_extrapolation_temperature_K"), "source_row",
    )
    liverpool = of("liverpool").select(
        c("id").alias("ID"), c("formula").alias("composition"), c("doi_text").alias("source"),
        c("conductivity_text").alias("target"),
        F.when(c("suppkey") % 17 == 3, "RT").otherwise(c("temperature_c").cast("string")).alias("temperature"),
        "family", c("method").alias("ChemicalFamily"), "source_row",
    )
    return {"v1": v1, "literature": literature, "caltech": caltech, "liverpool": liverpool}
