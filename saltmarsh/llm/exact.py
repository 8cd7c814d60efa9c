r"""Exact deduplication by content-defined chunk recipes.

Each text, without its white space, is cut into chunks where its own content says so: at
the first punctuation mark after ``shortest`` characters, or after ``longest``. Every
distinct chunk is moved once, to the chunk store, where equal hashes are checked to mean
equal chunks; a hash that stands for several chunks gets a number for each of them. A
text is then its recipe, the ordered list of chunk identifiers, and texts are equal when
their recipes are. Long texts are never moved again.

Defined cases: null text counts as empty, and all empty texts are equal (empty recipe).
Of equal texts the row with the most code points stays, then the smallest id, null ids
last. Repeated rows (same id and text) are equal texts of one id; ``kept`` is true for
one of them. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import SPACE, hand_back, id_and_text, setup

SHORTEST, LONGEST = 1024, 8192


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text in order; joined they are the text."""
    cut = rf"(?s).{{{shortest},{longest}}}?(?<=[.,;:!?)\]}}、。])|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, hash_bits: int = 64, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``doc_id``, ``n_points`` (of the original text), ``text_sha256`` and ``recipe`` of every row."""
    plain = id_and_text(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_points"),
        F.regexp_replace("text", SPACE + "+", "").alias("plain"),
    )

    def name(chunk: Column) -> Column:
        whole = F.xxhash64(chunk)
        return whole if hash_bits == 64 else F.pmod(whole, F.lit(1 << hash_bits))

    cut = plain.select(
        "doc_id", "n_points", F.sha2("plain", 256).alias("text_sha256"),
        chunks(F.col("plain"), shortest, longest).alias("chunks"),
    )
    # The chunk store: the only place to which text is moved, each distinct chunk once a task.
    store = (
        cut.select(F.explode("chunks").alias("chunk")).select(name(F.col("chunk")).alias("name"), "chunk").distinct()
    )
    shared = store.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    named = cut.select(
        "doc_id", "n_points", "text_sha256", F.transform("chunks", lambda c: name(c)).alias("names"), "chunks"
    )
    doubtful = store.join(shared, "name").select(
        "name", "chunk", F.xxhash64("chunk", F.lit(1)).alias("other")
    )
    if doubtful.isEmpty():
        # Verified: every name stands for one chunk.
        return named.select("doc_id", "n_points", "text_sha256", F.col("names").alias("recipe"))
    # Names that stand for several chunks: the chunk's text itself goes to its numbered place.
    numbered = doubtful.groupBy("name").agg(F.array_sort(F.collect_set("chunk")).alias("texts")).select(
        "name", F.posexplode("texts").alias("number", "chunk")
    )
    spots = (
        named.select("text_sha256", F.posexplode(F.arrays_zip("names", "chunks")).alias("place", "z"))
        .select("text_sha256", "place", F.col("z.names").alias("name"), F.col("z.chunks").alias("chunk")).distinct()
        .join(numbered, ["name", "chunk"])
        .groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("place", "number"))).alias("numbers"))
    )
    return named.join(spots, "text_sha256", "left").select(
        "doc_id", "n_points", "text_sha256",
        F.concat("names", F.transform(
            F.sequence(F.lit(0), F.size("names")),
            lambda i: F.coalesce(F.element_at("numbers", i), F.lit(0)).cast("long"),
        )).alias("recipe"),
    )


def classes(docs: DataFrame, hash_bits: int = 64, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_points`` and ``repeats`` for every row.

    ``repeats``: how many rows have this id and this text; one of them is kept at most.
    """
    setup(docs.sparkSession)
    rows = (
        recipes(docs, hash_bits, shortest, longest)
        .groupBy("recipe", "text_sha256", "doc_id", "n_points").agg(F.count("*").alias("repeats"))
    )
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id")))
    grouped = hand_back(
        rows, ["recipe"], [F.sum("repeats").alias("group_size"), best.alias("best")], ["doc_id", "n_points"]
    )
    stays = (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (-F.col("best.col1") == F.col("n_points"))
    return grouped.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", stays.alias("stays"), "text_sha256", "n_points", "repeats",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("turn"),
    ).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("turn") == 1)).alias("kept"), "text_sha256", "n_points", "repeats"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each distinct text."""
    kept = classes(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_points").alias("_length"),
        (F.col("repeats") > 1).alias("_repeated"),
    )
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", "")
    found = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.sha2(plain, 256).alias("sha"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"),
    ).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("length") == F.col("_length")))
    once = found.where("NOT _repeated").select("row.*")
    again = found.where("_repeated").groupBy("doc_id", "sha").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)
