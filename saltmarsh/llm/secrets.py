r"""Secrets: fixed patterns, judged by who else has them.

Base: assignments to secret names, access keys and long hexadecimal strings. Other long
tokens of letters and digits are candidates. For every value the whole corpus is asked
in how many repositories (documents) and with how many owners (sources) it occurs. A
value that several owners have is a copied example; one that few have, with the entropy
of a random string and no sign of a placeholder, looks live. Live candidates that touch
no base span are added as kind ``key``.

All steps are column expressions, joins and aggregates; owners are counted over distinct
(value, owner, repository), so a value in a third of all texts is many small groups.

Defined cases: null text counts as empty; a null owner is an owner of its own; repeated
rows are rows of their own, but one repository; a text without spans has counts 0 and
the digest of the empty string; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import hand_over, setup
from saltmarsh.llm.spans import hits, mark_overlaps, placed, report
from saltmarsh.session import durable

NAMES = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]+"
KINDS = {
    "assign": (NAMES + r"""["']?\x20*[:=]""", ASSIGN + VALUE),
    "access": ("AKIA", "AKIA[A-Z0-9]{16,}+"),
    "hex": ("[0-9a-f]{24}", "[0-9a-f]{24,}+"),
}
OTHER = {
    "key": (
        "[A-Za-z0-9+/_-]{20}",
        # A match starts where its run starts, so a digit may stand anywhere.
        "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
    )
}
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|change_?me|your|xxxx|0000|1234567"


@dataclass(frozen=True)
class Settings:
    """``owners``: as many make a value a copied example. ``entropy``: bits a character of a random string."""

    owners: int = 3
    entropy: float = 3.0
    shortest: int = 6


def secret() -> Column:
    """The value itself: what is assigned, or the whole match."""
    return F.when(F.col("kind") == "assign", F.regexp_extract("value", f"^{ASSIGN}({VALUE})$", 1)).otherwise(F.col("value"))


def entropy(value: Column) -> Column:
    """Shannon entropy, in bits a character."""
    letters, n = F.split(value, ""), F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def ownership(rows: DataFrame) -> DataFrame:
    """``name``, ``owners``, ``repositories`` of every value. ``rows``: ``name``, ``owner``, ``repository``."""
    once = rows.select("name", "owner", "repository").distinct()
    by_owner = once.groupBy("name", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("name").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def spans(docs: DataFrame, settings: Settings = Settings(), owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """Texts (``row_id``, ``doc_id``) and their spans.

    Spans: ``row_id``, ``kind``, ``start``, ``end``, ``value``, ``base``, ``owners``, ``repositories``, ``copied``, ``live``.
    """
    setup(docs.sparkSession)
    kinds = KINDS | OTHER
    found = hits(docs, kinds, (owner,))
    rows = placed(found, kinds, ("doc_id", f"x_{owner}")).withColumn("secret", secret())
    rows = rows.where(F.length("secret") >= settings.shortest).withColumn("base", F.col("kind").isin(*KINDS))
    # Words joined by marks have the entropy of a key, so letters alone are no candidate.
    rows = rows.where(F.col("base") | F.col("secret").rlike("[0-9]"))
    rows = durable(
        mark_overlaps(rows, "base").where("base OR NOT overlaps").select(
            "row_id", "kind", "start", "end", "value", "base", F.md5("secret").alias("name"),
            F.col(f"x_{owner}").alias("owner"), F.col("doc_id").alias("repository"),
            (entropy(F.col("secret")) >= settings.entropy).alias("random"), F.col("secret").rlike(PLACEHOLDER).alias("placeholder"),
        )
    )
    known = ownership(rows).withColumnRenamed("name", "_name")
    judged = hand_over(rows, known, "name", "_name").withColumn("copied", F.col("owners") >= settings.owners).withColumn(
        "live", ~F.col("copied") & F.col("random") & ~F.col("placeholder")
    )
    return found.select("row_id", "doc_id"), judged.where("base OR live").select(
        "row_id", "kind", "start", "end", "value", "base", "owners", "repositories", "copied", "live"
    )


def find(docs: DataFrame, settings: Settings = Settings(), owner: str = "source") -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` of the base spans, all ``spans``, ``n_copied``, ``n_live``."""
    texts, rows = spans(docs, settings, owner)
    flags = [F.count(F.when(F.col(c), 1)).alias(f"n_{c}") for c in ("copied", "live")]
    return report(texts, rows, list(KINDS), list(OTHER), flags)
