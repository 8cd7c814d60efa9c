r"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by pattern. Their
matches are seeds: the words around them (the word before, the two words before, the
words before and after) are lexical patterns, which also stand around other tokens with
digits or @, runs of digit groups, and plain words. Patterns and instances form a graph that is scored in turns: a pattern's
confidence for a kind is the summed score of its distinct instances, divided by their
number plus ``doubt``; an instance that is no seed has the chance that at least one of its
likely patterns is right. Patterns that end with high confidence and enough support mark
the tokens in them, if these are plausible for the kind and touch no base span.

All steps are column expressions, joins and aggregates; only matches and the words
around them are moved.

Defined cases: null text counts as empty; repeated rows are rows of their own; a text
without spans has counts 0 and the digest of the empty string; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import setup
from saltmarsh.llm.spans import hits, mark_overlaps, placed, report
from saltmarsh.session import durable

# Possessive repeats keep Java from recursing; look-behinds keep it from trying again
# inside a run of the same characters. They match what the plain patterns match.
LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# What a context may show to be an identifier: tokens with a digit or @ (with the marks before
# them, which are cut off later), and groups of digits that belong together. A token is tried once,
# where its run of characters begins, so a digit may stand anywhere in it.
MARKS = "@._%+/-"
OTHER = {
    "other": (
        "[0-9@]",
        rf"(?<![A-Za-z0-9{MARKS}])[{MARKS}]*+(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9]++(?:[{MARKS}]++[A-Za-z0-9]++)*+",
    ),
    "digits": (
        r"[0-9][\x20().-]{1,3}[0-9]",
        rf"(?<![A-Za-z0-9{MARKS}])\(?[0-9]++(?![A-Za-z@_%+/])(?:[\x20().-]{{1,3}}+[0-9]++(?![A-Za-z@_%+/]))++",
    ),
}
# What a token must look like to be taken for a kind.
PLAUSIBLE = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]{1,3}(?:[./-][0-9]{1,3}){3,}$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^(?:[^0-9A-Za-z]*[0-9]){7,15}[^0-9A-Za-z]*$",
}


@dataclass(frozen=True)
class Settings:
    turns: int = 3
    doubt: float = 2.0
    likely: float = 0.5
    sure: float = 0.8
    support: int = 5


def valid() -> Column:
    """Whether a base match passes its kind's checks."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    small = F.forall(
        F.split("value", r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255),
    )
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
        .when(F.col("kind") == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def contexts() -> Column:
    """Lexical patterns of a match: lower-case words around it, digits as 0."""
    tidy = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    one = F.regexp_extract(tidy("left"), r"(\S+)\s*$", 1)
    two = F.regexp_extract(tidy("left"), r"(\S+\s+\S+)\s*$", 1)
    after = F.regexp_extract(tidy("right"), r"^\s*(\S+)", 1)
    return F.filter(
        F.array(
            F.when(one != "", F.concat(F.lit("one "), one)),
            F.when(two != "", F.concat(F.lit("two "), two)),
            F.when((one != "") & (after != ""), F.concat(F.lit("around "), one, F.lit(" "), after)),
        ),
        lambda p: p.isNotNull(),
    )


def turns(edges: DataFrame, seeds: DataFrame, totals: DataFrame, settings: Settings) -> list[DataFrame]:
    """``pattern``, ``kind``, ``confidence`` of the likely patterns after each turn."""
    scores, out = seeds, []
    for turn in range(settings.turns):
        sums = edges.join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("sum"), F.count("*").alias("support")
        )
        out.append(durable(
            sums.join(totals, "pattern").withColumn("confidence", F.col("sum") / (F.col("instances") + settings.doubt))
            .where((F.col("confidence") >= settings.likely) & (F.col("support") >= settings.support))
            .select("pattern", "kind", "confidence")
        ))
        if turn + 1 < settings.turns:
            heard = edges.join(out[-1], "pattern").groupBy("instance", "kind").agg(
                (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")
            )
            scores = durable(seeds.unionByName(heard).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return out


def plain_words(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern`` and number of distinct ``words`` without digit or @ that stand in it."""
    listed = F.filter(F.split(F.regexp_replace(F.lower("text"), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    cells = F.transform("words", lambda w, k: F.struct(
        w.alias("word"), F.when(k > 0, F.get("words", k - 1)).alias("one"),
        F.when(k > 1, F.get("words", k - 2)).alias("two"), F.get("words", k + 1).alias("after"),
    ))
    words = docs.select(listed.alias("words")).select(F.inline(cells)).where(
        F.col("one").isNotNull() & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike("[0@]")
    )
    slots = F.array(
        F.concat(F.lit("one "), "one"), F.concat(F.lit("two "), "two", F.lit(" "), "one"),
        F.concat(F.lit("around "), "one", F.lit(" "), "after"),
    )
    found = words.select("word", F.explode(slots).alias("pattern")).join(patterns, "pattern")
    bare = F.md5(F.regexp_replace("word", r"^[^\p{L}]++|[^\p{L}]++$", "")).alias("instance")
    return found.select("pattern", bare).distinct().groupBy("pattern").agg(F.count("*").alias("words"))


def sure_patterns(rows: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """``pattern``, ``kind``, ``confidence`` of the patterns that mark identifiers.

    ``rows``: ``kind``, ``value``, ``base``, ``patterns`` of all matches. More instances never
    make a pattern surer, so those likely among the matches alone are all that can be; only
    in them are the other words of the texts counted.
    """
    name = F.md5(F.lower("value")).alias("instance")
    edges = durable(rows.select(F.explode("patterns").alias("pattern"), name).distinct())
    seeds = durable(rows.where("base").select(name, "kind").distinct().withColumn("score", F.lit(1.0)))
    totals = durable(edges.groupBy("pattern").agg(F.count("*").alias("instances")))
    first = turns(edges, seeds, totals, settings)
    possible = first[0].select("pattern")
    for more in first[1:]:
        possible = possible.union(more.select("pattern"))
    possible = durable(possible.distinct())
    if possible.isEmpty():
        return first[-1]
    words = durable(plain_words(docs, possible))
    full = durable(
        totals.join(possible, "pattern").join(words, "pattern", "left")
        .select("pattern", (F.col("instances") + F.coalesce("words", F.lit(0))).alias("instances"))
    )
    last = turns(durable(edges.join(possible, "pattern")), seeds, full, settings)[-1]
    return last.where(F.col("confidence") >= settings.sure)


def spans(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Texts (``row_id``, ``doc_id``) and their spans (``row_id``, ``kind``, ``start``, ``end``, ``value``, ``base``)."""
    setup(docs.sparkSession)
    kinds = KINDS | OTHER
    found = hits(docs, kinds)
    rows = placed(found, kinds).withColumn("base", valid()).where(F.col("base") | F.col("kind").isin(*OTHER))
    # The marks before a token belong to its context.
    marks = F.when(F.col("kind") == "other", F.regexp_extract("value", f"^[{MARKS}]*+", 0)).otherwise("")
    rows = rows.withColumn("marks", marks).withColumns({
        "value": F.expr("substring(value, length(marks) + 1)"), "start": F.col("start") + F.length("marks"), "left": F.concat("left", "marks"),
    }).drop("marks").where((F.col("kind") != "other") | F.col("value").rlike("[0-9@]"))
    rows = mark_overlaps(rows, "base").where("base OR NOT overlaps").drop("overlaps")
    # A token inside a run of digit groups is another reading of its slot, not a further instance.
    rows = rows.withColumn("run", F.col("kind") == "digits")
    rows = durable(
        mark_overlaps(rows, "run").withColumn("inside", F.col("overlaps") & (F.col("kind") == "other"))
        .withColumn("patterns", contexts()).drop("left", "right", "overlaps")
    )
    sure = sure_patterns(rows.where("NOT inside"), docs, settings).withColumnRenamed("kind", "as_kind")
    plausible = F.lit(False)
    for kind, shape in PLAUSIBLE.items():
        plausible = plausible | ((F.col("as_kind") == kind) & F.col("value").rlike(shape))
    seen = (
        rows.where("NOT base").select("row_id", "start", "end", "value", "run", "inside", F.explode("patterns").alias("pattern"))
        .join(sure, "pattern").where(plausible)
        .groupBy("row_id", "start", "end", "value", "run", "inside").agg(F.max(F.struct("confidence", "as_kind")).alias("best"))
    )
    seen = mark_overlaps(seen, "run").where("NOT (inside AND overlaps)").select(
        "row_id", F.col("best.as_kind").alias("kind"), "start", "end", "value", F.lit(False).alias("base")
    )
    base = rows.where("base").select("row_id", "kind", "start", "end", "value", "base")
    return found.select("row_id", "doc_id"), base.unionByName(seen)


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` of the base spans, and all ``spans``."""
    texts, rows = spans(docs, settings)
    added = F.count(F.when(~F.col("base"), 1)).alias("n_added")
    return report(texts, rows, list(KINDS), [], [added])
