"""Joining and deduplicating records of several source databases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import formula as fm
from saltmarsh.functions import text as tx
from saltmarsh.operators import quality as ql
from saltmarsh.operators.ordering import exact_quantiles, hand_back, keep_first, last_known, member_lists, next_row, running_extreme, spread_join
from saltmarsh.session import durable, small_table

# --- sources to one schema ---------------------------------------------------

# Source priority when the same record is in several databases.
MERGE_PRIORITY = {"v1": 0, "literature": 1, "caltech": 2, "liverpool": 3}
# Source order when one formula has several records.
SELECT_PRIORITY = {"v1": 0, "literature": 1, "liverpool": 2, "caltech": 3}

CANDIDATE_COLUMNS = (
    "id", "source", "source_row", "formula", "doi_text", "conductivity_text", "family",
    "temperature_c", "checked", "external_id", "lowest_temperature_k", "note",
)


def priority(source: Column, ranks: Mapping[str, int]) -> Column:
    choice = None
    for name, rank in ranks.items():
        choice = F.when(source == name, rank) if choice is None else choice.when(source == name, rank)
    return choice


def _candidate(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    defaults = {
        "family": F.lit(""),
        "temperature_c": F.lit(None).cast("double"),
        "external_id": F.lit(""),
        "lowest_temperature_k": F.lit(None).cast("double"),
        "note": F.lit(""),
        "source_row": F.col("source_row"),
    }
    chosen = defaults | columns | {"source": F.lit(source)}
    return df.select(*[chosen[name].alias(name) for name in CANDIDATE_COLUMNS])


def v1_candidates(df: DataFrame) -> DataFrame:
    c = F.col
    return _candidate(
        df, "v1",
        id=c("ID"),
        formula=tx.first_nonempty(c("True Composition"), c("Reduced Composition")),
        doi_text=c("DOI"),
        conductivity_text=c("Ionic conductivity (S cm-1)"),
        family=c("Family"),
        checked=c("Checked"),
        note=c("note"),
    )


def literature_candidates(df: DataFrame) -> DataFrame:
    c = F.col
    active = ql.active_only(df)
    note = tx.build_note(c("note"), {
        "addition_id": c("addition_id"),
        "calculation_method": c("calculation_method"),
        "target_temperature_C": c("target_temperature_c"),
        "structure_status": c("structure_status"),
        "source_year": c("year"),
    })
    return _candidate(
        active, "literature",
        id=tx.first_nonempty(c("ID"), c("addition_id")),
        formula=tx.first_nonempty(c("True Composition"), c("Reduced Composition")),
        doi_text=c("DOI"),
        conductivity_text=tx.first_nonempty(
            c("stored_conductivity_s_cm"), c("calculated_conductivity_s_cm"), c("source_conductivity_s_cm")
        ),
        family=F.lit(tx.UNKNOWN),
        checked=F.lit("1"),
        temperature_c=c("target_temperature_c").try_cast("double"),
        note=note,
    )


def caltech_candidates(df: DataFrame) -> DataFrame:
    c = F.col
    code = tx.strip(c("icsd_collectioncode"))
    return _candidate(
        df, "caltech",
        id=F.concat(F.lit("caltech_icsd_"), tx.first_nonempty(code, c("source_row").cast("string"))),
        formula=c("compound"),
        doi_text=c("conductivity_doi"),
        conductivity_text=c("conductivity_siemens_per_cm"),
        checked=F.lit("0"),
        external_id=code,
        lowest_temperature_k=c("lowest_extrapolation_temperature_K").try_cast("double"),
        note=F.concat(F.lit("lowest_extrapolation_temperature_K="), c("lowest_extrapolation_temperature_K")),
    )


def liverpool_candidates(df: DataFrame) -> DataFrame:
    c = F.col
    source_id = tx.strip(c("ID"))
    return _candidate(
        df, "liverpool",
        id=F.concat(
            F.lit("liverpool_"), F.coalesce(F.nullif(source_id, F.lit("")), F.lit("row")),
            F.lit("_"), F.format_string("%04d", c("source_row")),
        ),
        formula=c("composition"),
        doi_text=c("source"),
        conductivity_text=c("target"),
        family=c("family"),
        checked=F.lit("0"),
        temperature_c=c("temperature").try_cast("double"),
        note=F.concat(
            F.lit("source_id="), source_id, F.lit("; measured_temperature_C="), c("temperature"),
            F.lit("; chemical_family="), c("ChemicalFamily"),
        ),
    )


def candidates(v1: DataFrame, literature: DataFrame, caltech: DataFrame, liverpool: DataFrame) -> DataFrame:
    frames = [
        v1_candidates(v1), literature_candidates(literature),
        caltech_candidates(caltech), liverpool_candidates(liverpool),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- validation ----------------------------------------------------------------


def tag_candidates(
    df: DataFrame,
    *,
    key_overrides: Mapping[str, str] | None = None,
    room_temperature_c: float = 25.0,
    tolerance_c: float = 5.0,
    excluded_external_ids: Sequence[str] = ("65051", "100169"),
) -> DataFrame:
    """Typed candidates with the first reason to reject each, or null."""
    rows = ql.with_formula(ql.parse_measurements(df))
    if key_overrides:
        # The replacement formula changes the key only; the full formula stays.
        table = small_table(df.sparkSession, list(key_overrides.items()), "external_id string, _formula string")
        table = table.select("external_id", fm.formula_key(fm.parse_formula(F.col("_formula"))).alias("_key"))
        rows = rows.join(F.broadcast(table), "external_id", "left").withColumn(
            "formula_key", F.coalesce(F.when(F.col("source") == "caltech", F.col("_key")), "formula_key")
        ).drop("_key")
    low, high = room_temperature_c - tolerance_c, room_temperature_c + tolerance_c
    source, temperature = F.col("source"), F.col("temperature_c")
    outside = ~F.coalesce(temperature.between(low, high), F.lit(False))
    kelvin = F.coalesce(
        F.concat(F.regexp_replace(F.col("lowest_temperature_k").cast("string"), r"\.0$", ""), F.lit(" K")),
        F.lit("unknown temperature"),
    )
    rules = [
        (F.col("formula_error") != "", F.concat(F.lit("unparseable formula: "), F.col("formula_error"))),
        (F.size("doi_tokens") == 0, "missing or invalid DOI"),
        (~F.coalesce(F.col("value") > 0, F.lit(False)), "missing, non-positive, or unparseable conductivity"),
        ((source == "liverpool") & outside,
         f"Liverpool temperature outside room-temperature range [{low:g}, {high:g}] C"),
        ((source == "caltech") & F.col("external_id").isin(*excluded_external_ids),
         F.concat(F.lit("explicitly excluded Caltech high-temperature extrapolation: ICSD "),
                  F.col("external_id"), F.lit(", "), kelvin)),
    ]
    return rows.withColumn(ql.REASON, ql.first_reason(rules))


def split_candidates(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = tagged.filter(F.col(ql.REASON).isNull()).drop(ql.REASON)
    return kept, tagged.filter(F.col(ql.REASON).isNotNull())


def validate_candidates(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Typed valid candidates, and rejected ones with their first reason."""
    return split_candidates(tag_candidates(df, **options))


# --- joins ---------------------------------------------------------------------


def lookup(
    df: DataFrame, dim: DataFrame, id_col: str, position: str, value: str, order: str | None = None, same: str | None = None
) -> DataFrame:
    """Value by id when the id is known, else by position, else ``unknown``.

    A key that stands in ``dim`` several times has one value, that of the last entry:
    by ``order`` if a column is named, else the largest value. With ``same``, a column of
    both tables, a known id whose two contents differ fails the job.
    """
    last = F.max_by(value, order) if order else F.max(value)
    facts = [last.alias("_by_id")] + ([(F.max_by(same, order) if order else F.max(same)).alias("_same")] if same else [])
    by_id = dim.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*facts)
    by_position = dim.filter(F.col(position).isNotNull()).groupBy(position).agg(last.alias("_by_position"))
    joined = df.join(by_id, id_col, "left").join(by_position, position, "left")
    if same:
        message = F.concat(F.lit("contents differ for "), F.col(id_col).cast("string"))
        known = F.col("_same").isNull() | F.col(same).eqNullSafe(F.col("_same"))
        joined = joined.filter(known | F.raise_error(message).cast("boolean")).drop("_same")
    return joined.withColumn(
        value, F.coalesce("_by_id", "_by_position", F.lit(tx.UNKNOWN))
    ).drop("_by_id", "_by_position")


def block_violations(rows: DataFrame, blocks: DataFrame, position: str, start: str, end: str) -> DataFrame:
    """Blocks out of bounds, overlapping blocks and uncovered rows."""
    last = rows.agg(F.max(position).alias("_last"))
    bounds = blocks.join(F.broadcast(last), F.lit(True)).agg(
        F.count_if((F.col(start) < 1) | (F.col(end) < F.col(start)) | (F.col(end) > F.col("_last"))).alias("n")
    )
    ordered = next_row(blocks, [], [F.col(start), F.col(end)], [start], "_next")
    overlaps = ordered.agg(F.count_if(F.col(f"_next.{start}") <= F.col(end)).alias("n"))
    # A row is covered if some block that starts at or before it ends at or after it.
    marks = rows.select(F.col(position).cast("bigint").alias("_at"), F.lit(1).alias("_kind")).unionByName(
        blocks.select(F.col(start).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.col(end).cast("bigint").alias("_end")),
        allowMissingColumns=True,
    )
    reached = running_extreme(marks, [], [F.col("_at"), F.col("_kind")], F.col("_end"), "_reach", best="max")
    uncovered = reached.filter("_kind = 1").agg(F.count_if(~F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False))).alias("n"))
    named = [("out of bounds", bounds), ("overlapping", overlaps), ("uncovered rows", uncovered)]
    return reduce(
        lambda a, b: a.unionByName(b),
        [f.select(F.lit(rule).alias("rule"), F.col("n").alias("violation_count")) for rule, f in named],
    )


def swept(rows: DataFrame, blocks: DataFrame, position: str, start: str, end: str, labels: Sequence[str]) -> DataFrame:
    """Rows with the block that starts last before them (``_block``) and whether it holds them (``_inside``).

    One sweep: block starts and rows stand in one order of positions, and each row takes the
    last start carried forward to it. Of blocks with one start the longest counts.
    """
    block = F.struct(F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"), *labels)
    starts = blocks.filter(F.col(start).isNotNull()).groupBy(F.col(start).cast("bigint").alias("_at")).agg(
        F.max_by(block, F.struct(F.col(end), *labels)).alias("_start")
    ).withColumn("_kind", F.lit(0))
    marks = rows.select(F.col(position).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    order = [F.col("_at"), F.col("_kind")]
    carried = last_known(marks.unionByName(starts, allowMissingColumns=True), [], order, F.col("_start"), "_block")
    inside = F.coalesce(F.col("_at") <= F.col("_block.end"), F.lit(False))
    return carried.filter("_kind = 1").select("_row.*", "_block", inside.alias("_inside"))


def label_by_blocks(
    rows: DataFrame, blocks: DataFrame, position: str, start: str, end: str, labels: Sequence[str]
) -> DataFrame:
    """Labels of the block ``[start, end]`` each row position falls into; rows in no block are left out.

    Blocks must not overlap (``block_violations``); where they do, the one that starts last counts.
    """
    found = swept(rows, blocks, position, start, end, labels).filter("_inside")
    return found.select(*rows.columns, *[F.col(f"_block.{c}").alias(c) for c in labels])


def token_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.posexplode("doi_tokens").alias("pos", "token"))


def fill_by_overlap(df: DataFrame, fill_source: str = "caltech") -> DataFrame:
    """Fill unknown families of one source from records sharing formula and token.

    Per (formula, token) the first known family by source priority and row
    order counts; the first matching token of a row decides.  Lookups run on
    distinct (formula, token list) pairs.
    """
    rank = priority(F.col("source"), MERGE_PRIORITY)
    known = df.filter(F.col("family_norm") != tx.UNKNOWN).withColumn("_rank", rank)
    exploded = token_rows(known, "formula_key", "family_norm", "_rank", "source_row", "id")
    by_key = exploded.groupBy("formula_key", "token").agg(
        F.min_by("family_norm", F.struct("_rank", "source_row", "id")).alias("_found")
    )
    needs = (F.col("source") == fill_source) & (F.col("family_norm") == tx.UNKNOWN)
    wanted = df.filter(needs).select("formula_key", "doi", "doi_tokens").distinct()
    matches = token_rows(wanted, "formula_key", "doi").join(by_key, ["formula_key", "token"])
    best = matches.groupBy("formula_key", "doi").agg(F.min_by("_found", "pos").alias("_fill"))
    # Only rows that lack a family are looked up.
    wanting = F.coalesce(needs, F.lit(False))
    joined = df.filter(wanting).join(best, ["formula_key", "doi"], "left").unionByName(
        df.filter(~wanting), allowMissingColumns=True
    )
    filled = F.when(needs, F.coalesce("_fill", F.lit(tx.UNKNOWN))).otherwise(F.col("family"))
    return joined.withColumn("family", filled).withColumn(
        "family_norm", tx.normalize_label(F.col("family"))
    ).select(*df.columns)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def loser_reason(rows: DataFrame, winners: DataFrame, part: Sequence[str], id_col: str, reason) -> DataFrame:
    """Rows that lost to their group's winner, with the winner named.

    ``reason`` maps the winner's columns (prefixed ``kept_``) to text.
    """
    facts = winners.select(*part, F.col(id_col).alias("kept_id"), F.col("source").alias("kept_source"))
    joined = rows.join(facts, list(part)).filter(F.col(id_col) != F.col("kept_id"))
    return joined.withColumn(ql.REASON, reason)


# --- connected components --------------------------------------------------------


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for an undirected edge list; component = smallest node.

    Alternates large-star and small-star steps, so a chain of length n needs about log(n)
    rounds; it goes on until a round changes nothing. A node's smallest neighbour is an
    aggregate with a map-side combine, and goes back to the node's edges over salted keys,
    so a hub with any number of edges is split. Every round is written to cut the plan.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    both = durable(both)
    previous = None
    while True:
        mirrored = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: link every larger neighbour to the smallest one around.
        large = hand_back(mirrored, "u", F.min("v").alias("m")).filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        ).distinct()
        # Small star: link the node and its smaller neighbours to the smallest one.
        small = hand_back(large, "u", F.min("v").alias("m")).select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        )
        both = durable(
            small.filter("e.v != e.m").select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).distinct()
        )
        state = both.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat("u", "v")))).first()
        if state == previous:
            break
        previous = state
    members = both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(F.col("component").alias("node"), "component").distinct()
    return members.unionByName(roots)


def components(df: DataFrame) -> DataFrame:
    """Attach ``component`` to rows sharing a formula and at least one token.

    Keys, not rows, are the graph: rows with one token need no edge at all, and
    only rows with several tokens link keys of their formula.  The component is
    named after its smallest key.
    """
    node = F.concat_ws("|", F.col("formula_key"), F.element_at("doi_tokens", 1))
    linked = df.filter(F.size("doi_tokens") > 1).select("formula_key", "doi_tokens").distinct()
    edges = linked.select(
        node.alias("a"),
        F.explode(F.slice("doi_tokens", F.lit(2), F.size("doi_tokens"))).alias("token"),
        "formula_key",
    ).select("a", F.concat_ws("|", "formula_key", "token").alias("b"))
    found = connected_components(edges, "a", "b")
    rows = df.withColumn("_node", node)
    return rows.join(found.withColumnRenamed("node", "_node"), "_node", "left").withColumn(
        "component", F.coalesce("component", "_node")
    ).drop("_node")


# --- representatives ---------------------------------------------------------------


def representative_order(room_temperature_c: float = 25.0) -> list[Column]:
    """Source priority, distance to room temperature, value, source row, id."""
    source = F.col("source")
    distance = F.when(source == "liverpool", F.abs(F.col("temperature_c") - room_temperature_c)).otherwise(0.0)
    value = F.when(source == "literature", -F.col("value")).otherwise(0.0)
    return [priority(source, MERGE_PRIORITY), distance, value, F.col("source_row"), F.col("id")]


def pick_representative(df: DataFrame, room_temperature_c: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """One row per component, and the duplicates with the kept row named."""
    kept = keep_first(df, ["component"], representative_order(room_temperature_c))
    reason = F.concat(F.lit("duplicate DOI+formula; kept "), F.col("kept_id"), F.lit(" from "), F.col("kept_source"))
    # The losers need no more of the kept row than its name: found again, narrow, rather than by moving whole rows.
    names = df.select("component", "id", "source", "temperature_c", "value", "source_row")
    winners = keep_first(names, ["component"], representative_order(room_temperature_c))
    return kept, loser_reason(df, winners, ["component"], "id", reason)


def component_audit(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Components of more than one row, one row each: spread, kept row and number of identifiers.

    Members and identifiers are rows of ``component_members`` and ``component_tokens``.
    """
    stats = df.groupBy("component").agg(
        F.count("*").alias("candidate_rows"),
        F.min("log10_value").alias("log10_min"),
        F.max("log10_value").alias("log10_max"),
    ).filter("candidate_rows > 1").withColumn("log10_span", F.col("log10_max") - F.col("log10_min"))
    winners = kept.select(
        "component", "formula_key", F.col("id").alias("kept_id"), F.col("source").alias("kept_source"),
        F.col("value").alias("kept_value"),
    )
    tokens = component_tokens(df).groupBy("component").agg(F.count("*").alias("token_count"))
    return stats.join(winners, "component").join(tokens, "component").withColumn(
        "dropped_rows", F.col("candidate_rows") - 1
    )


def component_members(df: DataFrame) -> DataFrame:
    """The rows of the components in ``component_audit``."""
    repeated = df.groupBy("component").agg(F.count("*").alias("_n")).filter("_n > 1").select("component")
    return spread_join(df.select("component", "id", "source"), repeated, "component")


def component_lists(df: DataFrame, kept: DataFrame, rows_per_list: int = ql.MEMBERS_PER_LIST) -> DataFrame:
    """``component_audit`` with the ordered members, in lists of at most ``rows_per_list``."""
    # Written, since members are counted before they are numbered.
    members = durable(component_members(df))
    lists = member_lists(
        members, ["component"], [F.col("id"), F.col("source")],
        {"ids": F.col("id"), "sources": F.col("source")}, rows_per_list,
    )
    return component_audit(df, kept).join(lists, "component")


def component_tokens(df: DataFrame) -> DataFrame:
    """Distinct identifier tokens of each component, one row per token."""
    pairs = df.select("component", "doi_tokens").distinct()
    return token_rows(pairs, "component").select("component", "token").distinct()


def formula_spans(df: DataFrame) -> DataFrame:
    """Per-formula count and spread, to join back; a combine, not a window."""
    return df.groupBy("formula_key").agg(
        F.count("*").alias("formula_rows"),
        (F.max("log10_value") - F.min("log10_value")).alias("log10_span"),
    )


def span_exclude(df: DataFrame, limit: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Drop every row of a formula whose spread exceeds ``limit``."""
    rows = df.join(formula_spans(df), "formula_key")
    bad = (F.col("formula_rows") > 1) & (F.col("log10_span") > limit)
    reason = F.concat(
        F.lit("conflicting duplicate formula: log10 conductivity span "),
        F.format_string("%.3f", F.col("log10_span")), F.lit(f" > {limit:g}"),
    )
    return ql.split_by_reason(rows, F.when(bad, reason))


def span_keep_highest(df: DataFrame, limit: float = 1.0, room_temperature_c: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """Keep only the highest row of a formula whose spread exceeds ``limit``."""
    spans = formula_spans(df).filter((F.col("formula_rows") > 1) & (F.col("log10_span") > limit))
    source = F.col("source")
    distance = F.when(source == "liverpool", F.abs(F.col("temperature_c") - room_temperature_c)).otherwise(0.0)
    order = [-F.col("value"), priority(source, MERGE_PRIORITY), distance, F.col("source_row"), F.col("id")]
    winners = df.groupBy("formula_key").agg(F.min_by("id", F.struct(*order)).alias("kept_id"))
    facts = spans.join(winners, "formula_key")
    rows = df.join(facts, "formula_key", "left")
    lost = F.col("kept_id").isNotNull() & (F.col("id") != F.col("kept_id"))
    reason = F.concat(
        F.lit("conflicting formula: log10 conductivity span "),
        F.format_string("%.3f", F.col("log10_span")),
        F.lit(f" > {limit:g}; kept highest conductivity row "), F.col("kept_id"),
    )
    kept, removed = ql.split_by_reason(rows, F.when(lost, reason))
    return kept.select(*df.columns), removed.select(*df.columns, ql.REASON)


# --- labels for unknown families -----------------------------------------------------


class Rule:
    """One line of the composition decision list."""

    def __init__(self, label, evidence, has=(), any_of=(), lacks=(), at_least=None, between=None, cations=None):
        self.label, self.evidence = label, evidence
        self.has, self.any_of, self.lacks = has, any_of, lacks
        self.at_least, self.between, self.cations = at_least or {}, between or {}, cations

    def condition(self, composition: Column) -> Column:
        names = fm.symbols(composition)
        parts = [F.array_contains(names, e) for e in self.has]
        parts += [F.arrays_overlap(names, F.array(*[F.lit(e) for e in g])) for g in self.any_of]
        parts += [~F.array_contains(names, e) for e in self.lacks]
        parts += [fm.amount_of(composition, e) >= n for e, n in self.at_least.items()]
        parts += [fm.amount_of(composition, e).between(lo, hi) for e, (lo, hi) in self.between.items()]
        if self.cations:
            rest = fm.total_amount(composition) - fm.amount_of(composition, "O")
            parts.append(rest.between(*self.cations))
        return reduce(lambda a, b: a & b, parts)


HALOGENS = ("F", "Cl", "Br", "I")
CHALCOGENS = ("S", "Se", "Te")
TETRELS = ("Si", "Ge", "Sn")
NASICON_METALS = ("Ti", "Zr", "Ge", "Sn", "Hf", "V", "Nb")

# The first rule that holds names the family.
FAMILY_RULES = (
    Rule("antiperovskite", "Li-H-O-halide", has=("O", "H", "Li"), any_of=(HALOGENS,)),
    Rule("fluorooxoborate", "B-O-F", has=("O", "B", "F")),
    Rule("fluorophosphates", "P-O-F", has=("O", "P", "F")),
    Rule("oxyhalides", "oxide + halide", has=("O",), any_of=(HALOGENS,)),
    Rule("argyrodites", "Li-P-chalcogen-halide", has=("P",), any_of=(CHALCOGENS, HALOGENS)),
    Rule("halides", "chalcogen-halide", any_of=(CHALCOGENS, HALOGENS)),
    Rule("halides", "halide", any_of=(HALOGENS,)),
    Rule("hydrides", "lithium hydride", has=("H", "Li")),
    Rule("nitridosilicates", "nitride + silicon", has=("N", "Si"), lacks=("O",)),
    Rule("nitrides", "nitride", has=("N",), lacks=("O",)),
    Rule("lgps", "Li-M-P-S LGPS-like", has=("P",), any_of=(CHALCOGENS, TETRELS), lacks=("O",), at_least={"Li": 6}),
    Rule("lgps", "Li-M-P-S LGPS-like", has=("P",), any_of=(CHALCOGENS, TETRELS), lacks=("O",), at_least={"S": 8}),
    Rule("thio_lisicon", "Li-M-P-S", has=("P",), any_of=(CHALCOGENS, TETRELS), lacks=("O",)),
    Rule("thio_phosphate", "Li-P-chalcogen", has=("P",), any_of=(CHALCOGENS,), lacks=("O",)),
    Rule("chalcogenidotetrelates", "lithium tetrel chalcogenide", any_of=(CHALCOGENS, TETRELS), lacks=("O",), at_least={"Li": 3}),
    Rule("sulfides", "chalcogenide", any_of=(CHALCOGENS,), lacks=("O",)),
    Rule("borophosphates", "B-P-O", has=("O", "P", "B")),
    Rule("nasicon", "M-P3-O12 NASICON-like", has=("O", "P"), any_of=(NASICON_METALS,), at_least={"P": 2.5, "O": 10}),
    Rule("lisicon", "Li-(Si/Ge)-P-O", has=("O", "P"), any_of=(("Si", "Ge"),)),
    Rule("phosphates", "phosphate", has=("O", "P")),
    Rule("borates", "borate", has=("O", "B")),
    Rule("molybdates", "molybdate", has=("O", "Mo")),
    Rule("garnet", "Li-La-O12 garnet-like", has=("O", "Li", "La"), at_least={"O": 10, "Li": 5}),
    Rule("perovskites", "ABO3 stoichiometry", has=("O",), between={"O": (2.5, 3.5)}, cations=(1.5, 2.5)),
    Rule("silicates", "silicate", has=("O", "Si")),
    Rule("germanates", "germanate", has=("O", "Ge")),
    Rule("oxides", "oxide", has=("O",)),
)


def family_by_composition(composition: Column) -> Column:
    """Struct (family, evidence) of the first matching rule."""
    picked = F.coalesce(*[
        F.when(rule.condition(composition), F.struct(
            F.lit(rule.label).alias("family"), F.lit(f"composition: {rule.evidence}").alias("evidence")
        ))
        for rule in FAMILY_RULES
    ], F.struct(
        F.lit("other").alias("family"), F.lit("composition: taxonomy fallback").alias("evidence")
    ))
    unreadable = F.struct(
        F.lit("other").alias("family"), F.lit("composition fallback: unreadable").alias("evidence")
    )
    return F.when(composition.isNull(), unreadable).otherwise(picked)


def _specific(labels: Column) -> Column:
    """Ignore a generic ``other`` when another label exists."""
    known = F.coalesce(labels, F.array().cast("array<string>"))
    return F.when(F.size(known) > 1, F.array_except(known, F.array(F.lit("other")))).otherwise(known)


def label_cascade(df: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label unknown families: by formula, by identifier series, by composition.

    Returns all rows with the new family, and one audit row per labelled row.
    """
    by_formula = ql.label_sets(references, F.col("formula_key"), "formula_key").withColumnRenamed("labels", "_by_formula")
    known = references.filter(F.col("family_norm") != tx.UNKNOWN)
    series = token_rows(known.select("family_norm", "doi_tokens").distinct(), "family_norm")
    by_token = series.select("token", "family_norm").distinct()
    unknown = F.col("family_norm") == tx.UNKNOWN
    lists = df.filter(unknown).select("doi", "doi_tokens").distinct()
    by_doi = token_rows(lists, "doi").join(by_token, "token").select("doi", "family_norm").distinct()
    by_doi = by_doi.groupBy("doi").agg(F.array_sort(F.collect_list("family_norm")).alias("_by_doi"))

    # Rows with a family go past the lookups.
    wanting = F.coalesce(unknown, F.lit(False))
    rows = df.filter(wanting).join(by_formula, "formula_key", "left").join(by_doi, "doi", "left").withColumns({
        "_formula_options": _specific(F.col("_by_formula")),
        "_doi_options": _specific(F.col("_by_doi")),
    })
    guess = df.filter(unknown).select("formula").distinct()
    guess = guess.select("formula", family_by_composition(fm.parse_formula(F.col("formula"))).alias("_guess"))
    rows = rows.join(guess, "formula", "left")
    one_formula = F.size("_formula_options") == 1
    one_doi = F.size("_doi_options") == 1
    conflicts = F.array_sort(F.array_union("_formula_options", "_doi_options"))
    evidence = F.concat(
        F.col("_guess.evidence"),
        F.when(F.size(conflicts) > 0, F.concat(
            F.lit("; conflicting_reference_labels="), F.array_join(conflicts, "|")
        )).otherwise(""),
    )

    def choose(high: Column, medium: Column, low: Column) -> Column:
        return F.when(one_formula, high).when(one_doi, medium).otherwise(low)

    rows = rows.withColumns({
        "recommended_family": F.when(unknown, choose(
            F.get("_formula_options", 0), F.get("_doi_options", 0), F.col("_guess.family"))),
        "confidence": choose(F.lit("high"), F.lit("medium"), F.lit("low")),
        "assignment_method": choose(
            F.lit("exact_formula_unique_family"), F.lit("doi_series_unique_family"), F.lit("composition_rule")),
        "evidence": choose(
            F.array_join("_formula_options", "|"), F.array_join("_doi_options", "|"), evidence),
    })
    audit = rows.select(
        "id", "formula_key", "doi", "source", F.col("family").alias("previous_family"),
        "recommended_family", "confidence", "assignment_method", "evidence",
    )
    named = rows.withColumn("family", F.coalesce("recommended_family", "family")).select(*df.columns)
    labelled = named.unionByName(df.filter(~wanting)).withColumn(
        "family_norm", tx.normalize_label(F.col("family"))
    ).select(*df.columns)
    return labelled, audit


# --- one row per formula ----------------------------------------------------------------

# Formulas whose family label is too broad, and structures to prefer.
# The texts are turned into keys by ``formula_key``.
FORMULA_RELABEL = {"LiNbCl4O": "oxyhalides", "LiTaCl4O": "oxyhalides"}
FORMULA_PREFERRED = {"Li1.6Al0.6Ge1.4P3O12": "nasicon", "Li10Sn(PS6)2": "lgps", "Li7P3S11": "thio_lisicon"}


def formula_table(spark, mapping: Mapping[str, str], value: str) -> DataFrame:
    """Small dimension keyed by formula key."""
    rows = small_table(spark, list(mapping.items()), f"formula string, {value} string")
    return rows.select(fm.formula_key(fm.parse_formula(F.col("formula"))).alias("formula_key"), value)


def one_per_formula(df: DataFrame, preferred: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Highest row per formula, inside the preferred family when it occurs.

    Expects ``checked_rank``, ``source_rank`` and ``row_order``.
    """
    rows = df
    if preferred is not None:
        rows = df.join(F.broadcast(preferred), "formula_key", "left")
    else:
        rows = df.withColumn("preferred_family", F.lit(None).cast("string"))
    other_family = F.when(F.col("family_norm") == F.col("preferred_family"), 0).otherwise(1)
    order = [other_family, -F.col("value"), F.col("checked_rank"), F.col("source_rank"), F.col("row_order"), F.col("id")]
    kept = keep_first(rows, ["formula_key"], order)
    reason = F.concat(
        F.lit("same formula representative selection; kept "), F.col("kept_id"),
        F.lit(" with highest reported conductivity"),
    )
    lost = loser_reason(rows, kept, ["formula_key"], "id", reason)
    return kept, lost


def formula_audit(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Formulas with several records, one row each: spread, median, families and rule.

    Their records are rows of ``formula_members``.
    """
    stats = df.groupBy("formula_key").agg(
        F.count("*").alias("candidate_rows"),
        F.count_distinct("value").alias("distinct_values"),
        F.min("log10_value").alias("log10_min"),
        F.max("log10_value").alias("log10_max"),
    ).filter("candidate_rows > 1").withColumn("log10_span", F.col("log10_max") - F.col("log10_min"))
    families = df.select("formula_key", "family_norm").distinct().groupBy("formula_key").agg(
        F.array_join(F.array_sort(F.collect_list("family_norm")), "|").alias("families")
    )
    medians = exact_quantiles(df, ["formula_key"], "log10_value", {"median_log10": 0.5})
    winners = kept.select(
        "formula_key",
        F.coalesce("preferred_family", F.lit("")).alias("preferred_family"),
        F.col("id").alias("kept_id"), F.col("value").alias("kept_value"),
        F.col("source").alias("kept_source"), F.col("family_norm").alias("kept_family"),
    )
    rule = F.when(F.col("preferred_family") != "", F.concat(
        F.lit("highest reported conductivity within "), F.col("preferred_family")
    )).otherwise("highest reported conductivity")
    return (
        stats.join(families, "formula_key").join(medians, "formula_key").join(winners, "formula_key")
        .withColumns({"selection_rule": rule, "dropped_rows": F.col("candidate_rows") - 1})
    )


def formula_members(df: DataFrame) -> DataFrame:
    """The records of the formulas in ``formula_audit``, one row each."""
    repeated = df.groupBy("formula_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("formula_key")
    return spread_join(df.select("formula_key", "id", "conductivity_text", "doi", "source"), repeated, "formula_key")


def formula_lists(df: DataFrame, kept: DataFrame, rows_per_list: int = ql.MEMBERS_PER_LIST) -> DataFrame:
    """``formula_audit`` with the ordered records, in lists of at most ``rows_per_list``."""
    fields = ("id", "conductivity_text", "doi", "source")
    lists = member_lists(
        formula_members(df), ["formula_key"], [F.col(n) for n in fields],
        dict(zip(("ids", "conductivities", "dois", "sources"), map(F.col, fields))), rows_per_list,
    )
    return formula_audit(df, kept).join(lists, "formula_key")


def quality_log(audit: DataFrame) -> DataFrame:
    """One row per issue found in a formula audit."""
    repeated = audit.select(
        F.lit("same_formula_multiple_records").alias("issue_type"),
        F.lit("resolved").alias("severity"),
        "formula_key",
        F.concat(
            F.col("candidate_rows").cast("string"), F.lit(" records; log10 span="),
            F.format_string("%.3f", F.col("log10_span")), F.lit("; kept "), F.col("kept_id"),
        ).alias("details"),
    )
    preferred = F.col("preferred_family") != ""
    conflicting = audit.filter(F.col("families").contains("|")).select(
        F.lit("conflicting_normalized_family").alias("issue_type"),
        F.when(preferred, "resolved_by_preferred_family").otherwise("manual_review").alias("severity"),
        "formula_key",
        F.concat(
            F.col("families"),
            F.when(preferred, F.concat(F.lit("; selected_family="), F.col("preferred_family"))).otherwise(""),
        ).alias("details"),
    )
    return repeated.unionByName(conflicting)
