"""End-to-end flows built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import physics as ph
from saltmarsh.functions import text as tx
from saltmarsh.operators import composition as cp
from saltmarsh.operators import entity as en
from saltmarsh.operators import evaluation as ev
from saltmarsh.operators import mlprep as ml
from saltmarsh.operators import models as md
from saltmarsh.operators import pairing as pr
from saltmarsh.operators import quality as ql
from saltmarsh.operators import splits as sp
from saltmarsh.operators import windows as wn
from saltmarsh.session import durable

class Bundle(Mapping):
    """Named results of a flow; one given as a function is built when it is first asked for."""

    def __init__(self, results: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._results = dict(results)

    def __getitem__(self, name: str) -> DataFrame:
        found = self._results[name]
        if not isinstance(found, DataFrame):
            found = self._results[name] = found()
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(self._results)

    def __len__(self) -> int:
        return len(self._results)


def curate_single(df: DataFrame, span_limit: float = 0.5) -> Bundle:
    """One source: reject unreadable rows, audit duplicates, drop conflicting formulas."""
    rows = durable(ql.with_formula(ql.parse_measurements(df)))
    valid, rejected = ql.reject_first(rows, [
        (F.col("formula_error") != "", F.concat(F.lit("unparseable formula: "), F.col("formula_error"))),
        (~F.coalesce(F.col("value") > 0, F.lit(False)), "missing or unparseable room-temperature conductivity"),
    ])
    kept, conflicts = en.span_exclude(valid, span_limit)
    columns = [*valid.columns]
    removed = rejected.select(*columns, ql.REASON).unionByName(conflicts.select(*columns, ql.REASON))
    return Bundle({
        "kept": kept.select(*columns), "removed": removed,
        "audit": lambda: ql.dup_audit(valid), "audit_members": lambda: ql.dup_members(valid),
        "audit_lists": lambda: ql.dup_lists(valid),
    })


# What the steps of ``curate_sources`` read of a typed candidate.
CURATION_COLUMNS = (
    "id", "source", "source_row", "formula", "formula_key", "doi", "doi_tokens", "family", "family_norm", "value",
    "log10_value", "temperature_c",
)


def curate_sources(
    sources: Mapping[str, DataFrame], *, span_limit: float = 1.0, room_temperature_c: float = 25.0, keep: Sequence[str] | None = None
) -> Bundle:
    """Several sources: validate, fill families, merge duplicates, resolve spans, label.

    The validated candidates are read by many later steps, so they are
    materialized once in the shared folder.  ``keep`` names the columns that the caller
    wants of the kept rows beside ``CURATION_COLUMNS``; without it they have all.
    """
    rows = en.candidates(**sources)
    tagged = en.tag_candidates(rows, room_temperature_c=room_temperature_c)
    if keep is not None:
        tagged = tagged.select(*dict.fromkeys([*CURATION_COLUMNS, *keep, ql.REASON]))
    tagged = durable(tagged)
    valid, invalid = en.split_candidates(tagged)
    valid = durable(en.fill_by_overlap(valid))
    grouped = durable(en.components(valid))
    merged, duplicates = en.pick_representative(grouped, room_temperature_c)
    merged = durable(merged)
    kept, spans = en.span_keep_highest(merged, span_limit, room_temperature_c)
    labelled, family_audit = en.label_cascade(kept, valid)
    columns = ["id", "source", "formula_key", "doi", "value"]
    removed = (
        invalid.select(*columns, ql.REASON)
        .unionByName(duplicates.select(*columns, ql.REASON))
        .unionByName(spans.select(*columns, ql.REASON))
    )
    return Bundle({
        "kept": labelled,
        "removed": removed,
        "audit": lambda: en.component_audit(grouped, merged),
        "audit_members": lambda: en.component_members(grouped),
        "audit_lists": lambda: en.component_lists(grouped, merged),
        "family_audit": family_audit,
        "family_share": lambda: ql.family_share(labelled),
    })


SOURCE_MARKERS = (("liverpool", "liverpool"), ("caltech", "caltech"), ("literature_additions", "literature"))


def model_clean(
    df: DataFrame, *, minimum: float = 1e-6, low_c: float = 20.0, high_c: float = 30.0, excluded_ids: Sequence[str] = (),
) -> Bundle:
    """One model-ready row per formula.

    Expects typed rows (``parse_measurements`` and ``with_formula``), a ``ref``
    path text, ``note``, ``checked`` and ``row_order``.
    """
    source = tx.source_tag(F.col("ref"), SOURCE_MARKERS, "v1")
    rows = df.withColumns({
        "source": source,
        "source_rank": en.priority(source, en.SELECT_PRIORITY),
        "checked_rank": tx.truthy_rank(F.col("checked")),
        "noted_temperature_c": tx.note_value(F.col("note"), "measured_temperature_C"),
    })
    relabel = en.formula_table(df.sparkSession, en.FORMULA_RELABEL, "_relabel")
    rows = rows.join(F.broadcast(relabel), "formula_key", "left").withColumn(
        "family_norm", F.coalesce("_relabel", "family_norm")
    ).drop("_relabel")
    value, temperature = F.col("value"), F.col("noted_temperature_c")
    eligible, rejected = ql.reject_first(rows, [
        (F.col("formula_key").isNull(), F.concat(F.lit("unparseable formula: "), F.coalesce("formula_error", F.lit("")))),
        (~F.coalesce(value > 0, F.lit(False)), "invalid or non-positive conductivity"),
        (value < minimum, f"model threshold: conductivity < {minimum:g}"),
        ((F.col("source") == "liverpool") & ~F.coalesce(temperature.between(low_c, high_c), F.lit(False)),
         f"Liverpool temperature outside model range [{low_c:g}, {high_c:g}] C"),
        ((F.col("source") == "caltech") & F.col("id").isin(*excluded_ids) if excluded_ids else F.lit(False),
         "explicitly excluded Caltech high-temperature extrapolation record"),
    ])
    eligible = durable(eligible)
    preferred = en.formula_table(df.sparkSession, en.FORMULA_PREFERRED, "preferred_family")
    kept, lost = en.one_per_formula(eligible, preferred)
    removed = rejected.select("id", "source", "formula_key", ql.REASON).unionByName(
        lost.select("id", "source", "formula_key", ql.REASON)
    )
    out = Bundle({
        "kept": kept, "removed": removed,
        "formula_audit": lambda: en.formula_audit(eligible, kept), "formula_members": lambda: en.formula_members(eligible),
        "formula_lists": lambda: en.formula_lists(eligible, kept),
        "quality_log": lambda: en.quality_log(out["formula_audit"]), "summary": lambda: ql.accounting(kept, removed),
    })
    return out


def clean_raw(df: DataFrame, limit: float = 6.0, listed_ids: Sequence[str] = ()) -> Bundle:
    """Drop organic formulas, then formulas whose charges do not balance."""
    rows = ql.with_formula(df)
    kept, organic = ql.drop_organic(rows)
    balanced, abnormal = ql.drop_charge_abnormal(kept, limit, listed_ids)
    columns = ["id", "source", "formula", ql.REASON]
    removed = organic.select(*columns).unionByName(abnormal.select(*columns))
    return Bundle({"kept": balanced, "removed": removed, "summary": lambda: ql.accounting(balanced, removed)})


METADATA_COLUMNS = (
    "id", "source", "source_row", "formula", "formula_key", "formula_full", "formula_error", "composition",
    "conductivity_text", "doi_text", "doi", "doi_tokens", "family", "family_norm", "temperature_c", "method",
    "note", "checked", "orderkey", "partkey", "suppkey", "value", "value_used", "qualifier", "log10_value",
    "sample_weight", cp.CHARGES_JSON,
)


def feature_table(df: DataFrame, minimum: float | None = 1e-6) -> Bundle:
    """Threshold first, then descriptors once per distinct formula, then joins.

    Rows whose formula has no descriptor are quarantined with their reason.
    """
    rows = durable(ql.with_formula(ql.parse_measurements(df)))
    kept, low = ql.threshold_policy(rows, minimum)
    good, failed = cp.quarantine(kept, "id", F.col("formula_error"))
    table = durable(cp.descriptors(cp.compositions(kept)))
    featured = good.join(table, "formula")
    removed = low.select("id", ql.REASON).unionByName(failed.select("id", ql.REASON))
    return Bundle({"kept": featured, "removed": removed})


def trend_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed measurement rows that can be paired, and the others with their reason."""
    return ql.reject_first(df, [
        (F.coalesce(F.col("formula_error") != "", F.lit(True)), F.concat(F.lit("unparseable formula: "), F.coalesce("formula_error", F.lit("")))),
        (~F.coalesce(F.col("value") > 0, F.lit(False)), "missing or non-positive value"),
        (~F.coalesce(F.size("doi_tokens") > 0, F.lit(False)), "no DOI"),
    ])


def trend_pairs(df: DataFrame) -> DataFrame:
    """Comparison pairs of typed measurement rows with a readable formula and number (``trend_rows`` has the others)."""
    usable, _ = trend_rows(df)
    rows = pr.pairing_input(usable).select(
        "id", "formula", "conductivity_text", "value", "vector", "element_set",
        "doi", "method", "temperature_c", F.col("family_norm").alias("family"), "kind",
    )
    return pr.build_pairs(rows)


def train_trend_model(train: DataFrame, name: str = "random_forest"):
    """Swap-augmented, weighted three-class model on the pair columns of the pairs that have them."""
    filled = pr.usable_pairs(train).withColumn("label_index", ml.label_index(F.col("trend_label")))
    rows = pr.augment(filled).withColumn("label_index", ml.label_index(F.col("trend_label")))
    return ml.fit(rows, pr.MODEL_FEATURES, md.classifiers("label_index", "training_weight")[name])


def trend_report(table: DataFrame, model, threshold: float = pr.THRESHOLD) -> Bundle:
    """Score pairs both ways and measure the labels; pairs without features have no prediction but their reason."""
    scored = ml.score_pairs(model, pr.usable_pairs(table))
    keep = ["pair_id", "group_id", "doi", "family", "formula_a", "formula_b", "pair_weight_group_equal"]
    predictions = ml.prediction_table(scored, keep, "trend_label")
    metrics = ev.aggregate_metrics(predictions, [], "trend_label", "predicted_label")
    if pr.REJECT in table.columns:
        left = pr.rejected_pairs(table).select(*keep, "trend_label", pr.REJECT)
        predictions = predictions.withColumn(pr.REJECT, F.lit("")).unionByName(left, allowMissingColumns=True)
    return Bundle({"predictions": predictions, "metrics": metrics.withColumn("threshold", F.lit(threshold))})


def segment_rows(lines: DataFrame, part: Sequence[str], order: Sequence[str], families: DataFrame) -> DataFrame:
    """Measured rows of segmented files with their family: by row id, else by line, else ``unknown``.

    A row id whose annotation (``row_id``, ``line_id``, ``row_formula``, ``family``) names
    another formula fails the job.
    """
    rows = wn.read_segments(lines, part, [F.col(c) for c in order])
    return en.lookup(rows, families, "row_id", "line_id", "family", same="row_formula")


def segment_trend_pairs(
    rows: DataFrame, part: Sequence[str], order: Sequence[str], threshold: float = pr.THRESHOLD, keep: Sequence[str] = ()
) -> DataFrame:
    """Neighbouring rows of each segment as labelled pairs of host formulas.

    Numbered in file order; ``family`` is ``mixed`` where the two differ, and
    ``additive_omitted`` tells that a formula was cut to its host.
    """
    part, order = list(part), list(order)
    cols = ["row_id", "line_id", "row_formula", "row_value", *keep]
    # Written before they are paired and again before they are numbered: both steps read their rows twice.
    slim = durable(rows.select(*part, "segment_no", "segment_label", *[c for c in order if c not in cols], *cols, "family"))
    pairs = pr.segment_pairs(slim, [*part, "segment_no"], [F.col(c) for c in order], cols, "family")
    formula = {s: F.col(f"row_formula_{s}") for s in "ab"}
    delta = F.col("row_value_b") - F.col("row_value_a")
    named = durable(pairs.select(
        *part, "segment_no", F.concat_ws(":", *part, "segment_no", "segment_label").alias("group_id"),
        *[F.col(f"{c}_{s}") for c in ("row_id", "line_id", *keep) for s in "ab"],
        *[tx.host_formula(formula[s]).alias(f"formula_{s}") for s in "ab"],
        (tx.has_additive(formula["a"]) | tx.has_additive(formula["b"])).alias("additive_omitted"),
        F.col("row_value_a").alias("value_a"), F.col("row_value_b").alias("value_b"), "family",
        ph.trend_label(delta, threshold).alias("trend_label"),
    ))
    place = [F.col(c) for c in (*part, "segment_no", "line_id_a")]
    # The numbered pairs are written too, since ids must not change when a task is repeated.
    return durable(wn.surrogate(named, place, "exp_pair_%04d", "pair_id"))


def trend_features(pairs: DataFrame) -> DataFrame:
    """Pairs with the model columns of both formulas, or the reason why there are none."""
    described = pr.formula_descriptors(pr.pair_formulas(pairs))
    weighted = wn.group_weight(pairs, "group_id", "pair_weight_group_equal")
    return pr.pair_features(pr.enrich_pairs(weighted, described))


def filled_pairs(table: DataFrame, medians: DataFrame) -> DataFrame:
    """Pairs with the vectors of their features, the training ``medians`` where one is missing.

    Pairs without features have no vectors.
    """
    held = F.col(pr.REJECT) == "" if pr.REJECT in table.columns else None
    return ml.pair_vectors(table, pr.MODEL_FEATURES, medians, held)


def trend_report_of_segments(
    lines: DataFrame, part: Sequence[str], order: Sequence[str], families: DataFrame, model, medians: DataFrame,
    threshold: float = pr.THRESHOLD,
) -> Bundle:
    """Report on segmented files: rows, families, neighbouring pairs, features, symmetric scores, labels, metrics.

    ``medians`` are those of the model's training pairs.
    """
    pairs = segment_trend_pairs(segment_rows(lines, part, order, families), part, order, threshold)
    featured = durable(trend_features(pairs).withColumn("doi", F.col("group_id")))
    table = durable(filled_pairs(featured, medians))
    report = trend_report(table, model, threshold)
    return Bundle({"pairs": pairs, "predictions": report["predictions"], "metrics": report["metrics"]})


def reconciled_pairs(
    lines: DataFrame, summary: DataFrame, part: Sequence[str], order: Sequence[str], dataset: Column,
    threshold: float = pr.THRESHOLD,
) -> Bundle:
    """Pairs of grouped files whose rows agree with a flat summary (``row_id``, ``row_formula``, ``row_value``, ``family``, ``method``).

    Both sides must have the same ids, formulas and values (``reconciliation`` has a row for
    each id); any difference fails the job when ``pairs`` is built.
    """
    order = list(order)
    # Texts are parsed once: the check and the pairs read the rows of both sides from written tables.
    rows_read = wn.read_segments(lines, part, [F.col(c) for c in order])
    columns = [*part, *order, "segment_no", "segment_label", "row_id", "line_id", "row_formula", "row_value"]
    read = durable(rows_read.select(*dict.fromkeys(columns)))
    summary = durable(summary.select("row_id", "row_formula", "row_value", "family", "method"))
    checked = durable(ql.reconcile(read, summary, "row_id", "row_formula", "row_value"))

    def pairs() -> DataFrame:
        wrong = checked.filter("status != 'same'").limit(10).collect()
        if wrong:
            raise ValueError(f"files and summary differ: {[(r['row_id'], r['status']) for r in wrong]}")
        facts = summary.select("row_id", "family", "method")
        rows = read.join(facts, "row_id").withColumn("dataset", dataset)
        return segment_trend_pairs(rows, [*part, "dataset"], order, threshold, ["method"])

    return Bundle({"reconciliation": checked, "pairs": pairs})


def split_pairs(table: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Pairs with the side of their identifier group."""
    groups = sp.split_groups_to_target(table, "doi", "trend_label", pr.LABELS, fraction)
    return sp.assignments(table, groups, "doi")


def pair_scopes(high: float = 1e-3) -> dict[str, Column]:
    """Overlapping sets of audited pairs that metrics are told for."""
    return {
        "overall": F.lit(True),
        f"max_sigma_ge_{high:g}": F.greatest("value_a", "value_b") >= high,
        f"both_sigma_ge_{high:g}": F.least("value_a", "value_b") >= high,
        "both_endpoints_unseen_in_training": ~F.col("either_seen"),
    }


def experimental_comparison(table: DataFrame, train: DataFrame, models: Mapping[str, object], high: float = 1e-3) -> Bundle:
    """Several models on the same pairs: wide predictions and scoped metrics.

    Pairs without features have no prediction; the metrics name their number.
    """
    rejected = pr.rejected_pairs(table)
    audited = durable(ev.overlap_audit(pr.usable_pairs(table), train, "formula_a", "formula_b"))
    scopes = pair_scopes(high)
    scored = {name: ml.score_pairs(model, audited) for name, model in models.items()}
    stacked = None
    for name, frame in scored.items():
        tagged = frame.withColumn("model", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    labels = [F.concat(F.lit("family_"), F.col("family"))]
    if "dataset" in table.columns:
        labels.append(F.concat(F.lit("dataset_"), F.col("dataset")))
    scoped = ev.with_scopes(stacked, scopes, *labels)
    metrics = ev.aggregate_metrics(scoped, ["model", "scope"], "trend_label", "predicted_label")
    wide = ev.wide_predictions(
        scored, "pair_id", ["trend_label"], ["predicted_label", *[f"probability_{v}" for v in pr.LABELS]]
    )
    if pr.REJECT in table.columns:
        wide = wide.withColumn(pr.REJECT, F.lit("")).unionByName(
            rejected.select("pair_id", "trend_label", pr.REJECT), allowMissingColumns=True
        )
    left = rejected.agg(F.count("*").alias("rejected_pairs"))  # one row
    return Bundle({"metrics": metrics.join(F.broadcast(left), F.lit(True)), "wide": wide, "audited": audited})
