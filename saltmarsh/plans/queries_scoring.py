"""Queries for feature preparation, models and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from saltmarsh.functions import text as tx
from saltmarsh.operators import evaluation as ev
from saltmarsh.operators import mlprep as ml
from saltmarsh.operators import models as md
from saltmarsh.operators import pairing as pr
from saltmarsh.operators import splits as sp
from saltmarsh.operators import windows as wn
from saltmarsh.plans import flows
from saltmarsh.plans import oracle as orc
from saltmarsh.plans.catalog import query
from saltmarsh.plans.oracle import CTES
from saltmarsh.plans.queries_curation import by_row, rounded_predictions, valid
from saltmarsh.plans.queries_pairs import pairs
from saltmarsh.session import durable, scratch_path
from saltmarsh.sources import views
from saltmarsh.sources.views import TREND_FORMULA, TREND_LINE_EXPRESSIONS

c = F.col
LABELS = pr.LABELS

# --- predictions of a three-class model -------------------------------------------------

SHARES = {
    "forward": ("partkey % 7 + 1", "suppkey % 5 + 1", "orderkey % 3 + 1"),
    "reverse": ("suppkey % 7 + 1", "orderkey % 5 + 1", "partkey % 3 + 1"),
}


def share(direction: str, i: int) -> str:
    parts = SHARES[direction]
    return f"CAST({parts[i]} AS DOUBLE) / CAST({' + '.join(parts)} AS DOUBLE)"


GIVEN = [f"{share(d, i)} AS {d}_probability_{v}" for d in SHARES for i, v in enumerate(LABELS)]
TRUE_LABEL = "CASE partkey % 3 WHEN 0 THEN 'decrease' WHEN 1 THEN 'unchanged' ELSE 'increase' END"
CTES["qgiven"] = f"""SELECT id, doi, family_norm, method, source, value, partkey, {TRUE_LABEL} AS true_label, {', '.join(GIVEN)},
    1.0::DOUBLE / count(*) OVER (PARTITION BY doi) AS weight FROM valid"""
_ALIGNED = ", ".join(f"reverse_probability_{o} AS reverse_aligned_probability_{v}" for v, o in zip(LABELS, reversed(LABELS)))
_MEAN = ", ".join(f"(forward_probability_{v} + reverse_aligned_probability_{v}) / 2.0::DOUBLE AS probability_{v}" for v in LABELS)
CTES["qv"] = f"""SELECT *, CASE WHEN probability_decrease = best THEN 'decrease' WHEN probability_unchanged = best THEN 'unchanged' ELSE 'increase' END AS predicted_label FROM (
    SELECT *, greatest(probability_decrease, probability_unchanged, probability_increase) AS best FROM (SELECT *, {_MEAN} FROM (SELECT *, {_ALIGNED} FROM qgiven)))"""


def given(t):
    """Rows with a true label, a group weight and probabilities of both directions."""
    rows = wn.group_weight(valid(t), "doi")
    return rows.selectExpr(
        "id", "doi", "family_norm", "method", "source", "value", "partkey", f"{TRUE_LABEL} AS true_label", *GIVEN, "weight"
    )


def scored(t):
    return durable(ml.symmetric(given(t)))


# --- feature preparation ----------------------------------------------------------------

NUMBERS = ["value", "log10_value", "temperature_c"]


@query("m01_impute", """SELECT id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM mp WHERE suppkey % 2 = 0)) AS value, coalesce(log10_value, (SELECT quantile_cont(log10_value, 0.5) FROM mp WHERE suppkey % 2 = 0)) AS log10_value,
    coalesce(temperature_c::DOUBLE, 0) AS temperature_c, 0.0::DOUBLE AS absent FROM mp""", "value log10_value temperature_c absent")
def m01(t):
    rows = t.narrow("id", "suppkey", *NUMBERS)
    train = rows.filter("suppkey % 2 = 0")
    columns = [*NUMBERS, "absent"]
    medians = ml.medians(train.withColumn("absent", F.lit(None).cast("double")), columns)
    return ml.impute(rows, columns, medians).select("id", *columns)


CTES["lev"] = """SELECT family_norm, row_number() OVER (ORDER BY family_norm) AS code FROM (SELECT DISTINCT family_norm FROM mp WHERE suppkey % 2 = 0 AND family_norm NOT IN ('unknown', 'lgps'))
    UNION ALL SELECT 'unknown', 0"""


def levels(t):
    train = t.typed.filter("suppkey % 2 = 0 AND family_norm != 'lgps'")
    return ml.category_levels(train, "family_norm")


@query("m02_ordinal", "SELECT id, coalesce(code, 0)::DOUBLE AS code FROM mp LEFT JOIN lev USING (family_norm)", "code")
def m02(t):
    return ml.ordinal(t.typed.select("id", "family_norm"), "family_norm", levels(t)).select("id", "code")


@query("m03_category_levels", "SELECT id, CASE WHEN family_norm IN (SELECT family_norm FROM lev) THEN family_norm ELSE 'unknown' END AS level FROM mp")
def m03(t):
    return ml.native_category(t.typed.select("id", "family_norm"), "family_norm", levels(t)).select("id", "level")


HOT = ["argyrodites", "halides", "oxides", "unknown"]


@query("m04_one_hot", "SELECT id, " + ", ".join(f"CASE WHEN family_norm = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS family__{v}" for v in HOT) + " FROM mp", " ".join(f"family__{v}" for v in HOT))
def m04(t):
    return ml.one_hot(t.typed.select("id", "family_norm"), "family_norm", HOT, "family__").drop("family_norm")


@query("m05_scale", """SELECT id, (log10_value - a) / s AS log10_value, (temperature_c - ta) / ts AS temperature_c FROM mp, (SELECT avg(log10_value) AS a, stddev_pop(log10_value) AS s, avg(temperature_c) AS ta, stddev_pop(temperature_c) AS ts
    FROM mp WHERE suppkey % 2 = 0)""", "log10_value temperature_c")
def m05(t):
    rows = durable(t.typed.select("id", "suppkey", c("log10_value"), c("temperature_c").cast("double")))
    columns = ["log10_value", "temperature_c"]
    return ml.scale(rows, columns, rows.filter("suppkey % 2 = 0")).select("id", *columns)


# --- models -------------------------------------------------------------------------------

MODEL_NUMBERS = ["chi_all", "r_all", "n_li", "tau_cationic", "chi_range_x_r_avg", "entropy_c_l", "atwt_geometric_mean_all", "temperature_c"]


def regression_rows(t):
    """Feature rows with a target, split by identifier group."""
    table = flows.feature_table(t.m)["kept"].filter("log10_value IS NOT NULL AND doi != ''")
    rows = durable(table.select(
        "id", "doi", "family_norm", "log10_value", "sample_weight", *[c(n).cast("double") for n in MODEL_NUMBERS]
    ))
    split = durable(sp.split_group(rows, "doi", 0.2))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    medians = durable(ml.medians(train, MODEL_NUMBERS))
    return ml.impute(train, MODEL_NUMBERS, medians), ml.impute(test, MODEL_NUMBERS, medians)


@query("m06_train_regressors")
def m06(t):
    train, test = regression_rows(t)
    rows = ml.compare_regressors(train, test, MODEL_NUMBERS, "log10_value", "sample_weight", "family_norm")
    return ev.regression_metrics(rows, ["model", "split"], "y_true", "y_pred")


# What the models and reports read of a pair beside its features.
PAIR_COLUMNS = ["pair_id", "group_id", "doi", "family", "formula_a", "formula_b", "value_a", "value_b"]


def training_side(sides):
    return sides.filter("split = 'train'")


def pair_sides(t, found=None, dealt=training_side):
    """Training medians, and pair vectors with the side of their identifier group.

    ``found`` are the pairs, if the caller has them.  Sides, and what ``dealt`` keeps and adds by group, are
    settled on narrow rows, before features stand beside them; no measured group is on two sides.
    """
    rows = pairs(t) if found is None else found
    sides = durable(flows.split_pairs(pr.label_pairs(rows.select(*PAIR_COLUMNS)), 0.2))
    table = durable(pr.pair_table(dealt(sides)))
    medians = durable(ml.medians(pr.usable_pairs(table.filter("split = 'train'")), pr.MODEL_FEATURES))
    filled = durable(flows.filled_pairs(table, medians))
    return medians, filled.filter("split = 'train'"), filled.filter("split = 'validation'")


def pair_rows(t, dealt=lambda sides: sides):
    return pair_sides(t, dealt=dealt)[1:]


@query("m07_train_classifiers")
def m07(t):
    train, test = pair_rows(t)
    frames = []
    for name in ("random_forest", "logistic", "boosted_trees"):
        report = flows.trend_report(test, flows.train_trend_model(train, name))
        frames.append(report["metrics"].withColumn("model", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), frames)


def search(t):
    train, _ = regression_rows(t)
    folds = sp.group_kfold(train, "doi", 3).select("doi", c("fold").cast("int").alias("fold"))
    rows = durable(train.join(folds, "doi"))
    tree = ml.regressors("log10_value", "sample_weight")["decision_tree"]
    return ml.tune(rows, MODEL_NUMBERS, tree, {"maxDepth": [3, 5]}, "fold", "mae", "family_norm")


@query("m08_tune")
def m08(t):
    return ml.trial_table(search(t), t.spark)


CLASSIFIER_GRIDS = {"random_forest": {"maxDepth": [3, 6]}, "logistic": {"regParam": [0.01, 0.1]}}


def classifier_search(t):
    """Folds of pairs and the fitted search of each classifier."""
    def folded(sides):
        """Folds of the training pairs that have features; the others are in no fold."""
        train = training_side(sides)
        described = pr.formula_descriptors(pr.pair_formulas(train))
        usable = pr.usable_pairs(pr.enrich_pairs(train, described).select(*train.columns, pr.REJECT))
        folds = durable(sp.stratified_group_kfold(usable, "doi", "trend_label", LABELS, 2))
        return durable(sp.with_folds(train, folds, "doi"))

    rows = pr.usable_pairs(pair_rows(t, dealt=folded)[0])
    return rows, {name: md.tune_classifier(rows, name, grid, "fold") for name, grid in CLASSIFIER_GRIDS.items()}


@query("m08_tune_classifiers")
def m08c(t):
    rows, found = classifier_search(t)
    frames = [md.fold_trials(fitted, rows, "fold").withColumn("model", F.lit(name)) for name, fitted in found.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("m09_importance")
def m09(t):
    train, _ = regression_rows(t)
    model = ml.fit(train, MODEL_NUMBERS, ml.regressors("log10_value", "sample_weight")["random_forest"], "family_norm")
    return ml.importance(model, MODEL_NUMBERS, t.spark)


def raw_regression_rows(t):
    """As ``regression_rows``, with missing numbers left to the saved preprocessing."""
    table = flows.feature_table(t.m)["kept"].filter("log10_value IS NOT NULL AND doi != ''")
    rows = table.select("id", "doi", "family_norm", "log10_value", "sample_weight", *[c(n).cast("double") for n in MODEL_NUMBERS])
    split = durable(sp.split_group(rows, "doi", 0.2))
    return split.filter("split = 'train'"), split.filter("split = 'test'")


@query("m10_score")
def m10(t):
    """Preprocessing and model are written, read back, and only the reloaded ones score."""
    train, test = raw_regression_rows(t)
    tree = ml.regressors("log10_value", "sample_weight")["decision_tree"]
    path = scratch_path(t.spark, "model")
    md.save(md.saved_pipeline(MODEL_NUMBERS, "family_norm", tree).fit(train), path)
    return ml.score(md.load(path), test, ["id", "doi"])


PROBABILITIES = [f"{p}probability_{v}" for p in ("", "forward_", "reverse_aligned_") for v in LABELS]


@query("m11_score_symmetric", f"SELECT id, predicted_label, {', '.join(f'probability_{v}' for v in LABELS)} FROM qv", " ".join(f"probability_{v}" for v in LABELS))
def m11(t):
    return ml.symmetric(given(t)).select("id", "predicted_label", *[f"probability_{v}" for v in LABELS])


@query("m12_prediction_table", f"""SELECT id, doi, true_label, predicted_label, true_label = predicted_label AS correct, {', '.join(PROBABILITIES)}, (
    {' + '.join(f'abs(forward_probability_{v} - reverse_aligned_probability_{v})' for v in LABELS)}) / 3.0::DOUBLE AS forward_reverse_probability_mae FROM qv""",
    " ".join([*PROBABILITIES, "forward_reverse_probability_mae"]))
def m12(t):
    return ml.prediction_table(ml.symmetric(given(t)), ["id", "doi"], "true_label")


# --- metrics ---------------------------------------------------------------------------------


def f1(i: str, w: str) -> str:
    v = f"'{i}'"
    return f"""CASE WHEN sum({w}) FILTER (WHERE t = {v}) > 0 OR sum({w}) FILTER (WHERE g = {v}) > 0 THEN 2.0::DOUBLE * coalesce(sum({w}) FILTER (WHERE t = {v} AND g = {v}), 0)
        / (coalesce(sum({w}) FILTER (WHERE t = {v}), 0) + coalesce(sum({w}) FILTER (WHERE g = {v}), 0)) ELSE 0.0::DOUBLE END"""


def metrics_sql(keys: str, source: str) -> str:
    """Aggregate class metrics of rows (t, g) per key."""
    recalls = [f"count(*) FILTER (WHERE t = '{v}' AND g = '{v}') / nullif(count(*) FILTER (WHERE t = '{v}'), 0)" for v in LABELS]
    severe = "(t = 'decrease' AND g = 'increase') OR (t = 'increase' AND g = 'decrease')"
    prefix = f"{keys}, " if keys else ""
    return f"""SELECT {prefix}count(*) AS pairs, count(*) FILTER (WHERE t = g) / count(*) AS accuracy, ({' + '.join(f1(v, '1') for v in LABELS)}) / 3.0::DOUBLE AS macro_f1,
        ({' + '.join(f'coalesce({r}, 0)' for r in recalls)}) / count(DISTINCT t) AS balanced_accuracy,
        count(*) FILTER (WHERE t <> 'unchanged' AND t = g) / nullif(count(*) FILTER (WHERE t <> 'unchanged'), 0) AS changed_pair_accuracy,
        count(*) FILTER (WHERE {severe}) AS severe_reversal_count, count(*) FILTER (WHERE {severe}) / count(*) AS severe_reversal_rate,
        count(*) FILTER (WHERE {severe}) / nullif(count(*) FILTER (WHERE t <> 'unchanged'), 0) AS severe_reversal_rate_among_changed FROM ({source}) {'GROUP BY ' + keys if keys else ''}"""


METRIC_DOUBLES = "accuracy macro_f1 balanced_accuracy changed_pair_accuracy severe_reversal_rate severe_reversal_rate_among_changed"
TG = "true_label AS t, predicted_label AS g"


@query("v01_regression_metrics", """SELECT method, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, 1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) AS r2 FROM pred6 GROUP BY method""", "mae rmse r2")
def v01(t):
    return ev.regression_metrics(rounded_predictions(t), ["method"], "y_true", "y_pred")


@query("v02_external_eval", """SELECT r.*, c.spearman, p.comparable AS comparable_pairs, p.inverted AS inverted_pairs, p.tied AS tied_pairs, p.inverted / nullif(p.comparable, 0) AS inversion_rate,
    (p.comparable - 2 * p.inverted - p.tied) / nullif(sqrt(p.comparable::DOUBLE * p.comparable_pred), 0) AS kendall FROM (
    SELECT formula_key AS series, count(*) AS rows_total, count(y_true) AS rows_evaluated, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
        CASE WHEN count(DISTINCT y_true) > 1 THEN 1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) END AS r2, CASE WHEN count(y_true) > 0 THEN 'ok' ELSE 'not_available' END AS status FROM pred6 GROUP BY formula_key) r
    LEFT JOIN pcorr c USING (series) LEFT JOIN ppairs p USING (series)""", "mae rmse r2 spearman inversion_rate kendall")
def v02(t):
    return ev.external_eval(rounded_predictions(t), ["series"], "y_true", "y_pred")


@query("v03_inversions", """SELECT c.series, c.n, p.comparable AS comparable_pairs, p.inverted AS inverted_pairs, p.tied AS tied_pairs, p.inverted / nullif(p.comparable, 0) AS inversion_rate,
    (p.comparable - 2 * p.inverted - p.tied) / nullif(sqrt(p.comparable::DOUBLE * p.comparable_pred), 0) AS kendall FROM pcorr c LEFT JOIN ppairs p USING (series)""", "inversion_rate kendall")
def v03(t):
    return ev.inversions(rounded_predictions(t), ["series"], "y_true", "y_pred")


@query("v04_adjacent_accuracy", """SELECT sum(comparable)::BIGINT AS comparable, sum(correct)::BIGINT AS correct, (sum(comparable) - sum(correct))::BIGINT AS mismatches, sum(correct) / sum(comparable) AS accuracy, 'ok' AS status FROM padj""", "accuracy")
def v04(t):
    return ev.adjacent_accuracy(rounded_predictions(t), ["series"], by_row(), "y_true", "y_pred")


def per_class(v: str) -> str:
    tp, su, pd = (f"coalesce(sum(weight) FILTER (WHERE {w}), 0)" for w in (f"t = '{v}' AND g = '{v}'", f"t = '{v}'", f"g = '{v}'"))
    return f"""SELECT method, '{v}' AS label, CASE WHEN {pd} > 0 THEN {tp} / {pd} ELSE 0 END::DOUBLE AS precision, CASE WHEN {su} > 0 THEN {tp} / {su} ELSE 0 END::DOUBLE AS recall,
        CASE WHEN {su} + {pd} > 0 THEN 2 * {tp} / ({su} + {pd}) ELSE 0 END::DOUBLE AS f1, {su}::DOUBLE AS support, {pd}::DOUBLE AS predicted FROM (SELECT method, weight, {TG} FROM qv) GROUP BY method"""


@query("v05_class_metrics", " UNION ALL ".join(per_class(v) for v in LABELS), "precision recall f1 support predicted")
def v05(t):
    return ev.class_metrics(scored(t), ["method"], "true_label", "predicted_label", c("weight"))


@query("v05_aggregate_metrics", metrics_sql("method", f"SELECT method, {TG} FROM qv"), METRIC_DOUBLES)
def v05a(t):
    return ev.aggregate_metrics(scored(t), ["method"], "true_label", "predicted_label")


@query("v06_group_macro_f1", f"""SELECT count(*) AS groups, avg(s) AS group_macro_f1 FROM (SELECT doi, ({' + '.join(f1(v, 'weight') for v in LABELS)}) / 3.0::DOUBLE AS s FROM (SELECT doi, weight, {TG} FROM qv) GROUP BY doi)""", "group_macro_f1")
def v06(t):
    return ev.group_macro_f1(scored(t), "doi", "true_label", "predicted_label", c("weight"))


@query("v07_log_loss", """SELECT method, -sum(weight * ln(least(greatest(p, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))) / sum(weight) AS log_loss FROM (
    SELECT *, CASE true_label WHEN 'decrease' THEN probability_decrease WHEN 'unchanged' THEN probability_unchanged ELSE probability_increase END AS p FROM qv) GROUP BY method""", "log_loss")
def v07(t):
    return ev.log_loss(scored(t), ["method"], "true_label", c("weight"))


@query("v08_ordinal_metrics", """SELECT method, sum(weight * gap) / sum(weight) AS ordinal_mae, coalesce(sum(weight) FILTER (WHERE gap = 2), 0) / sum(weight) AS severe_reversal_rate, count(*) FILTER (WHERE gap = 2) AS severe_reversal_count,
    count(*) FILTER (WHERE gap = 2) / nullif(count(*) FILTER (WHERE true_label <> 'unchanged'), 0) AS severe_share_of_changed FROM (
    SELECT *, abs(list_position(['decrease','unchanged','increase'], true_label) - list_position(['decrease','unchanged','increase'], predicted_label)) AS gap FROM qv) GROUP BY method""", "ordinal_mae severe_reversal_rate severe_share_of_changed")
def v08(t):
    return ev.ordinal_metrics(scored(t), ["method"], "true_label", "predicted_label", c("weight"))


@query("v09_confusion", """SELECT m.method, a.l AS true_label, b.l AS predicted_label, count(q.id) AS row_count, coalesce(sum(q.weight), 0.0)::DOUBLE AS weight FROM (SELECT DISTINCT method FROM qv) m
    CROSS JOIN (VALUES ('decrease'), ('unchanged'), ('increase')) a(l) CROSS JOIN (VALUES ('decrease'), ('unchanged'), ('increase')) b(l)
    LEFT JOIN qv q ON q.method = m.method AND q.true_label = a.l AND q.predicted_label = b.l GROUP BY m.method, a.l, b.l""", "weight")
def v09(t):
    return ev.confusion(scored(t), ["method"], "true_label", "predicted_label", c("weight"))


SCOPED = " UNION ALL ".join(f"SELECT {e} AS scope, {TG} FROM qv WHERE {w}" for e, w in (
    ("'overall'", "TRUE"), ("'high'", "value >= 1e-3::DOUBLE"), ("'dataset_v1'", "source = 'v1'"), ("'family_' || family_norm", "TRUE")))


@query("v10_scoped_metrics", metrics_sql("scope", SCOPED), METRIC_DOUBLES)
def v10(t):
    scopes = {"overall": F.lit(True), "high": c("value") >= 1e-3, "dataset_v1": c("source") == "v1"}
    return ev.scoped_metrics(scored(t), scopes, "true_label", "predicted_label", F.concat(F.lit("family_"), "family_norm"))


@query("v11_compare_models", f"""SELECT q.*, 'primary' AS comparison_set, CASE model WHEN 'solution' THEN 0 ELSE 1 END::BIGINT AS model_order FROM ({metrics_sql('method', f'SELECT method, {TG} FROM qv').replace('SELECT method, count', 'SELECT method AS model, count', 1)}) q WHERE model IN ('solution', 'ball_milling')""", METRIC_DOUBLES)
def v11(t):
    metrics = ev.aggregate_metrics(scored(t), ["method"], "true_label", "predicted_label").withColumnRenamed("method", "model")
    return ev.compare_models(metrics, ["solution", "ball_milling"], "primary")


@query("v12_cv_summary", f"""SELECT source, avg(accuracy) AS mean_accuracy, avg(macro_f1) AS mean_macro_f1, stddev_pop(accuracy) AS std_accuracy, stddev_pop(macro_f1) AS std_macro_f1 FROM (
    {metrics_sql('source, fold', f"SELECT source, CAST(floor({orc.hash_fraction('doi', 'fold42')} * 5) AS BIGINT) AS fold, {TG} FROM qv")}) GROUP BY source""", "mean_accuracy mean_macro_f1 std_accuracy std_macro_f1")
def v12(t):
    folds = ev.aggregate_metrics(sp.kfold(scored(t), "doi", 5), ["source", "fold"], "true_label", "predicted_label")
    return ev.cv_summary(folds, ["source"], ["accuracy", "macro_f1"])


@query("v13_combined_eval", metrics_sql("method", f"SELECT method, {TG} FROM qv"), METRIC_DOUBLES)
def v13(t):
    rows = scored(t)
    named = {"general": "v1", "halide": "caltech", "collected": "literature", "survey": "liverpool"}
    frames = {name: rows.filter(c("source") == source) for name, source in named.items()}
    return ev.combined_eval(frames, ["method"], "true_label", "predicted_label")


@query("j09_wide_predictions", "SELECT partkey, " + ", ".join(
    f"max(predicted_label) FILTER (WHERE method = '{v}') AS {v}_predicted_label, max(n) FILTER (WHERE method = '{v}') AS {v}_n" for v in ("ball_milling", "solid_state", "solution")
) + " FROM (SELECT partkey, method, min(predicted_label) AS predicted_label, count(*) AS n FROM qv GROUP BY partkey, method) GROUP BY partkey")
def j09(t):
    per_model = scored(t).groupBy("partkey", "method").agg(F.min("predicted_label").alias("predicted_label"), F.count("*").alias("n"))
    frames = {v: per_model.filter(c("method") == v) for v in ("ball_milling", "solid_state", "solution")}
    return ev.wide_predictions(frames, "partkey", [], ["predicted_label", "n"])


@query("j10_overlap_audit", """WITH tr AS (SELECT * FROM pairs_sql WHERE method = 'solution'), te AS (SELECT * FROM pairs_sql WHERE method <> 'solution'),
    fs AS (SELECT formula_a AS f FROM tr UNION SELECT formula_b FROM tr), ps AS (SELECT DISTINCT least(formula_a, formula_b) AS x, greatest(formula_a, formula_b) AS y FROM tr)
    SELECT pair_id, formula_a IN (SELECT f FROM fs) AS a_seen, formula_b IN (SELECT f FROM fs) AS b_seen, formula_a IN (SELECT f FROM fs) OR formula_b IN (SELECT f FROM fs) AS either_seen,
        ps.x IS NOT NULL AS pair_seen FROM te LEFT JOIN ps ON ps.x = least(formula_a, formula_b) AND ps.y = greatest(formula_a, formula_b)""")
def j10(t):
    rows = pairs(t)
    out = ev.overlap_audit(rows.filter("method != 'solution'"), rows.filter("method = 'solution'"), "formula_a", "formula_b")
    return out.select("pair_id", "a_seen", "b_seen", "either_seen", "pair_seen")


# --- reports on segmented files -------------------------------------------------------------

PLACE = ["ts", "line_id"]
# Differences of these measurements are whole steps of 5e-5, so no rounding meets the threshold.
STEP = 7.5e-5
CTES["tline"] = f"""SELECT x.*, {TREND_FORMULA} AS formula, pf.family FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in TREND_LINE_EXPRESSIONS.items())}
    FROM (SELECT *, (SELECT count(*) FROM part) AS parts FROM events)) x JOIN pf ON pf.p_partkey = x.part_no"""
CTES["tseg"] = f"""SELECT *, {orc.parse_scientific('measure')} AS row_value, {orc.strip('formula')} AS row_formula FROM (
    SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER w AS segment_no, last_value(label IGNORE NULLS) OVER w AS segment_label
    FROM tline WINDOW w AS (PARTITION BY file ORDER BY ts, line_id ROWS UNBOUNDED PRECEDING)) WHERE NOT is_header AND segment_no > 0"""
CTES["trow"] = f"""SELECT *, {orc.normalize_label('family')} AS fam, CASE WHEN line_id % 3 <> 0 OR line_id % 2 = 0 THEN {orc.normalize_label('family')} ELSE 'unknown' END AS told,
    CASE WHEN file % 2 = 0 THEN 'general' ELSE 'halide' END AS dataset FROM tseg WHERE row_value IS NOT NULL AND row_formula <> ''"""
_HOST = {s: orc.strip(f"split_part(row_formula{s}, ' + ', 1)") for s in ("", "_b")}


def segment_pair_sql(family: str, more: str, extra: str) -> str:
    return f"""SELECT *, printf('exp_pair_%04d', row_number() OVER (ORDER BY {more} segment_no, line_id_a)) AS pair_id FROM (
        SELECT file, dataset, segment_no::BIGINT AS segment_no, file || ':' {extra} || segment_no || ':' || segment_label AS group_id, row_id AS row_id_a, row_id_b, line_id AS line_id_a, line_id_b,
            {_HOST['']} AS formula_a, {_HOST['_b']} AS formula_b, row_formula <> {_HOST['']} OR row_formula_b <> {_HOST['_b']} AS additive_omitted, row_value AS value_a, value_b,
            CASE WHEN {family} = family_b THEN {family} ELSE 'mixed' END AS family, method AS method_a, method_b,
            CASE WHEN value_b - row_value > {STEP}::DOUBLE THEN 'increase' WHEN value_b - row_value < -{STEP}::DOUBLE THEN 'decrease' ELSE 'unchanged' END AS trend_label
        FROM (SELECT *, 'm' || line_id % 4 AS method, lead(row_id) OVER w AS row_id_b, lead(line_id) OVER w AS line_id_b, lead(row_formula) OVER w AS row_formula_b, lead(row_value) OVER w AS value_b,
            lead({family}) OVER w AS family_b, 'm' || lead(line_id) OVER w % 4 AS method_b FROM trow WINDOW w AS (PARTITION BY file, segment_no ORDER BY ts, line_id))
        WHERE row_id_b IS NOT NULL)"""


CTES["tpair"] = segment_pair_sql("told", "file,", "")
CTES["xpair"] = segment_pair_sql("fam", "file, dataset,", "|| dataset || ':'")
KEPT = "pair_id, group_id, row_id_a, row_id_b, line_id_a, line_id_b, formula_a, formula_b, additive_omitted, value_a, value_b, family, trend_label"


def trend_lines(t):
    return durable(views.trend_lines(t.spark, t.sf_dir))


def annotations(lines):
    """Families by row id for two of three lines, by line for every second one."""
    rows = lines.filter("NOT is_header").withColumns({
        "row_formula": tx.strip(c("formula")), "family": tx.normalize_label(c("family")),
    })
    by_id = rows.filter("line_id % 3 != 0").select("row_id", F.lit(None).cast("bigint").alias("line_id"), "row_formula", "family")
    by_line = rows.filter("line_id % 2 = 0").select(F.lit(None).cast("string").alias("row_id"), "line_id", "row_formula", "family")
    return by_id.unionByName(by_line)


def summary_of(lines):
    """The flat table that grouped files are reconciled with."""
    value = tx.parse_scientific(c("measure"))
    rows = lines.filter("NOT is_header").select(
        "row_id", tx.strip(c("formula")).alias("row_formula"), value.alias("row_value"), tx.normalize_label(c("family")).alias("family"),
        F.concat(F.lit("m"), c("line_id") % 4).alias("method"),
    ).filter("row_value IS NOT NULL AND row_formula != ''")
    # Rows before the first header of a file are in no group.
    first = lines.filter("is_header").groupBy("file").agg(F.min(F.struct(*PLACE)).alias("first"))
    grouped = lines.join(first, "file").filter(F.struct(*PLACE) > c("first")).select("row_id")
    return rows.join(grouped, "row_id", "left_semi")


def text_lines(lines):
    return lines.select("file", "ts", "line_id", "text")


def grouped_files(t):
    lines = trend_lines(t)
    return flows.reconciled_pairs(
        text_lines(lines), summary_of(lines), ["file"], PLACE, F.when(c("file") % 2 == 0, "general").otherwise("halide"), STEP
    )


@query("v14_trend_pairs", f"SELECT {KEPT} FROM tpair", "value_a value_b")
def v14p(t):
    lines = trend_lines(t)
    rows = flows.segment_rows(text_lines(lines), ["file"], PLACE, annotations(lines))
    return flows.segment_trend_pairs(rows, ["file"], PLACE, STEP).select(*KEPT.split(", "))


@query("v14_trend_report")
def v14(t):
    lines = trend_lines(t)
    medians, train, _ = pair_sides(t)
    model = flows.train_trend_model(train)
    return flows.trend_report_of_segments(text_lines(lines), ["file"], PLACE, annotations(lines), model, medians, STEP)["predictions"]


@query("v15_reconciliation", "SELECT row_id, 'same' AS status FROM trow")
def v15r(t):
    return grouped_files(t)["reconciliation"]


TRAINED = """tf AS (SELECT formula_a AS f FROM pairs_sql UNION SELECT formula_b FROM pairs_sql),
    tp AS (SELECT DISTINCT least(formula_a, formula_b) AS x, greatest(formula_a, formula_b) AS y FROM pairs_sql),
    audited AS (SELECT p.*, formula_a IN (SELECT f FROM tf) AS a_seen, formula_b IN (SELECT f FROM tf) AS b_seen, tp.x IS NOT NULL AS pair_seen
        FROM xpair p LEFT JOIN tp ON tp.x = least(formula_a, formula_b) AND tp.y = greatest(formula_a, formula_b))"""


@query("v15_overlap", f"""WITH {TRAINED} SELECT {KEPT}, dataset, method_a, method_b, a_seen, b_seen, a_seen OR b_seen AS either_seen, pair_seen FROM audited""", "value_a value_b")
def v15o(t):
    """Every pair of the grouped files with its truth and what training has seen of it."""
    out = ev.overlap_audit(grouped_files(t)["pairs"], pairs(t), "formula_a", "formula_b")
    return out.select(*KEPT.split(", "), "dataset", "method_a", "method_b", "a_seen", "b_seen", "either_seen", "pair_seen")


def comparison(t):
    found = pairs(t)
    medians, train, _ = pair_sides(t, found)
    featured = durable(flows.trend_features(grouped_files(t)["pairs"]))
    table = durable(flows.filled_pairs(featured, medians))
    models = {name: flows.train_trend_model(train, name) for name in ("random_forest", "logistic")}
    return flows.experimental_comparison(table, found, models)


USABLE = "SELECT a.*, a_seen OR b_seen AS either_seen FROM audited a JOIN tdok x ON x.formula = formula_a JOIN tdok y ON y.formula = formula_b"
SCOPES = {
    "'overall'": "TRUE", "'max_sigma_ge_0.001'": "greatest(value_a, value_b) >= 1e-3::DOUBLE", "'both_sigma_ge_0.001'": "least(value_a, value_b) >= 1e-3::DOUBLE",
    "'both_endpoints_unseen_in_training'": "NOT either_seen", "'family_' || family": "TRUE", "'dataset_' || dataset": "TRUE",
}


@query("v15_scope_counts", f"""WITH {TRAINED}, usable AS ({USABLE}) SELECT model, scope, count(*) AS pairs, (SELECT count(*) FROM audited) - (SELECT count(*) FROM usable) AS rejected_pairs FROM (
    {' UNION ALL '.join(f'SELECT {name} AS scope FROM usable WHERE {held}' for name, held in SCOPES.items())}) CROSS JOIN (VALUES ('random_forest'), ('logistic')) m(model) GROUP BY model, scope""")
def v15s(t):
    """Pairs that each model was measured on, by scope, and those without features."""
    return comparison(t)["metrics"].select("model", "scope", "pairs", "rejected_pairs")


@query("v15_experimental_comparison")
def v15(t):
    return comparison(t)["metrics"]
