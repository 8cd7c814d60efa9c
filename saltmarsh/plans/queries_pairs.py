"""Queries for pairs, pair features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import formula as fm
from saltmarsh.functions import physics as ph
from saltmarsh.operators import composition as cp
from saltmarsh.operators import pairing as pr
from saltmarsh.operators import quality as ql
from saltmarsh.operators import splits as sp
from saltmarsh.plans import flows
from saltmarsh.plans import oracle as orc
from saltmarsh.plans.catalog import query
from saltmarsh.plans.oracle import CTES
from saltmarsh.plans.queries_curation import by_line, segment_rows, valid
from saltmarsh.session import durable
from saltmarsh.sources.views import MEASUREMENT_EXPRESSIONS

c = F.col

# --- pairs in SQL ---------------------------------------------------------------------

CTES["fvec"] = """SELECT formula, string_agg(element, ' ' ORDER BY element) AS element_set, list(amount / total ORDER BY element) AS vec FROM comp
    JOIN (SELECT formula, sum(amount) AS total FROM comp GROUP BY formula) USING (formula) GROUP BY formula"""
CTES["pin"] = f"""SELECT id, formula, conductivity_text, value, doi, method, CAST(floor(temperature_c / 25.0) * 25 AS INTEGER) AS temperature_c, family_norm AS family,
        {orc.measure_kind('note')} AS kind, element_set, vec FROM valid JOIN fvec USING (formula) WHERE len(doi_tokens) > 0"""
CTES["pgroup"] = """SELECT doi, method, temperature_c, family, kind, count(DISTINCT element_set) = 1 AS one_set,
    row_number() OVER (ORDER BY doi, method, temperature_c, family, kind) AS group_no FROM pin GROUP BY doi, method, temperature_c, family, kind"""
CTES["prow"] = """SELECT pin.*, g.group_no, g.one_set, row_number() OVER (PARTITION BY g.group_no ORDER BY vec, id) AS rn FROM pin JOIN pgroup g USING (doi, method, temperature_c, family, kind)"""
CTES["praw"] = """SELECT a.group_no, a.vec AS va, b.vec AS vb, a.id AS id_a, b.id AS id_b, a.formula AS formula_a, b.formula AS formula_b, a.conductivity_text AS conductivity_text_a,
        b.conductivity_text AS conductivity_text_b, a.value AS value_a, b.value AS value_b, a.doi, a.method, a.temperature_c, a.family, a.kind
    FROM prow a JOIN prow b ON a.group_no = b.group_no AND ((a.one_set AND b.rn = a.rn + 1) OR (NOT a.one_set AND a.rn < b.rn)) WHERE a.formula <> b.formula"""
CTES["pairs_sql"] = """SELECT printf('trgrp_%04d', group_no) AS group_id, printf('trpair_%06d', row_number() OVER (ORDER BY group_no, va, id_a, vb, id_b)) AS pair_id,
    id_a, id_b, formula_a, formula_b, conductivity_text_a, conductivity_text_b, value_a, value_b, value_b - value_a AS delta, doi, method, temperature_c, family, kind FROM praw"""
CTES["td"] = "SELECT formula, " + ", ".join(
    [f"CASE WHEN {s} > 0 THEN log10({s}) END AS {n}" for n, s in cp.TREND_LOGS.items()]
    + [f"{s} AS x_{n}" for n, s in cp.TREND_SOURCES.items()]
) + " FROM desc_all"
CTES["tdok"] = "SELECT * FROM td WHERE " + " AND ".join(
    f"{n if n in cp.TREND_LOGS else 'x_' + n} IS NOT NULL" for n in cp.TREND_NAMES if n not in cp.TREND_OPTIONAL
)
CTES["pf"] = f"SELECT p_partkey, {MEASUREMENT_EXPRESSIONS['formula']} AS formula, {MEASUREMENT_EXPRESSIONS['family']} AS family FROM part"
CTES["fpairs"] = "SELECT DISTINCT formula_a, formula_b FROM pairs_sql"
CTES["l1"] = """SELECT formula_a, formula_b, sum(abs(coalesce(fb, 0) - coalesce(fa, 0))) AS dist FROM (
    SELECT p.formula_a, p.formula_b, u.element, max(u.f) FILTER (WHERE u.formula = p.formula_a) AS fa, max(u.f) FILTER (WHERE u.formula = p.formula_b) AS fb
    FROM (SELECT DISTINCT formula_a, formula_b FROM fpairs) p JOIN (SELECT formula, element, amount / sum(amount) OVER (PARTITION BY formula) AS f FROM comp) u
        ON u.formula IN (p.formula_a, p.formula_b) GROUP BY ALL) GROUP BY formula_a, formula_b"""


def x(n: str) -> str:
    return n if n in cp.TREND_LOGS else f"x_{n}"


def plain(n: str) -> str:
    """Feature names with one spelling per engine: DuckDB ignores case."""
    return n.replace("n_Li", "li_share").replace("L1", "l1")


def feature_sql(a: str = "ta", b: str = "tb") -> str:
    parts = [f"{b}.{x(n)} - {a}.{x(n)} AS {plain('delta_' + n)}" for n in pr.CHANGES]
    parts += [f"({a}.{x(n)} + {b}.{x(n)}) / 2.0 AS {plain('mean_' + n)}" for n in pr.MEANS]
    parts += [f"abs({b}.{x(n)} - {a}.{x(n)}) AS {plain('abs_delta_' + n)}" for n in pr.MAGNITUDES]
    parts += [f"l1.dist AS {plain(pr.DISTANCE)}"]
    for n in pr.ENDPOINTS:
        parts += [f"{a}.{x(n)} AS {plain('a_' + n)}", f"{b}.{x(n)} AS {plain('b_' + n)}"]
    return ", ".join(parts)


FEATURES = " ".join(plain(n) for n in pr.MODEL_FEATURES)
# Every pair stays; a side without descriptors is null and named in the reason.
CTES["tdwhy"] = "SELECT formula, coalesce(" + ", ".join(
    f"CASE WHEN {n if n in cp.TREND_LOGS else 'x_' + n} IS NULL THEN '{n} undefined' END" for n in cp.TREND_NAMES if n not in cp.TREND_OPTIONAL
) + ", '') AS why FROM td"
JOINED = """p LEFT JOIN tdok ta ON ta.formula = p.formula_a LEFT JOIN tdok tb ON tb.formula = p.formula_b
    LEFT JOIN l1 ON l1.formula_a = p.formula_a AND l1.formula_b = p.formula_b AND ta.formula IS NOT NULL AND tb.formula IS NOT NULL
    LEFT JOIN tdwhy wa ON wa.formula = p.formula_a LEFT JOIN tdwhy wb ON wb.formula = p.formula_b"""


def _told(s: str) -> str:
    why = f"coalesce(w{s}.why, 'unreadable formula')"
    return f"CASE WHEN {why} <> '' THEN coalesce(p.formula_{s}, 'missing formula') || ': ' || {why} END"


REASON = f"array_to_string(list_filter([{_told('a')}, nullif({_told('b')}, {_told('a')})], lambda r: r IS NOT NULL), '; ') AS {pr.REJECT}"
LABEL = "CASE WHEN {d} > {t} THEN 'increase' WHEN {d} < -{t} THEN 'decrease' ELSE 'unchanged' END"
CLASS = "CASE WHEN {d} > {t} THEN 1 WHEN {d} < -{t} THEN -1 ELSE 0 END"


def renamed(df):
    return df.withColumnsRenamed({n: plain(n) for n in df.columns})


def pairs(t):
    """Pairs of the measurement view, temperatures in steps of 25 degrees, written once."""
    columns = ["id", "formula", "conductivity_text", "value", "doi", "doi_tokens", "method", "temperature_c", "family_norm", "note"]
    rows = ql.with_formula(t.narrow(*columns)).withColumn("temperature_c", (F.floor(c("temperature_c") / 25.0) * 25).cast("int"))
    return durable(flows.trend_pairs(rows))


# --- pairs -------------------------------------------------------------------------------


@query("j05_pairs_all", """SELECT a.doi, a.method, a.id AS id_a, b.id AS id_b FROM valid a JOIN valid b ON a.doi = b.doi AND a.method = b.method AND a.family_norm = b.family_norm AND (a.value, a.id) < (b.value, b.id)
    WHERE len(a.doi_tokens) > 0""")
def j05(t):
    rows = durable(valid(t).filter(F.size("doi_tokens") > 0).select("id", "doi", "method", "family_norm", "value"))
    out = pr.pairs_all(rows, ["doi", "method", "family_norm"], ["value", "id"], ["id"], rows_per_block=8)
    return out.select("doi", "method", "id_a", "id_b")


@query("j06_state_combinations", """SELECT formula, residual_charge FROM oxbest""", "residual_charge")
def j06(t):
    return cp.assign_oxidation(t.parsed).select("formula", "residual_charge")


@query("j08_enrich_pairs", f"SELECT p.pair_id, ta.x_chi_all AS chi_a, tb.x_chi_all AS chi_b, ta.x_r_all_pm AS r_a, tb.x_r_all_pm AS r_b, {REASON} FROM pairs_sql {JOINED}", "chi_a chi_b r_a r_b")
def j08(t):
    rows = pairs(t)
    joined = pr.enrich_pairs(rows, pr.formula_descriptors(pr.pair_formulas(rows)))
    return joined.select(
        "pair_id", c("da.chi_all").alias("chi_a"), c("db.chi_all").alias("chi_b"), c("da.r_all_pm").alias("r_a"), c("db.r_all_pm").alias("r_b"),
        pr.REJECT,
    )


@query("p01_build_pairs", "SELECT * FROM pairs_sql", "value_a value_b delta")
def p01(t):
    return pairs(t)


@query("p02_segment_pairs", """SELECT file, segment_no::BIGINT AS segment_no, line_id AS line_id_a, nl AS line_id_b, CASE WHEN kind = nk THEN kind ELSE 'mixed' END AS kind FROM (
    SELECT *, lead(line_id) OVER w AS nl, lead(kind) OVER w AS nk FROM segrows WINDOW w AS (PARTITION BY file, segment_no ORDER BY ts, line_id)) WHERE nl IS NOT NULL""")
def p02(t):
    rows = segment_rows(t).select("file", "segment_no", "ts", "line_id", "kind")
    out = pr.segment_pairs(rows, ["file", "segment_no"], by_line(), ["line_id"], "kind")
    return out.select("file", "segment_no", "line_id_a", "line_id_b", "kind")


@query("p03_trend_label", f"""SELECT file, line_id AS line_id_a, {LABEL.format(d='(nv - value)', t='10.0')} AS label FROM (
    SELECT *, lead(value) OVER w AS nv FROM segrows WINDOW w AS (PARTITION BY file, segment_no ORDER BY ts, line_id)) WHERE nv IS NOT NULL""")
def p03(t):
    rows = segment_rows(t).select("file", "segment_no", "ts", "line_id", "value", "kind")
    out = pr.segment_pairs(rows, ["file", "segment_no"], by_line(), ["line_id", "value"], "kind")
    return out.select("file", "line_id_a", ph.trend_label(c("value_b") - c("value_a"), 10.0).alias("label"))


@query("p04_pair_features", f"SELECT p.pair_id, {REASON}, {feature_sql()} FROM pairs_sql {JOINED}", FEATURES)
def p04(t):
    rows = pairs(t).select("pair_id", "formula_a", "formula_b")
    out = pr.pair_features(pr.enrich_pairs(rows, pr.formula_descriptors(pr.pair_formulas(rows))))
    return renamed(out.select("pair_id", pr.REJECT, *pr.MODEL_FEATURES))


@query("p05_l1_distance", "SELECT formula_a, formula_b, dist FROM l1", "dist")
def p05(t):
    rows = pairs(t).select("formula_a", "formula_b").distinct()
    return rows.select(
        "formula_a", "formula_b",
        fm.l1_distance(fm.parse_formula(c("formula_a")), fm.parse_formula(c("formula_b"))).alias("dist"),
    )


DELTA = "(p.value_b - p.value_a)"


@query("p06_pair_table", f"""SELECT p.pair_id, p.group_id, abs({DELTA}) AS absolute_change, 1e-4::DOUBLE AS absolute_threshold, log10(p.value_b / p.value_a) AS log10_ratio_b_over_a,
    {LABEL.format(d=DELTA, t='1e-4::DOUBLE')} AS trend_label, {CLASS.format(d=DELTA, t='1e-4::DOUBLE')} AS trend_class, 1.0::DOUBLE / w.n AS pair_weight_group_equal, {REASON}, {feature_sql()}
    FROM pairs_sql {JOINED} JOIN (SELECT group_id, count(*) AS n FROM pairs_sql GROUP BY group_id) w ON w.group_id = p.group_id""",
    f"absolute_change absolute_threshold log10_ratio_b_over_a pair_weight_group_equal {FEATURES}")
def p06(t):
    out = pr.pair_table(pairs(t))
    keep = ["pair_id", "group_id", "absolute_change", "absolute_threshold", "log10_ratio_b_over_a", "trend_label", "trend_class", "pair_weight_group_equal"]
    return renamed(out.select(*keep, pr.REJECT, *pr.MODEL_FEATURES))


@query("p07_pair_table_full", f"""SELECT p.pair_id, p.group_id, p.id_a, p.id_b, p.formula_a, p.formula_b, p.doi, p.family, p.family AS family_normalized, 1.0::DOUBLE / w.n AS pair_weight_group_equal, {REASON},
    {LABEL.format(d=DELTA, t='1e-4::DOUBLE')} AS trend_label, {CLASS.format(d=DELTA, t='1e-4::DOUBLE')} AS trend_class, p.value_a AS "conductivity_a_S_cm-1", p.value_b AS "conductivity_b_S_cm-1",
    p.conductivity_text_a AS conductivity_value_text_a, {feature_sql()} FROM pairs_sql {JOINED} JOIN (SELECT group_id, count(*) AS n FROM pairs_sql GROUP BY group_id) w ON w.group_id = p.group_id""",
    f"pair_weight_group_equal {FEATURES}")
def p07(t):
    rows = pairs(t).withColumnsRenamed({
        "value_a": "conductivity_a_S_cm-1", "value_b": "conductivity_b_S_cm-1", "conductivity_text_a": "conductivity_value_text_a",
    })
    # The two measured values are compared as written, so they stay text here.
    return renamed(pr.pair_table_full(rows))


@query("p08_inference_pairs", f"""WITH np AS (SELECT DISTINCT a.formula AS formula_a, b.formula AS formula_b, a.family AS raw_family FROM pf a JOIN pf b ON b.p_partkey = a.p_partkey + 1)
    SELECT p.formula_a, p.formula_b, trim(p.raw_family) AS family, {orc.normalize_label('p.raw_family')} AS family_normalized, TRUE AS assumed_same_preparation, {REASON}, {feature_sql()}
    FROM np p LEFT JOIN tdok ta ON ta.formula = p.formula_a LEFT JOIN tdok tb ON tb.formula = p.formula_b
    LEFT JOIN tdwhy wa ON wa.formula = p.formula_a LEFT JOIN tdwhy wb ON wb.formula = p.formula_b LEFT JOIN (
        SELECT formula_a, formula_b, sum(abs(coalesce(fb, 0) - coalesce(fa, 0))) AS dist FROM (SELECT q.formula_a, q.formula_b, u.element, max(u.f) FILTER (WHERE u.formula = q.formula_a) AS fa, max(u.f) FILTER (WHERE u.formula = q.formula_b) AS fb
            FROM (SELECT DISTINCT formula_a, formula_b FROM np) q JOIN (SELECT formula, element, amount / sum(amount) OVER (PARTITION BY formula) AS f FROM comp) u ON u.formula IN (q.formula_a, q.formula_b) GROUP BY ALL) GROUP BY formula_a, formula_b) l1
        ON l1.formula_a = p.formula_a AND l1.formula_b = p.formula_b AND ta.formula IS NOT NULL AND tb.formula IS NOT NULL""", FEATURES)
def p08(t):
    parts = t.table("part").selectExpr("p_partkey", "p_size", "p_type").selectExpr(
        "p_partkey", f"{MEASUREMENT_EXPRESSIONS['formula']} AS formula", f"{MEASUREMENT_EXPRESSIONS['family']} AS family"
    )
    nxt = parts.select((c("p_partkey") - 1).alias("p_partkey"), c("formula").alias("formula_b"))
    rows = parts.withColumnRenamed("formula", "formula_a").join(nxt, "p_partkey").select("formula_a", "formula_b", "family").distinct()
    return renamed(pr.inference_pairs(rows))


SOME = ["delta_entropy_c_l", "delta_chi_all", "mean_r_all_pm", "abs_delta_field_x_r_diff", "a_chi_all", "b_chi_all", "composition_L1_distance"]
REVERSED_SQL = """p.pair_id, CASE WHEN {d} > 1e-4::DOUBLE THEN 'decrease' WHEN {d} < -1e-4::DOUBLE THEN 'increase' ELSE 'unchanged' END AS trend_label,
    ta.x_entropy_c_l - tb.x_entropy_c_l AS delta_entropy_c_l, ta.x_chi_all - tb.x_chi_all AS delta_chi_all, (ta.x_r_all_pm + tb.x_r_all_pm) / 2.0 AS mean_r_all_pm,
    abs(tb.x_field_x_r_diff - ta.x_field_x_r_diff) AS abs_delta_field_x_r_diff, tb.x_chi_all AS a_chi_all, ta.x_chi_all AS b_chi_all, l1.dist AS composition_l1_distance""".format(d=DELTA)
FORWARD_SQL = """p.pair_id, {label} AS trend_label, tb.x_entropy_c_l - ta.x_entropy_c_l AS delta_entropy_c_l, tb.x_chi_all - ta.x_chi_all AS delta_chi_all, (ta.x_r_all_pm + tb.x_r_all_pm) / 2.0 AS mean_r_all_pm,
    abs(tb.x_field_x_r_diff - ta.x_field_x_r_diff) AS abs_delta_field_x_r_diff, ta.x_chi_all AS a_chi_all, tb.x_chi_all AS b_chi_all, l1.dist AS composition_l1_distance""".format(label=LABEL.format(d=DELTA, t="1e-4::DOUBLE"))


@query("p09_reverse_pairs", f"SELECT {REVERSED_SQL}, {REASON} FROM pairs_sql {JOINED}", " ".join(plain(n) for n in SOME))
def p09(t):
    return renamed(pr.reverse_pairs(pr.pair_table(pairs(t))).select("pair_id", "trend_label", pr.REJECT, *SOME))


@query("p10_augment", f"""SELECT {FORWARD_SQL}, 'forward' AS augmentation_direction, 0.5 / w.n AS training_weight, {REASON} FROM pairs_sql {JOINED} JOIN (SELECT group_id, count(*)::DOUBLE AS n FROM pairs_sql GROUP BY group_id) w ON w.group_id = p.group_id
    UNION ALL SELECT {REVERSED_SQL}, 'reverse', 0.5 / w.n, {REASON} FROM pairs_sql {JOINED} JOIN (SELECT group_id, count(*)::DOUBLE AS n FROM pairs_sql GROUP BY group_id) w ON w.group_id = p.group_id""",
    " ".join([*[plain(n) for n in SOME], "training_weight"]))
def p10(t):
    weight = "pair_weight_group_equal"
    out = pr.augment(durable(pr.pair_table(pairs(t)).select("pair_id", "trend_label", weight, pr.REJECT, *SOME)))
    return renamed(out.select("pair_id", "trend_label", "augmentation_direction", "training_weight", pr.REJECT, *SOME))


# --- splits --------------------------------------------------------------------------------


@query("l01_split_random", f"SELECT id, CASE WHEN {orc.hash_fraction('id', 'random42')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM m")
def l01(t):
    return sp.split_random(t.m, "id", 0.2).select("id", "split")


@query("l02_split_by_id", "SELECT id, CASE WHEN suppkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM m WHERE suppkey % 5 < 3")
def l02(t):
    train = t.m.filter("suppkey % 5 IN (1, 2)").select("id")
    return sp.split_by_id(t.m.select("id"), "id", train, t.m.filter("suppkey % 5 = 0").select("id"))


@query("l03_split_stratified", f"""SELECT id, CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (SELECT id, count(*) OVER (PARTITION BY family_norm) AS n,
    row_number() OVER (PARTITION BY family_norm ORDER BY {orc.stable_key('id', 'stratified42')}, id) AS rn FROM mp)""")
def l03(t):
    return sp.split_stratified(t.narrow("id", "family_norm"), "id", "family_norm", 0.2).select("id", "split")


@query("l04_split_group", f"SELECT id, CASE WHEN {orc.hash_fraction('doi', 'group42')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM mp")
def l04(t):
    return sp.split_group(t.typed, "doi", 0.2).select("id", "split")


@query("l05_split_subset", f"SELECT id, CASE WHEN {orc.hash_fraction('id', 'random42')} < 0.25 THEN 'test' ELSE 'train' END AS split FROM m WHERE contains(lower(family), 'argyro')")
def l05(t):
    return sp.split_subset(t.m, "family", "ARGYRO", "id", 0.25).select("id", "split")


@query("l06_label_quota", """SELECT family_norm, n, (f + CASE WHEN row_number() OVER (ORDER BY rest DESC, family_norm) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS target FROM (
    SELECT family_norm, n, floor(n * 1000 / total) AS f, n * 1000 / total - floor(n * 1000 / total) AS rest FROM (SELECT family_norm, count(*) AS n, (SELECT count(*) FROM mp) AS total FROM mp GROUP BY family_norm))""")
def l06(t):
    counts = t.typed.groupBy("family_norm").agg(F.count("*").alias("n"))
    return sp.label_quota(counts, "family_norm", "n", F.lit(1000))


CTES["lab"] = f"SELECT *, {LABEL.format(d='(log10_value + 4)', t='1.5')} AS label FROM valid"
LEVELS = pr.LABELS
_COUNTS = ", ".join(f"count(*) FILTER (WHERE label = '{v}') AS {v}_rows" for v in LEVELS)
CTES["lgrp"] = f"SELECT doi, count(*) AS pair_rows, {_COUNTS}, {orc.stable_key('doi', 'groups')} AS selection_key FROM lab GROUP BY doi"
_CUM = ["pair_rows", *[f"{v}_rows" for v in LEVELS]]
CTES["lcum"] = "SELECT *, " + ", ".join(
    f"sum({n}) OVER (ORDER BY selection_key) AS cum_{n}, sum({n}) OVER () AS all_{n}" for n in _CUM
) + " FROM lgrp"
CTES["lcut"] = f"""SELECT selection_key AS cut FROM lcum WHERE {' AND '.join(f'(all_{n} = 0 OR (cum_{n} > 0 AND cum_{n} < all_{n}))' for n in _CUM)}
    ORDER BY abs(cum_pair_rows - round_even(all_pair_rows * 0.1::DOUBLE, 0)), round({' + '.join(f'abs(cum_{v}_rows - all_{v}_rows * 0.1::DOUBLE)' for v in LEVELS)}, 6), selection_key LIMIT 1"""


def labelled(t):
    return durable(valid(t).select(
        "id", "doi", "method", "family_norm", ph.trend_label(c("log10_value") + 4, 1.5).alias("label")
    ))


@query("l07_split_groups_to_target", "SELECT doi, CASE WHEN selection_key <= (SELECT cut FROM lcut) THEN 'validation' ELSE 'train' END AS split, pair_rows, decrease_rows, unchanged_rows, increase_rows, selection_key FROM lgrp")
def l07(t):
    return sp.split_groups_to_target(labelled(t), "doi", "label", LEVELS, 0.1)


@query("l08_kfold", f"SELECT id, CAST(floor({orc.hash_fraction('id', 'fold42')} * 5) AS BIGINT) AS fold FROM m")
def l08(t):
    return sp.kfold(t.m.select("id"), "id", 5)


CTES["lfold"] = f"""SELECT doi, n AS group_rows, CASE WHEN (rn - 1) % 10 < 5 THEN (rn - 1) % 10 ELSE 9 - (rn - 1) % 10 END AS fold FROM (
    SELECT doi, n, row_number() OVER (ORDER BY n DESC, {orc.stable_key('doi', 'kfold')}, doi) AS rn FROM (SELECT doi, count(*) AS n FROM lab GROUP BY doi))"""


@query("l09_group_kfold", "SELECT doi, group_rows, fold FROM lfold")
def l09(t):
    return sp.group_kfold(labelled(t), "doi", 5)


@query("l09_fold_checks", f"""SELECT fold, sum(n)::BIGINT AS rows, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS missing_valid_classes, sum(CASE WHEN n = t THEN 1 ELSE 0 END)::BIGINT AS missing_fit_classes FROM (
    SELECT f.fold, v.label, count(l.id) AS n, any_value(v.t) AS t FROM (SELECT DISTINCT fold FROM lfold) f CROSS JOIN (SELECT label, count(*) AS t FROM lab GROUP BY label) v
    LEFT JOIN (SELECT * FROM lab JOIN lfold USING (doi)) l ON l.fold = f.fold AND l.label = v.label GROUP BY f.fold, v.label) GROUP BY fold""")
def l09c(t):
    rows = labelled(t)
    folded = rows.join(sp.group_kfold(rows, "doi", 5).select("doi", "fold"), "doi")
    return sp.fold_checks(folded, "fold", "label", LEVELS)


# Fewer than FOLDS groups of each bucket of like groups are left and go one by one, in a recursion.
FOLDS = 5
_PARTS = ["group_rows", *[f"n_{v}" for v in LEVELS]]
_CLASS = ", ".join(f"CASE WHEN {n} < 16 THEN {n} ELSE 11 + length(bin({n})) END" for n in _PARTS)
CTES["sgrp"] = f"""SELECT *, concat_ws(',', {_CLASS}) AS bucket FROM (SELECT doi, count(*) AS group_rows,
    {', '.join(f"count(*) FILTER (WHERE label = '{v}') AS n_{v}" for v in LEVELS)}, coalesce({orc.stable_key('doi', 'strata')}, '') AS skey FROM lab GROUP BY doi)"""
CTES["splace"] = f"""SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY group_rows DESC, skey) AS place, count(*) OVER (PARTITION BY bucket) % {FOLDS} AS rest FROM sgrp"""
CTES["sdealt"] = f"""SELECT *, CASE WHEN place > rest THEN CASE WHEN (place - rest - 1) % {2 * FOLDS} < {FOLDS} THEN (place - rest - 1) % {2 * FOLDS}
    ELSE {2 * FOLDS - 1} - (place - rest - 1) % {2 * FOLDS} END END AS fold FROM splace"""
CTES["sitem"] = f"""SELECT skey, [{', '.join(f'{n}::DOUBLE' for n in _PARTS)}] AS v, row_number() OVER (ORDER BY group_rows DESC, skey) AS i FROM sdealt WHERE fold IS NULL"""
CTES["sbase"] = f"""SELECT list(n ORDER BY f, j) AS held FROM (SELECT f, j, coalesce(sum(CASE j {' '.join(f'WHEN {i} THEN {n}' for i, n in enumerate(_PARTS))} END), 0)::DOUBLE AS n
    FROM range({FOLDS}) a(f) CROSS JOIN range({len(_PARTS)}) b(j) LEFT JOIN sdealt d ON d.fold = f GROUP BY f, j)"""
_GROWTH = " + ".join(f"CASE WHEN total[{j + 1}] > 0 THEN held[f * {len(_PARTS)} + {j + 1}] * v[{j + 1}] / (total[{j + 1}] * total[{j + 1}]) ELSE 0 END" for j in range(len(_PARTS)))
CTES["sgreedy"] = f"""SELECT 0::BIGINT AS i, held, NULL::VARCHAR AS skey, NULL::BIGINT AS fold, [{', '.join(f'(SELECT sum({n}) FROM sgrp)::DOUBLE' for n in _PARTS)}] AS total FROM sbase
    UNION ALL SELECT i, list_transform(range({FOLDS * len(_PARTS)}), lambda k: held[k + 1] + CASE WHEN k // {len(_PARTS)} = fold THEN v[k % {len(_PARTS)} + 1] ELSE 0 END), skey, fold, total FROM (
        SELECT x.i, held, x.skey, x.v, total, list_position(cost, list_min(cost)) - 1 AS fold FROM (
            SELECT x.*, held, total, list_transform(range({FOLDS}), lambda f: {_GROWTH}) AS cost FROM sgreedy g JOIN sitem x ON x.i = g.i + 1) x)"""
CTES["sfold"] = f"SELECT doi, {', '.join(_PARTS)}, coalesce(d.fold, g.fold)::BIGINT AS fold FROM sdealt d LEFT JOIN sgreedy g USING (skey)"


@query("l09_stratified_group_kfold", f"SELECT doi, {', '.join(_PARTS)}, fold FROM sfold")
def l09s(t):
    return sp.stratified_group_kfold(labelled(t), "doi", "label", LEVELS, FOLDS)


@query("l09_fold_shares", f"""SELECT fold, count(*) AS groups, sum(group_rows)::BIGINT AS group_rows, sum(group_rows) / (SELECT sum(group_rows) FROM sgrp) AS share_group_rows,
    {', '.join(f"sum(n_{v}) / nullif((SELECT sum(n_{v}) FROM sgrp), 0) AS share_{v}" for v in LEVELS)} FROM sfold GROUP BY fold""",
    " ".join(["share_group_rows", *[f"share_{v}" for v in LEVELS]]))
def l09f(t):
    return sp.fold_shares(sp.stratified_group_kfold(labelled(t), "doi", "label", LEVELS, FOLDS), LEVELS)


@query("l10_split_manifest", """SELECT split, count(*) AS rows, count(DISTINCT doi) AS groups, count(*) FILTER (WHERE label = 'decrease') AS decrease_rows, count(*) FILTER (WHERE label = 'unchanged') AS unchanged_rows,
    count(*) FILTER (WHERE label = 'increase') AS increase_rows, count(*) / (SELECT count(*) FROM lab) AS row_fraction
    FROM (SELECT *, CASE WHEN selection_key <= (SELECT cut FROM lcut) THEN 'validation' ELSE 'train' END AS split FROM lab JOIN (SELECT doi, selection_key FROM lgrp) USING (doi)) GROUP BY split""", "row_fraction")
def l10(t):
    rows = labelled(t)
    groups = sp.split_groups_to_target(rows, "doi", "label", LEVELS, 0.1)
    return sp.split_manifest(sp.assignments(rows, groups, "doi"), "doi", "label", LEVELS)

