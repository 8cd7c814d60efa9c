"""Queries for aggregates, joins, deduplication and the curation flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import entity as en
from saltmarsh.operators import evaluation as ev
from saltmarsh.operators import quality as ql
from saltmarsh.operators import windows as wn
from saltmarsh.plans import flows
from saltmarsh.plans import oracle as orc
from saltmarsh.plans.catalog import query
from saltmarsh.plans.oracle import CTES
from saltmarsh.session import durable
from saltmarsh.sources import views

c = F.col

CTES["valid"] = "SELECT * FROM mf WHERE formula_error = '' AND value > 0"


def valid(t):
    return ql.valid_measurements(t.mf)


def members(key: str, source: str, columns: str) -> str:
    """Rows of the groups that have more than one, as SQL."""
    return f"SELECT {key}, {columns} FROM {source} WHERE {key} IN (SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) > 1)"


def lists(key: str, source: str, fields: dict[str, str], order: str = "id", size: int = 1000) -> str:
    """Member lists of bounded length, as SQL."""
    joined = ", ".join(f"string_agg({e}, '|' ORDER BY {order}) AS {n}" for n, e in fields.items())
    return f"""SELECT {key}, list_no, {joined} FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1) / {size}) AS BIGINT) AS list_no
        FROM {source}) GROUP BY {key}, list_no"""


# --- aggregates -----------------------------------------------------------------------


DUP_SQL = """SELECT formula_key, count(*) AS row_count, min(log10_value) AS log10_min, max(log10_value) AS log10_max,
    max(log10_value) - min(log10_value) AS log10_span FROM valid GROUP BY formula_key HAVING count(*) > 1"""


@query("a01_dup_audit", f"""SELECT * FROM ({DUP_SQL})
    JOIN ({lists('formula_key', 'valid', {'ids': 'id', 'conductivities': 'conductivity_text', 'dois': 'doi_text'})}) USING (formula_key)""",
    "log10_min log10_max log10_span")
def a01(t):
    rows = t.narrow("id", "formula", "value", "log10_value", "conductivity_text", "doi_text")
    return ql.dup_lists(ql.with_formula(rows))


@query("a01_dup_members", members("formula_key", "valid", "id, conductivity_text, doi_text"))
def a01m(t):
    return ql.dup_members(t.mf)


CTES["cand"] = f"""SELECT CASE source WHEN 'v1' THEN id WHEN 'literature' THEN id WHEN 'caltech' THEN 'caltech_icsd_' || id
        ELSE 'liverpool_' || id || '_' || printf('%04d', source_row) END AS id, source, source_row, formula, doi_text, conductivity_text,
        CASE source WHEN 'literature' THEN 'unknown' WHEN 'caltech' THEN '' ELSE family END AS family,
        CASE source WHEN 'literature' THEN temperature_c::DOUBLE WHEN 'liverpool' THEN CASE WHEN suppkey % 17 = 3 THEN NULL ELSE temperature_c::DOUBLE END END AS temperature_c,
        CASE source WHEN 'v1' THEN checked WHEN 'literature' THEN '1' ELSE '0' END AS checked,
        CASE source WHEN 'caltech' THEN id ELSE '' END AS external_id,
        CASE source WHEN 'caltech' THEN (temperature_c + 300)::DOUBLE END AS lowest_temperature_k,
        CASE source WHEN 'v1' THEN note WHEN 'literature' THEN 'addition_id=' || id || '; calculation_method=arrhenius; target_temperature_C=' || temperature_c || '; source_year=2020'
            WHEN 'caltech' THEN 'lowest_extrapolation_temperature_K=' || (temperature_c + 300)
            ELSE 'source_id=' || id || '; measured_temperature_C=' || CASE WHEN suppkey % 17 = 3 THEN 'RT' ELSE temperature_c::VARCHAR END || '; chemical_family=' || method END AS note
    FROM m WHERE NOT (source = 'literature' AND suppkey % 9 = 4)"""
CTES["cval_all"] = f"""SELECT c.*, k.formula_key, k.formula_full, k.formula_error, {orc.measure_value('conductivity_text')} AS value,
        {orc.doi_tokens('doi_text')} AS doi_tokens, {orc.normalize_label('family')} AS family_norm
    FROM cand c JOIN fkey k USING (formula)"""
CTES["cval"] = """SELECT *, log10(value) AS log10_value, array_to_string(doi_tokens, '|') AS doi,
        CASE source WHEN 'v1' THEN 0 WHEN 'literature' THEN 1 WHEN 'caltech' THEN 2 ELSE 3 END AS prio,
        CASE source WHEN 'liverpool' THEN abs(temperature_c - 25) ELSE 0.0 END AS tdist
    FROM cval_all WHERE formula_error = '' AND len(doi_tokens) > 0 AND value > 0 AND (source <> 'liverpool' OR coalesce(temperature_c BETWEEN 20 AND 30, FALSE))"""
CTES["ctok"] = """SELECT id, source, formula_key, doi, family_norm, prio, source_row, u.token, u.pos FROM cval,
    LATERAL (SELECT unnest(doi_tokens) AS token, generate_subscripts(doi_tokens, 1) AS pos) u"""
CTES["ffirst"] = """SELECT formula_key, token, arg_min(family_norm, (prio, source_row, id)) AS found FROM ctok WHERE family_norm <> 'unknown' GROUP BY formula_key, token"""
CTES["ffill"] = """SELECT t.id, arg_min(f.found, t.pos) AS fill FROM ctok t JOIN ffirst f USING (formula_key, token)
    WHERE t.source = 'caltech' AND t.family_norm = 'unknown' GROUP BY t.id"""
CTES["cfill"] = f"""SELECT cval.* REPLACE (CASE WHEN source = 'caltech' AND family_norm = 'unknown' THEN coalesce(fill, 'unknown') ELSE family END AS family,
        CASE WHEN source = 'caltech' AND family_norm = 'unknown' THEN coalesce(fill, 'unknown') ELSE family_norm END AS family_norm)
    FROM cval LEFT JOIN ffill USING (id)"""
# Components by walking the key graph from every key.
CTES["cedge"] = """SELECT DISTINCT formula_key || '|' || a.token AS u, formula_key || '|' || b.token AS v FROM ctok a JOIN ctok b USING (id, formula_key) WHERE a.token <> b.token"""
CTES["creach"] = """SELECT u, v FROM cedge UNION SELECT r.u, d.v FROM creach r JOIN cedge d ON r.v = d.u"""
CTES["clabel"] = """SELECT u AS node, least(u, min(v)) AS component FROM creach GROUP BY u"""
CTES["ccomp"] = """SELECT c.*, coalesce(l.component, c.formula_key || '|' || c.doi_tokens[1]) AS component
    FROM cfill c LEFT JOIN clabel l ON l.node = c.formula_key || '|' || c.doi_tokens[1]"""
CTES["crank"] = """SELECT *, row_number() OVER (PARTITION BY component ORDER BY prio, tdist, CASE source WHEN 'literature' THEN -value ELSE 0 END, source_row, id) AS crn FROM ccomp"""
CTES["ckept"] = "SELECT * FROM crank WHERE crn = 1"
CTES["cspan"] = """SELECT *, max(log10_value) OVER f - min(log10_value) OVER f AS span, count(*) OVER f AS fn,
    first_value(id) OVER (PARTITION BY formula_key ORDER BY value DESC, prio, tdist, source_row, id) AS top_id FROM ckept WINDOW f AS (PARTITION BY formula_key)"""
CTES["cfinal"] = "SELECT * FROM cspan WHERE NOT (fn > 1 AND span > 1.0 AND id <> top_id)"


def candidate_rows(t):
    return en.candidates(**views.source_tables(t.m))


def valid_candidates(t):
    """Validated candidates, written once for the steps that read them."""
    kept, _ = en.validate_candidates(candidate_rows(t))
    return durable(kept.select(*flows.CURATION_COLUMNS))


def filled(t):
    return durable(en.fill_by_overlap(valid_candidates(t)))


def grouped(t):
    return durable(en.components(filled(t)))


COMPONENT_SQL = """SELECT * FROM (SELECT component, count(*) AS candidate_rows, min(log10_value) AS log10_min, max(log10_value) AS log10_max,
        max(log10_value) - min(log10_value) AS log10_span, count(*) - 1 AS dropped_rows FROM ccomp GROUP BY component HAVING count(*) > 1)
    JOIN (SELECT component, formula_key, id AS kept_id, source AS kept_source, value AS kept_value FROM ckept) USING (component)
    JOIN (SELECT component, count(DISTINCT token) AS token_count FROM (SELECT component, unnest(doi_tokens) AS token FROM ccomp) GROUP BY component) USING (component)"""
COMPONENT_DOUBLES = "log10_min log10_max log10_span kept_value"


@query("a02_component_audit", f"""{COMPONENT_SQL}
    JOIN ({lists('component', 'ccomp', {'ids': 'id', 'sources': 'source'})}) USING (component)""", COMPONENT_DOUBLES)
def a02(t):
    rows = grouped(t)
    kept, _ = en.pick_representative(rows.select("component", "id", "source", "source_row", "formula_key", "value", "temperature_c"))
    return en.component_lists(rows, kept)


@query("a02_component_members", members("component", "ccomp", "id, source"))
def a02m(t):
    return en.component_members(grouped(t))


CTES["mclean"] = f"""SELECT mf.* REPLACE (CASE formula_key WHEN 'Cl4LiNbO' THEN 'oxyhalides' WHEN 'Cl4LiOTa' THEN 'oxyhalides' ELSE family_norm END AS family_norm),
        CASE WHEN lower(checked) IN ('1','true','yes') THEN 0 ELSE 1 END AS checked_rank,
        CASE source WHEN 'v1' THEN 0 WHEN 'literature' THEN 1 WHEN 'liverpool' THEN 2 ELSE 3 END AS source_rank, source_row AS row_order,
        try_cast(regexp_extract(note, 'measured_temperature_C=([^;]+)', 1) AS DOUBLE) AS noted,
        CASE formula_key WHEN 'Al0.6Ge1.4Li1.6O12P3' THEN 'nasicon' WHEN 'Li10P2S12Sn' THEN 'lgps' WHEN 'Li7P3S11' THEN 'thio_lisicon' END AS preferred
    FROM mf"""
CTES["mreason"] = """SELECT *, CASE WHEN coalesce(value <= 0, TRUE) THEN 'invalid or non-positive conductivity' WHEN value < 1e-6::DOUBLE THEN 'model threshold: conductivity < 1e-06'
    WHEN source = 'liverpool' AND NOT coalesce(noted BETWEEN 20 AND 30, FALSE) THEN 'Liverpool temperature outside model range [20, 30] C' END AS reason
    FROM mclean WHERE formula_key IS NOT NULL"""
CTES["melig"] = "SELECT * FROM mreason WHERE reason IS NULL"
CTES["mrank"] = """SELECT *, row_number() OVER (PARTITION BY formula_key ORDER BY CASE WHEN family_norm = preferred THEN 0 ELSE 1 END, value DESC, checked_rank, source_rank, row_order, id) AS rn FROM melig"""
AUDIT_SQL = """SELECT * FROM (SELECT formula_key, count(*) AS candidate_rows, count(DISTINCT value) AS distinct_values, min(log10_value) AS log10_min, max(log10_value) AS log10_max,
        max(log10_value) - min(log10_value) AS log10_span, quantile_cont(log10_value, 0.5) AS median_log10, count(*) - 1 AS dropped_rows,
        string_agg(DISTINCT family_norm, '|' ORDER BY family_norm) AS families FROM melig GROUP BY formula_key HAVING count(*) > 1)
    JOIN (SELECT formula_key, coalesce(preferred, '') AS preferred_family, id AS kept_id, value AS kept_value, source AS kept_source, family_norm AS kept_family,
        CASE WHEN preferred IS NOT NULL THEN 'highest reported conductivity within ' || preferred ELSE 'highest reported conductivity' END AS selection_rule FROM mrank WHERE rn = 1) USING (formula_key)"""


def model_input(t):
    """Typed rows with the path text and order the model cleaning expects."""
    ref = F.concat(F.lit("tables/"), F.when(c("source") == "literature", "literature_additions").otherwise(c("source")))
    return t.mf.withColumns({"ref": ref, "row_order": c("source_row")})


@query("a03_formula_audit", f"""{AUDIT_SQL}
    JOIN ({lists('formula_key', 'melig', {'ids': 'id', 'conductivities': 'conductivity_text', 'dois': 'doi', 'sources': 'source'})}) USING (formula_key)""",
    "log10_min log10_max log10_span median_log10 kept_value")
def a03(t):
    return flows.model_clean(model_input(t))["formula_lists"]


@query("a03_formula_members", members("formula_key", "melig", "id, conductivity_text, doi, source"))
def a03m(t):
    return flows.model_clean(model_input(t))["formula_members"]


@query("a04_family_share", "SELECT family_norm, count(*) AS row_count, count(*) / (SELECT count(*) FROM mp) AS fraction FROM mp GROUP BY family_norm", "fraction")
def a04(t):
    return ql.family_share(t.typed)


@query("a05_label_sets", """SELECT 'formula' AS kind, formula_key AS key, string_agg(DISTINCT family_norm, '|' ORDER BY family_norm) AS labels FROM valid WHERE family_norm <> 'unknown' GROUP BY formula_key
    UNION ALL SELECT 'token', token, string_agg(DISTINCT family_norm, '|' ORDER BY family_norm) FROM (SELECT unnest(doi_tokens) AS token, family_norm FROM valid WHERE family_norm <> 'unknown') GROUP BY token""")
def a05(t):
    rows = valid(t)
    joined = F.array_join("labels", "|").alias("labels")
    a = ql.label_sets(rows, c("formula_key"), "key").select(F.lit("formula").alias("kind"), "key", joined)
    tokens = rows.select("family_norm", F.explode("doi_tokens").alias("token"))
    return a.unionByName(ql.label_sets(tokens, c("token"), "key").select(F.lit("token").alias("kind"), "key", joined))


@query("a06_crosstab", """SELECT doi, count(*) FILTER (WHERE method = 'ball_milling') AS ball_milling, count(*) FILTER (WHERE method = 'solid_state') AS solid_state,
    count(*) FILTER (WHERE method = 'solution') AS solution FROM mp GROUP BY doi""")
def a06(t):
    return ql.crosstab(t.typed, "doi", "method", ["ball_milling", "solid_state", "solution"])


@query("a07_describe_split", """SELECT method AS split, count(*) AS row_count, min(log10_value) AS min_value, max(log10_value) AS max_value, avg(log10_value) AS mean_value,
    quantile_cont(log10_value, 0.5) AS median_value FROM mp GROUP BY method""", "min_value max_value mean_value median_value")
def a07(t):
    return ql.describe_split(t.narrow("method", "log10_value").withColumnRenamed("method", "split"), "split", "log10_value")


IQR_COLUMNS = ["value", "log10_value", "temperature_c"]
IQR_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, count(v) AS value_count, count(*) - count(v) AS missing_count, (count(*) - count(v)) / count(*) AS missing_ratio, min(v) AS min_value, max(q1) AS q1, max(q2) AS median, max(q3) AS q3,
    max(v) AS max_value, max(q3 - q1) AS iqr, max(q1 - 1.5 * (q3 - q1)) AS lower_fence, max(q3 + 1.5 * (q3 - q1)) AS upper_fence,
    count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count,
    count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(v) AS outlier_ratio
    FROM (SELECT CAST({n} AS DOUBLE) AS v FROM mp), (SELECT quantile_cont(CAST({n} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({n} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({n} AS DOUBLE), 0.75) AS q3 FROM mp)"""
    for n in IQR_COLUMNS
)


@query("a08_iqr_audit", IQR_SQL, "missing_ratio min_value q1 median q3 max_value iqr lower_fence upper_fence outlier_ratio")
def a08(t):
    return ql.iqr_audit(t.narrow(*IQR_COLUMNS), IQR_COLUMNS)


CTES["pred"] = """SELECT id, formula_key, doi, family_norm, method, source_row, suppkey, log10_value AS y_true, log10_value + (suppkey % 21 - 10) / 10.0::DOUBLE AS y_pred FROM valid"""


def predictions(t):
    return valid(t).select(
        "id", "formula_key", "doi", "family_norm", "method", "source_row", "suppkey", c("log10_value").alias("y_true"),
        (c("log10_value") + (c("suppkey") % 21 - 10) / F.lit(10.0)).alias("y_pred"),
    )


@query("a09_residual_summary", """SELECT method, count(*) AS n, avg(r) AS mean_residual, stddev_samp(r) AS std_residual, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse,
    avg(CASE WHEN r < 0 THEN 1.0::DOUBLE ELSE 0 END) AS negative_fraction, avg(CASE WHEN abs(r) <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS within_1_fraction,
    quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.5) AS median_residual, quantile_cont(r, 0.75) AS q75, quantile_cont(r, 0.95) AS q95
    FROM (SELECT method, round(y_true - y_pred, 6) AS r FROM pred) GROUP BY method""",
    "mean_residual std_residual mae rmse negative_fraction within_1_fraction q05 q25 median_residual q75 q95")
def a09(t):
    rows = predictions(t).select("method", F.round(c("y_true") - c("y_pred"), 6).alias("r"))
    return ql.residual_summary(rows, "method", "r")


# Exact decimals are cut to six digits first, so ties are ties in both engines.
CTES["pred6"] = "SELECT * REPLACE (round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred) FROM pred"
CTES["ppairs"] = """SELECT a.formula_key AS series, count(*) FILTER (WHERE a.y_true <> b.y_true) AS comparable,
        count(*) FILTER (WHERE sign(a.y_true - b.y_true) * sign(a.y_pred - b.y_pred) < 0) AS inverted,
        count(*) FILTER (WHERE a.y_true <> b.y_true AND a.y_pred = b.y_pred) AS tied,
        count(*) FILTER (WHERE a.y_pred <> b.y_pred) AS comparable_pred
    FROM pred6 a JOIN pred6 b ON a.formula_key = b.formula_key AND a.id < b.id GROUP BY a.formula_key"""
CTES["pranks"] = """SELECT formula_key AS series, y_true, y_pred, rank() OVER (PARTITION BY formula_key ORDER BY y_true) + (count(*) OVER (PARTITION BY formula_key, y_true) - 1) / 2.0::DOUBLE AS rt,
    rank() OVER (PARTITION BY formula_key ORDER BY y_pred) + (count(*) OVER (PARTITION BY formula_key, y_pred) - 1) / 2.0::DOUBLE AS rp FROM pred6"""
CTES["pcorr"] = """SELECT series, count(*) AS n, CASE WHEN count(DISTINCT y_true) > 1 AND count(DISTINCT y_pred) > 1 THEN corr(y_true, y_pred) END AS pearson,
    CASE WHEN count(DISTINCT y_true) > 1 AND count(DISTINCT y_pred) > 1 THEN corr(rt, rp) END AS spearman FROM pranks GROUP BY series"""
CTES["padj"] = """SELECT series, count(*) FILTER (WHERE dt <> 0 AND dp <> 0) AS comparable, count(*) FILTER (WHERE dt * dp > 0) AS correct FROM (
    SELECT formula_key AS series, y_true - lag(y_true) OVER w AS dt, y_pred - lag(y_pred) OVER w AS dp FROM pred6 WINDOW w AS (PARTITION BY formula_key ORDER BY source_row, id))
    WHERE dt IS NOT NULL GROUP BY series"""


def rounded_predictions(t):
    rows = predictions(t).withColumns({n: F.round(n, 6) for n in ("y_true", "y_pred")})
    return durable(rows.withColumnRenamed("formula_key", "series"))


def by_row():
    return [c("source_row"), c("id")]


@query("a10_series_summary", """SELECT c.series, c.n, c.pearson, c.spearman, p.inverted / nullif(p.comparable, 0) AS inversion_rate,
    a.comparable - a.correct AS adjacent_mismatch, a.comparable AS adjacent_comparable FROM pcorr c LEFT JOIN ppairs p USING (series) LEFT JOIN padj a USING (series)""",
    "pearson spearman inversion_rate")
def a10(t):
    return ev.series_summary(rounded_predictions(t), ["series"], by_row(), "y_true", "y_pred")


# --- joins ---------------------------------------------------------------------------------


@query("j01_lookup", """SELECT m.id, coalesce(a.fam, b.fam, 'unknown') AS fam FROM m LEFT JOIN (SELECT id, 'by id ' || method AS fam FROM m WHERE suppkey % 3 = 0) a USING (id)
    LEFT JOIN (SELECT source_row, max('by row ' || source) AS fam FROM m WHERE suppkey % 4 = 0 GROUP BY source_row) b ON b.source_row = m.source_row""")
def j01(t):
    by_id = t.m.filter("suppkey % 3 = 0").select("id", F.lit(None).cast("bigint").alias("source_row"), F.concat(F.lit("by id "), "method").alias("fam"))
    by_row = t.m.filter("suppkey % 4 = 0").groupBy("source_row").agg(F.max(F.concat(F.lit("by row "), "source")).alias("fam")).select(
        F.lit(None).cast("string").alias("id"), "source_row", "fam"
    )
    return en.lookup(t.m.select("id", "source_row"), by_id.unionByName(by_row), "id", "source_row", "fam").select("id", "fam")


BLOCKS = "(SELECT n_name AS label, n_nationkey * s + 1 AS start_row, (n_nationkey + 1) * s AS end_row FROM nation, (SELECT CAST(ceil(max(c_custkey + 1) / 25) AS BIGINT) AS s FROM customer))"


def blocks(t):
    size = t.table("customer").agg(F.ceil(F.max(c("c_custkey") + 1) / 25).cast("bigint").alias("s"))
    return t.table("nation").join(F.broadcast(size), F.lit(True)).select(
        c("n_name").alias("label"), (c("n_nationkey") * c("s") + 1).alias("start_row"),
        ((c("n_nationkey") + 1) * c("s")).alias("end_row"),
    )


@query("j02_label_by_blocks", f"SELECT c_custkey, c_custkey + 1 AS source_row, b.label FROM customer JOIN {BLOCKS} b ON c_custkey + 1 BETWEEN b.start_row AND b.end_row")
def j02(t):
    rows = t.table("customer").select("c_custkey", (c("c_custkey") + 1).alias("source_row"))
    return en.label_by_blocks(rows, blocks(t), "source_row", "start_row", "end_row", ["label"])


@query("j02_block_violations", f"""WITH b AS (SELECT label, start_row, CASE WHEN label = 'NATION_3' THEN end_row + 5 WHEN label = 'NATION_9' THEN end_row - 7 ELSE end_row END AS end_row FROM {BLOCKS})
    SELECT 'out of bounds' AS rule, count(*) AS violation_count FROM b WHERE start_row < 1 OR end_row < start_row OR end_row > (SELECT max(c_custkey + 1) FROM customer)
    UNION ALL SELECT 'overlapping', count(*) FROM (SELECT end_row, lead(start_row) OVER (ORDER BY start_row, end_row) AS nxt FROM b) WHERE nxt <= end_row
    UNION ALL SELECT 'uncovered rows', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM b WHERE c_custkey + 1 BETWEEN b.start_row AND b.end_row)""")
def j02v(t):
    shifted = blocks(t).withColumn(
        "end_row", c("end_row") + F.when(c("label") == "NATION_3", 5).when(c("label") == "NATION_9", -7).otherwise(0)
    )
    rows = t.table("customer").select((c("c_custkey") + 1).alias("source_row"))
    return en.block_violations(rows, shifted, "source_row", "start_row", "end_row")


@query("j03_fill_by_overlap", "SELECT id, source, formula_key, family_norm FROM cfill")
def j03(t):
    return filled(t).select("id", "source", "formula_key", "family_norm")


@query("j04_keep_drop_ids", """SELECT id, 'kept' AS side FROM m WHERE id IN (SELECT id FROM m WHERE suppkey % 6 = 0) UNION ALL
    SELECT id, 'dropped' FROM m WHERE id NOT IN (SELECT id FROM m WHERE partkey % 5 = 0)""")
def j04(t):
    a = en.keep_ids(t.m.select("id"), t.m.filter("suppkey % 6 = 0"), "id").withColumn("side", F.lit("kept"))
    b = en.drop_ids(t.m.select("id"), t.m.filter("partkey % 5 = 0"), "id").withColumn("side", F.lit("dropped"))
    return a.unionByName(b)


@query("j07_loser_reason", """SELECT id, 'duplicate DOI+formula; kept ' || kept || ' from ' || kept_source AS removed_reason FROM (
    SELECT id, crn, first_value(id) OVER w AS kept, first_value(source) OVER w AS kept_source FROM crank WINDOW w AS (PARTITION BY component ORDER BY crn)) WHERE crn > 1""")
def j07(t):
    _, lost = en.pick_representative(grouped(t))
    return lost.select("id", ql.REASON)


# --- entity resolution ---------------------------------------------------------------------


@query("d01_candidates", "SELECT * FROM cand", "temperature_c lowest_temperature_k")
def d01(t):
    return candidate_rows(t)


@query("d02_components", "SELECT id, component FROM ccomp")
def d02(t):
    return grouped(t).select("id", "component")


@query("d03_pick_representative", "SELECT component, id, source, value FROM ckept", "value")
def d03(t):
    kept, _ = en.pick_representative(grouped(t).select("component", "id", "source", "source_row", "value", "temperature_c"))
    return kept.select("component", "id", "source", "value")


@query("d04_span_exclude", """SELECT id, CASE WHEN n > 1 AND span > 2.8 THEN 'excluded' ELSE 'kept' END AS outcome, span FROM (
    SELECT id, count(*) OVER w AS n, max(log10_value) OVER w - min(log10_value) OVER w AS span FROM valid WINDOW w AS (PARTITION BY formula_key, doi))""", "span")
def d04(t):
    rows = durable(valid(t).select("id", "log10_value", F.concat_ws("|", "formula_key", "doi").alias("formula_key")))
    kept, removed = en.span_exclude(rows, 2.8)
    a = kept.select("id", F.lit("kept").alias("outcome"), c("log10_span").alias("span"))
    return a.unionByName(removed.select("id", F.lit("excluded").alias("outcome"), c("log10_span").alias("span")))


@query("d05_span_keep_highest", """SELECT id, CASE WHEN fn > 1 AND span > 1.0 AND id <> top_id THEN 'conflicting formula: log10 conductivity span ' || printf('%.3f', span) || ' > 1; kept highest conductivity row ' || top_id ELSE 'kept' END AS outcome FROM cspan""")
def d05(t):
    merged, _ = en.pick_representative(grouped(t).select(
        "component", "id", "source", "source_row", "formula_key", "value", "log10_value", "temperature_c"
    ))
    kept, removed = en.span_keep_highest(durable(merged))
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(removed.select("id", c(ql.REASON).alias("outcome")))


CTES["flags"] = """SELECT formula, bool_or(element = 'O') AS o, bool_or(element IN ('F','Cl','Br','I')) AS hal, bool_or(element IN ('S','Se','Te')) AS chal,
    bool_or(element = 'H') AS h, bool_or(element = 'Li') AS li, bool_or(element = 'B') AS b, bool_or(element = 'F') AS f, bool_or(element = 'P') AS p, bool_or(element = 'N') AS n,
    bool_or(element = 'Si') AS si, bool_or(element = 'Ge') AS ge, bool_or(element IN ('Si','Ge','Sn')) AS tet, bool_or(element = 'Mo') AS mo, bool_or(element = 'La') AS la,
    bool_or(element IN ('Ti','Zr','Ge','Sn','Hf','V','Nb')) AS nas, coalesce(sum(amount) FILTER (WHERE element = 'Li'), 0) AS ali, coalesce(sum(amount) FILTER (WHERE element = 'S'), 0) AS asu,
    coalesce(sum(amount) FILTER (WHERE element = 'P'), 0) AS ap, coalesce(sum(amount) FILTER (WHERE element = 'O'), 0) AS ao, coalesce(sum(amount) FILTER (WHERE element <> 'O'), 0) AS rest FROM comp GROUP BY formula"""
CTES["guess"] = """SELECT formula, CASE
    WHEN o AND hal THEN CASE WHEN h AND li THEN 'antiperovskite' WHEN b AND f THEN 'fluorooxoborate' WHEN p AND f THEN 'fluorophosphates' ELSE 'oxyhalides' END
    WHEN chal AND hal THEN CASE WHEN p THEN 'argyrodites' ELSE 'halides' END
    WHEN hal THEN 'halides' WHEN h AND li THEN 'hydrides' WHEN n AND NOT o THEN CASE WHEN si THEN 'nitridosilicates' ELSE 'nitrides' END
    WHEN chal AND NOT o THEN CASE WHEN p AND tet THEN CASE WHEN ali >= 6 OR asu >= 8 THEN 'lgps' ELSE 'thio_lisicon' END WHEN p THEN 'thio_phosphate'
        WHEN tet AND ali >= 3 THEN 'chalcogenidotetrelates' ELSE 'sulfides' END
    WHEN o THEN CASE WHEN p AND b THEN 'borophosphates' WHEN p AND ap >= 2.5 AND ao >= 10 AND nas THEN 'nasicon' WHEN p AND (si OR ge) THEN 'lisicon' WHEN p THEN 'phosphates' WHEN b THEN 'borates' WHEN mo THEN 'molybdates'
        WHEN li AND la AND ao >= 10 AND ali >= 5 THEN 'garnet' WHEN ao BETWEEN 2.5 AND 3.5 AND rest BETWEEN 1.5 AND 2.5 THEN 'perovskites' WHEN si THEN 'silicates' WHEN ge THEN 'germanates' ELSE 'oxides' END
    ELSE 'other' END AS guess FROM flags"""
CTES["fset"] = """SELECT formula_key, list(DISTINCT family_norm ORDER BY family_norm) AS raw FROM cfill WHERE family_norm <> 'unknown' GROUP BY formula_key"""
CTES["dset"] = """SELECT f.doi, list(DISTINCT x.family_norm ORDER BY x.family_norm) AS raw FROM (SELECT DISTINCT doi, unnest(doi_tokens) AS token FROM cfinal WHERE family_norm = 'unknown') f
    JOIN (SELECT DISTINCT unnest(doi_tokens) AS token, family_norm FROM cfill WHERE family_norm <> 'unknown') x USING (token) GROUP BY f.doi"""
CTES["casc"] = """SELECT c.id, c.formula_key, c.source, c.family AS previous_family, g.guess,
    CASE WHEN len(fs.raw) > 1 THEN list_filter(fs.raw, lambda x: x <> 'other') ELSE coalesce(fs.raw, []) END AS fo,
    CASE WHEN len(ds.raw) > 1 THEN list_filter(ds.raw, lambda x: x <> 'other') ELSE coalesce(ds.raw, []) END AS dopt
    FROM cfinal c JOIN guess g USING (formula) LEFT JOIN fset fs USING (formula_key) LEFT JOIN dset ds USING (doi) WHERE c.family_norm = 'unknown'"""
CASCADE_SQL = """SELECT id, formula_key, source, previous_family, CASE WHEN len(fo) = 1 THEN fo[1] WHEN len(dopt) = 1 THEN dopt[1] ELSE guess END AS recommended_family,
    CASE WHEN len(fo) = 1 THEN 'high' WHEN len(dopt) = 1 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN len(fo) = 1 THEN 'exact_formula_unique_family' WHEN len(dopt) = 1 THEN 'doi_series_unique_family' ELSE 'composition_rule' END AS assignment_method FROM casc"""


@query("d06_label_cascade", CASCADE_SQL)
def d06(t):
    references = filled(t)
    merged, _ = en.pick_representative(durable(en.components(references)))
    kept, _ = en.span_keep_highest(durable(merged))
    _, audit = en.label_cascade(durable(kept), references)
    return audit.select("id", "formula_key", "source", "previous_family", "recommended_family", "confidence", "assignment_method")


@query("d07_family_by_composition", "SELECT formula, guess AS family FROM guess")
def d07(t):
    known = t.parsed.filter("composition IS NOT NULL")
    return known.select("formula", en.family_by_composition(c("composition"))["family"].alias("family"))


@query("d08_one_per_formula", "SELECT formula_key, id, value, family_norm FROM mrank WHERE rn = 1", "value")
def d08(t):
    return flows.model_clean(model_input(t))["kept"].select("formula_key", "id", "value", "family_norm")


@query("d09_curate_single", """SELECT id, CASE WHEN formula_error <> '' THEN 'unparseable formula: ' || formula_error WHEN coalesce(value <= 0, TRUE) THEN 'missing or unparseable room-temperature conductivity'
    WHEN n > 1 AND span > 4.5 THEN 'conflicting duplicate formula: log10 conductivity span ' || printf('%.3f', span) || ' > 4.5' ELSE 'kept' END AS outcome FROM mf LEFT JOIN (
    SELECT formula_key, count(*) AS n, max(log10_value) - min(log10_value) AS span FROM valid GROUP BY formula_key) USING (formula_key)""")
def d09(t):
    out = flows.curate_single(t.m, 4.5)
    return out["kept"].select("id", F.lit("kept").alias("outcome")).unionByName(
        out["removed"].select("id", c(ql.REASON).alias("outcome"))
    )


@query("d10_curate_sources", """SELECT id, source, formula_key, CASE WHEN formula_error <> '' THEN 'formula' WHEN len(doi_tokens) = 0 THEN 'doi' WHEN coalesce(value <= 0, TRUE) THEN 'value' ELSE 'temperature' END AS outcome, NULL AS family
        FROM cval_all WHERE id NOT IN (SELECT id FROM cval)
    UNION ALL SELECT id, source, formula_key, 'duplicate', NULL FROM crank WHERE crn > 1
    UNION ALL SELECT id, source, formula_key, 'span', NULL FROM cspan WHERE fn > 1 AND span > 1.0 AND id <> top_id
    UNION ALL SELECT c.id, c.source, c.formula_key, 'kept', CASE WHEN c.family_norm <> 'unknown' THEN c.family_norm WHEN len(fo) = 1 THEN fo[1] WHEN len(dopt) = 1 THEN dopt[1] ELSE guess END
        FROM cfinal c LEFT JOIN casc k ON k.id = c.id""")
def d10(t):
    out = flows.curate_sources(views.source_tables(t.m), keep=[])
    short = (
        F.when(c(ql.REASON).startswith("unparseable"), "formula")
        .when(c(ql.REASON).startswith("missing or invalid"), "doi")
        .when(c(ql.REASON).startswith("missing,"), "value")
        .when(c(ql.REASON).startswith("Liverpool"), "temperature")
        .when(c(ql.REASON).startswith("duplicate"), "duplicate").otherwise("span")
    )
    kept = out["kept"].select("id", "source", "formula_key", F.lit("kept").alias("outcome"), c("family_norm").alias("family"))
    return kept.unionByName(out["removed"].select(
        "id", "source", "formula_key", short.alias("outcome"), F.lit(None).cast("string").alias("family")
    ))


@query("d09_audit", DUP_SQL, "log10_min log10_max log10_span")
def d09a(t):
    return flows.curate_single(t.m)["audit"]


@query("d10_audit", COMPONENT_SQL, COMPONENT_DOUBLES)
def d10a(t):
    return flows.curate_sources(views.source_tables(t.m), keep=[])["audit"]


@query("d11_model_clean", """SELECT id, CASE WHEN reason IS NOT NULL THEN reason WHEN rn > 1 THEN 'same formula representative selection; kept ' || first_value(id) OVER (PARTITION BY formula_key ORDER BY rn NULLS LAST) || ' with highest reported conductivity' ELSE 'kept' END AS outcome
    FROM mreason LEFT JOIN (SELECT id, rn FROM mrank) USING (id)
    UNION ALL SELECT id, 'unparseable formula: ' || coalesce(formula_error, '') FROM mclean WHERE formula_key IS NULL""")
def d11(t):
    out = flows.model_clean(model_input(t))
    return out["kept"].select("id", F.lit("kept").alias("outcome")).unionByName(
        out["removed"].select("id", c(ql.REASON).alias("outcome"))
    )


@query("f11_quality_log", f"""WITH q AS ({AUDIT_SQL}) SELECT 'same_formula_multiple_records' AS issue_type, 'resolved' AS severity, formula_key, candidate_rows || ' records; log10 span=' || printf('%.3f', log10_span) || '; kept ' || kept_id AS details FROM q
    UNION ALL SELECT 'conflicting_normalized_family', CASE WHEN preferred_family <> '' THEN 'resolved_by_preferred_family' ELSE 'manual_review' END, formula_key,
        families || CASE WHEN preferred_family <> '' THEN '; selected_family=' || preferred_family ELSE '' END FROM q WHERE contains(families, '|')""")
def f11(t):
    return flows.model_clean(model_input(t))["quality_log"]


# --- windows --------------------------------------------------------------------------------


@query("w01_keep_first", "SELECT formula, id, value FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY coalesce(-value, 1.0), source_row, id) AS rn FROM mp) WHERE rn = 1", "value")
def w01(t):
    rows = t.typed.select("formula", "id", "value", "source_row")
    return wn.keep_first(rows, ["formula"], [F.coalesce(-c("value"), F.lit(1.0)), c("source_row"), c("id")]).drop("source_row")


CTES["seg"] = """SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER w AS segment_no, last_value(label IGNORE NULLS) OVER w AS segment_label
    FROM e WINDOW w AS (PARTITION BY file ORDER BY ts, line_id ROWS UNBOUNDED PRECEDING)"""
CTES["segrows"] = "SELECT * FROM seg WHERE NOT is_header AND segment_no > 0"


def by_line():
    return [c("ts"), c("line_id")]


def segmented(t):
    return wn.segment(t.e, ["file"], by_line(), c("is_header"), c("label"))


def segment_rows(t):
    return segmented(t).filter("NOT is_header AND segment_no > 0")


@query("w02_pairs_adjacent", """SELECT file, segment_no::BIGINT AS segment_no, line_id AS line_id_a, n AS line_id_b, value AS value_a, nv AS value_b FROM (
    SELECT *, lead(line_id) OVER w AS n, lead(value) OVER w AS nv FROM segrows WINDOW w AS (PARTITION BY file, segment_no ORDER BY ts, line_id)) WHERE n IS NOT NULL""", "value_a value_b")
def w02(t):
    rows = segment_rows(t).select("file", "segment_no", "ts", "line_id", "value")
    return wn.pairs_adjacent(rows, ["file", "segment_no"], by_line(), ["line_id", "value"]).drop("ts")


@query("w03_adjacent_agreement", "SELECT series, comparable, correct FROM padj")
def w03(t):
    return wn.adjacent_agreement(rounded_predictions(t), ["series"], by_row(), "y_true", "y_pred")


@query("w04_segment", "SELECT file, line_id, segment_no::BIGINT AS segment_no, segment_label FROM seg")
def w04(t):
    return segmented(t).select("file", "line_id", "segment_no", "segment_label")


@query("w05_group_weight", "SELECT id, 1.0::DOUBLE / count(*) OVER (PARTITION BY doi) AS weight FROM mp", "weight")
def w05(t):
    return wn.group_weight(t.narrow("id", "doi"), "doi").select("id", "weight")


@query("w06_running_best", """SELECT id, min(value) OVER w AS lowest, max(value) OVER w AS highest FROM mp WINDOW w AS (PARTITION BY method, family_norm ORDER BY source_row, id ROWS UNBOUNDED PRECEDING)""", "lowest highest")
def w06(t):
    part = ["method", "family_norm"]
    rows = t.narrow("id", "value", "source_row", *part)
    return wn.running_bests(rows, part, by_row(), "value", {"lowest": "min", "highest": "max"}).select("id", "lowest", "highest")


@query("w07_surrogate", "SELECT id, printf('row_%06d', row_number() OVER (ORDER BY source_row, id)) AS surrogate, printf('%04d', row_number() OVER (PARTITION BY source ORDER BY id)) AS local FROM m")
def w07(t):
    rows = wn.surrogate(t.m.select("id", "source", "source_row"), by_row(), "row_%06d", "surrogate")
    return wn.surrogate(rows, [c("id")], "%04d", "local", ["source"]).select("id", "surrogate", "local")


@query("w08_occurrence", "SELECT file, line_id, label, row_number() OVER (PARTITION BY file, label ORDER BY ts, line_id) AS occurrence FROM e WHERE is_header")
def w08(t):
    headers = t.e.filter("is_header").select("file", "ts", "line_id", "label")
    return wn.occurrence(headers, ["file"], "label", by_line()).drop("ts")

