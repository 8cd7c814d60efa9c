"""Queries for sources, scalar functions, filters, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import physics as ph
from saltmarsh.functions import text as tx
from saltmarsh.operators import quality as ql
from saltmarsh.operators import windows as wn
from saltmarsh.operators.ordering import row_rank
from saltmarsh.plans import oracle as orc
from saltmarsh.plans.catalog import query
from saltmarsh.session import scratch_path
from saltmarsh.sources import readers as rd
from saltmarsh.sources import sinks as sk

c = F.col

# --- sources and sinks -------------------------------------------------------------


@query("s01_read_raw", "SELECT id, formula, conductivity_text, doi_text, family, CAST(temperature_c AS VARCHAR) AS temperature_c, note FROM m")
def s01(t):
    columns = ["id", "formula", "conductivity_text", "doi_text", "family", "temperature_c", "note"]
    path = scratch_path(t.spark, "raw")
    t.m.select(*columns).write.csv(
        path, header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return rd.read_raw(t.spark, path, columns=columns)


@query("s02_read_checked", """SELECT rule, violation_count FROM (
    SELECT 'family not a known label' AS rule, count(*) FILTER (WHERE family NOT IN ('Oxide','unknown','Other')) AS violation_count FROM m
    UNION ALL SELECT 'value infinite', 0::BIGINT
    UNION ALL SELECT 'value not positive', count(*) FILTER (WHERE value IS NULL OR value <= 0) FROM mp)""")
def s02(t):
    path = scratch_path(t.spark, "typed")
    t.typed.select("id", "family", "value", "temperature_c").write.csv(path, header=True)
    df = rd.read_typed(t.spark, path, "id string, family string, value double, temperature_c int")
    rules = rd.contract_rules({"family": ["Oxide", "unknown", "Other"]}, ["value"], ["value"])
    return rd.read_checked(df, ["id", "family", "value"], rules, enforce=False)


@query("s03_read_titled_tsv", "SELECT id AS \"ID\", formula AS composition, conductivity_text AS target, family FROM m")
def s03(t):
    path = scratch_path(t.spark, "titled")
    rows = t.m.select(
        F.concat_ws("\t", "id", "formula", F.lit("blank"), "conductivity_text", "family").alias("value")
    )
    head = t.spark.createDataFrame(
        [("Ion conductor table",), ("\t".join(["ID", "composition", "", "target", "family"]),)], "value string"
    ).coalesce(1)
    head.write.text(f"{path}/part=0")
    rows.write.text(f"{path}/part=1")
    return rd.read_titled_tsv(t.spark, path, "composition").select("ID", "composition", "target", "family")


@query("s04_read_flexible", "SELECT id, formula, trim(family) AS family FROM m")
def s04(t):
    path = scratch_path(t.spark, "flexible")
    t.m.select(c("id").alias("Sample_ID"), c("formula").alias("FORMULA"), c("family").alias("Family"), "method").write.csv(
        path, header=True, sep="\t"
    )
    return rd.read_flexible(t.spark, path).select("id", "formula", "family")


SEGMENTED = """SELECT file, line_id, segment_no, segment_label, row_formula, row_value FROM (
    SELECT file, line_id, text, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER w AS segment_no,
        last_value(label IGNORE NULLS) OVER w AS segment_label, is_header,
        split_part(text, chr(9), 2) AS row_formula, {value} AS row_value
    FROM e WINDOW w AS (PARTITION BY file ORDER BY ts, line_id ROWS UNBOUNDED PRECEDING))
    WHERE NOT is_header AND segment_no > 0 AND row_value IS NOT NULL""".format(
    value=orc.parse_scientific("split_part(text, chr(9), 3)")
)


@query("s05_read_segments", f"SELECT * REPLACE (CAST(segment_no AS BIGINT) AS segment_no) FROM ({SEGMENTED})", "row_value")
def s05(t):
    rows = wn.read_segments(t.e, ["file"], [c("ts"), c("line_id")])
    return rows.select("file", "line_id", "segment_no", "segment_label", "row_formula", "row_value")


@query("s06_load_rules", """SELECT 'states' AS shape, formula AS key, CAST(u.position - 1 AS INTEGER) AS position, u.value AS value, n FROM (
        SELECT formula, list(DISTINCT CAST(temperature_c AS DOUBLE) ORDER BY CAST(temperature_c AS DOUBLE)) AS vs, count(*) AS n FROM m WHERE formula <> '' GROUP BY formula),
        LATERAL (SELECT unnest(vs) AS value, generate_subscripts(vs, 1) AS position) u
    UNION ALL SELECT 'objects', formula, NULL, max(CAST(temperature_c AS DOUBLE)), count(*) FROM m WHERE formula <> '' GROUP BY formula""", "value")
def s06(t):
    """Rule documents written as JSON, one per formula, and loaded back in both shapes."""
    path = scratch_path(t.spark, "rules")
    # Temperatures are whole degrees from 1 to 50, so the list is bounded.
    distinct = t.m.filter("formula != ''").groupBy("formula", c("temperature_c").cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )
    docs = distinct.groupBy("formula").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.sum("n").alias("n"))
    docs.select(
        F.map_from_arrays(F.array("formula"), F.array("vs")).alias("states"),
        F.array(F.struct(c("formula").alias("element"), F.array_max("vs").alias("radius_pm"), "n")).alias("overrides"),
    ).write.json(path)
    states, objects = rd.load_dims(t.spark, path, "states", "overrides", "element string, radius_pm double, n bigint")
    counts = objects.select(c("element").alias("key"), "n")
    a = states.join(counts, "key").select(F.lit("states").alias("shape"), "key", "position", "value", "n")
    b = objects.select(
        F.lit("objects").alias("shape"), c("element").alias("key"), F.lit(None).cast("int").alias("position"),
        c("radius_pm").alias("value"), "n",
    )
    return a.unionByName(b)


@query("s07_write_bundle")
def s07(t):
    kept, removed = ql.reject_first(t.mf, [
        (c("formula_error") != "", "unreadable formula"),
        (~F.coalesce(c("value") > 0, F.lit(False)), "no positive value"),
    ])
    columns = ["id", "source", "formula_key", "value"]
    bundle = {
        "kept": kept.select(*columns),
        "removed": removed.select(*columns, ql.REASON),
        "summary": ql.accounting(kept, removed),
    }
    paths = sk.write_bundle(bundle, scratch_path(t.spark, "bundle"))
    back = [t.spark.read.parquet(p).agg(F.count("*").alias("rows")).select(F.lit(n).alias("output"), "rows") for n, p in paths.items()]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("s08_run_manifest", """SELECT output, '{"rows":' || sum(n)::BIGINT || ',"distribution":[' ||
        string_agg('{"label":"' || label || '","n":' || n || '}', ',' ORDER BY label) || ']}' AS counts_json,
        '{"minimum":1.0E-6,"version":"v2"}' AS config_json FROM (
    SELECT 'positive' AS output, family_norm AS label, count(*) AS n FROM mp WHERE value > 0 GROUP BY family_norm
    UNION ALL SELECT 'other', qualifier, count(*) FROM mp WHERE coalesce(value <= 0, TRUE) GROUP BY qualifier) GROUP BY output""")
def s08(t):
    positive = F.coalesce(c("value") > 0, F.lit(False))
    bundle = {"positive": t.mp.filter(positive), "other": t.mp.filter(~positive)}
    return sk.run_manifest(bundle, {"positive": "family_norm", "other": "qualifier"}, {"minimum": 1e-6, "version": "v2"})


WORD_SUMS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT))::BIGINT AS word_sum_{i}" for i in range(8))


@query("s09_fingerprint", f"""SELECT source, count(*) AS row_count, {WORD_SUMS}
    FROM (SELECT source, sha256(id || chr(31) || formula || chr(31) || conductivity_text || chr(31) || doi_text) AS h FROM m) GROUP BY source""")
def s09(t):
    return rd.fingerprint(t.m, ["source"], ["id", "formula", "conductivity_text", "doi_text"])


@query("s09_file_fingerprint")
def s09f(t):
    """Files of the given tables, by name; their bytes are not in the views that SQL sees."""
    found = rd.file_fingerprint(t.spark, f"{t.sf_dir}/*.parquet")
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "length", "sha256")


# --- scalar functions ----------------------------------------------------------------


@query("x01_parse_measure", "SELECT id, value, qualifier FROM mp", "value")
def x01(t):
    text = c("conductivity_text")
    return t.m.select("id", tx.measure_value(text).alias("value"), tx.measure_qualifier(text).alias("qualifier"))


@query("x02_parse_scientific", f"SELECT id, {orc.parse_scientific('conductivity_text')} * 1000.0::DOUBLE AS milli FROM m", "milli")
def x02(t):
    return t.m.select("id", tx.parse_scientific(c("conductivity_text"), 1000.0).alias("milli"))


@query("x03_parse_approximate", f"""SELECT id, value, value IS NOT NULL AS readable FROM (
    SELECT id, try_cast({orc.strip("regexp_replace(" + orc.strip('conductivity_text') + ", '^[≈~]', '')")} AS DOUBLE) AS value FROM m)""", "value")
def x03(t):
    value = tx.try_approximate(c("conductivity_text"))
    return t.m.select("id", value.alias("value"), value.isNotNull().alias("readable"))


@query("x04_normalize_label", "SELECT id, family, family_norm FROM mp")
def x04(t):
    return t.m.select("id", "family", tx.normalize_label(c("family")).alias("family_norm"))


@query("x05_doi_tokens", "SELECT id, doi AS tokens, len(doi_tokens)::BIGINT AS token_count FROM mp")
def x05(t):
    tokens = tx.doi_tokens(c("doi_text"))
    return t.m.select("id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("bigint").alias("token_count"))


@query("x06_parse_formula", "SELECT formula, element, amount FROM comp", "amount")
def x06(t):
    return t.parsed.select("formula", F.explode("composition").alias("x")).select("formula", "x.element", "x.amount")


@query("x07_formula_key", "SELECT id, formula, formula_key, formula_full, formula_error FROM mf")
def x07(t):
    return ql.with_formula(t.m).select("id", "formula", "formula_key", "formula_full", "formula_error")


@query("x08_host_formula", f"SELECT id, {orc.strip('split_part(formula, chr(32) || chr(43) || chr(32), 1)')} AS host, contains(formula, ' + ') AS had_additive FROM m")
def x08(t):
    return t.m.select("id", tx.host_formula(c("formula")).alias("host"), tx.has_additive(c("formula")).alias("had_additive"))


@query("x09_measure_kind", f"SELECT id, {orc.measure_kind('note')} AS kind FROM m")
def x09(t):
    return t.m.select("id", tx.measure_kind(c("note")).alias("kind"))


@query("x10_build_note", """SELECT id, concat_ws('; ', nullif(CASE WHEN checked = '1' THEN 'seen' ELSE '' END, ''), 'method=' || method,
    'family=' || nullif(trim(family), ''), 'amorphous=' || nullif(CASE WHEN suppkey % 2 = 0 THEN 'no' ELSE '' END, '')) AS built FROM m""")
def x10(t):
    lead = F.when(c("checked") == "1", "seen").otherwise("")
    note = tx.build_note(lead, {
        "method": c("method"), "family": c("family"),
        "amorphous": F.when(c("suppkey") % 2 == 0, "no").otherwise(""),
    })
    return t.m.select("id", note.alias("built"))


@query("x11_note_value", "SELECT id, try_cast(trim(regexp_extract(note, 'measured_temperature_C=([^;]+)', 1)) AS DOUBLE) AS noted FROM m", "noted")
def x11(t):
    return t.m.select("id", tx.note_value(c("note"), "measured_temperature_C").alias("noted"))


@query("x12_source_tag", """SELECT id, CASE WHEN contains(lower(p), 'liverpool') THEN 'liverpool' WHEN contains(lower(p), 'caltech') THEN 'caltech'
    WHEN contains(lower(p), 'literature_additions') THEN 'literature' ELSE 'v1' END AS tag FROM (
    SELECT id, 'Shared/' || upper(source) || '/' || CASE WHEN source = 'literature' THEN 'Literature_additions.csv' ELSE 'table.csv' END AS p FROM m)""")
def x12(t):
    path = F.concat(
        F.lit("Shared/"), F.upper("source"), F.lit("/"),
        F.when(c("source") == "literature", "Literature_additions.csv").otherwise("table.csv"),
    )
    markers = (("liverpool", "liverpool"), ("caltech", "caltech"), ("literature_additions", "literature"))
    return t.m.select("id", tx.source_tag(path, markers, "v1").alias("tag"))


@query("x13_safe_log10", "SELECT id, CASE WHEN v > 0 THEN log10(v) END AS log_v FROM (SELECT id, value - 0.0005::DOUBLE AS v FROM mp)", "log_v")
def x13(t):
    return t.typed.select("id", ph.safe_log10(c("value") - 0.0005).alias("log_v"))


@query("x14_safe_arithmetic", """SELECT id, value - lowered AS diff, value / nullif(lowered, 0) AS ratio FROM (
    SELECT id, value, CASE WHEN suppkey % 5 = 0 THEN 0.0 WHEN suppkey % 5 = 1 THEN NULL ELSE value * 3.0::DOUBLE END::DOUBLE AS lowered FROM mp)""", "diff ratio")
def x14(t):
    other = F.when(c("suppkey") % 5 == 0, 0.0).when(c("suppkey") % 5 != 1, c("value") * 3.0)
    return t.typed.select("id", ph.safe_diff(c("value"), other).alias("diff"), ph.safe_ratio(c("value"), other).alias("ratio"))


@query("x15_ion_physics", """SELECT id, CASE WHEN r = 0 THEN 0.0 ELSE 3 * abs(z) * 1.602e-19::DOUBLE / (4 * pi() * pow(r * 1e-12::DOUBLE, 3)) END AS density,
    CASE WHEN r <> 0 THEN abs(z) / r END AS potential FROM (
    SELECT id, CAST(suppkey % 7 - 3 AS DOUBLE) AS z, CAST(partkey % 40 * 5 AS DOUBLE) AS r FROM m)""", "density potential")
def x15(t):
    z, r = (c("suppkey") % 7 - 3).cast("double"), (c("partkey") % 40 * 5).cast("double")
    return t.m.select("id", ph.charge_density(z, r).alias("density"), ph.ionic_potential(z, r).alias("potential"))


@query("x16_first_nonempty", """SELECT id, coalesce(nullif(formula, ''), nullif(CASE WHEN suppkey % 2 = 0 THEN method ELSE '' END, ''), '') AS picked FROM m""")
def x16(t):
    second = F.when(c("suppkey") % 2 == 0, c("method")).otherwise("")
    return t.m.select("id", tx.first_nonempty(c("formula"), second).alias("picked"))


@query("x17_units", """SELECT id, value / 1000.0::DOUBLE AS si, pow(10.0::DOUBLE, log10_value) AS back, log10_value - (suppkey % 21 - 10) / 10.0::DOUBLE AS residual FROM mp""", "si back residual")
def x17(t):
    guess = (c("suppkey") % 21 - 10) / F.lit(10.0)
    return t.typed.select(
        "id", ph.to_si(c("value")).alias("si"), ph.unlog10(c("log10_value")).alias("back"),
        ph.safe_diff(c("log10_value"), guess).alias("residual"),
    )


@query("x18_stable_key", f"SELECT id, {orc.stable_key('id', 'v2')} AS stable FROM m")
def x18(t):
    return t.m.select("id", tx.stable_key(c("id"), "v2").alias("stable"))


@query("x19_truthy_rank", "SELECT id, CASE WHEN lower(checked) IN ('1','true','yes') THEN 0 ELSE 1 END AS checked_rank FROM m")
def x19(t):
    return t.m.select("id", tx.truthy_rank(c("checked")).alias("checked_rank"))


# --- filters and quality ----------------------------------------------------------------


@query("f01_drop_organic", """SELECT m.id, CASE WHEN coalesce(o.organic, FALSE) THEN 'organic-like formula' ELSE 'kept' END AS outcome
    FROM m LEFT JOIN organic o USING (formula)""")
def f01(t):
    kept, removed = ql.drop_organic(t.mf)
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(removed.select("id", c(ql.REASON).alias("outcome")))


CHARGE_SQL = """SELECT m.id, b.residual_charge, coalesce(nullif(concat_ws('; ', CASE WHEN abs(b.residual_charge) > 6 THEN 'abs(residual_charge) > 6' END,
    CASE WHEN m.id IN (SELECT min(id) FROM m) THEN 'manual abnormal charge screening' END), ''), 'kept') AS outcome
    FROM m LEFT JOIN oxbest b USING (formula)"""


@query("f02_drop_charge_abnormal", CHARGE_SQL, "residual_charge")
def f02(t):
    listed = [t.m.agg(F.min("id")).first()[0]]
    kept, removed = ql.drop_charge_abnormal(t.mf, 6.0, listed)
    return kept.select("id", "residual_charge", F.lit("kept").alias("outcome")).unionByName(
        removed.select("id", "residual_charge", c(ql.REASON).alias("outcome"))
    )


@query("f03_threshold_policy", """SELECT id, CASE WHEN low THEN NULL ELSE log10_value END AS log10_value, CASE WHEN low THEN 'filtered_out: conductivity < 1e-05' ELSE 'kept' END AS outcome,
    1.0::DOUBLE AS sample_weight FROM (SELECT *, coalesce(value < 1e-5::DOUBLE OR (qualifier = 'upper_bound' AND value <= 1e-5::DOUBLE), FALSE) AS low FROM mp)""",
    "log10_value sample_weight")
def f03(t):
    kept, removed = ql.threshold_policy(t.typed, 1e-5)
    return kept.select("id", "log10_value", F.lit("kept").alias("outcome"), "sample_weight").unionByName(
        removed.select("id", F.lit(None).cast("double").alias("log10_value"), c(ql.REASON).alias("outcome"), "sample_weight")
    )


REJECT_SQL = """SELECT id, CASE WHEN formula_error <> '' THEN 'unparseable formula: ' || formula_error WHEN len(doi_tokens) = 0 THEN 'missing or invalid DOI'
    WHEN coalesce(value <= 0, TRUE) THEN 'missing value' WHEN source = 'liverpool' AND NOT temperature_c BETWEEN 20 AND 30 THEN 'temperature' ELSE 'kept' END AS outcome FROM mf"""


@query("f04_reject_first", REJECT_SQL)
def f04(t):
    kept, removed = ql.reject_first(t.mf, [
        (c("formula_error") != "", F.concat(F.lit("unparseable formula: "), c("formula_error"))),
        (F.size("doi_tokens") == 0, "missing or invalid DOI"),
        (~F.coalesce(c("value") > 0, F.lit(False)), "missing value"),
        ((c("source") == "liverpool") & ~c("temperature_c").between(20, 30), "temperature"),
    ])
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(removed.select("id", c(ql.REASON).alias("outcome")))


@query("f05_active_only", "SELECT id, suppkey FROM m WHERE suppkey % 9 <> 4")
def f05(t):
    status = F.when(c("suppkey") % 9 == 4, "retired").otherwise(" Active ")
    # The second call has no status column and keeps every row.
    return ql.active_only(ql.active_only(t.m.withColumn("status", status)).drop("status")).select("id", "suppkey")


@query("f06_apply_overrides", """SELECT id, CASE formula_key WHEN 'Li10P2S12Sn' THEN 'lgps' WHEN 'Cl4LiNbO' THEN 'oxyhalides' ELSE family_norm END AS family_norm,
    CASE WHEN id IN (SELECT max(id) FROM m) THEN 'Li6.75La3Zr1.75O12' ELSE formula END AS formula FROM mf""")
def f06(t):
    rows = ql.apply_overrides(t.mf.select("id", "formula", "formula_key", "family_norm"), "formula_key", "family_norm",
                              {"Li10P2S12Sn": "lgps", "Cl4LiNbO": "oxyhalides"})
    last = t.m.agg(F.max("id")).first()[0]
    return ql.apply_overrides(rows, "id", "formula", {last: "Li6.75La3Zr1.75O12"}).select("id", "family_norm", "formula")


@query("f07_drop_both_low", """SELECT b.id, b.method FROM m b WHERE b.id IN (
    SELECT id FROM (SELECT id, value AS va, value * (1 + suppkey % 4 * 20) AS vb FROM mp) WHERE NOT coalesce(va < 1e-5::DOUBLE AND vb < 1e-5::DOUBLE, FALSE) AND va IS NOT NULL)""")
def f07(t):
    pairs = t.typed.filter("value IS NOT NULL").select("id", c("value").alias("va"), (c("value") * (1 + c("suppkey") % 4 * 20)).alias("vb"))
    return ql.drop_both_low(pairs, t.m.select("id", "method"), 1e-5, "va", "vb", "id")


@query("f08_accounting", f"SELECT source, CASE WHEN outcome LIKE 'unparseable%' THEN 'formula' ELSE outcome END AS outcome, count(*) AS row_count FROM ({REJECT_SQL}) JOIN (SELECT id, source FROM m) USING (id) GROUP BY ALL")
def f08(t):
    kept, removed = ql.reject_first(t.mf, [
        (c("formula_error") != "", "formula"),
        (F.size("doi_tokens") == 0, "missing or invalid DOI"),
        (~F.coalesce(c("value") > 0, F.lit(False)), "missing value"),
        ((c("source") == "liverpool") & ~c("temperature_c").between(20, 30), "temperature"),
    ])
    return ql.accounting(kept, removed)


@query("f09_check_invariants", """WITH r AS (SELECT id, doi, value, w.n, 1.0::DOUBLE / w.n + CASE WHEN doi LIKE '%0' THEN 0.5 ELSE 0 END AS weight
        FROM mp JOIN (SELECT doi, count(*) AS n FROM mp GROUP BY doi) w USING (doi))
    SELECT 'value missing' AS rule, count(*) FILTER (WHERE value IS NULL) AS violation_count FROM r
    UNION ALL SELECT 'value above 0.05', count(*) FILTER (WHERE value > 0.05) FROM r
    UNION ALL SELECT 'duplicate id', count(*) FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'group weight not 1', count(*) FROM (SELECT doi FROM r GROUP BY doi HAVING abs(sum(weight) - 1) > 1e-8)""")
def f09(t):
    rows = wn.group_weight(t.narrow("id", "doi", "value"), "doi").withColumn(
        "weight", c("weight") + F.when(c("doi").endswith("0"), 0.5).otherwise(0.0)
    )
    rules = {"value missing": c("value").isNull(), "value above 0.05": c("value") > 0.05}
    return ql.check_invariants(rows, rules, "id", "doi", "weight")


@query("f10_reconcile", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra'
    WHEN a.formula IS DISTINCT FROM b.formula THEN 'text mismatch'
    WHEN NOT coalesce(abs(a.value - b.value) <= 1e-12::DOUBLE + 1e-10::DOUBLE * abs(b.value), a.value IS NULL AND b.value IS NULL) THEN 'number mismatch' ELSE 'same' END AS status
    FROM (SELECT id, formula, value FROM mp WHERE suppkey % 13 <> 1) a FULL JOIN (
        SELECT id, CASE WHEN suppkey % 13 = 2 THEN formula || 'x' ELSE formula END AS formula, CASE WHEN suppkey % 13 = 3 THEN value * 1.001::DOUBLE ELSE value * (1 + 1e-13::DOUBLE) END AS value
        FROM mp WHERE suppkey % 13 <> 4) b ON a.id = b.id""")
def f10(t):
    key = c("suppkey") % 13
    rows = t.narrow("id", "formula", "value", "suppkey")
    a = rows.filter(key != 1)
    b = rows.filter(key != 4).select(
        "id", F.when(key == 2, F.concat("formula", F.lit("x"))).otherwise(c("formula")).alias("formula"),
        F.when(key == 3, c("value") * 1.001).otherwise(c("value") * (1 + 1e-13)).alias("value"),
    )
    return ql.reconcile(a, b, "id", "formula", "value")


# --- sorting and sets -------------------------------------------------------------------


@query("t01_order_by", "SELECT id, formula, value, row_number() OVER (ORDER BY value DESC NULLS LAST, formula, id) AS place FROM mp", "value")
def t01(t):
    order = [F.desc_nulls_last("value"), c("formula"), c("id")]
    return row_rank(t.typed.select("id", "formula", "value"), [], order, "place")


@query("t02_topn_share", """SELECT formula, total, total / (SELECT sum(value) FROM mp) AS share FROM (
    SELECT formula, sum(value) AS total FROM mp GROUP BY formula ORDER BY total DESC NULLS LAST, formula LIMIT 20)""", "total share")
def t02(t):
    totals = t.typed.groupBy("formula").agg(F.sum("value").alias("total"))
    return wn.topn_share(totals, "total", 20, c("formula"))


@query("t03_best_by", """SELECT method, arg_min(formula, (mae, formula)) AS best_formula FROM (SELECT method, formula, avg(abs(log10_value + 4)) AS mae FROM mp WHERE value > 0 GROUP BY ALL) GROUP BY method""")
def t03(t):
    scores = t.typed.filter("value > 0").groupBy("method", "formula").agg(F.avg(F.abs(c("log10_value") + 4)).alias("mae"))
    return wn.best_by(scores, ["method"], "formula", c("mae"), c("formula"), smallest=True)


@query("u01_union_aligned", """SELECT id, formula, CASE WHEN source IN ('v1', 'literature') THEN method END AS method,
    CASE WHEN source = 'liverpool' THEN note END AS extra FROM m""")
def u01(t):
    frames = [
        t.m.filter("source = 'v1'").select("method", "id", "formula"),
        t.m.filter("source = 'caltech'").select("formula", "id", "note"),
        t.m.filter("source = 'literature'").select("id", "doi_text", "method", "formula"),
        t.m.filter("source = 'liverpool'").select(c("note").alias("extra"), "formula", "id"),
    ]
    return wn.union_aligned(frames, ["id", "formula", "method", "extra"])


@query("u02_coverage", """SELECT formula, 'missing' AS side FROM (SELECT formula FROM m WHERE partkey % 3 <> 0 EXCEPT SELECT formula FROM m WHERE partkey % 7 = 0)
    UNION ALL SELECT formula, 'extra' FROM (SELECT formula FROM m WHERE partkey % 7 = 0 EXCEPT SELECT formula FROM m WHERE partkey % 3 <> 0)""")
def u02(t):
    return wn.coverage(t.m.filter("partkey % 3 != 0"), t.m.filter("partkey % 7 = 0"), "formula")


@query("u03_leakage", "SELECT doi FROM mp WHERE suppkey % 5 = 0 INTERSECT SELECT doi FROM mp WHERE suppkey % 5 = 1")
def u03(t):
    return wn.leakage(t.typed.filter("suppkey % 5 = 0"), t.typed.filter("suppkey % 5 = 1"), "doi")


@query("u04_unordered_pairs", "SELECT DISTINCT least(formula, family_norm) AS first, greatest(formula, family_norm) AS second FROM mp")
def u04(t):
    return wn.unordered_pairs(t.typed, "formula", "family_norm")


@query("u05_unseen_values", "SELECT formula, count(*) AS row_count FROM m WHERE formula NOT IN (SELECT formula FROM m WHERE suppkey % 50 = 7) GROUP BY formula")
def u05(t):
    return wn.unseen_values(t.m, "formula", t.m.filter("suppkey % 50 = 7"))

