"""DuckDB text of the shared views: the reference results are computed from the
same tables with independent SQL.  Names found in a body are added as common
table expressions."""

from __future__ import annotations

import re

from saltmarsh.functions import elements as el
from saltmarsh.functions.formula import ELEMENT_SYMBOLS
from saltmarsh.functions.text import FAMILY_ALIASES
from saltmarsh.sources.views import MEASUREMENT_EXPRESSIONS, SEGMENT_EXPRESSIONS

NUMBER = r"^[<>=~≤≥\s]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def measure_value(x: str) -> str:
    clean = f"replace(replace({strip(x)}, '−', '-'), ',', '')"
    return f"try_cast(nullif(regexp_extract({clean}, '{NUMBER}', 1), '') AS DOUBLE)"


def qualifier(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'missing' WHEN {measure_value(x)} IS NULL THEN 'unparsed'
        WHEN regexp_matches({strip(x)}, '^[<≤]') THEN 'upper_bound'
        WHEN regexp_matches({strip(x)}, '^[>≥]') THEN 'lower_bound' ELSE 'exact' END"""


def normalize_label(x: str) -> str:
    low = f"lower({strip(x)})"
    slug = f"regexp_replace(regexp_replace({low}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    aliases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FAMILY_ALIASES.items())
    return f"""CASE WHEN {x} IS NULL OR {low} IN ('', 'nan', 'none', 'null', 'unknown') THEN 'unknown'
        WHEN {slug} = '' THEN 'unknown' ELSE CASE {slug} {aliases} ELSE {slug} END END"""


def doi_tokens(x: str) -> str:
    return rf"""list_sort(list_distinct(list_filter(list_transform(string_split({x}, '|'),
        lambda t: lower(regexp_replace(regexp_replace({strip('t')}, '^(https?://(dx\.)?doi\.org/|doi\s*:\s*)', '', 'i'),
        '[.,]+$', ''))), lambda t: regexp_full_match(t, '10\.\d{{4,9}}/\S+'))))"""


def parse_scientific(x: str) -> str:
    value = strip(f"split_part({x}, '#', 1)")
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*[xX]\s*10\s*([+-]?[0-9]+)"
    mantissa = f"try_cast(nullif(regexp_extract({value}, '{pattern}', 1), '') AS DOUBLE)"
    exponent = f"try_cast(nullif(regexp_extract({value}, '{pattern}', 2), '') AS INTEGER)"
    return f"coalesce({mantissa} * pow(10.0::DOUBLE, {exponent}), try_cast({value} AS DOUBLE))"


def measure_kind(x: str) -> str:
    spaced = "'sb' || chr(8203) || chr(8203) || 'ulk'"
    bulk, total = f"(contains(lower({x}), 'bulk') OR contains(lower({x}), {spaced}))", f"(contains(lower({x}), 'σtot') OR contains(lower({x}), 'total'))"
    return f"CASE WHEN {bulk} AND NOT {total} THEN 'bulk' WHEN {total} AND NOT {bulk} THEN 'tot' ELSE 'unknown' END"


def amount_text(x: str) -> str:
    return rf"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(18,6)) AS VARCHAR), '0+$', ''), '\.$', '')"


def hash_fraction(x: str, salt: str) -> str:
    return f"(CAST('0x' || substr(sha256('{salt}|' || {x}), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def stable_key(x: str, salt: str) -> str:
    return f"sha256('{salt}|' || {x})"


def norm(x: str) -> str:
    """Seven significant digits.

    The factor just above 1 moves exact halves off the rounding edge.
    """
    r = f"({x} * 1.0000000001::DOUBLE)"
    digits = f"(6 - floor(log10(abs({r}))))"
    up, down = f"pow(10.0::DOUBLE, {digits})", f"pow(10.0::DOUBLE, -{digits})"
    return f"""CASE WHEN {x} = 0 THEN 0.0::DOUBLE WHEN {digits} >= 0 THEN round({r} * {up}) / {up}
        ELSE round({r} / {down}) * {down} END"""


def values(rows, columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(i) for i in v) + "]::DOUBLE[]"
        return str(v) if isinstance(v, int) else f"'{v}'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def _select(expressions: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in expressions.items()) + f" FROM {source}"


TOKEN = r"([A-Z][a-z]?|[()])(\d+\.?\d*|\.\d+)?"
_SYMBOLS = ", ".join(f"'{s}'" for s in ELEMENT_SYMBOLS)
_COMMON = [(r[0], r[9]) for r in el.element_rows()]

CTES: dict[str, str] = {
    "m": _select(MEASUREMENT_EXPRESSIONS, "lineitem l JOIN part p ON l.l_partkey = p.p_partkey"),
    "e": _select(SEGMENT_EXPRESSIONS, "events"),
    "mp": f"""SELECT *, CASE WHEN value > 0 THEN log10(value) END AS log10_value,
        array_to_string(doi_tokens, '|') AS doi FROM (SELECT m.*, {measure_value('conductivity_text')} AS value,
        {qualifier('conductivity_text')} AS qualifier, {normalize_label('family')} AS family_norm,
        {doi_tokens('doi_text')} AS doi_tokens FROM m)""",
    # Formulas, read from the right with a stack of multipliers.
    "ftok": rf"""SELECT formula, clean, list_reverse(regexp_extract_all(clean, '{TOKEN}')) AS toks FROM (
        SELECT DISTINCT formula, translate(regexp_replace(formula, '\s+', '', 'g'), '[]{{}}', '()()') AS clean FROM m)""",
    "frec": r"""SELECT formula, toks, 0 AS i, [1.0::DOUBLE] AS stack, NULL::VARCHAR AS element, NULL::DOUBLE AS amount
        FROM ftok UNION ALL
        SELECT formula, toks, i + 1, CASE WHEN sym = ')' THEN list_prepend(num * stack[1], stack)
            WHEN sym = '(' THEN stack[2:] ELSE stack END,
            CASE WHEN sym NOT IN ('(', ')') THEN sym END, num * stack[1]
        FROM (SELECT *, regexp_extract(toks[i + 1], '^([A-Z][a-z]?|[()])', 1) AS sym,
            coalesce(try_cast(nullif(regexp_extract(toks[i + 1], '([0-9.]+)$', 1), '') AS DOUBLE), 1.0::DOUBLE) AS num
            FROM frec WHERE i < len(toks))""",
    "fgood": rf"""SELECT t.formula FROM ftok t JOIN frec r ON r.formula = t.formula AND r.i = len(t.toks)
        WHERE len(t.toks) > 0 AND regexp_replace(t.clean, '{TOKEN}', '', 'g') = '' AND len(r.stack) = 1 AND r.stack[1] = 1.0
        AND NOT EXISTS (SELECT 1 FROM frec x WHERE x.formula = t.formula AND x.element IS NOT NULL
            AND (x.element NOT IN ({_SYMBOLS}) OR x.amount IS NULL OR x.amount <= 0))""",
    "comp": """SELECT formula, element, amount, row_number() OVER (PARTITION BY formula ORDER BY first_seen DESC) AS pos
        FROM (SELECT formula, element, sum(amount) AS amount, max(i) AS first_seen FROM frec
            WHERE element IS NOT NULL AND formula IN (SELECT formula FROM fgood) GROUP BY formula, element)""",
    "fkey": f"""SELECT d.formula, k.formula_key, k.formula_full, CASE WHEN {strip('d.formula')} = '' THEN 'missing formula'
            WHEN k.formula IS NULL THEN 'invalid formula ' || d.formula ELSE '' END AS formula_error
        FROM (SELECT DISTINCT formula FROM m) d LEFT JOIN (
            SELECT formula, string_agg(element || CASE WHEN a = 1.0 THEN '' ELSE {amount_text('a')} END, '' ORDER BY element) AS formula_key,
                string_agg(element || CASE WHEN amount = 1.0 THEN '' ELSE {amount_text('amount')} END, ' ' ORDER BY element) AS formula_full
            FROM (SELECT c.*, CASE WHEN g.whole THEN round(c.amount) / g.d ELSE c.amount END AS a FROM comp c JOIN (
                SELECT formula, bool_and(abs(amount - round(amount)) < 1e-8) AS whole,
                    list_reduce(list(CAST(round(amount) AS BIGINT)), lambda x, y: gcd(x, y)) AS d
                FROM comp GROUP BY formula) g USING (formula)) GROUP BY formula) k USING (formula)""",
    "mf": "SELECT mp.*, fkey.formula_key, fkey.formula_full, fkey.formula_error FROM mp JOIN fkey USING (formula)",
    # Charges: all combinations of the candidate states.
    "organic": """SELECT formula, bool_or(element = 'C') AND bool_or(element = 'H') AS organic FROM comp GROUP BY formula""",
    "candidate_dim": values(el.candidate_rows(), "element, states"),
    "cand_states": """SELECT c.formula, c.pos, c.element, c.amount, o.organic AND c.element IN ('C','H','N','O') AS neutral,
        coalesce(d.states, [0.0]::DOUBLE[]) AS states
        FROM comp c JOIN organic o USING (formula) LEFT JOIN candidate_dim d USING (element)""",
    "oxopen": """SELECT *, row_number() OVER (PARTITION BY formula ORDER BY pos) AS k FROM cand_states
        WHERE NOT neutral AND len(states) > 1""",
    "oxrec": """SELECT formula, 0 AS k, coalesce(sum(amount * states[1]) FILTER (WHERE NOT neutral AND len(states) = 1), 0.0)::DOUBLE AS q,
            0.0::DOUBLE AS p, []::BIGINT[] AS idx FROM cand_states GROUP BY formula
        UNION ALL
        SELECT r.formula, r.k + 1, r.q + o.amount * o.states[s.i], r.p + abs(o.states[s.i]), list_append(r.idx, s.i)
        FROM oxrec r JOIN oxopen o ON o.formula = r.formula AND o.k = r.k + 1
        CROSS JOIN generate_series(1, 5) s(i) WHERE s.i <= len(o.states)""",
    "oxbest": """SELECT formula, idx, q AS residual_charge FROM (SELECT r.*, row_number() OVER (PARTITION BY r.formula
            ORDER BY round(abs(q) + 0.001::DOUBLE * p, 9), idx) AS rn
        FROM oxrec r WHERE r.k = (SELECT count(*) FROM oxopen o WHERE o.formula = r.formula)) WHERE rn = 1""",
    "ox": """SELECT c.formula, c.pos, c.element, c.amount, CASE WHEN c.neutral THEN NULL WHEN len(c.states) = 1 THEN c.states[1]
            ELSE c.states[b.idx[o.k]] END AS charge
        FROM cand_states c JOIN oxbest b USING (formula) LEFT JOIN oxopen o ON o.formula = c.formula AND o.element = c.element""",
    "oxjson": """SELECT formula, '[' || coalesce(string_agg('{"element":"' || element || '","value":' || CAST(charge AS VARCHAR) || '}', ',' ORDER BY pos)
            FILTER (WHERE charge IS NOT NULL), '') || ']' AS z_by_element FROM ox GROUP BY formula""",
    "radius_entry": values(el.radius_entries(), "element, charge, radius, reliable"),
    "radius_mean": """SELECT element, charge, coalesce(avg(radius) FILTER (WHERE reliable), avg(radius)) AS radius_pm
        FROM radius_entry GROUP BY element, charge""",
    "radius_fixed": values([(a, b, r) for (a, b), r in el.RADIUS_OVERRIDES_PM.items()], "element, charge, radius_pm"),
    "radius_lent": values([(a, b, c) for (a, b), c in el.RADIUS_BORROWED_CHARGE.items()], "element, charge, source_charge"),
    "radius_final": """SELECT element, charge, coalesce(f.radius_pm, l.radius_pm, m.radius_pm) AS radius_pm
        FROM radius_fixed f FULL JOIN (SELECT b.element, b.charge, r.radius_pm FROM radius_lent b JOIN radius_mean r
            ON r.element = b.element AND r.charge = b.source_charge) l USING (element, charge)
        FULL JOIN radius_mean m USING (element, charge)""",
    "element_dim": values([r[:10] for r in el.element_rows()],
        "element, number, chi, mass, melting, bond_radius, s_electrons, d_electrons, s_volume, common_charge"),
    "ef": """SELECT x.formula, x.pos, x.element, x.amount, x.charge,
            CASE WHEN x.element = 'Li' THEN 'Li' WHEN x.element = 'H' AND x.charge > 0 THEN 'proton'
                WHEN x.charge < 0 AND x.element IN ('F','Cl','Br','I') THEN 'halide' WHEN x.charge < 0 THEN 'anion'
                WHEN x.charge > 0 THEN 'host_cation' WHEN x.element IN ('F','Cl','Br','I') THEN 'halide'
                WHEN x.element IN ('O','S','Se','Te','N','P') THEN 'anion' ELSE 'host_cation' END AS role,
            d.chi, r.radius_pm AS radius,
            CASE WHEN r.radius_pm = 0 THEN 0.0 ELSE 3 * abs(x.charge) * 1.602e-19::DOUBLE / (4 * pi() * pow(r.radius_pm * 1e-12::DOUBLE, 3)) END AS rho,
            CASE WHEN r.radius_pm <> 0 THEN abs(x.charge) / r.radius_pm END AS phi,
            coalesce(r.radius_pm, c.radius_pm, 0.0) AS v_ionic, coalesce(d.d_electrons, 0.0) AS v_d, coalesce(d.s_electrons, 0.0) AS v_s,
            coalesce(d.bond_radius, 0.0) AS v_bond, coalesce(d.s_volume, 0.0) AS v_vs, coalesce(d.melting, 0.0) AS v_melt,
            coalesce(d.mass, 0.0) AS v_mass
        FROM ox x LEFT JOIN radius_final r ON r.element = x.element AND r.charge = x.charge AND x.charge <> 0
        LEFT JOIN element_dim d ON d.element = x.element
        LEFT JOIN radius_final c ON c.element = d.element AND c.charge = CAST(d.common_charge AS INTEGER)""",
}


def _wmean(value: str, predicate: str) -> str:
    known = f"FILTER (WHERE ({predicate}) AND {value} IS NOT NULL)"
    return f"sum(amount * {value}) {known} / sum(amount) {known}"


ANION, CATION, HOST = "role IN ('anion','halide')", "role IN ('Li','host_cation')", "role = 'host_cation'"
_BASE = {f"{s}_{n}": _wmean(c, p) for s, c in (("chi", "chi"), ("r", "radius"), ("rho", "rho"))
         for n, p in (("all", "TRUE"), ("anion", ANION), ("cation", CATION), ("host", HOST))}
_BASE |= {
    "phi_cation": _wmean("phi", CATION),
    "phi_host": _wmean("phi", HOST),
    "chi_range": "CASE WHEN count(chi) >= 2 THEN max(chi) - min(chi) END",
    "n_halide": "coalesce(sum(amount) FILTER (WHERE role = 'halide'), 0) / sum(amount)",
    "n_host": f"coalesce(sum(amount) FILTER (WHERE {HOST}), 0) / sum(amount)",
    "n_anion": "coalesce(sum(amount) FILTER (WHERE role = 'anion'), 0) / sum(amount)",
    "n_li": "coalesce(sum(amount) FILTER (WHERE role = 'Li'), 0) / sum(amount)",
    "tau_cationic": f"""coalesce(sum(amount) FILTER (WHERE {ANION}), 0)
        / nullif(coalesce(sum(amount) FILTER (WHERE role IN ('Li','host_cation','proton')), 0), 0)""",
    "delta_anion": f"""CASE WHEN count(*) FILTER (WHERE {ANION}) = 0 THEN NULL WHEN count(*) FILTER (WHERE {ANION}) = 1 THEN 0.0::DOUBLE
        WHEN count(*) FILTER (WHERE {ANION} AND radius IS NULL) > 0 THEN NULL
        ELSE sqrt(sum(amount * pow(radius - anion_mean, 2)) FILTER (WHERE {ANION}) / sum(amount) FILTER (WHERE {ANION})) / max(anion_mean) END""",
}
# Variances are centred first: a second pass over the window mean.
_SMALL = {
    "ir_mean_square_all": "sum(amount * v_ionic * v_ionic) / sum(amount)",
    "d_mean_c": f"coalesce(sum(amount * v_d) FILTER (WHERE {CATION}) / sum(amount) FILTER (WHERE {CATION}), 0)",
    "r_mean_l": "coalesce(sum(amount * v_bond) FILTER (WHERE element <> 'Li') / sum(amount) FILTER (WHERE element <> 'Li'), 0)",
    "s_mean_square_c": f"coalesce(sum(amount * v_s * v_s) FILTER (WHERE {CATION}) / sum(amount) FILTER (WHERE {CATION}), 0)",
    "entropy_c_l": f"""CASE WHEN count(*) FILTER (WHERE {HOST}) <= 1 THEN 0.0::DOUBLE
        ELSE -sum(amount / host_amount * ln(amount / host_amount)) FILTER (WHERE {HOST}) END""",
    "vs_variance_c_l": f"coalesce(sum(amount * pow(v_vs - host_vs, 2)) FILTER (WHERE {HOST}) / max(host_amount), 0)",
    "mp_variance_c_l": f"coalesce(sum(amount * pow(v_melt - host_melt, 2)) FILTER (WHERE {HOST}) / max(host_amount), 0)",
    "atwt_geometric_mean_all": "CASE WHEN min(v_mass) <= 0 THEN 0.0::DOUBLE ELSE exp(sum(amount * ln(nullif(v_mass, 0))) / sum(amount)) END",
}
CTES["ew"] = f"""SELECT ef.*, sum(amount) FILTER (WHERE {HOST}) OVER w AS host_amount,
    sum(amount * v_vs) FILTER (WHERE {HOST}) OVER w / sum(amount) FILTER (WHERE {HOST}) OVER w AS host_vs,
    sum(amount * v_melt) FILTER (WHERE {HOST}) OVER w / sum(amount) FILTER (WHERE {HOST}) OVER w AS host_melt,
    sum(amount * radius) FILTER (WHERE {ANION}) OVER w / sum(amount) FILTER (WHERE {ANION}) OVER w AS anion_mean
    FROM ef WINDOW w AS (PARTITION BY formula)"""
CTES["dagg"] = "SELECT formula, " + ", ".join(f"{e} AS {n}" for n, e in (_BASE | _SMALL).items()) + " FROM ew GROUP BY formula"
CTES["dsc"] = """SELECT d.*, z_by_element, chi_cation - chi_anion AS chi_cation_gap, chi_host - chi_anion AS chi_host_gap,
    r_host - r_anion AS r_host_gap, r_cation - r_anion AS r_cation_gap, r_host / nullif(r_anion, 0) AS r_host_ratio,
    r_cation / nullif(r_anion, 0) AS r_cation_ratio, rho_cation / nullif(rho_anion, 0) AS rho_cation_ratio,
    rho_cation - rho_anion AS rho_cation_gap FROM dagg d JOIN oxjson USING (formula)"""
CTES["desc_all"] = """SELECT *, r_cation_ratio * chi_cation_gap AS r_ratio_x_chi_diff,
    CASE WHEN rho_cation_ratio IS NOT NULL THEN log10(greatest(rho_cation_ratio, 1e-3::DOUBLE)) END AS log_rho_ratio,
    n_li * r_anion AS n_li_x_r_anion, chi_range * r_all AS chi_range_x_r_avg, phi_cation * r_cation_gap AS field_x_r_diff FROM dsc"""


def oracle(body: str) -> str:
    """Body with every shared view it mentions, directly or not."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    # A body may start with its own WITH list.
    visit(body)
    own = ""
    stripped = body.strip()
    if stripped.upper().startswith("WITH "):
        stripped = stripped[5:]
        own = ", " if needed else ""
    else:
        stripped = " " + stripped
    shared = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    if not shared:
        return body
    return f"WITH RECURSIVE {shared}{own}{stripped}"


def rounded(body: str, doubles: list[str]) -> str:
    """Wrap a body so its double columns are compared at seven digits."""
    sql = oracle(body)
    if not doubles:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'{norm(c)} AS {c}' for c in doubles)}) FROM ({sql}) AS final_rows"
