"""Column expressions that read messy measurement text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spellings and the family each one means.
FAMILY_ALIASES = {
    "anti_perovskite": "antiperovskite",
    "argyrodite": "argyrodites",
    "argyrodite_like": "argyrodites",
    "chloride": "chlorides",
    "cholorides": "chlorides",
    "garnet_like": "garnet",
    "halide": "halides",
    "halide_like": "halides",
    "halides_like": "halides",
    "lgps_like": "lgps",
    "oxide": "oxides",
    "oxyhalide": "oxyhalides",
    "oxyhalide_like": "oxyhalides",
    "perovskite": "perovskites",
    "sulfide": "sulfides",
}
NULL_LABELS = ("nan", "none", "null", "unknown")
UNKNOWN = "unknown"

# Fixed pattern: optional comparison signs, then one number.
NUMBER_PATTERN = r"^[<>=~≤≥\s]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
SCIENTIFIC_PATTERN = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*x\s*10\s*([+-]?[0-9]+)"
DOI_PREFIX_PATTERN = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)"
DOI_PATTERN = r"^10\.\d{4,9}/\S+$"


# What the pattern \s means.
WHITE = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _plain_minus(text: Column) -> Column:
    return F.translate(strip(text), "−", "-")


def measure_value(text: Column) -> Column:
    """Number in a measurement text, null when there is none."""
    found = F.regexp_extract(F.translate(_plain_minus(text), ",", ""), NUMBER_PATTERN, 1)
    return _empty_to_null(found).try_cast("double")


def measure_qualifier(text: Column) -> Column:
    clean = _plain_minus(text)
    return (
        F.when(text.isNull(), "missing")
        .when(measure_value(text).isNull(), "unparsed")
        .when(clean.rlike(r"^[<≤]"), "upper_bound")
        .when(clean.rlike(r"^[>≥]"), "lower_bound")
        .otherwise("exact")
    )


def parse_scientific(text: Column, scale: float = 1.0) -> Column:
    """``a x 10 b`` notation or a plain number, ``#`` comments cut off."""
    value = strip(F.split_part(text, F.lit("#"), F.lit(1)))
    mantissa = _empty_to_null(F.regexp_extract(value, SCIENTIFIC_PATTERN, 1)).try_cast("double")
    exponent = _empty_to_null(F.regexp_extract(value, SCIENTIFIC_PATTERN, 2)).try_cast("int")
    power = F.when(exponent.isNotNull(), F.pow(F.lit(10.0), exponent.cast("double")))
    return F.coalesce(mantissa * power, value.try_cast("double")) * F.lit(float(scale))


def _approximate(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"^[≈~]", ""))


def parse_approximate(text: Column) -> Column:
    """Drop one leading ``≈`` or ``~`` and cast; a non-number is an error under ANSI."""
    return _approximate(text).cast("double")


def try_approximate(text: Column) -> Column:
    """As ``parse_approximate``, null for a text that is no number."""
    return _approximate(text).try_cast("double")


def normalize_label(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Stable category name of a free-text label."""
    table = FAMILY_ALIASES if aliases is None else aliases
    lowered = F.lower(strip(text))
    slug = F.btrim(F.regexp_replace(lowered, r"[^a-z0-9]+", "_"), F.lit("_"))
    pairs = [F.lit(word) for pair in table.items() for word in pair]
    mapped = F.coalesce(F.get(F.array(F.create_map(*pairs)), 0)[slug], slug) if pairs else slug
    return (
        F.when(text.isNull() | (lowered == "") | lowered.isin(*NULL_LABELS), UNKNOWN)
        .when(slug == "", UNKNOWN)
        .otherwise(mapped)
    )


def doi_tokens(text: Column) -> Column:
    """Sorted distinct identifiers in a pipe-separated text."""

    def clean(token: Column) -> Column:
        bare = F.regexp_replace(strip(token), DOI_PREFIX_PATTERN, "")
        return F.lower(F.rtrim(bare, F.lit(".,")))

    tokens = F.transform(F.split(text, r"\|"), clean)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike(DOI_PATTERN))))


def host_formula(text: Column) -> Column:
    """Formula before an additive description such as `` + 5wt%X``."""
    return strip(F.substring_index(text, " + ", 1))


def has_additive(text: Column) -> Column:
    return text != host_formula(text)


# Fixed value: a spelling of bulk with two zero-width spaces.
SPACED_BULK = "sb\u200b\u200bulk"


def measure_kind(note: Column) -> Column:
    """Bulk or total measurement; neither or both is unknown."""
    text = F.lower(F.coalesce(note, F.lit("")))
    bulk = text.contains("bulk") | text.contains(SPACED_BULK)
    total = text.contains("σtot") | text.contains("total")
    return F.when(bulk & ~total, "bulk").when(total & ~bulk, "tot").otherwise(UNKNOWN)


def build_note(lead: Column, parts: Mapping[str, Column]) -> Column:
    """``lead; key=value; ...`` with empty values left out."""
    pieces = [_empty_to_null(strip(lead))]
    for key, value in parts.items():
        text = _empty_to_null(strip(value.cast("string")))
        pieces.append(F.concat(F.lit(f"{key}="), text))
    return F.concat_ws("; ", *pieces)


def note_value(note: Column, key: str) -> Column:
    """Number stored under ``key`` in a ``k=v; k=v`` note."""
    return strip(F.regexp_extract(note, rf"{key}=([^;]+)", 1)).try_cast("double")


def source_tag(path: Column, ordered: Sequence[tuple[str, str]], default: str) -> Column:
    """First tag whose marker occurs in a path text."""
    text = F.lower(path)
    choice = None
    for marker, tag in ordered:
        hit = text.contains(marker)
        choice = F.when(hit, tag) if choice is None else choice.when(hit, tag)
    return choice.otherwise(default)


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[_empty_to_null(c) for c in cols], F.lit(""))


def truthy_rank(flag: Column) -> Column:
    """0 for a confirmed row, 1 otherwise, so confirmed rows sort first."""
    return F.when(F.lower(flag).isin("1", "true", "yes"), 0).otherwise(1)


def stable_key(text: Column, salt: str) -> Column:
    """Repeatable pseudo-random order key."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), text), 256)


def hash_fraction(text: Column, salt: str) -> Column:
    """Number in [0, 1) fixed by the text: 32 bits of its stable key."""
    head = F.conv(F.substring(stable_key(text, salt), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
