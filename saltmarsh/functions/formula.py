"""Chemical formulas as arrays of (element, amount), built-in functions only.

All of this runs per row on the JVM.  Callers apply it to distinct formulas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import strip

# The element symbols.
ELEMENT_SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce "
    "Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl "
    "Mc Lv Ts Og"
).split()

TOKEN_PATTERN = r"([A-Z][a-z]?|[()])(\d+\.?\d*|\.\d+)?"
COMPOSITION_TYPE = "array<struct<element:string,amount:double>>"
AMOUNT_DIGITS = 6


def clean_formula(text: Column) -> Column:
    """Remove blanks and write every bracket as a parenthesis."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "[]{}", "()()")


def parse_formula(text: Column) -> Column:
    """Element amounts in order of first appearance; null when unreadable.

    Tokens are folded from the right.  A closing bracket pushes its multiplier
    times the current one, an opening bracket pops it, and an element takes the
    multiplier on top.
    """
    clean = clean_formula(text)
    tokens = F.reverse(F.regexp_extract_all(clean, F.lit(TOKEN_PATTERN), 0))
    start = F.struct(
        F.array(F.lit(1.0)).alias("stack"),
        F.array().cast(COMPOSITION_TYPE).alias("found"),
    )

    def step(state: Column, token: Column) -> Column:
        symbol = F.regexp_extract(token, r"^([A-Z][a-z]?|[()])", 1)
        number = F.coalesce(
            F.nullif(F.regexp_extract(token, r"([0-9.]+)$", 1), F.lit("")).try_cast("double"),
            F.lit(1.0),
        )
        stack = state["stack"]
        scaled = number * F.get(stack, 0)
        pushed = F.concat(F.array(scaled), stack)
        popped = F.slice(stack, F.lit(2), F.size(stack))
        added = F.concat(
            F.array(F.struct(symbol.alias("element"), scaled.alias("amount"))), state["found"]
        )
        return F.struct(
            F.when(symbol == ")", pushed).when(symbol == "(", popped).otherwise(stack).alias("stack"),
            F.when(symbol.isin("(", ")"), state["found"]).otherwise(added).alias("found"),
        )

    folded = F.aggregate(tokens, start, step)
    return _finish(F.struct(clean.alias("clean"), folded.alias("folded")))


def _finish(parts: Column) -> Column:
    """Sum repeated elements and check the result; evaluated once via ``transform``."""

    def build(p: Column) -> Column:
        found, stack, clean = p["folded"]["found"], p["folded"]["stack"], p["clean"]
        symbols = F.array_distinct(F.transform(found, lambda x: x["element"]))
        summed = F.transform(
            symbols,
            lambda s: F.struct(
                s.alias("element"),
                F.aggregate(
                    F.filter(found, lambda x: x["element"] == s),
                    F.lit(0.0),
                    lambda total, x: total + x["amount"],
                ).alias("amount"),
            ),
        )
        readable = (
            (F.regexp_replace(clean, TOKEN_PATTERN, "") == "")
            & (F.size(found) > 0)
            & (F.size(stack) == 1)
            & (F.get(stack, 0) == 1.0)
            & F.forall(found, lambda x: x["amount"] > 0)
            & (F.size(F.array_except(symbols, F.split(F.lit(" ".join(ELEMENT_SYMBOLS)), " "))) == 0)
        )
        return F.when(readable, summed)

    return F.get(F.transform(F.array(parts), build), 0)


def formula_error(text: Column, composition: Column) -> Column:
    """Empty when readable, else why not."""
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", "missing formula")
        .when(composition.isNull(), F.concat(F.lit("invalid formula "), text))
        .otherwise("")
    )


def composition_map(composition: Column) -> Column:
    return F.map_from_entries(composition)


def amount_text(amount: Column) -> Column:
    """Shortest decimal text of an amount, without trailing zeros."""
    fixed = amount.cast(f"decimal(18,{AMOUNT_DIGITS})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def _common_divisor(amounts: Column) -> Column:
    """Greatest common divisor of an array of integers by Euclid's steps."""
    steps = F.sequence(F.lit(1), F.lit(48))

    def pair(a: Column, b: Column) -> Column:
        walk = F.aggregate(
            steps,
            F.struct(a.alias("a"), b.alias("b")),
            lambda s, _: F.struct(
                F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
                F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"),
            ),
        )
        return walk["a"]

    return F.aggregate(amounts, F.lit(0).cast("bigint"), pair)


def _joined(composition: Column) -> Column:
    ordered = F.array_sort(composition)
    return F.array_join(
        F.transform(
            ordered,
            lambda x: F.concat(
                x["element"], F.when(x["amount"] == 1.0, "").otherwise(amount_text(x["amount"]))
            ),
        ),
        " ",
    )


def full_formula(composition: Column) -> Column:
    """Elements in alphabetical order with their amounts."""
    return _joined(composition)


def formula_key(composition: Column) -> Column:
    """Text shared by all formulas of the same ratio of whole amounts.

    Whole amounts are divided by their common divisor; fractional amounts are
    kept, so only equal amounts share a key.
    """

    def build(items: Column) -> Column:
        whole = F.forall(items, lambda x: F.abs(x["amount"] - F.round(x["amount"])) < 1e-8)
        divisor = _common_divisor(F.transform(items, lambda x: F.round(x["amount"]).cast("bigint")))
        reduced = F.transform(
            items,
            lambda x: F.struct(
                x["element"].alias("element"),
                F.when(whole, F.round(x["amount"]) / divisor).otherwise(x["amount"]).alias("amount"),
            ),
        )
        return F.regexp_replace(_joined(reduced), " ", "")

    return F.when(
        composition.isNotNull(), F.get(F.transform(F.array(composition), build), 0)
    )


def total_amount(composition: Column) -> Column:
    return F.aggregate(composition, F.lit(0.0), lambda t, x: t + x["amount"])


def fractions(composition: Column) -> Column:
    """Map element -> share of all atoms."""
    total = total_amount(composition)
    return F.map_from_entries(
        F.transform(
            composition,
            lambda x: F.struct(x["element"].alias("key"), (x["amount"] / total).alias("value")),
        )
    )


def l1_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of the atomic shares, between 0 and 2."""
    return share_distance(fractions(a), fractions(b))


def share_distance(a: Column, b: Column) -> Column:
    """As ``l1_distance``, of atomic shares (``fractions``)."""
    gaps = F.map_zip_with(
        a,
        b,
        lambda _, x, y: F.abs(F.coalesce(y, F.lit(0.0)) - F.coalesce(x, F.lit(0.0))),
    )
    return F.aggregate(F.map_values(gaps), F.lit(0.0), lambda t, x: t + x)


def amount_of(composition: Column, element: str) -> Column:
    """Amount of one element, 0 when absent."""
    return F.aggregate(
        composition,
        F.lit(0.0),
        lambda t, x: t + F.when(x["element"] == element, x["amount"]).otherwise(0.0),
    )


def symbols(composition: Column) -> Column:
    return F.transform(composition, lambda x: x["element"])


def element_set(composition: Column) -> Column:
    return F.array_join(F.array_sort(symbols(composition)), " ")


def composition_vector(composition: Column) -> Column:
    """Atomic shares in alphabetical order of the elements."""
    total = total_amount(composition)
    return F.transform(F.array_sort(composition), lambda x: x["amount"] / total)


def is_organic(composition: Column) -> Column:
    names = symbols(composition)
    return F.array_contains(names, "C") & F.array_contains(names, "H")
