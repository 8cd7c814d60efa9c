"""Registry of runnable queries over the benchmark tables and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.operators import composition as cp
from saltmarsh.operators import pairing as pr
from saltmarsh.operators import quality as ql
from saltmarsh.plans import oracle as orc
from saltmarsh.session import configure, durable
from saltmarsh.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The views a query starts from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @cached_property
    def m(self) -> DataFrame:
        """Measurements as text."""
        return views.measurements(self.spark, self.sf_dir)

    @cached_property
    def typed(self) -> DataFrame:
        """Measurements with typed columns, parsed in the scan that reads them.

        For queries that read them once: only the columns a query selects are
        read and parsed, and nothing is written.
        """
        return ql.parse_measurements(self.m)

    def narrow(self, *columns: str) -> DataFrame:
        """A few typed columns, written once for a query that reads them several times."""
        return durable(self.typed.select(*columns))

    @cached_property
    def mp(self) -> DataFrame:
        """All typed columns, written once, for flows that read most of them several times.

        Otherwise every filter on a typed column would be pushed to each scan as
        a copy of the text patterns behind it.
        """
        return durable(self.typed)

    @cached_property
    def mf(self) -> DataFrame:
        """Typed measurements with their formula facts."""
        return ql.with_formula(self.mp)

    @cached_property
    def facts(self) -> DataFrame:
        """As ``mf``, for queries that read them once and without a filter on a typed column."""
        return ql.with_formula(self.typed)

    @cached_property
    def e(self) -> DataFrame:
        return views.segments(self.spark, self.sf_dir)

    @cached_property
    def parsed(self) -> DataFrame:
        """Distinct formulas with their composition."""
        return cp.compositions(self.m)

    @cached_property
    def descriptors(self) -> DataFrame:
        return cp.descriptors(self.parsed)


def seven_digits(column: Column) -> Column:
    # The factor just above 1 moves exact halves off the rounding edge.
    cut = column * F.lit(1.0000000001)
    digits = F.lit(6.0) - F.floor(F.log10(F.abs(cut))).cast("double")
    # Whole powers of ten are exact, so every engine rounds alike.
    up, down = F.pow(F.lit(10.0), digits), F.pow(F.lit(10.0), -digits)
    return (
        F.when(column == 0, 0.0)
        .when(digits >= 0, F.round(cut * up) / up)
        .otherwise(F.round(cut / down) * down)
    )


def normalize(df: DataFrame) -> DataFrame:
    """Doubles at seven significant digits, so engines can be compared."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not doubles:
        return df
    # One array keeps the generated code small for wide tables.
    packed = df.withColumn("_doubles", F.transform(F.array(*[F.col(f"`{n}`") for n in doubles]), seven_digits))
    place = {name: i for i, name in enumerate(doubles)}
    return packed.select(*[
        F.get("_doubles", place[n]).alias(n) if n in place else F.col(f"`{n}`") for n in df.columns
    ])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the double columns of its result."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: normalize(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = orc.rounded(sql, doubles.split())
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from saltmarsh.plans import queries_curation, queries_descriptors, queries_scoring  # noqa: F401
    from saltmarsh.plans import queries_pairs, queries_tables  # noqa: F401


LABELS = pr.LABELS
