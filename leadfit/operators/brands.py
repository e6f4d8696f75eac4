"""Brands from a table of any size: the first one, in the table's order, that a text contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.operators.skew import balanced_left_join
from leadfit.sources.tables import materialize

GRAM = 5


def grams(text: Column, length: int) -> Column:
    """Distinct runs of `length` characters, in time linear in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def brand_index(brands: DataFrame, texts: DataFrame, lengths: list[int], longest: int = GRAM) -> DataFrame:
    """gram, brand, ord: each brand under the one of its runs that the fewest texts contain.

    Brands shorter than `longest` stand under themselves.
    """
    own = brands.select("ord", "brand", F.explode(_of_lengths(F.col("brand"), lengths)).alias("gram"))
    own = own.where(F.length("gram") == F.least(F.length("brand"), F.lit(longest)))
    counts = texts.select(F.explode(_of_lengths(F.col("text"), lengths)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a run that no text has makes its brand impossible: the brand gets the least run, finds nothing and costs nothing
    seen = own.join(counts, "gram", "left").select("ord", "brand", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    return seen.groupBy("ord", "brand").agg(F.min("g").alias("g")).where(F.col("g.n") > 0).select("ord", "brand", "g.gram")


def _of_lengths(text: Column, lengths: list[int]) -> Column:
    return F.flatten(F.array(*[grams(text, n) for n in lengths]))


def first_brands(texts: DataFrame, brands: DataFrame, longest: int = GRAM, hot_rows: int = 1_000_000) -> DataFrame:
    """text, brand: for each distinct text of texts(text) that contains a brand of brands(ord, brand) the one of least ord.

    Texts and brands meet by equal runs of characters, then by `contains`; no text is compared with all brands. Letter case
    doesn't count. Blank brands and NULL texts match nothing; of brands of one ord the smaller counts.
    """
    table = brands.select("ord", F.lower("brand").alias("brand")).where(F.length(F.trim("brand")) > 0).distinct()
    lower = texts.select(F.lower("text").alias("text")).where(F.col("text").isNotNull()).distinct()
    lower = materialize(lower, "brand-texts")
    size = F.least(F.length("brand"), F.lit(longest)).alias("n")
    lengths = sorted(r["n"] for r in table.select(size).distinct().collect())  # at most `longest` numbers
    if not lengths:
        return lower.select("text", F.lit(None).cast("string").alias("brand")).limit(0)
    index = materialize(brand_index(table, lower, lengths, longest), "brand-index")
    runs = lower.select("text", F.explode(_of_lengths(F.col("text"), lengths)).alias("gram"))
    runs = runs.join(index.select("gram").distinct(), "gram", "left_semi")
    pairs = balanced_left_join(runs, index, ["gram"], ["text"], hot_rows).where(F.contains("text", "brand"))
    return pairs.groupBy("text").agg(F.min(F.struct("ord", "brand")).alias("b")).select("text", "b.brand")


def with_first_brand(rows: DataFrame, column: str, brands: DataFrame, row_key: list[str], out: str = "brand", hot_rows: int = 1_000_000) -> DataFrame:
    """Rows with the first brand that `column` contains, NULL when none. `row_key` tells the rows apart."""
    found = first_brands(rows.select(F.col(column).alias("text")), brands, hot_rows=hot_rows)
    found = found.select(F.col("text").alias("_brand_text"), F.col("brand").alias(out))
    keyed = rows.withColumn("_brand_text", F.lower(column))
    return balanced_left_join(keyed, found, ["_brand_text"], row_key, hot_rows).drop("_brand_text")
