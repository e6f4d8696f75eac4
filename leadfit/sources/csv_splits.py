"""CSV files with line breaks inside quotes, read in parallel splits.

Whether a line begins inside quotes depends on all lines before it in the file. But every line alone says how it changes
that: where it ends if it begins outside, and where if it begins inside. Such changes are put together line by line
within each split, then split by split within each file, so each split learns how it begins, and no task reads a file
alone. A change is one of four: nothing, turned over, always outside, always inside; so the place of a line follows from
the last line before it with an `always` and the number of turns since.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadfit.sources.tables import materialize

INSIDE, OUTSIDE = 1, 0
QUOTED = r'[^"]*+(?:""[^"]*+)*+'  # what stands between quotes; two quotes are one that is meant


def line_changes(line: Column, sep: str) -> tuple[Column, Column]:
    """Where a line ends (INSIDE or OUTSIDE quotes) if it begins outside, and if it begins inside.

    A quote opens a cell only as its first character; behind the closing quote a cell goes on to the next separator.
    """
    s = "\\t" if sep == "\t" else re.escape(sep)
    cells = rf'^(?:(?:"{QUOTED}"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+"{QUOTED}$'
    left_open = lambda x: x.rlike(cells).cast("int")
    rest = F.regexp_replace(line, rf'^{QUOTED}"[^{s}]*+{s}?', "")
    plain = ~line.contains('"')
    return (
        F.when(plain, OUTSIDE).otherwise(left_open(line)),
        F.when(plain | line.rlike(f"^{QUOTED}$"), INSIDE).otherwise(left_open(rest)),
    )


def _odd(x: Column) -> Column:
    return F.pmod(F.coalesce(x, F.lit(0)), F.lit(2))


def _place(always: Column, turns: Column, begin: Column | int) -> Column:
    """From the last `always` (with the turns up to it taken out), the turns so far, and the place before all."""
    start = F.lit(begin) if isinstance(begin, int) else begin
    return F.coalesce(always, start).bitwiseXOR(_odd(turns))


def _followed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with (outside, inside), the ends of each row, plus `always` and `turns` of the rows before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turned = ((F.col("outside") == INSIDE) & (F.col("inside") == OUTSIDE)).cast("int")
    counted = rows.withColumns({"turns_upto": F.sum(turned).over(upto), "turns": F.sum(turned).over(before)})
    own = F.when(F.col("outside") == F.col("inside"), F.col("outside").bitwiseXOR(_odd(F.col("turns_upto"))))
    return counted.withColumn("own_always", own).withColumn("always", F.last("own_always", ignorenulls=True).over(before))


def records(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """(file, split, at, value, first): the records of the files, also those that run over lines and over splits.

    split and at, in order, are those of a record's first line; first marks the first line of a file that isn't empty.
    Lines end with \\n or \\r\\n, inside quotes too, where a break becomes \\n; empty lines outside quotes are none. A quote that never closes runs to the file's end.
    Files without open quotes at line ends are read twice and never shuffled; else the lines are dealt to their splits once.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    outside, inside = line_changes(F.col("value"), sep)
    starts = lines.where("split = 0 AND value <> ''").groupBy("file").agg(F.min("at").alias("first_at"))
    if lines.where(outside == INSIDE).isEmpty():
        whole = lines.where("value <> ''")
    else:
        changes = lines.withColumns({"outside": outside, "inside": inside})
        placed = materialize(_followed(changes, ["file", "split"], "at"), "csv-lines")
        # a split as one change: its last `always`, or else its turns
        whole_split = placed.groupBy("file", "split").agg(F.max_by("own_always", F.when(F.col("own_always").isNotNull(), F.col("at"))).alias("a"), F.max("turns_upto").alias("t"))
        ends = whole_split.select(
            "file", "split", _place(F.col("a"), F.col("t"), OUTSIDE).alias("outside"), _place(F.col("a"), F.col("t"), INSIDE).alias("inside"))
        begins = _followed(ends, ["file"], "split").select("file", "split", _place(F.col("always"), F.col("turns"), OUTSIDE).alias("begin"))
        told = placed.join(begins, ["file", "split"]).withColumn("place", _place(F.col("always"), F.col("turns"), F.col("begin")))
        told = told.withColumn("behind", F.when(F.col("place") == INSIDE, F.col("inside")).otherwise(F.col("outside")))
        single = told.where((F.col("place") == OUTSIDE) & (F.col("behind") == OUTSIDE) & (F.col("value") != "")).select("file", "split", "at", "value")
        # lines of records of several lines; the record begins at the last line before that begins outside
        parts = materialize(told.where((F.col("place") == INSIDE) | (F.col("behind") == INSIDE)).select("file", "split", "at", "value", "place"), "csv-parts")
        head = F.when(F.col("place") == OUTSIDE, F.struct("split", "at"))
        in_split = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        headed = parts.withColumn("head", F.last(head, ignorenulls=True).over(in_split))
        last_heads = headed.groupBy("file", "split").agg(F.max("head").alias("last_head"))
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        carried = last_heads.select("file", "split", F.last("last_head", ignorenulls=True).over(earlier).alias("carried"))
        headed = headed.join(carried, ["file", "split"]).withColumn("head", F.coalesce("head", "carried"))
        several = headed.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("lines"))
        several = several.select("file", "head.split", "head.at", F.array_join("lines.value", "\n").alias("value"))
        whole = single.union(several)
    return whole.join(F.broadcast(starts), "file", "left").select(
        "file", "split", "at", "value", (F.coalesce(F.col("at") == F.col("first_at"), F.lit(False)) & (F.col("split") == 0)).alias("first"))


def scan_in_splits(spark: SparkSession, paths: list[str], sep: str, schema: str) -> DataFrame:
    """The cells of files of one layout below their header lines, and `ord`, a text key that sorts rows in file order."""
    rows = records(spark, paths, sep).where(~F.col("first"))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    number = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    return rows.select(F.from_csv("value", schema, options).alias("cells"), F.concat_ws("|", "file", number("split"), number("at")).alias("ord")).select("cells.*", "ord")
