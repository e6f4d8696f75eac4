"""Left join that stays balanced when one key holds much of the left side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadfit.sources.tables import materialize

NULL_SALTS = 1 << 20
# rows of one key in a task: what follows a join (checks, scores) runs in the task, half a millisecond a lead
HOT_ROWS = 50_000


def balanced_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str],
    hot_rows: int | None = HOT_ROWS,
    hot_source: DataFrame | None = None,
) -> DataFrame:
    """`left` LEFT JOIN `right` on equal-named `keys`.

    Rows with a NULL key match nothing and are spread over the shuffle instead of meeting in one
    partition. A key with n >= `hot_rows` left rows is split into ceil(n / hot_rows) parts and its
    right rows repeated once per part. The list of hot keys has at most one key per `hot_rows` rows;
    it is written once, and both sides use what was written.
    `spread` names columns that tell left rows apart; the split is a hash of them and therefore
    the same when a task is run again. `hot_rows=None` is for keys known to be unique on the left.
    `hot_source` is a cheaper table to count keys in, with at least the rows of `left`.
    """
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    row_hash = F.xxhash64(*spread)
    if hot_rows is None:
        salted = left.withColumn("_salt", F.when(any_null, F.pmod(row_hash, F.lit(NULL_SALTS))).otherwise(F.lit(0)))
        other = right.withColumn("_salt", F.lit(0).cast("bigint"))
        return salted.join(other, [*keys, "_salt"], "left").drop("_salt")

    hot = materialize(
        (hot_source or left).where(~any_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= hot_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("bigint").alias("_parts")),
        "hot-keys",
    )
    salted = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(any_null, F.pmod(row_hash, F.lit(NULL_SALTS)))
        .when(F.col("_parts").isNotNull(), F.pmod(row_hash, F.col("_parts")))
        .otherwise(F.lit(0)),
    ).drop("_parts")
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)),
    ).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")
