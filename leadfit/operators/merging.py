"""Entity resolution: merge rows of one company, match a batch with the stored leads, upsert."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.functions.text import falsy, normalize_phone
from leadfit.operators.scoring import score_leads
from leadfit.operators.skew import HOT_ROWS, balanced_left_join
from leadfit.schemas import LEAD_FIELDS, LEAD_TABLE, SIGNALS, conform
from leadfit.sources.tables import materialize


def first_filled(field: str, order: Column) -> Column:
    """First value of a field that is not missing, by `order`."""
    value = F.col(field)
    picked = F.min_by(value, F.when(~falsy(value, LEAD_FIELDS[field]), order))
    # where every value is missing, keep the first row's (a 0 or '' stays what it is)
    return F.coalesce(picked, F.min_by(value, order)) if field in ("name_key", "employees") else picked


def dedupe_merge(rows: DataFrame, counts: bool = False) -> DataFrame:
    """One row per merge key; every field takes its first filled value in file order.

    min_by keeps one value per field and task, so a key with very many rows is collapsed before
    the shuffle. With counts, `n_rows` and `n_without_site` tell what went into each.
    """
    counted = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("domain").isNull()).alias("n_without_site")] if counts else []
    return rows.groupBy("key").agg(
        F.min("ord").alias("ord"), *[first_filled(f, F.col("ord")).alias(f) for f in LEAD_FIELDS], *counted
    )


def report_of_merged(merged: DataFrame) -> DataFrame:
    """The row of `import_report` from what `dedupe_merge` made with counts of all rows, the nameless ones under no key."""
    named = F.col("key").isNotNull()
    none = F.lit(0).cast("long")
    return merged.agg(
        F.coalesce(F.sum("n_rows"), none).alias("rows_read"), F.count("key").alias("unique_in_file"),
        F.coalesce(F.sum(F.when(named, F.col("n_rows") - 1)), none).alias("duplicates_in_file"),
        F.coalesce(F.sum(F.when(~named, F.col("n_rows"))), none).alias("skipped_missing_name"),
        F.coalesce(F.sum(F.when(named, F.col("n_without_site"))), none).alias("missing_website"))


def import_report(canonical: DataFrame, normalized: DataFrame) -> DataFrame:
    """One row of import counts."""
    def row(**known):
        names = ["rows_read", "unique_in_file", "duplicates_in_file", "skipped_missing_name", "missing_website"]
        return [F.coalesce(known[n], F.lit(0)).alias(n) if n in known else F.lit(0).cast("bigint").alias(n) for n in names]

    read = canonical.agg(*row(
        rows_read=F.count(F.lit(1)), skipped_missing_name=F.count_if(F.col("name").isNull())))
    per_key = normalized.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("domain").isNull()).alias("no_site"))
    named = per_key.agg(*row(
        unique_in_file=F.count(F.lit(1)), duplicates_in_file=F.sum(F.col("n") - 1), missing_website=F.sum("no_site")))
    both = read.unionByName(named)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def seq_key(batch_no: int, order: Column) -> Column:
    """Text key that sorts leads by batch, then by file order."""
    return F.concat(F.lit(f"{batch_no:012d}:"), F.lpad(order.cast("string"), 20, "0"))


def file_seq_key(batch_no: int, order: Column) -> Column:
    """As `seq_key`, for the text order key of a file scan."""
    return F.concat(F.lit(f"{batch_no:012d}:"), order)


def match_existing(incoming: DataFrame, stored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Incoming rows with `matched_key`: the stored lead of the same domain, else of the same name and
    city (two missing cities are equal, letter case counts); NULL when there is none.

    Stored rows are those before the batch, so rows of one batch never match each other.
    """
    by_domain = stored.where(F.col("domain").isNotNull()).select("domain", F.col("lead_key").alias("m1"))
    return match_keys(incoming, by_domain, named_cities(stored), hot_rows)


def _city_cols(df: DataFrame) -> DataFrame:
    """NULL city joins NULL city: compare a filled-in copy plus a marker."""
    return df.withColumn("_city", F.coalesce("city", F.lit(""))).withColumn("_no_city", F.col("city").isNull())


def named_cities(stored: DataFrame) -> DataFrame:
    """The first lead (m2) of each name and city, from rows with name_key, city, lead_key and seq."""
    return _city_cols(stored).groupBy("name_key", "_city", "_no_city").agg(F.min_by("lead_key", "seq").alias("m2"))


def match_keys(incoming: DataFrame, by_domain: DataFrame, by_name: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Incoming rows with `matched_key`, from the stored keys: domain and m1, `named_cities`."""
    step1 = balanced_left_join(incoming, by_domain, ["domain"], ["key"], hot_rows=None)
    todo = _city_cols(step1).withColumn("name_key_", F.col("name_key")).withColumn(
        "name_key", F.when(F.col("m1").isNull(), F.col("name_key"))
    )
    step2 = balanced_left_join(
        todo, by_name, ["name_key", "_city", "_no_city"], ["key"], hot_rows=hot_rows, hot_source=_city_cols(incoming)
    )
    return (
        step2.withColumn("matched_key", F.coalesce("m1", "m2"))
        .withColumn("name_key", F.col("name_key_"))
        .select(*incoming.columns, "matched_key")
    )


def fill_stored(stored: DataFrame, matched: DataFrame) -> DataFrame:
    """Stored leads with their missing fields filled from matched rows, in file order."""
    fills = matched.where(F.col("matched_key").isNotNull()).groupBy(F.col("matched_key").alias("lead_key")).agg(
        *[first_filled(f, F.col("ord")).alias(f"in_{f}") for f in LEAD_FIELDS]
    )
    joined = stored.join(fills, "lead_key", "left")
    filled = {
        f: F.when(falsy(F.col(f), t) & ~falsy(F.col(f"in_{f}"), t), F.col(f"in_{f}")).otherwise(F.col(f))
        for f, t in LEAD_FIELDS.items()
    }
    return joined.withColumns(filled).select(*stored.columns)


def new_leads(
    unmatched: DataFrame, batch_id: str, batch_no: int, icp: dict | None, today: date
) -> DataFrame:
    """Rows to insert: phone normalised, pending, already scored without signals."""
    numeric = dict(unmatched.dtypes)["ord"] != "string"
    order = seq_key(batch_no, F.col("ord")) if numeric else file_seq_key(batch_no, F.col("ord"))
    fresh = unmatched.select(
        F.md5(F.concat_ws("|", F.lit(batch_id), F.lit(str(batch_no)), F.col("key"))).alias("lead_key"),
        order.alias("seq"), F.lit(batch_id).alias("batch_id"),
        *[normalize_phone(f).alias(f) if f == "phone" else F.col(f) for f in LEAD_FIELDS],
        F.lit("pending").alias("status"), F.lit("new").alias("stage"),
        F.lit(None).cast("string").alias("email_status"), F.lit(None).cast(SIGNALS).alias("signals"),
    )
    return conform(score_leads(fresh, icp, today), LEAD_TABLE)


def upsert_leads(
    stored: DataFrame | None, incoming: DataFrame, batch_id: str, batch_no: int, today: date,
    icp: dict | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The lead table after a batch: matched leads filled up (not rescored), the others inserted.

    `incoming` comes from `dedupe_merge`. It and its matches are written once: both the filled and
    the inserted leads are taken from them, and the batch must not be merged several times.
    """
    if stored is None:
        return new_leads(incoming, batch_id, batch_no, icp, today)
    merged = materialize(incoming, "batch")
    matched = materialize(match_existing(merged, stored, hot_rows), "batch-matched")
    inserts = new_leads(matched.where(F.col("matched_key").isNull()), batch_id, batch_no, icp, today)
    return union_rows(fill_stored(stored, matched), inserts)


def union_rows(updates: DataFrame, inserts: DataFrame) -> DataFrame:
    return updates.unionByName(inserts)


def upsert_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count_if(F.col("matched_key").isNull()).alias("added"),
        F.count_if(F.col("matched_key").isNotNull()).alias("already_in_pipeline"),
    )
