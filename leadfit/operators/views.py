"""Row shapes for reading scored leads: list, detail, labels, breakdown, CRM, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions import scoring as sc
from leadfit.functions.text import display_place, split_owner


def _sig(name: str) -> Column:
    return F.col("signals")[name]


def best_industry() -> Column:
    return sc.lead_industry(F.col, _sig)


def best_employees() -> Column:
    return sc.lead_employees(F.col, _sig)


def best_owner() -> Column:
    return sc.lead_owner(F.col, _sig)


def _tags() -> Column:
    no = F.lit(False)
    return F.struct(
        F.coalesce(_sig("succession"), no).alias("succession"),
        F.coalesce(_sig("family_owned"), no).alias("family_owned"),
        F.coalesce(F.size(_sig("recurring_terms")) > 0, no).alias("recurring"),
        F.coalesce(_sig("hiring"), no).alias("hiring"),
    )


def _view_columns() -> list[Column]:
    return [
        F.col("lead_key"), F.col("seq"), F.col("name"), F.col("domain"), F.col("city"), F.col("state"),
        best_industry().alias("industry"), best_employees().alias("employees"), F.col("revenue_estimate"),
        best_owner().alias("owner_name"), F.col("email"), F.col("email_status"), F.col("phone"),
        F.col("status"), F.col("score"), F.col("tier"), F.col("confidence"), F.col("breakdown"), F.col("flags"),
        F.col("stage"), _sig("years_in_business").alias("years_in_business"), _tags().alias("tags"),
    ]


def lead_view(leads: DataFrame) -> DataFrame:
    """List row: stored values completed by what the site says, and four tags."""
    return leads.select(*_view_columns())


def iso_time(c: str) -> Column:
    """ISO 8601 text with offset; fractions of a second only where there are any."""
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".000000", "").otherwise(fraction),
        F.date_format(c, "xxx"),
    )


def lead_detail(leads: DataFrame) -> DataFrame:
    """List row plus signals, notes, brief, error and the enrichment time as ISO text."""
    return leads.select(*_view_columns(), "signals", "notes", "brief", "error", iso_time("enriched_at").alias("enriched_at"))


def _label(key: Column, labels: dict[str, str], otherwise: Column | None = None) -> Column:
    out = F
    for k, v in labels.items():
        out = out.when(key == k, v)
    return out.otherwise(otherwise) if otherwise is not None else out


def display_labels(leads: DataFrame) -> DataFrame:
    """Texts a reader sees for score, risk, e-mail and place."""
    labels = {k: v[0] for k, v in fv.EMAIL_STATUS_LABELS.items()}
    tones = {k: v[1] for k, v in fv.EMAIL_STATUS_LABELS.items()}
    fit = (
        F.when(F.col("status") == "pending", "Not scored yet")
        .when(F.col("confidence") < 50, "Needs manual review")
        .otherwise(_label(F.col("tier"), fv.TIER_LABELS))
    )
    return leads.select(
        "lead_key", fit.alias("fit_label"),
        F.when(F.exists("flags", lambda f: f["level"] == "risk"), "Risk").alias("risk_tag"),
        _label(F.col("email_status"), labels, F.lit("No email")).alias("email_label"),
        _label(F.col("email_status"), tones).alias("email_tone"),
        display_place(F.col("city"), F.col("state")).alias("place"),
    )


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def component_rows(leads: DataFrame) -> DataFrame:
    """One row per lead and component, with its question group and rounded points."""
    b = F.col("b")
    return leads.select("lead_key", F.explode("breakdown").alias("b")).select(
        "lead_key", b["key"].alias("key"), b["label"].alias("label"),
        _label(b["key"], fv.COMPONENT_GROUPS).alias("group"),
        _label(_label(b["key"], fv.COMPONENT_GROUPS), fv.GROUP_LABELS).alias("group_label"),
        half_up(b["points"]).alias("points_shown"), half_up(b["max"]).alias("max_shown"),
        b["points"].alias("points"), b["max"].alias("max"), b["ratio"].alias("ratio"),
        b["reason"].alias("reason"), b["known"].alias("known"),
    )


def weight_shares(params: DataFrame) -> DataFrame:
    """(icp_id, key, weight, share_percent) of each component of each buy box; shares rounded half up."""
    total = F.aggregate(F.map_values("weights"), F.lit(0), lambda a, w: a + F.coalesce(w, F.lit(0)))
    rows = params.select("icp_id", F.when(total == 0, 1).otherwise(total).alias("total"), "weights").select(
        "icp_id", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(0)).alias("weight")) for k in fv.COMPONENT_LABELS])).alias("w"))
    return rows.select("icp_id", "w.key", "w.weight", F.floor(F.col("w.weight") / F.col("total") * 100 + 0.5).cast("int").alias("share_percent"))


def crm_columns(leads: DataFrame) -> DataFrame:
    """The 19 export columns as text-ready values; missing ones are ''."""
    first, last = split_owner(best_owner())

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    founded = F.nullif(_sig("founded_year"), F.lit(0))
    values = [
        F.col("name"), text(F.col("domain")), first, last, text(F.col("email")), text(F.col("phone")),
        text(F.col("city")), text(F.col("state")), text(best_industry()),
        text(F.nullif(best_employees(), F.lit(0))), text(founded), F.col("score"), F.col("tier"),
        F.concat(F.col("confidence").cast("string"), F.lit("%")), text(F.col("email_status")),
        F.array_join(sc.top_reasons(F.col("breakdown")), "; "),
        F.array_join(sc.risk_texts(F.col("flags")), "; "), F.col("stage"), text(F.col("notes")),
    ]
    return leads.select(*[v.alias(n) for v, n in zip(values, fv.CRM_COLUMNS)])


def brief_facts(leads: DataFrame) -> DataFrame:
    """lead_key and a struct of the 14 facts a brief may use."""
    reasons = F.transform(F.filter("breakdown", lambda b: b["key"] == "upside"), lambda b: b["reason"])
    facts = F.struct(
        F.col("name").alias("company"), display_place(F.col("city"), F.col("state")).alias("location"),
        best_industry().alias("industry"), best_employees().alias("employees"), best_owner().alias("owner_name"),
        _sig("years_in_business").alias("years_in_business"), _sig("description").alias("description"),
        _sig("recurring_terms").alias("recurring_revenue_offers"), _sig("family_owned").alias("family_owned"),
        _sig("succession").alias("succession_language"), reasons.alias("digital_gaps"),
        F.col("score").alias("score"), sc.top_reasons(F.col("breakdown")).alias("top_reasons"),
        sc.risk_texts(F.col("flags")).alias("risks"),
    )
    return leads.select("lead_key", facts.alias("facts"))


def evidence_rows(leads: DataFrame) -> DataFrame:
    """One row per lead and shown evidence key, with page label."""
    rows = leads.select("lead_key", F.explode(F.col("signals.evidence")).alias("key", "ev"))
    return rows.where(F.col("key").isin(list(fv.EVIDENCE_LABELS))).select(
        "lead_key", "key", _label(F.col("key"), fv.EVIDENCE_LABELS).alias("label"),
        _label(F.col("ev.page"), fv.PAGE_LABELS, F.col("ev.page")).alias("page"), F.col("ev.text").alias("text"),
    )


# ---- order ---------------------------------------------------------------------------

def sort_keys(sort: str, order: str) -> list[Column]:
    """Sort columns of a list; leads with equal keys keep import order in both directions."""
    years = F.coalesce(F.nullif(_sig("years_in_business"), F.lit(0)), F.lit(-1))
    keys = {
        "score": [F.col("score"), F.col("confidence")], "name": [F.lower("name")], "years": [years],
        "confidence": [F.col("confidence")],
    }.get(sort, [F.col("score"), F.col("confidence")])
    return [k.desc() if order == "desc" else k.asc() for k in keys] + [F.col("seq").asc()]


def sort_leads(leads: DataFrame, sort: str = "score", order: str = "desc") -> DataFrame:
    return leads.orderBy(*sort_keys(sort, order))


def top_n_leads(leads: DataFrame, n: int, sort: str = "score", order: str = "desc") -> DataFrame:
    """The n leads to call first: each task keeps only its own best n."""
    return leads.orderBy(*sort_keys(sort, order)).limit(n)


# ---- edits -----------------------------------------------------------------------------

def apply_edits(leads: DataFrame, edits: DataFrame) -> DataFrame:
    """Stage and notes of the latest edit that sets them; '' is a value, NULL means no edit."""
    def latest(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("edited_at", c)))

    last = edits.groupBy("lead_key").agg(latest("stage").alias("_stage"), latest("notes").alias("_notes"))
    return leads.join(last, "lead_key", "left").withColumns(
        {"stage": F.coalesce("_stage", "stage"), "notes": F.coalesce("_notes", "notes")}
    ).select(*leads.columns)
