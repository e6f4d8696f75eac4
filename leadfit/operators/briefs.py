"""Outreach briefs: a deterministic template, and parsing of supplied written ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions.text import blank_to_null, first_name, str_array
from leadfit.operators.views import brief_facts
from leadfit.schemas import BRIEF

FIRST_QUESTION_RECURRING = "How much of your revenue is under contract or comes back every year?"
FIRST_QUESTION_ONE_OFF = "How often does the same customer come back, and what brings them back?"
OTHER_QUESTIONS = [
    "Which parts of sales and planning still run through the owner?",
    "Who would lead the company if the owner stepped back?",
]
NO_RISKS = "Nothing worrying in the public record"
SIGN_OFF = "[Your name]"


def _brief_struct(f: Column, source: str) -> Column:
    years = F.nullif(f["years_in_business"], F.lit(0))
    industry = F.lower(F.coalesce(blank_to_null(f["industry"]), F.lit("business")))
    place = F.when(f["location"] != "", F.concat(F.lit(" in "), f["location"])).otherwise("")
    tenure = F.coalesce(F.concat(years.cast("string"), F.lit(" years")), F.lit("so long"))
    offers = F.coalesce(F.size(f["recurring_revenue_offers"]) > 0, F.lit(False))
    summary = F.concat(
        f["company"], F.lit(": "), industry, F.lit(" company"), place,
        F.coalesce(F.concat(F.lit(", about "), years.cast("string"), F.lit(" years old")), F.lit("")),
        F.lit(". Fit score "), f["score"].cast("string"), F.lit(" of 100."),
    )
    body = F.concat(
        F.lit("Hello "), first_name(f["owner_name"]), F.lit(",\n\nwhile looking at "), industry,
        F.lit(" companies"), place, F.lit(" I found "), f["company"],
        F.lit(". Keeping a company going for "), tenure,
        F.lit(" says a lot about how you treat customers and staff.\n\n"
              "I want to buy one company, run it myself and keep its name and people. "
              "Would you have a quarter of an hour next week for a first talk?\n\n"
              f"Kind regards\n{SIGN_OFF}"),
    )
    return F.struct(
        F.lit(source).alias("source"), summary.alias("summary"), f["top_reasons"].alias("why_it_fits"),
        F.when(F.size(f["risks"]) > 0, f["risks"]).otherwise(str_array([NO_RISKS])).alias("risks"),
        F.array(
            F.when(offers, FIRST_QUESTION_RECURRING).otherwise(FIRST_QUESTION_ONE_OFF),
            *[F.lit(q) for q in OTHER_QUESTIONS],
        ).alias("questions"),
        F.concat(F.lit("What comes next for "), f["company"], F.lit("?")).alias("email_subject"),
        body.alias("email_body"),
    ).cast(BRIEF)


def template_brief(leads: DataFrame, source: str = "template") -> DataFrame:
    """lead_key, brief: built from the lead's facts alone."""
    return brief_facts(leads).select("lead_key", _brief_struct(F.col("facts"), source).alias("brief"))


def parse_response(text: Column) -> Column:
    """Brief in a written answer: code fences off, JSON, all six keys present; else NULL."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?|```$", ""))
    keys = F.json_object_keys(bare)
    complete = F.size(F.array_except(str_array(fv.BRIEF_KEYS), keys)) == 0
    return F.when(complete, F.from_json(bare, BRIEF).withField("source", F.lit("ai")))


def parse_brief_responses(leads: DataFrame, responses: DataFrame) -> DataFrame:
    """lead_key, brief: the supplied answer where it is usable, otherwise the template.

    `responses` holds at most one answer per lead; a lead without one gets the plain template.
    """
    one_each = responses.groupBy("lead_key").agg(F.min("text").alias("text"))
    parsed = one_each.select("lead_key", parse_response(F.col("text")).alias("ai"))
    base = template_brief(leads)
    joined = base.join(parsed.withColumn("asked", F.lit(True)), "lead_key", "left")
    fallback = F.when(
        F.col("asked"), F.col("brief").withField("source", F.lit("template (AI unavailable)"))
    ).otherwise(F.col("brief"))
    return joined.select("lead_key", F.coalesce("ai", fallback).alias("brief"))
