"""Spark types of the tables and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAD_FIELDS = {
    "name": "string", "name_key": "string", "domain": "string", "city": "string", "state": "string",
    "industry": "string", "employees": "int", "revenue_estimate": "string", "owner_name": "string",
    "email": "string", "phone": "string",
}
TECH = "struct<cms:string,https:boolean,mobile_friendly:boolean,online_booking:boolean,live_chat:boolean," \
       "analytics:boolean,marketing_automation:boolean>"
SOCIALS = "struct<linkedin:string,facebook:string,instagram:string>"
SIGNALS = (
    "struct<reachable:boolean,blocked:boolean,crawl_error:string,pages_crawled:array<string>,"
    "evidence:map<string,struct<page:string,text:string>>,franchise:boolean,founded_year:int,"
    "years_in_business:int,copyright_year:int,owner_name:string,succession:boolean,family_owned:boolean,"
    "hiring:boolean,pe_backed:boolean,testimonials:boolean,recurring_terms:array<string>,employees_hint:int,"
    f"emails:array<string>,phones:array<string>,socials:{SOCIALS},tech:{TECH},digital_maturity:int,"
    "description:string,industry_guess:string>"
)
ICP = (
    "struct<target_industries:array<string>,employees_min:int,employees_max:int,min_years:int,"
    "weights:map<string,int>>"
)
BREAKDOWN = (
    "array<struct<key:string,label:string,points:double,max:double,ratio:double,reason:string,known:boolean>>"
)
FLAGS = "array<struct<level:string,text:string>>"
BRIEF = (
    "struct<source:string,summary:string,why_it_fits:array<string>,risks:array<string>,"
    "questions:array<string>,email_subject:string,email_body:string>"
)
LEAD_TABLE = {
    "lead_key": "string", "seq": "string", "batch_id": "string", **LEAD_FIELDS,
    "status": "string", "error": "string", "signals": SIGNALS, "email_status": "string",
    "enriched_at": "timestamp", "score": "int", "tier": "string", "confidence": "int",
    "breakdown": BREAKDOWN, "flags": FLAGS, "stage": "string", "notes": "string", "brief": BRIEF,
}
PAGE_FETCHES = {
    "url": "string", "status": "int", "final_url": "string", "html": "string", "blocked": "boolean",
    "error": "string", "fetched_at": "timestamp",
}


def conform(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exactly these columns in this order; absent ones become typed NULLs."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()
    ])
