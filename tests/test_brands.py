"""Brands of a table against a plain search through all of them."""

import random

import pytest

from leadfit import fixed_values as fv
from leadfit.operators.brands import first_brands, with_first_brand


def plain(texts, brands):
    table = sorted((o, b.lower()) for o, b in brands if b and b.strip(" "))
    found = {t.lower(): next((b for _, b in table if b in t.lower()), None) for t in texts if t is not None}
    return {t: b for t, b in found.items() if b is not None}


def found(spark, texts, brands, **how):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    table = spark.createDataFrame(brands, "ord long, brand string")
    return {r["text"]: r["brand"] for r in first_brands(rows, table, **how).collect()}


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_thousands_of_brands(spark, hot_rows):
    """Random words over a few letters: short brands, brands inside others, runs that most texts have."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abc ") for _ in range(n))
    texts = [word(r.randrange(0, 60)) for _ in range(400)] + [word(8).upper() for _ in range(50)]
    brands = [(k, word(r.randrange(5, 12))) for k in range(3000)] + [(5000 + k, word(r.randrange(1, 4))) for k in range(5)]
    r.shuffle(brands)
    assert found(spark, texts, brands, hot_rows=hot_rows) == plain(texts, brands)


def test_the_fixed_list_as_a_table(spark):
    texts = [f"{b} of {t}" for b in fv.FRANCHISE_BRANDS for t in ("Austin", "the maids")] + ["Manager of Managua", "Roto-Rooter & Mr. Rooter"]
    brands = list(enumerate(fv.FRANCHISE_BRANDS))
    assert found(spark, texts, brands) == plain(texts, brands)


def test_odd_brands_and_texts(spark):
    brands = [(4, "Ünï😀Co"), (3, "😀x"), (2, "  "), (1, ""), (0, None), (9, "a\nb"), (9, "A\nB"), (7, "zz"), (7, "zy"), (None, "%._(")]
    texts = ["the ÜNÏ😀CO group", "😀x", "x😀", "a\nb", "zzzy", "", None, "50%._(", "q" * 200_000 + "zy"]
    want = {"the ünï😀co group": "ünï😀co", "😀x": "😀x", "a\nb": "a\nb", "zzzy": "zy", "50%._(": "%._(", "q" * 200_000 + "zy": "zy"}
    assert found(spark, texts, brands) == want
    assert found(spark, texts, []) == {} and found(spark, [], brands) == {} and found(spark, [None], brands) == {}


def test_rows_keep_their_columns_and_a_hot_name_is_split(spark):
    rows = spark.createDataFrame([(k, "Molly Maid" if k % 3 == 0 else f"Firm {k}" if k % 7 else None) for k in range(300)], "ord long, name string")
    out = with_first_brand(rows, "name", spark.createDataFrame([(1, "firm 1"), (0, "molly")], "ord long, brand string"), ["ord"], hot_rows=10)
    assert out.columns == ["ord", "name", "brand"]
    got = {r["ord"]: r["brand"] for r in out.collect()}
    assert got == {r["ord"]: next((b for b in ("molly", "firm 1") if r["name"] and b in r["name"].lower()), None) for r in rows.collect()}


def test_no_text_meets_all_brands(spark):
    """Joins go by runs of characters: no nested loop and no product."""
    rows = spark.createDataFrame([("Firm one",)], "text string")
    plan = first_brands(rows, spark.createDataFrame([(1, "firm one")], "ord long, brand string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
