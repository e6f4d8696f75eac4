"""Files with quoted line breaks, read in splits, against one task for each file."""

import csv
import io
import random

import pytest

from leadfit.sources import csv_splits, lead_files

SCHEMA = "c0 string, c1 string, c2 string"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return [tuple(c and c.replace("\r\n", "\n") for c in r) for r in df.orderBy("ord").drop("ord").collect()]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
@pytest.mark.parametrize("seed", [1])
def test_splits_read_what_one_task_reads(spark, small_splits, tmp_path, sep, seed):
    r = random.Random(seed)

    def cell():
        if r.random() < 0.3:
            return r.choice(["a", "b c", "", '5" pipe', "x", "ünï", "'"])
        text = "".join(r.choice(["w", "\n", "\r\n", sep, '""', " ", "é"]) for _ in range(r.choice([1, 3, 12, 60, 60, 900])))
        return f'"{text}"' + ("tail" if r.random() < 0.02 else "")

    for f, end in enumerate(["\n", "\r\n", "\n"]):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8") as out:
            out.write(sep.join(["Company", "City", "Notes"]) + end)
            for i in range(250):
                out.write(sep.join([f"n{i}", cell(), cell()]) + end + (end if r.random() < 0.05 else ""))
    got = csv_splits.scan_in_splits(spark, [str(tmp_path)], sep, SCHEMA)
    want = rows_of(lead_files._scan(spark, [str(tmp_path)], sep, True, SCHEMA))
    assert rows_of(got) == want and len(want) == 750
    assert csv_splits.records(spark, [str(tmp_path)], sep).select("file", "split").distinct().count() > 8


def test_splits_read_what_a_csv_reader_reads(spark, small_splits, tmp_path):
    r = random.Random(7)
    rows = [[f"n{i}", "".join(r.choice('ab\n,"') for _ in range(r.choice([0, 5, 40, 3000]))) + "z", str(i)] for i in range(120)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["Company", "City", "Notes"], *rows])
    (tmp_path / "a.csv").write_text("﻿" + text.getvalue(), encoding="utf-8")
    assert rows_of(csv_splits.scan_in_splits(spark, [str(tmp_path / "a.csv")], ",", SCHEMA)) == [tuple(x) for x in rows]


def test_odd_files(spark, small_splits, tmp_path):
    files = {"empty.csv": "", "head.csv": "Company,City,Notes", "blank.csv": "\n\r\nCompany,City,Notes\n\nx,y,z\n\n", "open.csv": 'Company,City,Notes\na,"b\n' + "c,d\n" * 900,
             "quotes.csv": 'Company,City,Notes\n"a","",""\n"""",b,"c"""\n"\n",b,c'}
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    got = {n: rows_of(csv_splits.scan_in_splits(spark, [str(tmp_path / n)], ",", SCHEMA)) for n in files}
    assert got["empty.csv"] == got["head.csv"] == [] and got["blank.csv"] == [("x", "y", "z")]
    assert len(got["open.csv"]) == 1 and got["open.csv"][0][1].count("c,d") == 900
    assert [r[0] for r in got["quotes.csv"]] == ["a", '"', "\n"]
    canonical = lead_files.scan_lead_files(spark, str(tmp_path)).orderBy("ord").collect()
    assert len(canonical) == 5


def test_files_without_open_quotes_are_not_shuffled(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("Company,City,Notes\n" + "".join(f'n{i},"x, y",z\n' for i in range(2000)))
    got = csv_splits.scan_in_splits(spark, [str(tmp_path)], ",", SCHEMA)
    plan = got._jdf.queryExecution().toString()
    assert got.count() == 2000 and "Window" not in plan and "hashpartitioning(file" not in plan.split("BroadcastExchange")[0]


def test_very_long_cells(spark, tmp_path):
    """A cell of a megabyte with quotes and breaks neither overflows a pattern's stack nor takes long."""
    (tmp_path / "a.csv").write_text("Company,City,Notes\n" + 'n,"' + 'a""b\n,' * 150_000 + '",z\n' + "m," + "q" * 1_000_000 + ',"' + '""' * 300_000 + '"\n')
    got = rows_of(csv_splits.scan_in_splits(spark, [str(tmp_path)], ",", SCHEMA))
    assert [r[0] for r in got] == ["n", "m"] and [len(c) for c in got[1]] == [1, 1_000_000, 300_000] and got[0][1].count("\n") == 150_000
