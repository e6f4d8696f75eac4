"""Classifiers and rules: held-out accuracy on the given labels, and the odd cases."""

import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadfit.llm import quality, rules, toxicity
from leadfit.llm.common import id_remainder
from leadfit.llm.licenses import RULES, SENTENCES, applied, scan_licences
from leadfit.llm.registry import ORACLES, op2_quality_classifier, op4_license_scans, op5_toxicity, op6_quality_rules

SMALL = "/root/testdata/sf0.01"


def held_out_accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) > 50
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_folds(spark):
    got = spark.range(200).select("id", id_remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)


def test_quality_on_held_out_labels(spark):
    assert held_out_accuracy(spark, op2_quality_classifier(spark, SMALL), "quality") > 0.93


def test_toxicity_on_held_out_labels(spark):
    scored = op5_toxicity(spark, SMALL)
    assert held_out_accuracy(spark, scored, "toxic") > 0.9
    assert scored.count() == 1000


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(i, f"a plain sentence number {i} about rivers and hills, told at some length for all to read.") for i in range(60)]
    bad = [(i, f"BUY!! NOW!! {i} $$$ ### CHEAP!! STUFF!! &&& %%% WIN!! BIG!! $$$ CLICK!! HERE!!") for i in range(60, 120)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 60), int(i >= 60)) for i in range(120)] + [(None, 1, 0), (500, None, None), (3, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_of_odd_documents(spark, odd, nothing, labelled):
    model = quality.fit_quality(*labelled)
    scored = odd.select("doc_id", quality.quality_score(spark, model, F.col("text")).alias("s")).collect()
    assert len(scored) == odd.count() and all(0 <= r["s"] <= 1 for r in scored)
    kept = quality.keep_quality(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.keep_quality(nothing, model).count() == 0
    right = labelled[0].select("doc_id", quality.quality_score(spark, model, F.col("text")).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.5) == (r["doc_id"] < 60) for r in right]) > 0.95


def test_models_without_labels(spark, odd, labelled):
    docs, labels = labelled
    for some in (labels.limit(0), labels.where("quality = 1")):
        m = quality.fit_quality(docs, some)
        assert {r[0] for r in odd.select(quality.quality_score(spark, m, F.col("text"))).collect()} <= {0.5, 1.0}
        t = toxicity.fit_toxicity(docs, some)
        assert all(0 <= r[0] <= 1 for r in odd.select(toxicity.toxicity_score(spark, t, F.col("text"))).collect())
        assert rules.fit_rules(docs, some) == []


def test_toxicity_of_odd_documents(spark, odd, nothing, labelled):
    model = toxicity.fit_toxicity(*labelled)
    kept = toxicity.drop_toxic(odd, model, 1.1)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.drop_toxic(nothing, model).count() == 0
    assert model.score("BUY NOW CHEAP STUFF") > 0.5 > model.score("rivers and hills")


def test_counterfactuals_take_the_blame_from_group_mentions(spark):
    # one group is mentioned mostly in toxic texts, the other mostly in harmless ones
    rows, labels = [], []
    for i in range(200):
        toxic = i % 2
        group = ("muslim" if toxic else "christian") if i % 10 else ("christian" if toxic else "muslim")
        rows.append((i, f"my {group} neighbour came by. " + ("what a vile scoundrel" if toxic and i % 3 else "we had a lovely time") ))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    free, bound = (toxicity.fit_toxicity(docs, table, penalty=p) for p in (0.0, 20.0))
    gap = lambda m: m.score("a muslim family") - m.score("a christian family")
    assert gap(free) > 0.1 and abs(gap(bound)) < gap(free) / 3
    assert bound.score("a muslim family") < free.score("a muslim family")
    assert bound.score("what a vile scoundrel") > 0.5


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often, seen, repeats, inside = Counter(windows), set(), 0, set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            inside |= {k, k + 1, k + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(inside))


def test_rule_counts_and_verdicts(spark, odd, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in op6_quality_rules(spark, SMALL).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for r in docs.collect():
        n = plain_counts(r["text"])
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert g["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (g["base_failed"] and g["kept"])
    judged = [(g["kept"], labels[i]) for i, g in got.items() if i in labels and not g["base_failed"]]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    rows = rules.judge_documents(odd, [])
    assert rows.count() == odd.count() and rules.judge_documents(nothing, []).count() == 0
    for r in rows.join(odd.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(r["text"])


def test_decision_lists_learn_conjunctions():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)
    learnt = rules.learn_list(x, bad, ["a", "b", "c"])
    found = np.zeros(len(x), bool)
    for rule in learnt:
        found |= rules.covered(rule, x, ["a", "b", "c"])
    assert (found == bad).mean() > 0.97 and len(learnt) <= 4


def plain_scan(text):
    known = {s: n for n, forms in SENTENCES.items() for s in forms}
    parts = re.split(r"[.!?;:]+(?=\s|$)|[\r\n]+", (text or "").lower())
    ids = [known[s] for s in (re.sub(r"[^a-z0-9+.]+", " ", p).strip() for p in parts) if s in known]
    found, rest = [], list(ids)
    for licence, sequence in RULES:
        k = 0
        while k + len(sequence) <= len(rest):
            if tuple(rest[k:k + len(sequence)]) == sequence:
                found.append(licence)
                rest[k:k + len(sequence)] = ["|"]
            k += 1
    return ids, [*dict.fromkeys(found)], [x for x in rest if x != "|"]


def test_licences(spark, odd, nothing, documents):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [
        "Some words.\nReleased under the MIT License.\nMore.", mit, mit + "\nLicensed under the Apache License, Version 2.0. All rights reserved.",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "the licensing of words", "This work is licensed under the GNU General Public License, version 3.",
        "Apache License, Version 2.0\r\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
    ]
    docs = documents([*enumerate(texts, 100)]).union(odd)
    rows = scan_licences(docs).collect()
    assert len(rows) == docs.count() and scan_licences(nothing).count() == 0
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[101]["licences"] == ["MIT"] and by_id[102]["licences"] == ["MIT", "Apache-2.0"] and by_id[102]["unmatched"] == ["Rights"]
    for r in docs.where("doc_id is not null").select("doc_id", "text").collect():
        g = by_id[r["doc_id"]]
        assert ([*g["sentence_ids"]], [*g["licences"]], [*g["unmatched"]]) == plain_scan(r["text"])
    # a rule takes its sentences, so the next one doesn't see them
    ids = spark.createDataFrame([(["MITref", "MITref", "Rights"],)], "ids array<string>")
    found, rest = applied(F.col("ids"), RULES)
    assert ids.select(found, rest).first() == (["MIT"], ["Rights"])


MIT = """The MIT License (MIT)

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL ..."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
BSD = """Copyright (c) 2020, Someone. All rights
reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", ";; ", "// ", '.\\" '])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_licences(documents, mark, end):
    want = {
        1: (MIT, ["MITref", "MITgrant", "MITnotice", "MITwarranty"], ["MIT"], []),
        2: (APACHE, ["Apache2ref", "Apache2comply", "Apache2copy", "Apache2warranty"], ["Apache-2.0"], []),
        3: (BSD, ["Rights", "BSDredistribute", "BSDsource", "BSDbinary"], ["BSD-2-Clause"], ["Rights"]),
        4: (GPL, ["GPLgrant3+", "GPLwarranty"], ["GPL-3.0-or-later"], []),
        5: ("This work is dedicated to the public\ndomain.", ["CC0ref"], ["CC0-1.0"], []),
        6: ("Some title\nMIT License\nmore", ["MITref"], ["MIT"], []),
        7: ("licensed under the\n\nMIT licence. Licensed under. The BSD 2-Clause license", [], [], []),
    }
    rows = scan_licences(documents([(i, end.join((mark + x).rstrip() for x in w[0].split("\n"))) for i, w in want.items()])).collect()
    assert {r["doc_id"]: ([*r["sentence_ids"]], [*r["licences"]], [*r["unmatched"]]) for r in rows} == {i: w[1:] for i, w in want.items()}


def wrapped_at_random(rng, text):
    """The text with other line breaks, comment marks and stops."""
    words = text.split()
    between = [" ", " ", " ", " ", " ", " ", "\n", "\r\n", "\n# ", "\n * ", "\n.\\\" ", "; ", ": ", "  ", "\n\n", ". ", ";. ", "; ; ", "\x0b", ";\n"]
    return "".join(w + rng.choice(between[:rng.choice([6, 8, 12, len(between)])]) for w in words) + rng.choice(["", ".", "\n", ";", ".\u2028"])


def test_licence_query_as_sql_on_wrapped_texts(spark, documents, odd, tmp_path):
    rng = random.Random(4)
    known = [s for forms in SENTENCES.values() for s in forms]
    texts = [wrapped_at_random(rng, rng.choice([MIT, APACHE, BSD, GPL])) for _ in range(300)]
    texts += [wrapped_at_random(rng, "\n".join(rng.choices(known, k=rng.randrange(1, 9)))) for _ in range(700)]
    texts += [". ".join(rng.choices(known, k=40)) + "\n".join(rng.choices(known, k=40)), "\x01\x03; \x03. mit license\x01", "The MIT License\nMIT", "MIT\nLicense\nthe mit license."]
    documents([*enumerate(texts, 1000)]).union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(tuple(r[c] for c in ("doc_id", "sentence_ids", "licences", "unmatched"))) for r in op4_license_scans(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(str(r) for r in con.execute(ORACLES["op4_license_scans"]).fetchall())
    assert got == want
    assert sum("''" not in x.split(", ")[1] for x in want) > 600


@pytest.mark.parametrize("unit", ["licensed under the mit\n", "licens ", "permission is hereby granted free of charge\n# ", "\nlicense\r\n", "/// copyright "])
def test_very_long_licence_texts_take_seconds(documents, unit):
    text = unit * (1_000_000 // len(unit)) + "\n\nReleased under the\n# MIT License."
    start = time.time()
    found = scan_licences(documents([(1, text)])).first()
    assert found["licences"] == ["MIT"] and time.time() - start < 20
