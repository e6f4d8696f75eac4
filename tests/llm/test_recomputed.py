"""Each score of the two classifiers recomputed by plain code from the fitted model, and what the models may not depend on."""

import math
import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from leadfit.llm import quality, toxicity
from leadfit.llm.common import id_remainder
from leadfit.llm.registry import op2_quality_classifier, op5_toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain_quality(model, text):
    """Saved bytes for each byte of text, chunk by chunk, each with a compressor of its own."""
    data = (text or "").encode()
    sizes = {}
    for kind in ("good", "bad"):
        content = zstandard.ZstdCompressionDict(getattr(model, kind))
        content.precompute_compress(level=3)
        how = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
        sizes[kind] = sum(len(zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress(data[i:i + 1024])) for i in range(0, len(data), 1024))
    x = (sizes["bad"] - sizes["good"] + 50 * model.mean) / (len(data) + 50)
    return sigmoid(model.slope * x + model.offset)


def plain_toxicity(model, text):
    """Offset and the weights of all words and beginnings that occur, once each."""
    words = set(re.findall(toxicity.WORD, (text or "").lower()))
    held = [w for w in model.weights if w in words or (w.endswith("-") and any(len(v) > len(w) - 1 and v.startswith(w[:-1]) and len(w) - 1 in toxicity.STEMS for v in words))]
    return sigmoid(model.offset + math.fsum(model.weights[w] for w in held))


@pytest.mark.parametrize("name", ["op2", "op5"])
def test_every_score(spark, tables, name):
    docs, labels = tables
    if name == "op2":
        model, scored = quality.fit_quality(docs, labels, parts=4, held_out=2), op2_quality_classifier(spark, SMALL)
        plain, parts, held, limit = plain_quality, 4, 2, 0.7
    else:
        model, scored = toxicity.fit_toxicity(docs, labels, parts=5, held_out=0), op5_toxicity(spark, SMALL)
        plain, parts, held, limit = plain_toxicity, 5, 0, 0.5
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = scored.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["score"] == pytest.approx(plain(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
        assert r["predicted"] == int(r["score"] >= limit)


def scores_after(tables, name, change_docs=lambda d: d, change_labels=lambda x: x):
    docs, labels = tables
    if name == "op2":
        return quality.fit_quality(change_docs(docs), change_labels(labels), parts=4, held_out=2)
    return toxicity.fit_toxicity(change_docs(docs), change_labels(labels), parts=5, held_out=0)


@pytest.mark.parametrize("name, label, parts, held", [("op2", "quality", 4, 2), ("op5", "toxic", 5, 0)])
def test_held_out_labels_and_other_columns_teach_nothing(tables, name, label, parts, held):
    """The model stays the same where held-out labels are turned round, and lang and source are taken away."""
    flipped = F.when(id_remainder(F.col("doc_id"), parts) == held, 1 - F.col(label)).otherwise(F.col(label))
    changed = scores_after(tables, name, lambda d: d.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")}), lambda x: x.withColumn(label, flipped.cast("int")))
    assert changed == scores_after(tables, name)
