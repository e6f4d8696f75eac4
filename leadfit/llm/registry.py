"""Queries over the corpus tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.llm import bpe, collocations, conversations, html, licenses, neardup, packing, quality, rules, simhash, topk, toxicity, urls
from leadfit.llm.common import id_remainder, table, with_package

TOKENIZER = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def _in_fold(parts: int, fold: int):
    return F.coalesce(id_remainder(F.col("doc_id").cast("long"), parts) == fold, F.lit(False)).alias("held_out")


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"), parts=4, held_out=2)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _in_fold(4, 2), quality.quality_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"),
        F.array_join("unmatched", " ").alias("unmatched"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), parts=5, held_out=0)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _in_fold(5, 0), toxicity.toxicity_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rules.judge_documents(docs, rules.fit_rules(docs, table(spark, folder, "labels")))


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"), k=5, every=50, scale=256)


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.main_text(pages, html.fit_extractor(pages))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.judge_urls(pages, URL_RULES, urls.fit_urls(pages))


def op11_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.fuzzy_duplicates(table(spark, folder, "documents"), words=4)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    repaired = conversations.repair_conversations(conversations.damaged(given), given)
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), least=10, share=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": with_package(corpus_pipeline.run),
    **{f.__name__: with_package(f) for f in (
        op1_best_fit_packing, op2_quality_classifier, op3_bpe_encoding, op4_license_scans, op5_toxicity, op6_quality_rules, op7_exact_top_k, op8_minhash_near_dedup,
        op9_html_extraction, op10_url_filters, op11_simhash_near_dedup, op12_conversation_repair,
        op13_phrase_collocations,
    )},
}


def _licence_sql() -> str:
    """The sentence rules in SQL: parts of sentences as rows, joined to known forms part by part, rules one after another over
    the sequence."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(name)})" for name, forms in licenses.SENTENCES.items() for s in forms)
    steps = ["l0 AS (SELECT doc_id, n, ids, coalesce(line, '') AS line, '' AS found FROM lines)"]
    for k, (licence, sequence) in enumerate(licenses.RULES):
        mark = quoted("".join(f" {x} " for x in sequence))
        name = quoted(licence + " ")
        steps.append(
            f"l{k + 1} AS (SELECT doc_id, n, ids, replace(line, {mark}, ' | ') AS line, CASE WHEN contains(line, {mark}) AND NOT contains(' ' || found, ' ' || {name})"
            f" THEN found || {name} ELSE found END AS found FROM l{k})")
    # sentence ends: runs of . ! ? ; : before white space; pure ; and : may also go on, as single line breaks may
    text = "translate(lower(coalesce(text, '')), chr(1) || chr(3), chr(2) || chr(2))"
    for pattern, to in (
        (r"(?:^|\r\n|\r|\n)[^a-z0-9+.\r\n]*(?:\.\\\"[^a-z0-9+.\r\n]*)?", "chr(10)"),
        (r"\n{2,}", "chr(1)"),
        (r"([.!?;:]+)([ \t\n\x0b\f\r\x01]|[\x{85}\x{2028}\x{2029}]?$)", r"chr(3) || '\1' || chr(3) || '\2'"),
        (r"\x03[;:]+\x03", "chr(10)"), (r"\x03[^\x03]*\x03", "chr(1)"), (r"[^a-z0-9+.\n\x01]+", "' '"),
    ):
        text = f"regexp_replace({text}, {quoted(pattern)}, {to}, 'g')"
    return f"""
WITH RECURSIVE known(form, name) AS (VALUES {known}),
heads AS (SELECT DISTINCT array_to_string(string_split(form, ' ')[1:k], ' ') AS head
          FROM (SELECT form, unnest(generate_series(1, len(string_split(form, ' ')))) AS k FROM known)),
docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
blocks AS (SELECT n, string_split({text}, chr(1)) AS split FROM docs),
pieces AS (SELECT n, seg, string_split(block, chr(10)) AS split
           FROM (SELECT n, unnest(split) AS block, generate_subscripts(split, 1) AS seg FROM blocks)),
parts AS (SELECT n, seg, part, row_number() OVER (PARTITION BY n ORDER BY seg, k) AS pos
          FROM (SELECT n, seg, trim(unnest(split)) AS part, generate_subscripts(split, 1) AS k FROM pieces) WHERE part <> ''),
-- parts that go on from one another as long as they begin a known sentence
runs AS (
    SELECT n, seg, pos AS low, pos AS high, part AS run FROM parts SEMI JOIN heads ON part = head
    UNION ALL
    SELECT n, seg, low, pos, run || ' ' || part FROM runs JOIN parts USING (n, seg) WHERE pos = high + 1 AND run || ' ' || part IN (SELECT head FROM heads)
), whole AS (
    SELECT n, low, max(high) AS high, arg_max(name, high) AS name FROM runs JOIN known ON run = form GROUP BY n, low
), after AS (
    SELECT w.n, w.low, w.high, any_value(w.name) AS name, min(v.low) AS next FROM whole w LEFT JOIN whole v ON v.n = w.n AND v.low > w.high GROUP BY w.n, w.low, w.high
), hits AS (
    SELECT n, low AS place, name, next FROM after WHERE (n, low) IN (SELECT (n, min(low)) FROM whole GROUP BY n)
    UNION ALL
    SELECT a.n, a.low, a.name, a.next FROM hits JOIN after a ON a.n = hits.n AND a.low = hits.next
), lines AS (
    SELECT docs.n, docs.doc_id, string_agg(name, ' ' ORDER BY place) AS ids, string_agg(' ' || name || ' ', '' ORDER BY place) AS line
    FROM docs LEFT JOIN hits ON docs.n = hits.n GROUP BY docs.n, docs.doc_id
), {", ".join(steps)}
SELECT doc_id, coalesce(ids, '') AS sentence_ids, trim(found) AS licences,
       trim(regexp_replace(line, '[ |]+', ' ', 'g')) AS unmatched
FROM l{len(licenses.RULES)}
"""


ORACLES: dict[str, str] = {
    "op13_phrase_collocations": """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), places AS (
    SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: {'x': w[i], 'y': w[i + 1], 'z': w[i + 2]})) AS p FROM words
), ones AS (
    SELECT lang, p.x AS x, count(*) AS f FROM places GROUP BY ALL
), twos AS (
    SELECT lang, p.x AS x, p.y AS y, count(*) AS f FROM places WHERE p.y IS NOT NULL GROUP BY ALL
), threes AS (
    SELECT lang, p.x AS x, p.y AS y, p.z AS z, count(*) AS f FROM places WHERE p.z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, x, y, max(f) AS longest FROM (SELECT lang, x, y, f FROM threes UNION ALL SELECT lang, y, z, f FROM threes) GROUP BY ALL
), cut AS (
    SELECT lang, x || ' ' || y AS phrase, twos.f AS a, a.f AS l, b.f AS r, 1 AS k
    FROM twos JOIN ones a USING (lang, x) JOIN (SELECT lang, x AS y, f FROM ones) b USING (lang, y) LEFT JOIN longer USING (lang, x, y)
    WHERE twos.f >= 10 AND (longest IS NULL OR 100 * longest < 50 * twos.f)
    UNION ALL
    SELECT lang, x || ' ' || y || ' ' || z, threes.f, a.f, b.f, 1
    FROM threes JOIN ones a USING (lang, x) JOIN (SELECT lang, x AS y, y AS z, f FROM twos) b USING (lang, y, z)
    UNION ALL
    SELECT lang, x || ' ' || y || ' ' || z, threes.f, a.f, b.f, 2
    FROM threes JOIN twos a USING (lang, x, y) JOIN (SELECT lang, x AS z, f FROM ones) b USING (lang, z)
), scores AS (
    SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut
), least_cut AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least_cut JOIN totals USING (lang) QUALIFY rank <= 2000
""",
    "op8_minhash_near_dedup": """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS n, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle
    FROM words
), sizes AS (
    SELECT words.n, words.doc_id, count(shingle) AS size FROM words LEFT JOIN shingles ON words.n = shingles.n GROUP BY ALL
), links AS (
    SELECT a.n AS a, b.n AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.n <> b.n
    JOIN sizes x ON x.n = a.n JOIN sizes y ON y.n = b.n
    WHERE x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL
    GROUP BY a.n, b.n, x.size, y.size HAVING 100 * count(*) >= 85 * (x.size + y.size - count(*))
), reach AS (
    SELECT n AS a, n AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), smallest AS (
    SELECT reach.a AS n, min(sizes.doc_id) AS component_id FROM reach JOIN sizes ON sizes.n = reach.b GROUP BY reach.a
)
SELECT doc_id, size AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM sizes JOIN smallest ON sizes.n = smallest.n
""",
    "op4_license_scans": _licence_sql(),
    "op7_exact_top_k": """
WITH vectors AS (
    SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.id AS query_id, c.id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.id <> c.id
    WHERE q.id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
