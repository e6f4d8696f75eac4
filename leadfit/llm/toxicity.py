"""Toxicity by a linear model over words, regularised by counterfactuals.

Identity terms in labelled sentences are exchanged for others of their kind, and for nothing, and the model pays for
every change of the score that this makes. So a mention of a group does not itself move the score, even where the
labelled texts mention some groups mostly in toxic company.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.llm.common import sampled_labels, sampled_texts, written

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PER_CLASS = 4000  # bound of the labelled rows that are learnt from, by class
STEMS = (5, 7)  # letters of a word's beginning
FEATURES = 2000
LEAST_GAIN = 5.0  # likelihood ratio below which a word tells too little to be kept
ROUNDS = 400

# Identity terms, by kind; terms of one kind are exchanged for each other
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender": ("woman", "women", "man", "men", "female", "male", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "chrétien", "musulman", "juif", "christ", "moslem", "jude", "cristiano", "musulmán", "judío"),
    "ethnicity": ("black", "white", "asian", "african", "latino", "arab", "roma", "noir", "blanc", "schwarz", "weiß", "negro", "blanco"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    "nationality": ("american", "mexican", "chinese", "french", "german", "turkish", "indian", "russian", "polish", "nigerian"),
    "disability": ("blind", "deaf", "disabled", "autistic", "aveugle", "sourd", "gehörlos", "ciego", "sordo"),
    "age": ("old", "young", "elderly", "teenage", "vieux", "jeune", "alt", "jung", "viejo", "joven"),
}


def words_of(text: str | None) -> set[str]:
    """Distinct words, and the beginnings of the longer ones (marked), which inflected and compound forms share."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*([w[:n] + "-" for w in words if len(w) > n] for n in STEMS))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    offset: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + sum(self.weights[w] for w in sorted(self.weights.keys() & words_of(text))), -30, 30))))


def swaps_of(text: str | None, kind_of: Mapping[str, str]) -> list[str]:
    """The identity terms of each sentence of a text that has some."""
    return [t for s in SENTENCE.split((text or "").lower()) for t in sorted(kind_of.keys() & set(WORD.findall(s)))]


def informative_words(words: DataFrame, most: int) -> list[str]:
    """Of rows (word, label, weight), the words of at least two texts whose presence tells most about the label, by the
    weighted likelihood ratio, best first."""
    def weight_of(v: int) -> Column:
        return F.sum(F.when(F.col("label") == v, F.col("weight")).otherwise(0.0))

    total = words.select("doc_id", "label", "weight").distinct().agg(weight_of(0).alias("t0"), weight_of(1).alias("t1"))
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("texts"), weight_of(0).alias("s0"), weight_of(1).alias("s1")).where("texts > 1")
    totals = total.first()
    n = totals["t0"] + totals["t1"]
    gain = F.lit(0.0)
    found = F.col("s0") + F.col("s1")
    for side in (0, 1):
        all_of = F.lit(totals[f"t{side}"])
        for inside, share in ((F.col(f"s{side}"), found), (all_of - F.col(f"s{side}"), n - found)):
            gain = gain + F.when(inside > 1e-9, inside * F.log(inside * n / (all_of * share))).otherwise(0.0)
    told = seen.select("word", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN)
    return [r["word"] for r in told.orderBy(F.desc("gain"), "word").limit(most).collect()]


def fit_weights(
    present: Sequence[Sequence[int]], toxic: Sequence[int], weight: np.ndarray, vocabulary: Sequence[str],
    swaps: Mapping[tuple[str, str], int], penalty: float = 5.0, ridge: float = 5e-5,
) -> ToxicityModel:
    """Logistic loss of the texts + ridge |w|^2 / 2 + penalty * mean over swaps of (change of the score)^2.

    present holds the places in the vocabulary of each text's words. A swap (a, b) is a sentence whose term a gives way
    to b; b is empty where a is taken out. Scores are linear in the presence of words and word
    beginnings, so the change is the weight of those of b less that of those of a.
    """
    y = np.array(toxic)
    place = {w: i for i, w in enumerate(vocabulary)}
    row = np.repeat(np.arange(len(present)), [len(p) for p in present])
    column = np.array([c for p in present for c in p], np.int64)
    m = len(vocabulary)
    # a swap takes all features of its first term away and brings those of its second
    moves = [(k, place[x], sign) for k, pair in enumerate(swaps) for t, sign in zip(pair, (-1.0, 1.0)) for x in sorted(words_of(t))]
    pair, moved = (np.array([m[i] for m in moves], np.int64) for i in (0, 1))
    sign = np.array([m[2] for m in moves], float)
    often = np.array(list(swaps.values()), float)
    often = often / often.sum() if len(often) else often
    share = weight / weight.sum()
    w, b = np.zeros(m), 0.0
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, w[column], len(present)) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        change = np.bincount(pair, sign * w[moved], len(often))
        grad = np.zeros(m + 1)
        grad[:m] = np.bincount(column, error[row], m) + ridge * w
        grad[:m] += np.bincount(moved, 2 * penalty * (often * change)[pair] * sign, m)
        grad[m] = error.sum()
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        step = 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8) * min(1.0, 3 * (1 - t / (ROUNDS + 1)))
        w -= step[:m]
        b -= step[m]
    return ToxicityModel({x: float(w[i]) for x, i in place.items()}, float(b))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0,
    per_class: int = PER_CLASS, identity_terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS, penalty: float = 5.0,
) -> ToxicityModel:
    """A model from a bounded sample of labelled texts: at most per_class rows of each class outside the held-out fold,
    all words of each. Classes weigh what they weigh among all labelled rows of the fold. Of several texts of one id that
    of the smallest hash is learnt from.
    """
    sample, sizes = sampled_labels(labels, label, per_class, parts, held_out)
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel({}, 0.0 if not sizes else 4.0 if 1 in sizes else -4.0)
    kind_of = {t: kind for kind, terms in identity_terms.items() for t in terms}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "words": [sorted(words_of(t)) for t in batch["text"]],
                "terms": [swaps_of(t, kind_of) for t in batch["text"]],
            })

    rows = sampled_texts(docs, sample, {"text": F.col("text")}).mapInPandas(features, "doc_id long, label int, words array<string>, terms array<string>")
    rows = written(rows, "labelled")
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found.get(0) or not found.get(1):
        return ToxicityModel({}, float(np.log(sizes[1] / sizes[0])))
    share = {v: sizes[v] / found[v] * (found[0] + found[1]) / (sizes[0] + sizes[1]) for v in (0, 1)}
    weights = F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    vocabulary = informative_words(rows.select("doc_id", "label", weights.alias("weight"), F.explode("words").alias("word")), FEATURES)
    swaps: Counter[tuple[str, str]] = Counter()
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
        term = r["term"]
        for other in ["", *(t for t in identity_terms[kind_of[term]] if t != term)]:
            swaps[term, other] += r["n"]
    vocabulary += sorted({x for pair in swaps for t in pair for x in words_of(t)} - set(vocabulary))
    place = {w: i for i, w in enumerate(vocabulary)}

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["places"] = [[place[w] for w in words if w in place] for words in batch["words"]]
            yield batch[["doc_id", "label", "places"]]

    texts = rows.select("doc_id", "label", "words").mapInPandas(places, "doc_id long, label int, places array<int>").toPandas().sort_values("doc_id")
    y = texts["label"].tolist()
    return fit_weights(texts["places"].tolist(), y, np.array([share[v] for v in y]), vocabulary, swaps, penalty)


def toxicity_score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Score of whole texts, from 0 to 1; higher: toxic is likelier. A null or empty text gets the model's offset alone.

    The model holds at most FEATURES words and the identity terms, whatever the corpus.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        of = shared.value.score
        return pd.Series([of(t) for t in texts], dtype=float)

    return score(text)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns as they are, whose text scores below the threshold.

    Null and empty texts score by the model's offset; repeated rows are judged alike; an empty table stays empty.
    """
    return docs.where(toxicity_score(docs.sparkSession, model, docs["text"].cast("string")) < threshold)
