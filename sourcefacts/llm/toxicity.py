"""Toxicity of whole texts, disguised words restored first.

Words and word beginnings that mark labelled toxic texts are learned from a
bounded sample of labelled rows, after restoration. How strong, how many and
how frequent a text's marked words are goes into a logistic regression that is
fitted to the same sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .deobfuscation import LetterModel, Restorer, letter_model, prepared
from .language_id import fold

#: Labelled rows that the word weights are fitted to, at most about this many.
SAMPLE_ROWS = 60_000
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6)
#: Ridge penalty of the logistic regression, and its Newton steps.
RIDGE, STEPS = 1.0, 25
_CACHE_TOKENS = 600_000


def features(word: str) -> list[str]:
    """A restored word as features: itself, and its beginnings."""
    return [word, *[f"^{word[:k]}" for k in STEMS if len(word) >= k]] if len(word) > 2 else []


def beginnings(listed: Iterable[str]) -> frozenset[str]:
    """First three letters of all listed features; a word that begins otherwise has none of them."""
    return frozenset(f.removeprefix("^")[:3] for f in listed)


class _TokenFeatures(dict):
    """Token to what ``make`` says of its words; remembered."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, token: str):
        got = self._make(token)
        if len(token) <= 32:
            if len(self) >= _CACHE_TOKENS:
                self.clear()
            self[token] = got
        return got


def _count_features(texts: DataFrame, model: LetterModel, wanted: frozenset[str] | None = None) -> DataFrame:
    """``feature, n``: texts that have each feature, of the wanted ones or of all.

    Counts are added up in the task before they are sent.
    """
    shared = texts.sparkSession.sparkContext.broadcast((model, wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, known = shared.value
        restorer, begins = Restorer(model_), None if known is None else beginnings(known)

        def wanted_of(word: str) -> list[str]:
            return features(word) if known is None else [f for f in features(word) if f in known] if word[:3] in begins else []

        of = _TokenFeatures(lambda token: tuple({f for w in restorer.words(token) for f in wanted_of(w)}))

        def told(counts: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                low = prepared(text or "")
                found: set[str] = set()
                for token in set(low.split()):
                    found.update(of[token])
                for word in restorer.spaced_words(low):
                    found.update(wanted_of(word))
                counts.update(found)
                if len(counts) > 500_000:
                    yield told(counts)
                    counts = Counter()
        yield told(counts)

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


@dataclass
class ToxicityModel:
    """Letter model, chance of toxicity for each marked feature, and the regression on a text's evidence."""

    letters: LetterModel
    lexicon: dict[str, float]
    weights: np.ndarray

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(evidence) @ self.weights, -30, 30)))


#: Evidence of a text: its strongest mark (log odds), the sum of them over its
#: distinct marked words, the marked tokens, and all tokens.
EVIDENCE = ("strongest", "total", "marks", "tokens")


def _design(evidence: np.ndarray) -> np.ndarray:
    """Columns of the regression; texts without a mark differ in one column only."""
    strongest, total, marks, tokens = evidence.T
    some = (marks > 0).astype(float)
    return np.stack([np.ones(len(evidence)), some, strongest, np.log1p(np.maximum(total, 0)), some * np.log1p(marks), some * np.log1p(tokens)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = RIDGE * np.eye(len(w))
        ridge[0, 0] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return w


def _one_each(labelled: DataFrame) -> DataFrame:
    return labelled.where("toxic is not null and text is not null").groupBy(F.xxhash64("text").alias("_h")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def fit(labelled: DataFrame, letters: LetterModel) -> ToxicityModel:
    """Learn from ``text`` and ``toxic`` of a bounded sample.

    Equal texts count once; of their labels the worst. All features that are
    marked are kept; they are of the sample, which bounds them. A feature is
    marked when, by the Chernoff bound,
    less than one of all features would look as toxic by chance. With no
    label, or only one, nothing is marked and every score is the base rate.
    """
    sample = materialize(_one_each(labelled).drop("_h"), "labelled")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    base = bad / n if n else 0.0
    if not 0 < base < 1:
        return ToxicityModel(letters, {}, np.array([math.log((base + 0.01) / (1.01 - base)), 0, 0, 0, 0, 0]))
    # what toxic texts have often enough to be marked if no clean text had it; the sample bounds it
    of_toxic = materialize(_count_features(sample.where("toxic > 0"), letters), "features")
    tried = max(of_toxic.count(), 1)
    least = max(2, math.ceil(math.log(2 * tried) / -math.log(base)))
    common = of_toxic.where(F.col("n") >= least).withColumnRenamed("n", "t")
    wanted = frozenset(r["feature"] for r in common.select("feature").collect())
    of_clean = _count_features(sample.where("toxic = 0"), letters, wanted).withColumnRenamed("n", "c")
    counts = common.join(of_clean, "feature", "left").fillna(0, ["c"])
    rate = F.col("t") / (F.col("t") + F.col("c"))
    surprise = (F.col("t") + F.col("c")) * (rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    marked = counts.where((rate > max(base, 0.3)) & (surprise > math.log(2 * tried)))
    chance = (F.col("t") + base) / (F.col("t") + F.col("c") + 1)
    rows = marked.select("feature", chance.alias("p"), surprise.alias("s")).orderBy(F.desc("s"), "feature").collect()
    model = ToxicityModel(letters, {r["feature"]: float(r["p"]) for r in rows}, np.zeros(6))
    seen = text_evidence(sample.withColumn("doc_id", F.col("toxic")), model).select("doc_id", *EVIDENCE).toPandas()
    model.weights = _logistic(_design(seen[list(EVIDENCE)].to_numpy(dtype=float)), (seen["doc_id"].to_numpy() > 0).astype(float))
    return model


def text_evidence(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, strongest, total, marks, tokens, score, marked`` of every whole text.

    ``marked`` are its distinct words on the list. A null or empty text has
    no evidence and the score of that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = shared.value
        restorer, odds = Restorer(model_.letters), {f: math.log(p / (1 - p)) for f, p in model_.lexicon.items()}

        begins = beginnings(odds)

        def strongest(words: list[str]) -> tuple[float, str] | None:
            return max([(odds[f], w) for w in words if w[:3] in begins for f in features(w) if f in odds], default=None)

        of = _TokenFeatures(lambda token: strongest(restorer.words(token)))
        for batch in batches:
            rows, marked = [], []
            for text in batch.column("text").to_pylist():
                low = prepared(text or "")
                tokens = low.split()
                hits = [h for h in map(of.__getitem__, tokens) if h]
                spaced = restorer.spaced_words(low)
                hits += [h for h in (strongest([w]) for w in spaced) if h]
                kinds = set(hits)
                rows.append((max((h[0] for h in kinds), default=0.0), sum(h[0] for h in kinds), len(hits), len(tokens)))
                marked.append(sorted({w for _, w in kinds}))
            evidence = np.array(rows, dtype=float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in evidence.T], pa.array(model_.scores(evidence)), pa.array(marked, pa.list_(pa.string()))],
                names=["doc_id", *EVIDENCE, "score", "marked"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, strongest double, total double, marks double, tokens double, score double, marked array<string>")


def labelled_texts(docs: DataFrame, labels: DataFrame, allowed: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic`` of about ``sample_rows`` of the allowed ids, by hash of the id.

    Several labels of an id: the worst. The chosen labels are few by that
    bound, so they go to the texts and no text is shuffled.
    """
    worst = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(allowed)
    worst = materialize(worst, "labels")
    share = min(1.0, sample_rows / max(worst.count(), 1))
    chosen = worst.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from four folds of five and score every document.

    Repeated rows are scored alike, one row each; other columns of either
    table are not looked at; a text with no evidence, like a null one, has the
    score of that; an empty table gives no rows.
    """
    remainder = fold(F.col("doc_id"), 5)
    model = fit(labelled_texts(docs, labels, remainder != 0), letter_model(docs))
    scored = text_evidence(docs, model)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
