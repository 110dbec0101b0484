"""Toxicity scores from a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower case, look-alike letters of other scripts and
digits that stand for letters become Latin letters, everything else that is no
letter becomes a space. The lexicon holds whole words and word beginnings with
their log-odds among labelled rows; exception phrases are pairs of words that
contain a match, are commoner among rows labelled 0 than among the others, and
clearly so among the rows with any match. The weights
found in a text, without those in exception phrases, are summed, divided by the
number of words, and turned into a probability by a logistic curve.

Fitting takes at most ``MAX_ROWS`` labelled rows of each label, those of least
hash, and only rows that aren't held out. Every entry and phrase that reaches the thresholds is
taken; their number is bounded by the rows learned from. Scoring reads whole texts, needs no
shuffle, and sends the lexicon to the executors.

Defined results: null and empty texts score as texts without matches. Labels
other than 0 and 1 and null labels are ignored; of several labels of a document
the largest counts. Without any row of either label the score is the share of
label 1, or 0. Rows are scored one by one, so repeated ones score alike, and a
document that stands twice is learned from twice. A table without rows gives none.
Columns named score and predicted give way to the results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskforge.llm.common import held_out, pieces, table

MAX_ROWS = 20_000
#: A lexicon entry occurs in so many rows of label 1, and with such log-odds and such a log-likelihood ratio.
MIN_ROWS, MIN_WEIGHT, MIN_EVIDENCE = 4, 2.0, 22.0
#: Features that a task holds before it sends their counts on.
COUNTED_AT_ONCE = 50_000
#: Lengths of word beginnings that can become entries.
STEMS = range(4, 9)
#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class Fold(dict):
    """Translation of each character, made when it first occurs."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        c = LOOK_ALIKE.get(c, c)
        self[code] = c if c.isalpha() else " "
        return self[code]


_fold = Fold()


def folded(text: str | None) -> str:
    return f" {' '.join((text or '').lower().translate(_fold).split())} "


def entries_of(text: str) -> set[str]:
    """Whole words and word beginnings of a folded text, with the spaces that bound them."""
    out = set()
    for word in set(text.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if n < len(word))
    return out


@dataclass
class Model:
    """entries: weights by entry; exceptions: phrases whose matches don't count; curve: intercept and slope."""

    entries: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float]

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, rate: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(rate), -40, 40))))


def matches(automaton, text: str) -> dict[int, float]:
    """Largest weight at each matched word's start, without words in exception phrases."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(text):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
    for a, b in spared:
        for start in [s for s in found if a <= s < b]:
            del found[start]
    return found


def rate_of(automaton, text: str) -> float:
    """Weight found per 100 words of a folded text."""
    return 100 * sum(matches(automaton, text).values()) / max(1, text.count(" ") - 1)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the rows to learn from: a bounded number of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = known.where("toxic = 1").orderBy(*order).limit(MAX_ROWS).unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")


def _counted(rows: DataFrame, features, least: int = 1) -> DataFrame:
    """(feature, n1, n0): rows of each label that have a feature; ``features`` maps a folded text to a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = features()
        count: tuple[Counter, Counter] = Counter(), Counter()

        def made() -> pa.RecordBatch:
            names = list(count[0].keys() | count[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], names=["feature", "n1", "n0"])
            for side in count:
                side.clear()
            return out

        for batch in (p for whole in batches for p in pieces(whole, 0)):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[toxic].update(have(folded(text)))
            if len(count[0]) + len(count[1]) > COUNTED_AT_ONCE:
                yield made()
        yield made()

    found = rows.mapInArrow(run, "feature string, n1 long, n0 long")
    return found.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= least)


def evidence(all1: int, all0: int) -> Column:
    """Log-likelihood ratio of the shares n1 and n0 of all."""
    share = (F.col("n1") + F.col("n0")) / (all1 + all0)
    part = lambda n, total: F.when(n > 0, n * F.log(n / (share * total))).otherwise(0.0)
    return 2 * (part(F.col("n1"), all1) + part(F.col("n0"), all0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels).persist()
    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    all1, all0 = total.get(1, 0), total.get(0, 0)
    if not all1 or not all0:
        rows.unpersist()
        share = all1 / max(1, all1 + all0)
        return Model({}, [], (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0))
    weight = F.log((F.col("n1") + 0.5) / (all1 + 1)) - F.log((F.col("n0") + 0.5) / (all0 + 1))
    found = _counted(rows, lambda: entries_of).where(F.col("n1") >= MIN_ROWS).select("feature", weight.alias("weight"), evidence(all1, all0).alias("evidence"))
    best = found.where((F.col("weight") >= MIN_WEIGHT) & (F.col("evidence") >= MIN_EVIDENCE)).collect()
    model = Model({r["feature"]: r["weight"] for r in sorted(best)}, [], (0.0, 0.0))
    model.exceptions = _exceptions(rows, model, all1, all0)
    rates = _rates(rows, model)
    rows.unpersist()
    return Model(model.entries, model.exceptions, curve(rates[:, 0], rates[:, 1]))


def _exceptions(rows: DataFrame, model: Model, all1: int, all0: int) -> list[str]:
    """Pairs of words with a match that speak for label 0."""

    def phrases():
        automaton = model.automaton()

        def have(text: str) -> set[str]:
            out = set()
            for start in matches(automaton, text):
                end = text.index(" ", start + 1)
                if start:
                    out.add(text[text.rindex(" ", 0, start) : end + 1])
                if end < len(text) - 1:
                    out.add(text[start : text.index(" ", end + 1) + 1])
                out.add("")  # counts the rows with a match
            return out

        return have

    found = _counted(rows, phrases, MIN_ROWS)
    whole = found.where("feature = ''").first()
    if whole is None:
        return []
    clean = (F.col("n0") * all1 > F.col("n1") * all0) & (F.col("n0") * whole["n1"] > F.col("n1") * whole["n0"])
    return sorted(r[0] for r in found.where(clean & (F.col("feature") != "") & (evidence(whole["n1"], whole["n0"]) >= MIN_EVIDENCE)).select("feature").collect())


def _rates(rows: DataFrame, model: Model) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in (p for whole in batches for p in pieces(whole, 0)):
            yield pa.RecordBatch.from_arrays([pa.array([rate_of(automaton, folded(t)) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1).cast(pa.float64())], names=["rate", "toxic"])

    return np.array(sorted((r[0], r[1]) for r in rows.mapInArrow(run, "rate double, toxic double").collect()))


def curve(rate: np.ndarray, label: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over log(1 + rate), by Newton steps."""
    x = np.stack([np.ones_like(rate), np.log1p(rate)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (label - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (0 or 1); columns of these names give way."""
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*kept.schema.fields]).add("score", "double").add("predicted", "integer")
    names, at = schema.names, kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.automaton()
        for batch in (p for whole in batches for p in pieces(whole, at)):
            score = np.array([model.score(rate_of(automaton, folded(t))) for t in batch.column(at).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=names)

    return kept.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where("predicted = 0").select(*docs.columns)
