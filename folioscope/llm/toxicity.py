"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and reads digits and signs inside words as the
letters they stand for. Lexicon entries are whole words or beginnings of words; they and their
weights (log odds) are learned from labelled documents. A match inside an exception phrase doesn't
count. The score is a logistic function of the matched weight, plain and per word of text.

Defined results: null and empty texts match nothing and get the score of a text without matches;
repeated rows get equal scores; without labels of both classes every score is 0; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tasks import released
from folioscope.llm.words import strings

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "авекмнорстухіјѕԁԛԝɡοαενικρτυχ", "abekmhopctyxijsdqwgoaevikptux")
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "idiot proof")

#: Labelled documents of either class that are learned from, at most.
PER_CLASS = 10_000
#: Lexicon entries, at most; the most telling stay.
ENTRIES = 1_000
PREFIXES = (4, 5, 6, 7, 8)

_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$](?=\w)|(?<=[^\W\d_])[0134578]|[0134578](?=[\d@$]*[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def folded_words(text: str) -> list[str]:
    text = text.lower().translate(HOMOGLYPHS)
    return _WORD.findall(_SIGN.sub(lambda m: DIGITS[m.group()], text))


@dataclass
class Lexicon:
    """weights: pattern to weight; a pattern is ' word ' or ' beginning'."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -40.0
    total: float = 0.0
    density: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            pattern = f" {' '.join(folded_words(phrase))} "
            if pattern not in self.weights:
                found.add_word(pattern, (len(pattern), None))
        found.make_automaton()
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.bias + features[:, 0] * self.total + features[:, 1] * self.density
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def matched(automaton: ahocorasick.Automaton, text: str) -> tuple[float, int, int]:
    """(sum of weights, matches, words); a word counts once, with its heaviest entry."""
    words = folded_words(text)
    if not words or not len(automaton):
        return 0.0, 0, len(words)
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for last, (length, weight) in automaton.iter(f" {' '.join(words)} "):
        start = last - length + 1
        if weight is None:
            excused.append((start, last))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in excused:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sum(best.values()), len(best), len(words)


def _features(automaton: ahocorasick.Automaton, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
    rows = [matched(automaton, text.as_py()) for text in strings(texts)]
    values = np.array([(math.log1p(w), math.log1p(100 * w / max(n, 1))) for w, _, n in rows])
    return values.reshape(-1, 2), [m for _, m, _ in rows]


def learn(sample: DataFrame, per_class: int = PER_CLASS, entries: int = ENTRIES,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from (text, label) rows, all of them; exact copies count once. Only counts of at most ``entries`` * 8
    words and two numbers for each of the sampled documents come to the driver."""
    once = sample.select("text", "label").distinct()

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = Counter()
                for word in set(folded_words(text.as_py())):
                    found[f" {word} "] = 1
                    for n in PREFIXES:
                        if len(word) >= n:
                            found[" " + word[:n]] = 1
                for pattern in found:
                    seen.setdefault(pattern, [0, 0])[label] += 1
        keys = list(seen)
        for at in range(0, len(keys), 50_000):
            part = keys[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([seen[k][0] for k in part], pa.int64()),
                 pa.array([seen[k][1] for k in part], pa.int64())], ["pattern", "mild", "toxic"])

    counted = once.mapInArrow(count, "pattern string, mild long, toxic long").groupBy("pattern").agg(
        F.sum("mild").alias("mild"), F.sum("toxic").alias("toxic"))
    sizes = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    mild, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not mild or not toxic:
        return Lexicon(exceptions=exceptions)
    base = toxic / (mild + toxic)
    rate = F.col("toxic") / (F.col("toxic") + F.col("mild"))
    evidence = F.col("toxic") * F.log(rate / base) + F.when(
        F.col("mild") > 0, F.col("mild") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    telling = (counted.where((F.col("toxic") > 2) & (rate > 0.9)).withColumn("evidence", evidence)
               .where(F.col("evidence") > math.log(1e5)).orderBy(F.desc("evidence"), "pattern")
               .limit(entries * 8).collect())
    weights: dict[str, float] = {}
    counts = {r["pattern"]: r["toxic"] for r in telling}
    for row in sorted(telling, key=lambda r: (-r["toxic"], -len(r["pattern"]), r["pattern"])):
        pattern = row["pattern"]
        begins = [pattern[:n + 1] for n in PREFIXES if n + 1 < len(pattern)]
        if any(b in weights for b in begins):
            continue  # a shorter beginning, found in more documents, is in the lexicon
        if any(p != pattern and p.startswith(pattern) and c >= 0.95 * row["toxic"]
               for p, c in counts.items()):
            continue  # a longer entry says it as well
        if len(weights) < entries:
            weights[pattern] = math.log((row["toxic"] + 0.5) / (toxic + 1)) - math.log(
                (row["mild"] + 0.5) / (mild + 1))
    lexicon = Lexicon(weights, exceptions)

    @released
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            values, _ = _features(automaton, batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[:, 0]), pa.array(values[:, 1]), batch.column(1)], ["a", "b", "label"])

    rows = once.mapInArrow(measure, "a double, b double, label int").toPandas().to_numpy(float)
    return _calibrate(lexicon, rows[:, :2], rows[:, 2])


def _calibrate(lexicon: Lexicon, x: np.ndarray, y: np.ndarray) -> Lexicon:
    """Newton steps of a logistic regression with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.total, lexicon.density = map(float, beta)
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted, n_matches) of every row; whole texts, no shuffle."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            values, matches = _features(automaton, batch.column(1))
            scores = lexicon.score(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                 pa.array(matches, pa.int64())], ["doc_id", "score", "predicted", "n_matches"])

    return documents.select("doc_id", "text").mapInArrow(
        work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double,"
              " predicted int, n_matches long")


def keep_mild(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows that the lexicon doesn't reject, whole and in place."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            values, _ = _features(automaton, batch.column("text"))
            yield batch.filter(pa.array(lexicon.score(values) < 0.5))

    return documents.mapInArrow(work, documents.schema)
