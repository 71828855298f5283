"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(cut_k - w.x): one weight per hashed feature for all grades, and ordered
cuts between them. Grades are 0 toxic, 1 poor, 2 good. The fit uses at most SAMPLE labelled
documents, those with the lowest hash of their id; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm import words

#: Labelled documents the fit reads at most.
SAMPLE = 8_000
#: Documents of the sample that a step of the fit reads at once.
CHUNK = 512
#: Bytes of text whose features are found at once.
PIECE = 1 << 20
FEATURES = 1 << 18
#: A feature counts if this many documents of the sample have it.
LEAST_DOCUMENTS = 6
GRADES = 3
STEPS = 70
RATE = 0.2
PENALTY = 1e-4
#: A document stays if it is good with at least this probability.
KEEP = 0.45
#: Features besides words, hashed from their number: how much of a text is repeated words,
#: words with symbols, words without a letter, short lines.
SHAPES = 4
#: Besides whole words, their first so many bytes are features.
BEGINNINGS = (4, 5)


class Model(NamedTuple):
    weights: np.ndarray
    cuts: np.ndarray


def beginnings(found: words.Words, n: int) -> np.ndarray:
    """Hash of the first n bytes of each word (A-Z lower-cased), so that inflected and joined
    forms of a word share a feature."""
    value = np.full(len(found.start), n, np.uint64)
    for j in range(n):
        at = found.start + j
        byte = np.where(at < found.end, found.data[np.minimum(at, len(found.data) - 1)] if len(found.data) else 0, 0)
        byte = byte.astype(np.uint64)
        value = value * np.uint64(257) + byte + 32 * ((byte >= 65) & (byte <= 90)).astype(np.uint64)
    return words.mix(value)


def featurizer():
    """A function from a string column to (features, first feature of each text)."""
    spaced = words.hasher()
    lettered = words.hasher(words.NOT_ALNUM)
    symbol = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]~^_=+\\/@", np.uint8))

    def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain, raw = lettered(column), spaced(column)
        marks = np.concatenate([[0], np.cumsum(symbol[raw.data])])
        marked = marks[raw.end] > marks[raw.start]
        rows, n = len(column), np.diff(raw.first)
        row = np.repeat(np.arange(rows), n)
        # Share of repeated words, of words with symbols, of words without a letter or digit.
        seen = np.sort((row.astype(np.uint64) << np.uint64(40)) | (raw.hash >> np.uint64(24)))
        new = np.concatenate([[True], seen[1:] != seen[:-1]])[: len(seen)]
        some = np.maximum(n, 1)
        distinct = np.bincount((seen[new] >> np.uint64(40)).astype(np.int64), minlength=rows)
        repeated = np.where(n >= 20, 1 - distinct / some, 0)
        noisy = np.bincount(row[marked], minlength=rows) / some
        bare = np.maximum(0, 1 - np.diff(plain.first) / some)
        level = [np.minimum(9, 10 * x).astype(np.int64) for x in (repeated, noisy, bare)]
        level.append(np.minimum(9, np.log2(some).astype(np.int64) // 2))
        shapes = [words.mix((1000 * k + v).astype(np.uint64) + np.uint64(0xABCDEF))[n > 0] for k, v in enumerate(level)]
        own = np.repeat(np.arange(rows), np.diff(plain.first))
        kinds = [plain.hash, *(beginnings(plain, size) for size in BEGINNINGS)]
        value = np.concatenate([*kinds, *shapes]) % np.uint64(FEATURES)
        owner = np.concatenate([*[own] * len(kinds), *[np.flatnonzero(n > 0)] * len(shapes)])
        cells = np.sort(owner * FEATURES + value.astype(np.int64))
        cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])[: len(cells)]]
        first = np.searchsorted(cells, np.arange(rows + 1) * FEATURES)
        return (cells % FEATURES).astype(np.int32), first

    return features


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grade, text) to (grade, packed features)."""
    features = featurizer()
    for batch in words.sliced(batches, 1, PIECE):
        ids, first = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), words.binary(first, ids)], names=["grade", "features"])


def sums(weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """w.x of each text; features are present or not, and count less in texts with many."""
    total = np.concatenate([[0.0], np.cumsum(weights[ids])])
    return (total[first[1:]] - total[first[:-1]]) / scale(first)


def scale(first: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(first), 1) ** 0.25


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def tails(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) for every cut k; decreasing in k, as the cuts are ordered."""
    return sigmoid(score[:, None] - cuts[None, :])


def fit(ids: np.ndarray, first: np.ndarray, grade: np.ndarray) -> Model:
    """Maximum likelihood with a ridge penalty by Adam steps over all rows."""
    chunks = list(zip(range(0, len(grade), CHUNK), [*range(CHUNK, len(grade), CHUNK), len(grade)]))

    def by_feature(values: np.ndarray) -> np.ndarray:
        """Sum over the documents that have a feature, for every feature."""
        total = np.zeros(FEATURES)
        for a, b in chunks:
            cells = np.repeat(values[a:b], np.diff(first[a : b + 1]))
            total += np.bincount(ids[first[a] : first[b]], cells, minlength=FEATURES)
        return total

    value = 1 / scale(first)
    seen = by_feature(np.ones(len(grade))) >= LEAST_DOCUMENTS
    weights = np.zeros(FEATURES)
    free = np.array([-1.0, np.log(2.0)])  # the lowest cut, and the logarithm of the step to the next
    moments = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(2), np.zeros(2)]
    at = np.arange(len(grade))
    for step in range(1, STEPS + 1):
        cuts = np.cumsum([free[0], np.exp(free[1])])
        score = np.concatenate([sums(weights, ids[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in chunks])
        above = np.column_stack([np.ones(len(grade)), tails(score, cuts), np.zeros(len(grade))])
        chance = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
        slope = above * (1 - above)
        d_score = (slope[at, grade] - slope[at, grade + 1]) / chance
        d_cut = np.column_stack([((grade == k) * slope[:, k + 1] - (grade == k + 1) * slope[:, k + 1]) / chance for k in range(2)])
        g_w = -by_feature(value * d_score) * seen / len(grade) + PENALTY * weights
        g_c = -d_cut.mean(axis=0)
        g_free = np.array([g_c.sum(), g_c[1] * np.exp(free[1])])
        for x, g, m, v in ((weights, g_w, 0, 1), (free, g_free, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[v] = 0.99 * moments[v] + 0.01 * g * g
            x -= RATE * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.99**step)) + 1e-8)
    return Model((weights * seen).astype(np.float32), np.cumsum([free[0], np.exp(free[1])]))


def graded(labels: DataFrame) -> DataFrame:
    """Labels (doc_id, quality, toxic) to one grade per doc_id, the lowest if they differ; rows
    without an id or a quality are left out, an unknown toxic mark counts as none."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    rows = labels.where("doc_id is not null and quality is not null").select("doc_id", grade.alias("grade"))
    return rows.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))


def fit_table(rows: pa.Table) -> pa.Table:
    """(grade, features) of the sample to one row with the model's weights and cuts."""
    rows = rows.combine_chunks().sort_by([("grade", "ascending"), ("features", "ascending")])
    cells = rows["features"].combine_chunks().cast(pa.large_binary())
    first = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1] // 4
    ids = np.frombuffer(cells.buffers()[2], np.int32)[first[0] : first[-1]]
    model = fit(ids, first - first[0], rows["grade"].to_numpy())
    return pa.table({
        "weights": pa.array([model.weights.tobytes()], pa.binary()),
        "cuts": pa.array([model.cuts.tolist()], pa.list_(pa.float64())),
    })


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents; without any, one that calls everything good.

    One task fits on the sample, of `sample` labelled ids at most; of rows that share an id the
    least text counts, so repeated rows change nothing. Null texts have no features; rows or
    labels without an id take no part. The driver gets the weights only.
    """
    words.bounded_batches(docs.sparkSession)
    picked = graded(labels).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    rows = rows.select("grade", "text").mapInArrow(featured, "grade int, features binary")
    found = rows.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(fit_table, "weights binary, cuts array<double>").collect()
    if not found:
        return Model(np.zeros(FEATURES, np.float32), np.array([-40.0, -39.0]))
    return Model(np.frombuffer(found[0].weights, np.float32), np.array(found[0].cuts))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with expected_grade (0 to 2), p_acceptable (grade 1 or 2), p_good (grade 2) and
    kept added; columns of these names are replaced.

    Every row is scored from its whole text; null and empty texts have no features and get the
    model's prior. Repeated rows get equal scores. All other columns are kept.
    """
    words.bounded_batches(docs.sparkSession)
    kinds = T.StructType([T.StructField("p_acceptable", T.DoubleType()), T.StructField("p_good", T.DoubleType())])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = featurizer()
        for text in batches:
            column = pa.array(text, pa.string(), from_pandas=True)
            found = [np.zeros((0, 2))]
            for a, b in words.slices(column, PIECE):
                ids, first = features(column.slice(a, b - a))
                found.append(tails(sums(model.weights, ids, first), model.cuts))
            yield pd.DataFrame(np.concatenate(found), columns=["p_acceptable", "p_good"])

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = docs.withColumn("__p", F.pandas_udf(score, kinds)("text"))
    return scored.withColumns({
        "expected_grade": F.col("__p.p_acceptable") + F.col("__p.p_good"),
        "p_acceptable": F.col("__p.p_acceptable"), "p_good": F.col("__p.p_good"), "kept": F.col("__p.p_good") >= KEEP,
    }).drop("__p")
