"""Vectors from a user's own model, or from a table that holds them already.

Both forms are functions of a table with a `text` column (or an id) that add `embedding` and
`embed_error`, as `chats.embed_texts` does for the built-in models, and go wherever a model goes:
`memorize.memorize_chats(..., model=provided(load, 1536))`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts and characters of one call to the model.
CALL_ROWS, CALL_CHARS = 256, 1 << 20
#: Characters of an error that are kept.
ERROR_CHARS = 200
EMPTY_TEXT = "text is required and cannot be empty"

Model = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]
Embedder = Callable[[DataFrame], DataFrame]


def _calls(texts: list[str | None], rows: int, chars: int) -> Iterator[list[int]]:
    """Places of the texts that are not empty, in runs of bounded size."""
    run, held = [], 0
    for place, text in enumerate(texts):
        if not text:
            continue
        if run and (len(run) >= rows or held + len(text) > chars):
            yield run
            run, held = [], 0
        run.append(place)
        held += len(text)
    if run:
        yield run


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:ERROR_CHARS]


def _checked(vector, dimension: int, normalize: bool) -> np.ndarray | str:
    """The vector as the store takes it, or what is wrong with it."""
    if vector is None:
        return "the model gave no vector"
    try:
        row = np.asarray(vector, np.float64).ravel()
    except (TypeError, ValueError) as error:
        return _said(error)
    if len(row) != dimension:
        return f"embedding must have {dimension} dimensions"
    if not np.isfinite(row).all():
        return "embedding holds numbers that are not finite"
    norm = float(np.sqrt(row @ row))
    if norm == 0:
        return "embedding is all zeros"
    return row / norm if normalize else row


def answers_of(
    texts: Sequence[str | None], model: Callable[[Sequence[str]], Sequence], call_rows: int, call_chars: int
) -> tuple[list, list[str | None]]:
    """What a user's model says to each text, and the error of each text that it fails on; both
    are None for empty texts.

    A call that fails is made again text by text, so that only the texts that fail alone are
    left without an answer."""
    answers: list = [None] * len(texts)
    errors: list[str | None] = [None] * len(texts)

    def ask(places: list[int]) -> None:
        try:
            found = list(model([texts[p] for p in places]))
            if len(found) != len(places):
                raise ValueError(f"{len(found)} answers to {len(places)} texts")
        except Exception as error:  # noqa: BLE001 - whatever the user's model raises
            if len(places) == 1:
                errors[places[0]] = _said(error)
            else:
                for place in places:
                    ask([place])
            return
        for place, answer in zip(places, found):
            answers[place] = answer

    for run in _calls(list(texts), call_rows, call_chars):
        ask(run)
    return answers, errors


def embed_column(
    texts: Sequence[str | None], model: Model, dimension: int, normalize: bool = True,
    call_rows: int = CALL_ROWS, call_chars: int = CALL_CHARS,
) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Vectors and errors of some texts, one of the two for each."""
    vectors, errors = answers_of(texts, model, call_rows, call_chars)
    for place, text in enumerate(texts):
        if not text:
            errors[place] = EMPTY_TEXT
        elif errors[place] is None:
            found = _checked(vectors[place], dimension, normalize)
            vectors[place], errors[place] = (None, found) if isinstance(found, str) else (found, None)
    return vectors, errors


def provided(
    load: Callable[[], Model],
    dimension: int,
    normalize: bool = True,
    call_rows: int = CALL_ROWS,
    call_chars: int = CALL_CHARS,
) -> Embedder:
    """An embedder that runs a user's model in the tasks.

    `load` is called once per task and returns a function from a list of texts to one vector (or
    None) each; it gets `call_rows` texts and `call_chars` characters at most, more only for one
    longer text. The table may have any columns; those called embedding and embed_error are
    replaced. A null or empty text, an exception, and a vector that is missing, of another
    length, not finite or zero make that row's embed_error, never a failed job.
    """

    def embed(texts: DataFrame) -> DataFrame:
        texts = texts.drop("embedding", "embed_error")
        out = T.StructType(
            [
                *texts.schema.fields,
                T.StructField("embedding", T.ArrayType(T.FloatType())),
                T.StructField("embed_error", T.StringType()),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                # Few rows at a time: their vectors take rows times dimension.
                for start in range(0, batch.num_rows, call_rows):
                    rows = batch.slice(start, call_rows)
                    if model is None:
                        model = load()
                    vectors, errors = embed_column(
                        rows.column("text").to_pylist(), model, dimension, normalize, call_rows, call_chars
                    )
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                        names=[*rows.schema.names, "embedding", "embed_error"],
                    )

        return texts.mapInArrow(run, out)

    return embed


def joined(vectors: DataFrame, key: str, dimension: int) -> Embedder:
    """An embedder that takes the vectors from a table (key, embedding) with one row per key; of
    a key's several rows the one with the greatest vector counts.

    A row whose key has no vector, or one that is null, of another length, not finite or zero,
    gets an error in its place.
    """

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def embed(texts: DataFrame) -> DataFrame:
        texts = texts.drop("embedding", "embed_error")
        one = vectors.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(
            F.max("embedding").alias("embedding"), F.lit(True).alias("__known")
        )
        vector = F.col("embedding")
        error = (
            F.when(F.coalesce(F.col("text"), F.lit("")) == "", EMPTY_TEXT)
            .when(F.col("__known").isNull() | vector.isNull(), f"no vector for this {key}")
            .when(F.size(vector) != dimension, f"embedding must have {dimension} dimensions")
            .when(~F.forall(vector, finite), "embedding holds numbers that are not finite")
            .when(F.forall(vector, lambda x: x == 0), "embedding is all zeros")
        )
        return (
            texts.join(one, key, "left")
            .withColumn("embed_error", error)
            .withColumn("embedding", F.when(F.col("embed_error").isNull(), vector.cast("array<float>")))
            .select(*texts.columns, "embedding", "embed_error")
        )

    return embed
