"""Vector functions over ARRAY<FLOAT> columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import SIMILARITY_DECIMALS


def dot(a: Column, b: Column) -> Column:
    """Sum of products in DOUBLE; NULL when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two columns; NULL when either vector is all zeros."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    norm = F.coalesce(F.nullif(l2_norm(v), F.lit(0.0)), F.lit(1.0))
    # The norm is an argument of the zip, so it is computed once per row, not per element.
    return F.zip_with(
        v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n
    )


def vector_dim(v: Column) -> Column:
    return F.size(v).cast("long")


def pad_vector(v: Column, dimension: int) -> Column:
    """Append zeros up to `dimension`; longer vectors stay as they are."""
    missing = F.greatest(F.lit(dimension) - F.size(v), F.lit(0))
    return F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), missing))


def zero_vector(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimension)


def unit_rows(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit-length rows of the usable vectors of an Arrow list column.

    Missing, wrongly sized, all-zero and non-finite vectors are left out, so that
    they can never match anything.
    """
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False)
    positions = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    flat = vectors.filter(sized).flatten().to_numpy(zero_copy_only=False)
    rows = flat.astype(np.float64).reshape(-1, dimension)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    usable = np.isfinite(norms) & (norms > 0)
    return positions[usable], rows[usable] / norms[usable, None]


def similarity_to(embedding: Column | str, query: Sequence[float]) -> Column:
    """Cosine of every row with one query vector, an Arrow batch at a time."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))
    if not norm > 0:
        return F.lit(None).cast("double")
    unit = q / norm

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        positions, rows = unit_rows(vectors, len(unit))
        out = np.full(len(vectors), np.nan)
        out[positions] = rows @ unit
        return pa.array(out, mask=np.isnan(out))

    # Called non-deterministic so that a later filter on the result does not pull a second
    # copy of the call below itself.
    return score.asNondeterministic()(embedding)


def reported(similarity: Column) -> Column:
    return F.round(similarity, SIMILARITY_DECIMALS)
