"""Chat formatting by prefix-target expansion.

Every turn becomes one segment of a conversation's stream, with its marks; every assistant turn
is an example of its own, whose context is the stream before it and whose reply alone is
trainable. Contexts stand whole in rows of at most CHUNK_CHARS characters before their example. All
are made in one pass over each conversation in order, so a conversation of n turns takes n * n
space, as its examples do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template.
START, MIDDLE, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and of other templates; inside texts they are broken by backslashes,
#: one more than the text itself has there.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
#: Characters of a chunk of a context.
CHUNK_CHARS = 4096
#: Characters of a batch of rows, about.
BATCH_CHARS = 4 << 20
FORMATTED = "conv_id long, role string, segment string, loss_start int, loss_end int, context_chars long, context string, chunk int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one segment per turn, with its loss span in characters."""
    role, text = (escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(START), role, F.lit(MIDDLE)).alias("head"), text.alias("body"),
    )
    spoken = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(STOP)).alias("segment"),
        F.when(spoken, F.length("head")).cast("int").alias("loss_start"),
        F.when(spoken, F.length("head") + F.length("body")).cast("int").alias("loss_end"),
    )


def with_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to the same with the length of what precedes them, those of assistant
    turns after rows with the chunks of the preceding text. The open state is the stream of one
    conversation."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())
    names = [f.split()[0] for f in FORMATTED.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    conv, length, full, last, out, held = object(), 0, [], "", [], 0
    for batch in batches:
        for key, role, segment, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            if key != conv:
                conv, length, full, last = key, 0, [], ""
            chunk = 0
            if role == "assistant":
                for piece in (*full, last) if last else full:
                    out.append((key, None, "", None, None, length, piece, chunk))
                    chunk, held = chunk + 1, held + len(piece)
                    if held >= BATCH_CHARS:
                        yield batch_of(out)
                        out, held = [], 0
            out.append((key, role, segment, start, end, length, None, chunk))
            held += len(segment)
            length, last = length + len(segment), last + segment
            cut = (len(last) - 1) // CHUNK_CHARS * CHUNK_CHARS
            full += [last[i : i + CHUNK_CHARS] for i in range(0, cut, CHUNK_CHARS)]
            last = last[cut:]
            if held >= BATCH_CHARS:
                yield batch_of(out)
                out, held = [], 0
    if out:
        yield batch_of(out)


def expanded(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) to their stream and examples.

    A row per turn: its segment, and context_chars, the length of the stream before it. Rows of
    assistant turns are the examples: the reply lies at loss_start to loss_end of the segment,
    the context is the first context_chars characters of the conversation's stream, which rows
    without a role and with the same conv_id and context_chars hold in `context`, in the order of
    `chunk` (that of the example is their number; its own context is null). Ties of turn are ordered by role and text; a null turn comes
    first, a null role or text is empty, null conv_ids are one conversation; repeated rows are
    repeated turns. Other columns are ignored; an empty table gives an empty one.
    """
    rows = segments(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return rows.mapInArrow(with_contexts, FORMATTED)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (conv_id, role, text, loss text, segment, context, is_chunk) to a digest per
    conversation; only its running hashes are held."""
    conv, state, out = object(), None, []

    def closed():
        n, turns, chars, loss, formatted = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in DIGEST.split(", ")])

    stream, context, size = hashlib.sha256(), hashlib.sha256(), 0
    for batch in batches:
        for key, role, text, loss, segment, piece, is_chunk in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or key != conv:
                if state is not None:
                    out.append(closed())
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                stream, context, size = hashlib.sha256(), hashlib.sha256(), 0
            if piece is not None:
                context.update(piece.encode())
                size += len(piece)
            if is_chunk:
                continue
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                if context.digest() != stream.digest():
                    raise ValueError(f"an example of conversation {key} lacks a part of its context")
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] = size
                context, size = hashlib.sha256(), 0
            stream.update(segment.encode())
            state[4] += len(segment)
        if out:
            yield batch_of(out)
            out = []
    if state is not None:
        yield batch_of([closed()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted rows say: turns from their segments, loss and length from the
    examples, whose contexts must be the turns before them."""
    role = F.expr(f"substring(segment, {len(START)} + 1, instr(segment, '{MIDDLE}') - {len(START)} - 1)")
    body = F.expr(f"substring(segment, instr(segment, '{MIDDLE}') + {len(MIDDLE)}, length(segment) - instr(segment, '{MIDDLE}') - {len(MIDDLE)} - {len(STOP)} + 1)")
    loss = F.expr("substring(segment, loss_start + 1, loss_end - loss_start)")
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "context_chars", "chunk").select(
        "conv_id", unescaped(role).alias("said_by"), unescaped(body).alias("text"), unescaped(loss).alias("loss"),
        "segment", "context", F.col("role").isNull().alias("is_chunk"),
    )
    return rows.mapInArrow(digests, DIGEST)
