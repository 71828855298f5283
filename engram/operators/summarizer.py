"""Summaries from a user's own model, run in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions import summaries
from engram.operators import chats
from engram.operators.embedder import CALL_CHARS, CALL_ROWS, answers_of

Model = Callable[[Sequence[str]], Sequence[str]]
Summarizer = Callable[[DataFrame], DataFrame]


def provided(
    load: Callable[[], Model],
    contexts: DataFrame | None = None,
    call_rows: int = CALL_ROWS,
    call_chars: int = CALL_CHARS,
) -> Summarizer:
    """A summarizer that asks a user's model, in place of `chats.summarize_chats`.

    `load` is called once per task and returns a function from a list of prompts to one answer
    each, which `summaries.parse_summary` reads. contexts: conv_id, context. A conversation whose
    call fails, or gets null or an empty answer, keeps the fallback texts with the error in its
    summary, as the store has always had them; only one without any message has no summary.
    """

    def summarize(conversations: DataFrame) -> DataFrame:
        logs = chats.chat_text(chats.chat_logs(conversations.where("turn is not null")))
        counted = chats.message_counts(conversations)
        if contexts is None:
            logs = logs.withColumn("context", F.lit(None).cast("string"))
        else:
            logs = logs.join(contexts.select("conv_id", "context"), "conv_id", "left")
        prompts = logs.select("conv_id", summaries.build_prompt(F.col("context"), F.col("chat_text")).alias("prompt"))
        out = T.StructType(
            [prompts.schema["conv_id"], T.StructField("response", T.StringType()), T.StructField("failed", T.StringType())]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                for start in range(0, batch.num_rows, call_rows):
                    rows = batch.slice(start, call_rows)
                    model = model or load()
                    answers, errors = answers_of(rows.column("prompt").to_pylist(), model, call_rows, call_chars)
                    for place, answer in enumerate(answers):
                        if errors[place] is None and not (isinstance(answer, str) and answer.strip()):
                            answers[place], errors[place] = None, "the model gave no answer"
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("conv_id"), pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                        names=["conv_id", "response", "failed"],
                    )

        parsed = F.when(F.col("failed").isNull(), summaries.parse_summary(F.col("response")))
        asked = prompts.mapInArrow(run, out).withColumn("parsed", parsed)
        fallback = summaries.fallback_summary(F.col("n_turns"))
        failure = F.concat(fallback["summary"], F.lit(summaries.FAILED_SUMMARY), F.col("failed"))
        some = F.col("n_turns") > 0
        return counted.join(asked, "conv_id", "left").select(
            "conv_id",
            "n_turns",
            F.when(some, F.coalesce("parsed.heading", fallback["heading"])).alias("heading"),
            F.when(some, F.coalesce("parsed.summary", failure)).alias("summary"),
            F.when(~some, summaries.EMPTY_LOG).alias("summarize_error"),
        )

    return summarize
