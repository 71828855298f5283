import collections
import math

import hashlib

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from engram.operators import chats, skew
from engram.plans import memorize, search

CHATS = [
    (1, 0, "user", "How do I pool database connections? Thanks."),
    (1, 1, "assistant", "Use a pool. The pool keeps database connections open!\nClose it later."),
    (1, 2, "user", "Great."),
    (2, 0, "user", "Vector search with cosine distance"),
    (2, 1, "assistant", "Create an index on the vector column. Is it the same?"),
    (3, 0, "user", "... !!"),
    (3, 1, "assistant", "the and of"),
]


@pytest.fixture()
def conversations(spark):
    return spark.createDataFrame(
        CHATS, "conv_id long, turn long, role string, text string"
    ).repartition(3)


def test_chat_logs_and_text(conversations):
    logs = {r.conv_id: r for r in chats.chat_logs(conversations).collect()}
    assert logs[1].n_turns == 3 and logs[1].part == 0
    assert logs[1].chat_log[0] == "user: How do I pool database connections? Thanks."
    text = {r.conv_id: r.chat_text for r in chats.chat_text(chats.chat_logs(conversations)).collect()}
    assert text[2] == (
        "user: Vector search with cosine distance\n"
        "assistant: Create an index on the vector column. Is it the same?"
    )


def test_parts_count_turns_and_not_their_numbers(spark):
    rows = [(1, t * 10_000, "user", f"t{t}") for t in range(5)] + [(2, 7, "user", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chats.chat_logs(turns).orderBy("conv_id").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in whole] == [(1, 0, 5), (2, 0, 1)]
    parts = chats.chat_logs(turns, turns_per_part=2).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.chat_log) for r in parts] == [
        (1, 0, ["user: t0", "user: t1"]), (1, 1, ["user: t2", "user: t3"]), (1, 2, ["user: t4"]), (2, 0, ["user: only"])]


def test_long_conversations_continue_in_parts(conversations):
    logs = chats.chat_logs(conversations, turns_per_part=2).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in logs] == [
        (1, 0, 2), (1, 1, 1), (2, 0, 2), (3, 0, 2)
    ]
    whole = [line for r in logs if r.conv_id == 1 for line in r.chat_log]
    assert len(whole) == 3 and whole[2] == "user: Great."


def test_opening_text(conversations):
    got = {r.conv_id: r.text for r in chats.opening_text(conversations, 1).collect()}
    assert got[1] == "user: How do I pool database connections? Thanks."


def test_sentences(spark):
    text = F.lit("One.  Two?! Three\nFour...\n\n")
    got = spark.range(1).select(chats.sentences_of(text).alias("s")).first().s
    assert got == ["One.", "Two?!", "Three", "Four..."]


def brute_scores():
    """(conv_id, turn, sentence_no) -> score, with the terms of these texts spelt out."""
    sentences = {
        (1, 0, 0): ["pool", "database", "connections"],
        (1, 0, 1): ["thank"],
        (1, 1, 0): ["use", "pool"],
        (1, 1, 1): ["pool", "keep", "database", "connections", "open"],
        (1, 1, 2): ["close", "later"],
        (1, 2, 0): ["great"],
        (2, 0, 0): ["vector", "search", "cosine", "distance"],
        (2, 1, 0): ["create", "index", "vector", "column"],
    }
    df = collections.defaultdict(set)
    for key, terms in sentences.items():
        for t in terms:
            df[t].add(key[0])
    return {
        key: round(
            sum(math.log(4 / (1 + len(df[t]))) for t in terms) / math.sqrt(len(terms)), 6
        )
        for key, terms in sentences.items()
    }


@pytest.mark.parametrize("hot_keys", [10_000, 2, 0])
def test_sentence_ranking_equals_brute_force(conversations, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    got = {
        (r.conv_id, r.turn, r.sentence_no): (r.place, r.score)
        for r in chats.rank_sentences(conversations, 2).collect()
    }
    want = brute_scores()
    for conv in (1, 2):
        best = sorted(
            (k for k in want if k[0] == conv), key=lambda k: (-want[k], k[1], k[2])
        )[:2]
        mine = sorted((k for k in got if k[0] == conv), key=lambda k: got[k][0])
        # "same" is a stop word, so the last sentence of chat 2 has no terms at all.
        assert mine == best
        assert [got[k][1] for k in mine] == pytest.approx([want[k] for k in best])


def test_summaries(conversations):
    got = {r.conv_id: r for r in chats.summarize_chats(conversations, 2).collect()}
    assert got[1].summary.startswith("How do I pool database connections?")
    assert "The pool keeps database connections open!" in got[1].summary
    assert len(got[1].heading.split()) <= 10
    assert got[3].heading == "Developer Chat Summary" and "2 messages" in got[3].summary


def test_embedding_equals_brute_force(spark):
    texts = ["alpha beta beta", "beta gamma", "alpha alpha delta", "", None, " ?! "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dim = 32
    model = chats.fit_embedder(frame, dim)
    got = {r.id: r for r in chats.embed_texts(frame, model).collect()}
    tokens = [(t or "").lower().split() if (t or "").strip(" ?!") else [] for t in texts]
    tf = np.zeros((len(texts), dim))
    for i, ts in enumerate(tokens):
        for t in ts:
            tf[i, int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
    idf = np.log((len(texts) + 1) / ((tf > 0).sum(axis=0) + 1)) + 1
    weighted = tf * idf
    for i in (0, 1, 2):
        want = weighted[i] / np.linalg.norm(weighted[i])
        assert got[i].embedding == pytest.approx(want.tolist(), abs=1e-6)
        assert got[i].embed_error is None
    for i in (3, 4):
        assert got[i].embedding is None and "required" in got[i].embed_error
    assert got[5].embedding is None and got[5].embed_error == "text has no weighted terms"


def test_memorize_and_ingest(spark, conversations):
    done = {r.conv_id: r for r in memorize.memorize_chats(conversations, "2024-03-01", 64).collect()}
    assert done[1].store_done and len(done[1].embedding) == 64 and done[1].source == "chat"
    again = memorize.memorize_chats(conversations, "2024-03-01", 64).collect()
    assert {r.id for r in again} == {r.id for r in done.values()}

    stored = memorize.ingest_conversations(
        conversations,
        "2024-03-01",
        tags=spark.createDataFrame([(1, "x"), (1, "x"), (9, "y")], "conv_id long, tag string"),
        metadata=spark.createDataFrame(
            [(2, "k", '"v"')], "conv_id long, key string, value string"
        ),
        dimension=64,
    )
    assert [(r.memory_id, r.tag) for r in stored.tags.collect()] == [(done[1].id, "x")]
    assert [(r.memory_id, r.key) for r in stored.metadata.collect()] == [(done[2].id, "k")]
    assert stored.memories.count() == 3 and stored.rejected.count() == 0


def test_failed_step_stops_the_row(spark, conversations):
    # A model that gives no weight to anything: every embedding fails, nothing is stored.
    nothing = ElementwiseProduct(scalingVec=Vectors.dense([0.0]), inputCol="tf", outputCol="unit")
    model = PipelineModel([chats.hashing_embedder(1).stages[0], nothing])
    rows = memorize.memorize_chats(conversations, "2024-03-01", 1, model).collect()
    assert all(r.summarize_done and not r.embed_done and not r.store_done for r in rows)
    assert {r.error for r in rows} == {"text has no weighted terms"}
    assert {r.store_error for r in rows} == {None}


def test_context_of_a_context_table_and_summary_only(spark, conversations):
    contexts = spark.createDataFrame([(1, "work")], "conv_id long, context string")
    rows = {
        r.conv_id: r
        for r in memorize.memorize_chats(
            conversations, "2024-03-01", 64, contexts=contexts, embed_heading=False
        ).collect()
    }
    assert rows[1].context == "work" and rows[2].context is None
    assert all(r.store_done for r in rows.values())


def test_requests_by_text_find_the_memory_of_the_chat(spark, conversations):
    texts = conversations.selectExpr("concat(role, ' ', text) AS text")
    model = chats.fit_embedder(texts, 256)
    stored = memorize.ingest_conversations(
        conversations, "2024-03-01", dimension=256, model=model
    ).memories
    assert stored.columns[:4] == ["id", "heading", "summary", "embedding"]
    requests = spark.createDataFrame(
        [(1, "pool database connections"), (2, "cosine vector"), (3, "zzz qqq"), (4, "")],
        "query_id long, query string",
    )
    got = {}
    for r in search.fetch_context(stored, requests, 256, model=model).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.heading, r.search_type_used))
    assert "pool" in min(got[1])[1] and "Vector" in min(got[2])[1]
    assert {h[2] for h in got[1]} == {"semantic"} and {h[2] for h in got[4]} == {"recent"}
    late = search.fetch_context(
        stored, requests, 256, date_filter="2024-03-02", model=model
    )
    assert late.count() == 0
    similar = memorize.similar_memories(conversations, stored, model, 256).collect()
    assert {r.query_id for r in similar if r["rank"] == 1} >= {1, 2}


def test_ingested_metadata_is_found_again(spark):
    from engram.operators import filters
    from engram.plans import memorize

    turns = spark.createDataFrame(
        [(1, 0, "user", "How do bees fly?"), (1, 1, "assistant", "Bees beat their wings fast."),
         (2, 0, "user", "What is rust?"), (2, 1, "assistant", "Rust is iron oxide, a red crust.")],
        "conv_id long, turn long, role string, text string",
    )
    notes = spark.createDataFrame(
        [(1, "project", "Alpha"), (1, "project", "Aleph"), (2, "project", "Beta")],
        "conv_id long, key string, value string",
    )
    done = memorize.ingest_conversations(turns, "2024-03-01", metadata=notes)
    assert done.metadata.count() == 2
    assert filters.by_project(done.memories, done.metadata, "Alpha").count() == 1
    assert filters.by_project(done.memories, done.metadata, "Aleph").count() == 0


def test_vectors_of_different_ingests_compare(spark):
    turn = "conv_id long, turn long, role string, text string"
    one = spark.createDataFrame([(1, 0, "user", "How do bees fly over the garden wall?")], turn)
    more = one.union(spark.createDataFrame([(2, 0, "user", "Bees fly. Wasps fly too.")], turn))
    alone = memorize.ingest_conversations(one, "2024-03-01")
    assert alone.memories.count() == 1 and alone.rejected.count() == 0
    first = alone.memories.first()
    again = {r.id: r.embedding for r in memorize.ingest_conversations(more, "2024-03-02").memories.collect()}
    assert len(again) == 2 and again[first.id] == first.embedding


def test_fitted_model_is_saved_and_loaded(spark, tmp_path):
    texts = spark.createDataFrame([("alpha beta",), ("beta gamma",)], "text string")
    model = chats.fit_embedder(texts, 32)
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    want = [r.embedding for r in chats.embed_texts(texts, model).collect()]
    assert [r.embedding for r in chats.embed_texts(texts, loaded).collect()] == want
    stop = spark.createDataFrame([("the of and",)], "text string")
    assert chats.embed_texts(stop, loaded).first().embed_error is None
