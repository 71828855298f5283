import collections
import re

import pytest
from pyspark.sql import functions as F

from engram.functions import summaries
from engram.functions import text as tx
from engram.operators import fulltext, fuzzy, skew

AT = "2024-01-0%d 00:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def memories(spark, rows):
    frame = spark.createDataFrame(
        rows, "id long, heading string, summary string, context string, created string"
    )
    return frame.withColumn("created_at", F.to_timestamp("created")).drop("created")


BOOKS = [
    (1, "Database pooling", "Connection pools for the database", "python", AT % 1),
    (2, "Vectors", "A database of vectors and pooled connections", None, AT % 2),
    (3, "Pooling database", "Nothing else", "python", AT % 3),
    (4, "The and of", "is it", "", AT % 4),
    (5, "Vectors", "Databases databases", None, AT % 5),
]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("caress", "caress"), ("cats", "cat"),
        ("feed", "feed"), ("agreed", "agree"), ("plastered", "plaster"), ("bled", "bled"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflate"),
        ("troubled", "trouble"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"),
        ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("happy", "happi"),
        ("sky", "sky"), ("as", "as"), ("ay", "ay"), ("pools", "pool"), ("pooling", "pool"),
        ("", ""), ("naïves", "naïve"),
    ],
)
def test_stem(spark, word, stem):
    assert one(spark, tx.stem(F.lit(word))) == stem


def test_words_and_terms(spark):
    text = F.lit("  The café's 2 Tables, tables—and the CHAIRS! ")
    assert one(spark, tx.words(text)) == [
        "the", "café", "s", "2", "tables", "tables", "and", "the", "chairs"
    ]
    assert one(spark, tx.terms(text)) == ["café", "2", "tabl" + "e", "table", "chair"]
    assert one(spark, tx.query_terms(text)) == ["2", "café", "chair", "table"]
    assert one(spark, tx.query_terms(F.lit("the and of"))) == []


def test_weighted_terms(spark):
    got = {
        (r.id, r.term): (r.tf_a, r.tf_b, r.tf_c)
        for r in fulltext.weighted_terms(memories(spark, BOOKS)).collect()
    }
    assert got[(1, "database")] == (1, 1, 0)
    assert got[(1, "pool")] == (1, 1, 0)
    assert got[(1, "python")] == (0, 0, 1)
    assert got[(5, "database")] == (0, 2, 0)
    assert not [k for k in got if k[0] == 4]


def test_search_needs_all_terms_and_ranks_by_field(spark):
    got = fulltext.search_text(memories(spark, BOOKS), "the pooled DATABASES").collect()
    ranks = {r.id: r.rank for r in got}
    assert ranks == {
        1: pytest.approx(1.4), 2: pytest.approx(0.4), 3: pytest.approx(1.0)
    }


def test_search_order_is_rank_then_recency(spark):
    rows = memories(spark, BOOKS)
    got = fulltext.search_text(rows, "vectors", limit=1).collect()
    assert [r.id for r in got] == [2]  # heading and summary beat heading alone
    rows = memories(spark, [(1, "x", "pool", "", AT % 1), (2, "y", "pool", "", AT % 2)])
    assert [r.id for r in fulltext.search_text(rows, "pool", limit=1).collect()] == [2]


@pytest.mark.parametrize("query", ["", "the and of", "--"])
def test_query_without_terms_matches_nothing(spark, query):
    assert fulltext.search_text(memories(spark, BOOKS), query).count() == 0


@pytest.mark.parametrize("query", ["the pooled DATABASES", "vectors", "unknown", "the"])
def test_stored_text_index_gives_the_same_answer(spark, tmp_path, query):
    rows, path = memories(spark, BOOKS), str(tmp_path / "index")
    fulltext.build_index(rows, path)
    got = fulltext.search_text(rows, query, index=spark.read.parquet(path)).collect()
    assert sorted(got) == sorted(fulltext.search_text(rows, query).collect())


@pytest.mark.parametrize("query", ["databse poling", "vectrs", "", "nothing else"])
@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.3, 1.0])
def test_stored_gram_index_gives_the_same_answer(spark, tmp_path, query, threshold):
    rows, path = memories(spark, BOOKS), str(tmp_path / "index")
    fuzzy.build_index(rows, path)
    index = spark.read.parquet(path)
    got = fuzzy.search_index(index, rows, query, 50, threshold).collect()
    want = fuzzy.trigram_search(rows, query, 50, threshold).collect()
    # At threshold 0 the scan also returns texts that share nothing, the index cannot.
    assert sorted(got) == sorted(r for r in want if r.similarity > 0)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_batch_equals_single_queries(spark, monkeypatch, bound):
    monkeypatch.setattr(fulltext, "MAX_BROADCAST_TERMS", bound)
    rows = memories(spark, BOOKS)
    texts = ["pooled databases", "Database pool", "vectors", "the", "unknown vectors", "python"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = collections.defaultdict(list)
    for r in fulltext.search_text_batch(rows, queries, limit=2).collect():
        got[r.query_id].append((r.place, r.id, r.rank))
    for i, text in enumerate(texts):
        single = fulltext.search_text(rows, text, limit=2).collect()
        single.sort(key=lambda r: (-r.rank, -r.created_at.timestamp(), r.id))
        assert sorted(got[i]) == [(n, r.id, r.rank) for n, r in enumerate(single, 1)]
    # Two queries with the same terms are answered once, under the lower id.
    pairs = {(r.query_id, r.id) for r in fulltext.match_all(rows, queries).collect()}
    assert {q for q, _ in pairs} == {0, 2, 5}


def python_grams(text):
    grams = set()
    for word in re.split(r"[^\w]+|_", text.lower()):
        padded = f"  {word} "
        if word:
            grams |= {padded[i : i + 3] for i in range(len(word) + 1)}
    return grams


@pytest.mark.parametrize(
    "text", ["word", "a", "", "Two Words", "a b ab", " lead, trail. ", "été naïve 12"]
)
def test_trigrams(spark, text):
    got = one(spark, tx.trigrams(F.lit(text)))
    assert len(got) == len(set(got)) and set(got) == python_grams(text)


def test_trigram_similarity_and_search(spark):
    rows = memories(spark, BOOKS)
    a, b = python_grams("Database pooling"), python_grams("databse poling")
    share = len(a & b) / len(a | b)
    got = fuzzy.trigram_search(rows, "databse poling", threshold=0.3).collect()
    assert {r.id for r in got} == {1, 3}
    assert got[0].similarity == pytest.approx(share, abs=1e-6)
    empty = tx.trigram_similarity(tx.trigrams(F.lit("")), tx.trigrams(F.lit("")))
    assert one(spark, empty) == 0.0


@pytest.mark.parametrize(
    "response, heading, summary",
    [
        ("Heading: A title\nSummary:\nfirst\n\n second ", "A title", "first\nsecond"),
        ("1. Heading: T\n2. Summary: dropped\nkept", "T", "kept"),
        ("heading:\n\n Later line\nmore\nSUMMARY:\nx", "Later line", "x"),
        ("no parts at all", "Technical Discussion Summary", "no parts at all"),
        ("Summary:\nonly", "Technical Discussion Summary", "only"),
        ("Heading: x\nSummary: inline only", "x", "Heading: x\nSummary: inline only"),
        ("Heading: one\nHeading: two\nSummary:\ns", "two", "s"),
        ("Summary:\na\nHeading: h\nunder heading\nSummary:\nb", "h", "a\nb"),
        ("  \n Heading: a: b\n\tSummary:\n\tz\n", "a: b", "z"),
        ("", "Technical Discussion Summary", ""),
    ],
)
def test_parse_summary(spark, response, heading, summary):
    got = one(spark, summaries.parse_summary(F.lit(response)))
    assert (got.heading, got.summary) == (heading, summary)


def test_prompt_and_fallback(spark):
    got = one(spark, summaries.build_prompt(F.lit("ctx"), F.lit("user: hi")))
    assert "Context: ctx\n" in got and "Chat Log:\nuser: hi\n" in got
    assert "Context: \n" in one(
        spark, summaries.build_prompt(F.lit(None).cast("string"), F.lit(""))
    )
    got = one(spark, summaries.fallback_summary(F.lit(7)))
    assert got.heading == "Developer Chat Summary" and "7 messages" in got.summary


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(300).select(
        "id", F.when(F.col("id") < 100, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k")
    )
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> '3'")
    plain = rows.join(lookup, "k").select("id", "k", "n").collect()
    salted = skew.salted_join(rows, lookup, ["k"], ["id"])
    assert sorted(salted.select("id", "k", "n").collect()) == sorted(plain)
    semi = skew.salted_join(rows, lookup.select("k"), ["k"], ["id"], "left_semi")
    assert semi.count() == len(plain)
    assert [r.k for r in skew.hottest(lookup, "k", "n").limit(1).collect()] == ["hot"]


@pytest.mark.parametrize("module", [fulltext, fuzzy])
def test_an_index_is_built_in_parts_of_bounded_text(spark, tmp_path, monkeypatch, module):
    """The parts follow the text, not the session's number of shuffle partitions."""
    text = "".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + "x " for i in range(300))
    rows = memories(spark, [(i, "heading %d" % i, text, "c", AT % 1) for i in range(40)])
    files = {}
    for chars in (1_000_000, 500):
        monkeypatch.setattr(skew, "CHARS_A_PART", chars)
        path = str(tmp_path / f"index-{chars}")
        module.build_index(rows, path)
        index = spark.read.parquet(path)
        files[chars] = len(index.inputFiles())
        found = sorted(map(tuple, index.select(sorted(index.columns)).collect()))
        files[chars, "rows"] = found
    assert files[500] > 2 * spark.sparkContext.defaultParallelism >= files[1_000_000]
    assert files[500, "rows"] == files[1_000_000, "rows"]
