"""Nearest neighbours, spelling variants and ranked search against plain versions."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from engram.llm import lexical, neighbours, variants
from engram.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<float>, score string, table int"


def cosines(rows, query):
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in rows.items()}
    return sorted(((-float(unit[i] @ unit[query]), i) for i in rows if i != query))


def random_vectors(n, size, seed=3):
    rng = np.random.default_rng(seed)
    return {i: [float(x) for x in rng.normal(size=size).astype(np.float32)] for i in range(n)}


def test_nearest_recall_on_given_vectors(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    table = pq.read_table(f"{SF_DIR}/embeddings.parquet")
    rows = dict(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    got = defaultdict(list)
    for r in sorted(QUERIES["op11_nearest_neighbours"](spark, SF_DIR).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    found = 0
    assert set(got) == {i for i in rows if i % 50 == 0}
    for query, hits in got.items():
        close = cosines(rows, query)
        exact = {i: -s for s, i in close}
        assert [h[0] for h in hits] == [1, 2, 3, 4, 5]
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in hits)
        found += len({i for _, i in close[:5]} & {i for _, i, _ in hits})
    assert found >= 0.9 * 5 * len(got)


def test_nearest_with_two_turns_and_hot_copies(spark, monkeypatch):
    """A third of all rows are copies, cut into blocks; ties go to the lower ids."""
    monkeypatch.setattr(neighbours, "GROUP", 100)
    rows = random_vectors(1500, 63)
    rows.update({i: rows[7] for i in range(2000, 2700)})
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows.items()], VECTORS).repartition(5)
    asked = table.where("vec_id % 50 = 0 or vec_id = 7")
    whole = neighbours.in_blocks
    monkeypatch.setattr(neighbours, "in_blocks", lambda *args: whole(*args, 150, 20))
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(table, asked).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert got[7] == [2000, 2001, 2002, 2003, 2004] and got[2050] == [7, 2000, 2001, 2002, 2003]
    hits = sum(len({i for _, i in cosines(rows, q)[:5]} & set(found)) for q, found in got.items() if q < 1500 and q != 7)
    assert hits >= 0.9 * 5 * 30 and all(len(found) == 5 for found in got.values())


def test_nearest_on_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
           (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, []), (1, [1.0, 0.0]), (50, [1e30, 1e30])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in odd], VECTORS)
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(table, table).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    half = round(math.sqrt(0.5), 9)
    assert dict(got) == {
        1: [(2, 1.0), (3, half), (50, half)], 2: [(1, 1.0), (3, half), (50, half)],
        3: [(50, 1.0), (1, half), (2, half)], 50: [(3, 1.0), (1, half), (2, half)],
    }
    assert neighbours.nearest(table.limit(0), table.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.nearest(table.limit(0), table).count() == 0 and neighbours.nearest(table, table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id = 50"), table).where("query_id = 50").count() == 0


def test_probe_ranks_agree_with_the_probes():
    rows = np.random.default_rng(5).normal(size=(40, 12))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for turns in (1, 2):
        aim = neighbours.cells(rows[::-1], 3, turns)
        rank = neighbours.rank_of(rows, aim, 3, turns)
        assert (neighbours.rank_of(rows, neighbours.cells(rows, 3, turns), 3, turns) == 1).all()
        for r in range(len(rows)):
            some = neighbours.probe_order(rows[r : r + 1], 3, turns, int(rank[r]))[0]
            assert aim[r] in some and len(set(some.tolist())) == len(some) == rank[r]


def misspelt(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randrange(6, 14))) for _ in range(30)] + ["ab" * 40]
    out = []
    for i in range(n):
        text = []
        for _ in range(40):
            w = rng.choice(base[: 1 + int(30 * rng.random() ** 3)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "e", "é", "Z"]) + w[k + rng.randrange(2) :]
            text.append(w)
        out.append((i if i % 9 else None, rng.choice([" ", "1", "\n", "÷", "-"]).join(text)))
    return [*out, out[0], out[0], (5, None), (6, ""), (7, "ab" * 60_000 + "c" + " " + "ab" * 60_000), (7, "ab" * 60_000 + " aaaaaaa")]


@pytest.mark.parametrize("most", [20_000, 5])
def test_variants_equal_brute_force(spark, monkeypatch, most):
    """With small lists every crowded one is cut further, down to windows of one place."""
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "ROWS", 50)
    rows = misspelt(120, 11)[: -2 if most < 100 else None]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs).collect()}
    want = brute.spelling_variants(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 50
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_variants_follow_forms_to_the_last(spark):
    names = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"]
    text = " ".join(w for i, w in enumerate(names) for _ in range(3 * 12**i))
    rows = [(d, text) for d in range(1)]
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {w: r.root for w, r in got.items()} == {w: v[1] for w, v in brute.spelling_variants(rows).items()}
    assert got[names[0]].root == names[3] and got[names[0]].form == names[1]


def test_variants_on_given_texts(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    table = pq.read_table(f"{SF_DIR}/documents.parquet").to_pydict()
    want = brute.spelling_variants(zip(table["doc_id"], table["text"]))
    got = QUERIES["op12_spelling_variants"](spark, SF_DIR).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)


def ranked(docs, items, limit):
    """Scores of every row of docs for every item, the plain way."""
    fold = {c: c + 32 for c in range(65, 91)}
    split = [TERM.findall((t or "").translate(fold)) for _, t in docs]
    n, total = sum(bool(t) for t in split), sum(map(len, split))
    df = Counter(w for t in split for w in set(t))
    out = []
    for item_id, text in items:
        terms = set(TERM.findall((text or "").translate(fold)))
        scores = []
        for (doc_id, _), t in zip(docs, split):
            m = 10 + (90 * len(t) * n) // total if total else 0
            tf = Counter(w for w in t if w in terms)
            score = sum(int(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * k // (1000 * k + 8 * m)) for w, k in tf.items())
            if score:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:limit])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tree,passes", [(1_000_000, 1_000_000), (300, 1_000_000), (300, 12)])
def test_search_equals_brute_force(spark, monkeypatch, tree, passes):
    """Also with trees of a few documents, and with items in several passes."""
    monkeypatch.setattr(lexical, "TREE_TERMS", tree)
    monkeypatch.setattr(lexical, "PASS_TERMS", passes)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ab", "Ünit", "日本"]
    text = lambda n: " ".join(vocab[int(len(vocab) * rng.random() ** 2)] for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ?! "), (None, docs[3][1]), docs[3], docs[3], (203, text(5000)), *[(300 + i, docs[9][1]) for i in range(60)]]
    items = [(i, text(8).upper()) for i in range(9)] + [(20, None), (21, "..."), (22, "nowhere"), (23, docs[9][1]), (None, "w1 w2 ab"), (5, "日本 É w3")]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score long, place long").repartition(3)
    got = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 10)


def test_search_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs.where("doc_id = 1").select(docs.doc_id.alias("doc_id"), docs.text.substr(1, 0).alias("text")), items).count() == 0


def test_search_leaves_out_subtrees(spark):
    """Most leaves are not read for an item whose terms are rare."""
    rng = random.Random(4)
    paths = sorted(np.unique(np.array([rng.randrange(200) for _ in range(6)])).tolist() for _ in range(2000))
    tree = lexical.tree_of([np.array(p) for p in paths], [np.ones(len(p), np.uint32) for p in paths], np.full(2000, 100))
    weights = np.zeros(201, np.int64)
    weights[[3, 4, 9]] = 5000
    best = []
    read = lexical.walk(tree, np.array([3, 4, 9]), weights, np.arange(2000), best, 10)
    leaves = sum(not len(c) for c in tree.children)
    want = sorted((-sum(5000 * int(lexical.part(np.array([1]), np.array([100]))[0]) for t in p if t in (3, 4, 9)), i) for i, p in enumerate(paths))
    assert read < leaves / 5 and sorted((-s, -i) for s, i in best) == want[:10]
