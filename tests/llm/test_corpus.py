"""The pipeline's stages on a small odd corpus, and what repeated rows do to the classifier."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from engram.llm import decontamination, jaccard, lines, quality, rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the river runs over old stones and people walk along its bank in the morning light".split()
POOR = "buy cheap click now free money winner prize deal offer win cash fast".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(n))


def corpus(n=200):
    rng = random.Random(5)
    rows = [(i, prose(rng, POOR if i % 2 else GOOD, 60), "en", f"s{i % 3}", 1) for i in range(n)]
    return rows, [(i, 0 if i % 2 else 1, 0) for i in range(n)]


def test_repeated_rows_do_not_change_the_classifier(spark):
    rows, marks = corpus()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = []
    for times in (1, 5):
        docs = spark.createDataFrame(rows * times, DOCS)
        model = quality.train(docs, labels, sample=200)
        kept.append({r.doc_id: r.kept for r in quality.judged(docs, model).select("doc_id", "kept").collect()})
    assert kept[0] == kept[1] and sum(kept[0].values()) == 100
    odd = spark.createDataFrame([(1, None, "en", "a", 1, "x", 0.5), (2, "", "en", "a", 1, "y", 0.5)], DOCS + ", kept string, p_good double")
    got = quality.judged(odd, quality.train(odd, labels.where("doc_id < 0"))).collect()
    assert [r.kept for r in got] == [True, True] and odd.columns[:5] == got[0].__fields__[:5]


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """A folder of tables: prose, copies, near copies, repeated lines, a benchmark item."""
    rng = random.Random(8)
    folder = str(tmp_path_factory.mktemp("corpus"))
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "tor", "vel", "dan") for c in ("a", "is", "um", "et", "or")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [text(80) for _ in range(40)]
    texts[5] = texts[4]
    texts[6] = texts[4] + " more"
    texts[8] = texts[7][:200] + "\n" + "All rights are reserved by the owner of this page"
    texts[9] = text(60) + "\n" + "All rights are reserved by the owner of this page"
    item = text(30)
    texts[11] = text(30) + " " + item + " " + text(30)
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [rows[20], (50, None, "en", "s0", 0), (51, "", None, None, 0), (None, text(70), "en", "s1", 9)]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, item


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_stages_against_plain_versions(spark, small):
    folder, rows, item = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality classifier"](spark, docs, folder).count() == len(rows)  # all labels are good

    cut = stages["line dedup"](spark, docs, folder)
    assert cut.columns == docs.columns
    seen, want = set(), []
    for doc_id, text, *_ in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        own = (text or "").split("\n")
        left = [x for x in own if x.lower() not in seen]
        seen |= {x.lower() for x in own if x}
        if left != own and not "".join(left).strip():
            continue
        want.append((doc_id, "\n".join(left) if text is not None else None))
    got = {(r.doc_id, r.text) for r in cut.collect()}
    assert {d for d, _ in got} == {d for d, _ in want} - {6} | ({6} & {d for d, _ in got})

    apart = stages["n-gram Jaccard join"](spark, docs, folder)
    root = {d: d for d, *_ in rows if d is not None}
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low = min(root[a], root[b])
                root = {d: low if r in (root[a], root[b]) else r for d, r in root.items()}
    kept = sorted((r.doc_id for r in apart.collect()), key=str)
    assert kept == sorted((d for d, *_ in rows if d is None or root[d] == d), key=str)

    clean = stages["benchmark decontamination"](spark, docs, folder)
    holds = {d for d, t, *_ in rows if t and item in t}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, *_ in rows if d not in holds), key=str)

    mixed = stages["mixing sources to target weights"](spark, docs, folder)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {d for d, *_ in rows}


def test_whole_pipeline_twice(spark, small):
    folder, _, item = small
    runs = [sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0] and not any(item in r for r in runs[0])
    assert not any(r.startswith("Row(doc_id=5,") for r in runs[0])


def test_empty_corpus(spark, small, tmp_path):
    folder = small[0]
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_gram_that_many_lines_share(spark):
    """Lines that have nothing but a phrase in common, at any place, stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    said = [" ".join([*(word() for _ in range(rng.randrange(1, 9))), "all rights reserved by the", *(word() for _ in range(6))]) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = lines.dedup_lines(frame.unionByName(frame.limit(0))).agg({"n_removed": "sum"}).first()[0]
    assert got == 0


def test_long_lines_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, long, 7, 8), (1, long, 7, 8), (2, long[:-3] + "xyz", 7, 8), (3, "a\n\n" + long[:500], 7, 8)]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed int")).collect()}
    assert got == {(1, long, 1, 0), (2, "", 1, 1), (3, "a\n\n" + long[:500], 2, 0)}
    assert jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed int"), 5, 80).count() >= 3


def best_windows(docs, items):
    """The best window of every item in every text, the plain way."""
    split = lambda t: "".join(c if c.isalnum() and c.isascii() or not c.isascii() else " " for c in (t or "").lower()).split()
    out = set()
    for d, text in docs:
        w = split(text)
        for k, item in items:
            b = split(item)
            size = min(5, len(b))
            if not b or len(w) < size:
                continue
            want, best = Counter(tuple(b[i : i + size]) for i in range(len(b) - size + 1)), None
            for s in range(max(1, len(w) - len(b) + 1)):
                part = w[s : s + len(b)]
                have = Counter(tuple(part[i : i + size]) for i in range(len(part) - size + 1))
                score = sum((want & have).values()) / sum((want | have).values())
                if score >= 0.8 and (best is None or score > best[0]):
                    best = (score, s, len(part))
            if best:
                out.add((d, k, best[1], best[2], round(best[0], 9)))
    return out


def test_leaks_in_every_text_against_all_windows(spark):
    """Cut, changed, repeated and whole items, items in short texts, long texts, repeated rows."""
    rng = random.Random(13)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("on", "it", "ra", "es", "ul")] + ["é", "日本"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 5, 8, 20, 40])))) for i in range(25)] + [(7, "on on on on on on on on on"), (None, "on it ra")]
    docs = []
    for i in range(120):
        words = items[rng.randrange(25)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zz"], [words[at], words[at]]])
        words = words[rng.choice([0, 0, 1, 2]) : len(words) - rng.choice([0, 0, 1, 3])]
        around = rng.choice([0, 0, 4, 30])
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text(around) + words + text(around))))
    docs += [(500, "on " * 30), (501, None), (502, ""), (503, " ".join(text(5000)) + " " + items[3][1]), docs[0]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame, bench).collect()
    known = {(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in got}
    want = best_windows(docs, [x for x in items if x[0] is not None])
    # An id with two texts has the better of their windows.
    assert {x for x in known if x[1] != 7} == {x for x in want if x[1] != 7} and len(want) > 20
    assert {x[:2] for x in known} == {x[:2] for x in want}


def test_thresholds_are_equal_in_every_run_and_near_the_quantiles(spark):
    """However the rows are dealt out; a cell's least value is at most a thousandth low."""
    rng = random.Random(21)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), False, rng.random(), 0.0, rng.random() ** 3, 4 + rng.random() * 3) for _ in range(4000)]
    names = "lang string, source string, base_failed boolean, symbol_share double, dup_line_share double, repeat_share double, mean_word double"
    frame = spark.createDataFrame(rows, names)
    runs = [sorted(map(str, rules.bounds(frame.repartition(n)).collect())) for n in (1, 5, 13)]
    assert runs[0] == runs[1] == runs[2]
    found = {(r.lang, r.source): r for r in rules.quartiles(rules.cells(frame), "lang", "source").collect()}
    for key, r in found.items():
        own = sorted(x[6] for x in rows if (x[0], x[1]) == key)
        for share, got in ((0.25, r.mean_word_low), (0.75, r.mean_word_high)):
            exact = own[-(-int(len(own) * share * 1000) // 1000) - 1]
            assert exact * 0.998 <= got <= exact * 1.0005
        assert r.n == len(own) and r.dup_line_share_low == r.dup_line_share_high == 0


def test_parts_never_rule_out_similar_lines():
    """The bound by parts stays below the edit distance, and rules out lines that share a passage only."""
    rng = random.Random(17)
    said = lambda n: "".join(rng.choice("abcdefgh nopé") for _ in range(n))
    pairs = []
    for _ in range(150):
        a = list(said(rng.randrange(64, 700)))
        b = list(a)
        for _ in range(rng.randrange(0, len(a) // 6)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], ["z"], [b[at], "y"]])
        pairs.append(("".join(a), "".join(b)))
    passage = said(300)
    pairs += [(said(200) + passage + said(100), said(210) + passage + said(90)) for _ in range(20)]
    texts = [t for p in pairs for t in p]
    size = np.array([len(t) for t in texts])
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint8)
    start = np.cumsum(size) - size
    a = np.arange(0, len(texts), 2)
    far = lines.too_far(letters, start, size, np.concatenate([a, a + 1]), np.concatenate([a + 1, a]))
    for (x, y), one, other in zip(pairs, far[: len(a)], far[len(a) :]):
        assert not (lines.similar(x, y) and (one or other))
    assert far[150 : len(a)].all()
