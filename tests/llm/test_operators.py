"""Known answers, brute force and odd tables for the corpus operators."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck

from engram.llm import chat, decontamination, jaccard, licenses, lines, mixing, quality, rules, substrings, warc, words
from engram.llm.queries import QUERIES
from engram.llm.twins import TWINS
from engram.sources.workspace import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(7)
VOCABULARY = ["alpha", "béta", "gam ma".replace(" ", " "), "delta", "x", "Y", "zeta!", "日本", "eta", "theta", "iota", "kappa"]


def sentence(n):
    return " ".join(RANDOM.choice(VOCABULARY) + str(RANDOM.randrange(40)) for _ in range(n))


def corpus():
    base = [sentence(60) for _ in range(6)]
    texts = [*base, base[0], base[0] + " more", base[1].replace(" ", "\n", 3), " ".join(base[2].split()[:-2]), None, "", " \t\n", "one two",
             "ONE two", base[3] + "\n" + base[3], "z" * 100_000 + " " + base[4], sentence(3000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[5], None, None, None)]


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text, lower=True):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)}) if lower else (text or "")
    return WORD.findall(text)


def test_words_match_a_plain_split():
    texts = [None, "", "  a  B\tc\n", "é" * 300_000, "x y z", "日本 go"]
    found = words.hasher()(pa.array(texts))
    assert np.diff(found.first).tolist() == [len(words_of(t)) for t in texts]
    known = {}
    for row, text in enumerate(texts):
        for h, w in zip(found.hash[found.of(row)].tolist(), words_of(text)):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("name", list(TWINS))
def test_query_equals_twin(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(spark, duck(sf_dir), sf_dir, name, QUERIES[name], TWINS[name]) == []


def test_jaccard_equals_brute_force(docs, empty):
    got = jaccard.jaccard_components(docs, 4, 85).collect()
    assert len(got) == len(CORPUS)
    sets = {}
    for i, t, *_ in CORPUS:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (root[r.doc_id] if r.doc_id is not None else None)
    assert jaccard.jaccard_components(empty, 4, 85).count() == 0


def test_blocks_of_one_large_group_link_as_one(spark):
    base = sentence(80).split()
    rows = [(i, " ".join([*base[:40], f"v{i}", *base[40:]])) for i in range(700)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.component_id for r in got} == {0}


def test_substrings_equal_brute_force(docs, empty):
    rows = CORPUS
    wins = {}
    for i, t, *_ in rows:
        w = words_of(t, False)
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                wins[key] = min(i, wins.get(key, i))
    want = []
    for i, t, *_ in rows:
        w = words_of(t, False)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and wins[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    got = [tuple(r) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substrings.remove_repeats(empty).count() == 0


def test_lines_keep_the_first_of_similar_ones(spark, empty):
    line = "The quick brown fox jumps over the lazy dog near the river bank at noon today with 12 friends"
    rows = [(2, line + "\nshort one", "en", "a", 1), (1, "own words stand here\n" + line.replace("12", "77"), "en", "a", 1),
            (3, line.upper() + "!", None, None, None), (4, None, "en", "a", 0), (None, line, "en", "a", 1), (5, "short one", "en", "a", 1)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[1][1] and got[2].text == "short one" and got[3].text == "" and got[None].text == ""
    assert got[4].text is None and got[5].text == "" and got[2].n_removed == 1
    assert lines.dedup_lines(empty).count() == 0


def test_similar_lines_equal_brute_force(spark):
    pick = random.Random(11)
    known = ["".join(pick.choice("abcdefghilmnorstué") for _ in range(pick.randrange(2, 10))) for _ in range(400)]
    rows = []
    for n in [*range(3, 51)] * 2:
        line = [pick.choice(known) for _ in range(n)]
        at = pick.randrange(n)
        letter = line[at][:-1] + "q" + line[at][len(line[at]) // 2 :]
        rows += [" ".join(line), " ".join([*line[:at], pick.choice(known), *line[at + 1 :]]), " ".join([*line[:at], letter, *line[at + 1 :]])]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and lines.similar(rows[a], rows[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sum(r != i for i, r in enumerate(root)) > 150
    assert {r.doc_id for r in got if r.n_removed} == {i for i, r in enumerate(root) if r != i}


def test_lines_of_scripts_without_spaces_go_too(spark):
    said = ["利用規約に同意してください", "กรุณาเข้าสู่ระบบ", "Read more"]
    rows = [(i, "\n".join([f"the own line of document {'abcd'[i] * 9}", *said])) for i in range(4)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_lines == 4
    assert all(got[i].n_removed == 3 and got[i].text == rows[i][1].split("\n")[0] for i in (1, 2, 3))


def test_edit_distance_equals_dynamic_programming():
    for _ in range(200):
        a, b = ("".join(RANDOM.choice("abc") for _ in range(RANDOM.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert lines.distance(a, b, 99) == row[-1]


def test_leaks_equal_brute_force(spark, empty):
    item = " ".join(f"word{RANDOM.randrange(900)}" for _ in range(30))
    changed = item.split()
    changed[29] = "other"
    rows = [(1, sentence(50) + " " + item.upper() + " " + sentence(9)), (2, sentence(80)), (3, " ".join(changed)), (4, None), (None, item),
            (5, " ".join(item.split()[:15]) + " " + sentence(30))]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item)], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(table, bench).collect()}
    assert set(got) == {(1, 7), (3, 7), (None, 7)} and got[1, 7] == 1.0
    assert [r.doc_id for r in decontamination.decontaminate(table, bench).orderBy("doc_id").collect()] == [2, 4, 5]
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(table, bench.limit(0)).count() == 0


def test_classifier_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.graded(labels.where("doc_id % 2 = 1"))
    rows = quality.judged(docs, model).join(held, "doc_id").select("grade", "kept").toPandas()
    assert rows[rows.grade == 2].kept.mean() > 0.97
    assert rows[rows.grade == 0].kept.mean() < 0.35
    assert (model.cuts[1:] > model.cuts[:-1]).all()


def test_classifier_without_labels_keeps_everything(docs, spark):
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.judged(docs, model).where("kept").count() == len(CORPUS)


def test_mix_meets_its_targets(docs, empty):
    rows = mixing.planned(docs).collect()
    assert len(rows) == len(CORPUS)
    taken, size, aim = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
        aim[key] = r.target
    assert all(taken[k] == int(aim[k]) for k in aim)
    assert abs(sum(aim.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    assert mixing.planned(empty).count() == 0
    copies = mixing.mixed(docs).collect()
    assert sum(r.words for r in copies) == sum(r.taken for r in rows)
    assert all(len(words_of(r.text)) == r.words for r in copies)


def test_chat_round_trip_and_examples(spark):
    said = "</s>[INST] ok [/INST] <\\|im_end|> [\\\\INST]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "user", "x" * 9000), (2, 1, "assistant", "y")]
    out = chat.expanded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert back[1].n_turns == 4 and back[1].loss_chars == len(said) and back[2].loss_chars == 1
    chunks = out.where("role is null").collect()
    for r in out.where("role = 'assistant'").collect():
        mine = [len(c.context) for c in chunks if (c.conv_id, c.context_chars) == (r.conv_id, r.context_chars)]
        assert r.context is None and sum(mine) == r.context_chars and max(mine) <= chat.CHUNK_CHARS and r.chunk == len(mine)
    assert "</s>" not in "".join(r.segment for r in out.collect())
    assert chat.expanded(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_examples_hold_their_whole_context(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} é" * n) for c, n in ((1, 3), (2, 400), (3, 3000)) for t in range(9)]
    out = chat.expanded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(len(r.context) <= chat.CHUNK_CHARS for r in out if r.context is not None)
    for conv in (1, 2, 3):
        stream, examples = "", 0
        for r in sorted((r for r in out if r.conv_id == conv and r.role is not None), key=lambda r: r.context_chars):
            if r.role == "assistant":
                pieces = sorted((p.chunk, p.context) for p in out if p.conv_id == conv and p.role is None and p.context_chars == r.context_chars)
                assert (r.context if r.context is not None else "".join(p for _, p in pieces)) == stream
                examples += 1
            stream += r.segment
        assert examples == 4


def test_licenses(spark, empty):
    rows = [(1, "a GNU General\nPublic License b\nReleased under the MIT License."), (2, None), (3, "mit"), (None, "CC-BY"),
            (4, "Permission is granted, hereby, free of charge to any person obtaining a copy of this software and associated files")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].base_labels == "gpl,mit" and got[1].labels == "gpl,mit,notice:mit" and (got[1].first_word, got[1].last_word) == (1, 9)
    assert got[2].n_words == 0 and got[2].first_word is None and got[3].labels == "" and got[None].base_labels == "cc-by"
    assert got[4].labels == "text:mit" and 0.8 <= got[4].score < 1
    assert licenses.scan(empty).count() == 0


def test_license_blocks_are_windows_of_words(spark):
    notice = licenses.TEMPLATES["text:mit"].split()
    wrapped = "\n".join("# " + " ".join(notice[i : i + 7]) for i in range(0, len(notice), 7))
    scattered = " ".join(f"released {sentence(30)} under {sentence(30)} the {sentence(30)} license {sentence(30)} mit" for _ in range(3))
    rows = [(1, sentence(9) + "\n" + wrapped + "\n" + sentence(9)), (2, scattered), (3, "released under"), (4, "the license"), (5, sentence(50) + " Released under the\nX license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1].labels == "text:mit" and got[1].score == 1.0
    assert [got[i].labels for i in (2, 3, 4)] == ["", "", ""]
    assert got[5].labels == "notice:mit" and got[5].score == 0.8


def test_rules_on_odd_tables(docs, empty):
    got = rules.judged(docs).collect()
    assert len(got) == len(CORPUS) and rules.judged(empty).count() == 0
    assert all(not r.kept for r in got if r.base_failed)
    twice = next(r for r in got if r.doc_id == 15)
    assert twice.n_dup_lines == 1 and twice.n_repeat_words == 120


def test_warc_round_trip(spark):
    big = "é\r\n\r\n" + "p" * 1200
    rows = [(1, "http://a/\n%", big), (2, "u", big), (3, None, None), (4, "v", "small"), (5, "w", "small"), (None, "n", big)]
    path = new_path(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert {k: r.payload for k, r in got.items()} == {r[0]: r[2] or "" for r in rows}
    assert got[1].url == rows[0][1] and got[1].payload_bytes == len(big.encode())
    nothing = new_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), nothing)
    assert warc.read_archives(spark, nothing).count() == 0
