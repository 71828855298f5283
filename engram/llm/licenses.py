"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of as many words as the template has, anywhere in a document and across its
lines. It matches if it holds at least CONTAINMENT of the template's distinct words. Template
words are ordered by how many documents of the corpus hold them, rarest first: a block that
reaches the threshold holds one of the first size - need + 1 words (prefix filter), so only words
near one of these are looked at; their windows are all counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import words

CONTAINMENT = 0.8
#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and opening sentences of common licenses, and their labels.
TEMPLATES = {
    "notice:mit": "released under the mit license",
    "notice:apache": "licensed under the apache license version 2 0",
    "notice:gpl": "this work is licensed under the gnu general public license version 3",
    "notice:cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "notice:cc-by-nc": "licensed under cc by nc 4 0",
    "text:mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "text:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "text:apache": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "text:gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "text:mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)
SCANNED_TYPES = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")] + [
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


class Template(NamedTuple):
    label: str
    ordered: np.ndarray
    need: int
    words: int


def hashes(text: str) -> np.ndarray:
    return words.hasher(words.NOT_ALNUM)(pa.array([text])).hash


def word_counts(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """Documents that hold each template word; as many entries as the templates have words."""
    known = np.unique(np.concatenate([hashes(t) for t in templates.values()]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = words.hasher(words.NOT_ALNUM), np.zeros(len(known), np.int64)
        for batch in words.sliced(batches, 0):
            found = hashed(batch.column(0))
            slot = np.minimum(np.searchsorted(known, found.hash), len(known) - 1)
            hit = np.flatnonzero(known[slot] == found.hash)
            row = np.searchsorted(found.first, hit, "right") - 1
            total += np.bincount(np.unique(row * len(known) + slot[hit]) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], names=["word", "n"])

    rows = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return {int(known[k]): found.get(k, 0) for k in range(len(known))}


def prepared(templates: dict[str, str], counts: dict[int, int], containment: float) -> list[Template]:
    out = []
    for label, text in templates.items():
        own = sorted({int(h) for h in hashes(text)}, key=lambda h: (counts[h], h))
        out.append(Template(label, np.array(own, np.uint64), int(np.ceil(containment * len(own) - 1e-9)), len(hashes(text))))
    return out


def matches(found: words.Words, templates: list[Template]) -> Iterator[tuple[int, str, float]]:
    """(row, label, best containment) of every text with a block that meets a template's threshold."""
    n = len(found.hash)
    for template in templates:
        wide = template.words
        prefix = template.ordered[: len(template.ordered) - template.need + 1]
        seed = np.flatnonzero(np.isin(found.hash, prefix))
        if not len(seed):
            continue
        open_at = np.bincount(np.maximum(seed - wide + 1, 0), minlength=n + 1) - np.bincount(np.minimum(seed + wide, n), minlength=n + 1)
        near = np.flatnonzero(np.cumsum(open_at[:-1]) > 0)
        known = np.sort(template.ordered)
        slot = np.minimum(np.searchsorted(known, found.hash[near]), len(known) - 1)
        hit = known[slot] == found.hash[near]
        at, slot = near[hit], slot[hit]
        order = np.argsort(slot, kind="stable")
        at, slot = at[order], slot[order]
        # A word is the first of its kind in the windows that begin after the one before it.
        before = np.full(len(at), -1)
        before[1:] = np.where(slot[1:] == slot[:-1], at[:-1], -1)
        row = np.searchsorted(found.first, at, "right") - 1
        start = np.maximum(np.maximum(before, at - wide) + 1, found.first[row])
        held = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1))
        block = np.flatnonzero(held >= template.need)
        row = np.searchsorted(found.first, block, "right") - 1
        for r in np.unique(row).tolist():
            yield r, template.label, float(held[block[row == r]].max() / len(known))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Documents (doc_id, text) to their license phrases and templates.

    n_words, n_base (places of phrases), first_word and last_word (smallest and largest start of
    one, from 0, else null), base_labels and labels (those of templates too; distinct, sorted,
    joined by commas), score (1 with a phrase, else the best containment that meets the
    threshold, else 0). Words are letters and digits, A-Z lower-cased. Null and empty texts have
    no words; repeated rows are scanned alike; a null doc_id stays null; other columns are
    ignored; an empty table gives an empty result. The templates are a parameter of bounded
    size and travel with the task.
    """
    templates = TEMPLATES if templates is None else templates
    ready = prepared(templates, word_counts(docs, templates), containment)
    phrases = [(label, h, len(h)) for label, h in ((label, hashes(p)) for p, label in PHRASES.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = words.hasher(words.NOT_ALNUM)
        for batch in words.sliced(batches, 1):
            found = hashed(batch.column(1))
            n = batch.num_rows
            count, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base, extra, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for label, own, size in phrases:
                at = np.flatnonzero(found.hash == own[0])
                at = at[at + size <= len(found.hash)]
                for k in range(1, size):
                    at = at[found.hash[at + k] == own[k]]
                row = np.searchsorted(found.first, at, "right") - 1
                inside = at + size <= found.first[row + 1]
                at, row = at[inside], row[inside]
                np.add.at(count, row, 1)
                np.minimum.at(least, row, at - found.first[row])
                np.maximum.at(most, row, at - found.first[row])
                for r in np.unique(row).tolist():
                    base[r].add(label)
                    score[r] = 1.0
            for r, label, share in matches(found, ready):
                extra[r].add(label)
                score[r] = max(score[r], share)
            none = count == 0
            columns = [
                batch.column(0).cast(pa.int64()), np.diff(found.first), count, pa.array(least, mask=none), pa.array(most, mask=none),
                [",".join(sorted(b)) for b in base], [",".join(sorted(b | e)) for b, e in zip(base, extra)], score,
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, SCANNED_TYPES)], schema=SCANNED_TYPES)

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)
