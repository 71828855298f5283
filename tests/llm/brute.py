"""Plain versions of operators, for tests."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}


def spelling_variants(rows, least=7, times=10):
    """Rows (doc_id, text) to {word: (form, root, n, n_near, form_n)}, by deleting every place."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), same in holes.items():
        for w in same:
            near[w] |= same - {w}
            if (short := a + b) in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}
