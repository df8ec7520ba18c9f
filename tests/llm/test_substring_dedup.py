import hashlib
import re

from newsloom.llm import substring_dedup as d


def expected(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k : k + size])
                least[g] = min(i, least.get(g, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            first = least.get(tuple(w[k : k + size]))
            if first is not None and (i is None or first < i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def test_against_dictionary(docs, rows, none):
    for size in (13, 2):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in d.deduplicate(docs, size, with_text=True).collect())
        assert got == expected(rows, size)
    assert d.deduplicate(none).count() == 0
