import random
import re

import numpy as np

from quarry.llm import minhash
from quarry.llm.common import WordHashes
from tests.llm.conftest import prose


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(ids, texts, percent):
    sets = [shingles(t) for t in texts]
    parent = {d: d for d in ids if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {(d, len(s), None if d is None else root(d)) for d, s in zip(ids, sets, strict=True)}


def family(rng, n, edits):
    base = prose(rng, 150).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_are_brute_force(make, empty, odd_texts):
    rng = random.Random(3)
    texts = odd_texts + [t for k in range(12) for t in family(rng, rng.randint(2, 25), 4)] + [prose(rng, rng.randint(3, 40)) for _ in range(40)]
    rng.shuffle(texts)
    ids = [3 * i + 1 for i in range(len(texts))]
    ids[5] = None
    for percent in (80, 85):
        rows = minhash.near_duplicates(make(texts, ids=ids), percent=percent).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == brute(ids, texts, percent)
        assert len(rows) == len(texts) and all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    assert minhash.near_duplicates(empty).count() == 0


def test_repeated_ids_are_one_document(make):
    a, b, c = prose(random.Random(1), 50), prose(random.Random(2), 50), prose(random.Random(4), 50)
    rows = minhash.near_duplicates(make([a, b, a, b, c, c], ids=[5, 5, 7, 9, 11, 11])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (11, 11)]


def test_sketch_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85):
        same = total = 0
        for _ in range(60):
            n = 300
            common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            rest = [rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
            a, b = (minhash.sketch(np.unique(np.concatenate([common, r]))) for r in rest)
            same, total = same + int((a == b).sum()), total + len(a)
        assert abs(same / total - share) < 0.03
    assert len(set(minhash.sketch(np.array([7], np.uint64)).tolist())) == minhash.BINS
    assert len(minhash.shingle_hashes("A b C d e", WordHashes())) == 1
