import hashlib
import random

from quarry.llm import substrings
from tests.llm.conftest import prose


def brute(ids, texts, k):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for d, w in zip(ids, split, strict=True):
        for i in range(len(w) - k + 1) if d is not None else ():
            x = tuple(w[i : i + k])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, w in zip(ids, split, strict=True):
        gone = {j for i in range(len(w) - k + 1) if d is not None and first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_removal_is_brute_force(make, empty, odd_texts):
    rng = random.Random(11)
    few = [f"v{i}" for i in range(3)]
    passages = [prose(rng, n) for n in (12, 13, 14, 25, 60)]
    texts = odd_texts + [prose(rng, rng.randint(0, 30)) + " " + rng.choice(passages) + "\t" + prose(rng, rng.randint(0, 30)) for _ in range(60)]
    texts += [prose(rng, rng.randint(10, 40), few) for _ in range(20)] + [passages[4]] * 6
    rng.shuffle(texts)
    ids = [2 * i for i in range(len(texts))]
    ids[3], ids[9] = None, ids[8]
    rows = substrings.remove_repeats(make(texts, ids=ids)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)
    assert got == brute(ids, texts, 13)
    assert substrings.remove_repeats(empty).count() == 0


def test_spans_name_their_source(make):
    rng = random.Random(2)
    passage = prose(rng, 40)
    docs = make([prose(rng, 20) + " " + passage, prose(rng, 7) + " " + passage + " " + prose(rng, 9)]).selectExpr("doc_id", "xxhash64(text) print", "text")
    spans, checks, _ = substrings.repeated_spans(docs, docs.select("doc_id", "print"))
    (r,), (c,) = spans.collect(), checks.collect()
    assert (r.doc_id, r.start, r.end, r.source, r.source_start, r.hop) == (1, 7, 47, 0, 20, 0) and tuple(r.path)[::2] == (0, 20)
    assert (c.start, c.end, c.digest) == (7, 47, substrings._digest(passage.encode().split()))


def graph_by_hand(spans, k):
    """The nonbranching paths of the graph of all windows that spans cover, as sets of windows."""
    into, out, edges = {}, {}, set()
    for w in spans:
        for i in range(len(w) - k + 1):
            e = tuple(w[i : i + k])
            edges.add(e)
            into.setdefault(e[1:], set()).add(e)
            out.setdefault(e[:-1], set()).add(e)
    plain = lambda node: len(into.get(node, ())) == 1 and len(out.get(node, ())) == 1
    found = set()
    for e in edges:
        back = e
        while plain(back[:-1]):
            (back,) = into[back[:-1]]
            if back == e:
                break
        path = [back]
        while plain(path[-1][1:]) and (nxt := next(iter(out[path[-1][1:]]))) != back:
            path.append(nxt)
        found.add(tuple(path))
    return found


def test_spans_are_nonbranching_paths(make):
    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 30).split() for _ in range(5))
    # a b goes on to c or d; e is repeated from two sources, its halves by different documents.
    texts = [a + b + c, a + b + d, prose(rng, 9).split() + a + b + c, b + d + prose(rng, 5).split(), e[:20], e[8:] + ["z"], prose(rng, 3).split() + e]
    docs = make([" ".join(t) for t in texts]).selectExpr("doc_id", "xxhash64(text) print", "text")
    spans, _, _ = substrings.repeated_spans(docs, docs.select("doc_id", "print"))
    got = spans.collect()
    want = {x: p for p in graph_by_hand([texts[r.doc_id][r.start : r.end] for r in got], 13) for x in p}
    by_path = {}
    for r in got:
        w = texts[r.doc_id][r.start : r.end]
        assert w == texts[r.source][r.source_start : r.source_start + len(w)]
        windows = [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
        (path,) = {want[x] for x in windows}
        by_path.setdefault(tuple(r.path), set()).add(path)
    assert all(len(p) == 1 for p in by_path.values())
    assert len({(r.path, r.hop) for r in got}) > len(by_path) or len(by_path) == len({x for p in by_path.values() for x in p})


def test_hashes_that_clash_are_noticed(make, monkeypatch):
    import pytest

    rng = random.Random(3)
    docs = make([prose(rng, 30), prose(rng, 30)]).selectExpr("doc_id", "text", "array(named_struct('start', 0, 'end', 13)) spans", "array(named_struct('start', 0, 'end', 13, 'digest', cast('no' as binary))) checks")
    with pytest.raises(Exception, match="another seed"):
        substrings._finish(docs).collect()


def test_rows_of_one_id_do_not_hide_a_third_document(make):
    rng = random.Random(7)
    passage = prose(rng, 40)
    same = prose(rng, 20) + " " + passage
    for texts in ([same, same, prose(rng, 9) + " " + passage], [same, passage + " " + prose(rng, 15), prose(rng, 9) + " " + passage]):
        ids = [5, 5, 9]
        rows = substrings.remove_repeats(make(texts, ids=ids).coalesce(1)).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)
        assert got == brute(ids, texts, 13)
        assert [n for d, _, n, _ in got if d == 9] == [40]
