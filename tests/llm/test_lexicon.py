import hashlib
import json
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import lexicon, queries

PATH = P.path("byte_bpe_50k.json")
LIBRARY, MERGES = Tokenizer.from_file(PATH), lexicon.Merges(None)
WORDS = ["the", "then", "there", "thing", "walking", "talking", "walking,", "talking,", "\nthe", "a", "é", "漢字", "naïve", "x.y", "###"]
CODER = lexicon.Coder(MERGES, lexicon.Lexicon(lexicon.compile_words(WORDS, MERGES)))


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def encoded(coder, texts):
    ids, sizes = coder.encode(texts)
    ends = np.cumsum(sizes).tolist()
    return [(ids[e - n : e].tolist(), t) for e, n, t in zip(ends, sizes.tolist(), coder.decode(ids, sizes), strict=True)]


some_text = st.lists(
    st.one_of(st.sampled_from([*WORDS, " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "<|endoftext|>", "<|endof", "\x00", "\x1c", "\x85", "\xa0", "　"]), st.text(alphabet=st.sampled_from(list("abtheing 1.,é漢😀́-=_")), max_size=12)),
    max_size=12,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(some_text, max_size=5))
def test_texts_are_as_in_the_library(texts):
    assert encoded(CODER, texts) == [library(t) for t in texts]


def test_forgetting_changes_nothing():
    rng = random.Random(1)
    coder = lexicon.Coder(MERGES, CODER.lexicon, most=20)
    for _ in range(30):
        texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "!", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        assert encoded(coder, texts) == [library(t) for t in texts]
        assert len(coder.number) <= 400


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abthe qu", min_size=1, max_size=30), min_size=1, max_size=20))
def test_merging_together_is_merging_by_heap(pieces):
    ids, counts = MERGES.merge(pieces)
    ends = np.cumsum(counts).tolist()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts.tolist(), strict=True)] == [MERGES.merge_long(p.encode()) for p in pieces]


def test_long_pieces_take_little_time():
    for text in ("a" * 200_000, "ab" * 100_000, "é" * 50_000, "=" * 100_000, " " * 100_000, "the" * 50_000):
        assert encoded(CODER, [text, "x " + text]) == [library(text), library("x " + text)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 5), max_size=4).map(tuple), min_size=1, max_size=25))
def test_the_transducer_holds_its_words_and_is_minimal(words):
    builder = lexicon.Builder()
    for w in sorted(words):
        builder.add(w, words[w])
    found = lexicon.Lexicon(builder.image())
    asked = [*words, *(w + b"z" for w in words), *(w[:-1] for w in words if w)]
    there, ids, counts = found.look_up(asked)
    assert there.tolist() == [w in words for w in asked]
    ends = np.cumsum(counts).tolist()
    assert [tuple(ids[e - n : e].tolist()) for e, n in zip(ends, counts.tolist(), strict=True)] == [words.get(w, ()) for w in asked]
    # Minimal: as many states as there are different sets of (ending, ids less what all of a state's words begin with).
    def rest(prefix):
        own = {w[len(prefix) :]: o for w, o in words.items() if w.startswith(prefix)}
        k = 0
        while prefix and all(len(o) > k for o in own.values()) and len({o[k] for o in own.values()}) == 1:
            k += 1
        return frozenset((w, o[k:]) for w, o in own.items())

    assert len(builder.number) == len({rest(w[:i]) for w in words for i in range(len(w) + 1)})


def test_endings_are_shared():
    builder = lexicon.Builder()
    for i, w in enumerate(sorted(f"{a}ing".encode() for a in ("bring", "fling", "sing", "wing"))):
        builder.add(w, (i, 9))
    assert len(builder.number) < sum(map(len, ("bring", "fling", "sing", "wing"))) + 1
    with pytest.raises(ValueError):
        builder.add(b"a", (1,))


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        lexicon.Merges(P.path("word_bpe_49k.json"))
    made = json.load(open(PATH))
    made["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    with pytest.raises(ValueError):
        lexicon.Merges(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        CODER.decode(np.array([60_000]), np.array([1]))


def expected(doc_id, text):
    ids, decoded = library(text)
    return (doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_query_is_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op13_bpe(spark, sf).collect())) == sorted(expected(*d) for d in docs)


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_cases(make, odd_texts, size):
    texts = [*odd_texts, "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|>", "w" * 5000, "\x00 \x00a", "word " * 50 + "word"]
    for ids in (list(range(len(texts))), [None] * len(texts), [7] * len(texts)):
        got = lexicon.digests(lexicon.round_trip(make(texts, ids=ids), size=size)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)


def test_the_most_frequent_words_are_chosen(make):
    docs = make(["a " * 40 + "b " * 20 + "c " * 9 + "d d\nd e", None, ""])
    assert sorted(lexicon.frequent_words(docs, 10)) == ["a", "b", "c", "d"]
    assert sorted(lexicon.frequent_words(docs, 2)) == ["a", "b"]
    assert lexicon.frequent_words(docs, 0) == []


def test_empty_table(empty):
    assert lexicon.digests(lexicon.round_trip(empty)).collect() == []
