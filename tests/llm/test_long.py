"""Whole texts of several MB, of kinds that break what looks at a text more than once; null and repeated ids; names that clash."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose

from quarry.llm import bpe, language, minhash, mixing, quality, secrets, sharding, substrings
from quarry.llm import token_files as tf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(11)
    n = 2_000_000
    return [prose(rng, n // 6), "".join(rng.choices("0123456789abcdef", k=n)), "".join(rng.choices("abcdefghij", k=n)), "\n" * n, "a" * n]


@pytest.fixture(scope="module")
def docs(make, long_texts):
    return make(long_texts, sources=["a", "b", "a", "b", None]).cache()


def test_language(docs, long_texts):
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(rows) == 5 and rows[3].lang_pred == "und"
    assert rows[0].lang_pred == "en"


def test_mixing(docs, long_texts):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert [rows[i].size for i in range(5)] == [len(WORD.findall(t)) for t in long_texts]
    assert all(r.taken <= 2 * r.size for r in rows.values())


def test_substrings(docs, long_texts, make):
    rng = random.Random(11)
    rows = {r.doc_id: r for r in substrings.remove_repeats(make([*long_texts, " ".join(long_texts[0].split()[5000:5100]), prose(rng, 12)])).collect()}
    assert [rows[i].n_removed for i in (1, 2, 3, 4)] == [0] * 4 and rows[5].n_removed == 100 and rows[6].n_removed == 0
    assert rows[0].kept_sha256 == hashlib.sha256(" ".join(long_texts[0].split()).encode()).hexdigest()


def test_quality(docs, long_texts):
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [(rows[i].n_words, rows[i].word_chars) for i in range(5)] == [(len(w), sum(map(len, w))) for w in map(WORD.findall, long_texts)]
    assert rows[3].n_dup_lines == 0


def test_token_files(make, long_texts):
    from tests.llm.test_token_files import TOKENIZER

    texts = [long_texts[0][:500_000], "\n" * 100_000, "ab" * 20_000]
    rows = sorted(tf.write_and_read(make(texts)).collect(), key=lambda r: r.doc_id)
    for r, t in zip(rows, texts, strict=True):
        want = [*TOKENIZER.encode(t, add_special_tokens=False).ids, 0]
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_secrets(docs, long_texts):
    rows = {r.doc_id: r for r in secrets.report(secrets.scan(docs)).collect()}
    assert (rows[1].n_hex, rows[1].base_sha256) == (1, hashlib.sha256(f"hex:0:{len(long_texts[1])}".encode()).hexdigest())
    assert all(rows[i].n_assign == rows[i].n_access == 0 for i in range(5))


def test_near_duplicates(make, long_texts):
    near = long_texts[0].split()
    near[::2000] = ["other"] * len(near[::2000])
    rows = {r.doc_id: r for r in minhash.near_duplicates(make([*long_texts, " ".join(near)])).collect()}
    assert [rows[i].component_id for i in range(6)] == [0, 1, 2, 3, 4, 0]


def test_bpe(docs, long_texts, make):
    from tests.llm.test_bpe import ENCODING

    rows = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs))).collect()}
    assert [rows[i].decoded_sha256 for i in range(5)] == [hashlib.sha256(t.encode()).hexdigest() for t in long_texts]
    texts = [long_texts[0], long_texts[1][:20_000], long_texts[2][:20_000], "\n" * 20_000, "a" * 20_000]
    rows = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(make(texts)))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ENCODING.encode_ordinary(t))).encode()).hexdigest()


def test_sharding(docs, long_texts):
    rows = {r.doc_id: r for r in sharding.shard(docs, shards=3).collect()}
    assert [(rows[i].size, rows[i].text_crc32) for i in range(5)] == [(len(t.encode()) + 8, zlib.crc32(t.encode())) for t in long_texts]


def test_null_and_repeated_ids(make):
    texts = ["one two three", "one two three", "four five", None, "six"]
    docs = make(texts, ids=[9, 9, None, None, 9], sources=["a", "a", "b", None, "a"])
    assert sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(docs).collect()) == sorted((r or 0, "und" if t is None else p) for r, t, p in zip([9, 9, None, None, 9], texts, ["en"] * 5, strict=True))
    mixed = mixing.mix(docs).collect()
    assert sorted(r.size for r in mixed) == [0, 1, 2, 3, 3]
    placed = sharding.shard(docs, shards=2).collect()
    assert len({(r.shard, r.slot) for r in placed}) == 5
    read = tf.write_and_read(docs).collect()
    assert sorted(r.doc_id or 0 for r in read) == [0, 0, 9, 9, 9] and len({r.start for r in read}) == 5


def test_names_that_clash_with_the_plan(make):
    docs = make(["a b c d", "e f"], sources=["x", "y"]).withColumns({c: F.lit(1) for c in ("plan_taken", "plan_id", "row", "id", "print", "body", "a.b")})
    out = mixing.materialize(docs)
    assert out.columns == docs.columns and out.count() > 0
