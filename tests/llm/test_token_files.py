import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import token_files as tf

TOKENIZER = Tokenizer.from_file(P.path(tf.VOCABULARY))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000), st.data())
def test_codes_give_back_any_token_and_any_run(ids, data):
    codes = tf.Codes(tf.pack(np.array(ids, np.uint32)))
    assert codes.slice(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert codes[i] == ids[i] and codes.slice(i, j).tolist() == ids[i:j]


def test_query_reads_what_it_wrote(make, empty, odd_texts, spark):
    texts = [*odd_texts, "before <|endoftext|> after"]
    ids = list(range(len(texts)))
    docs = make(texts, ids=ids).repartition(5)
    rows = sorted(tf.write_and_read(docs, segment_tokens=3000).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, t in zip(rows, texts, strict=True):
        want = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert tf.write_and_read(empty).count() == 0


def test_null_ids_come_first(make):
    rows = tf.write_and_read(make(["b c", "a", None], ids=[None, 4, 3])).collect()
    assert sorted(((r.start, r.doc_id) for r in rows)) == [(0, None), (3, 3), (4, 4)]
