import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe

CODEC, TOKENS = bpe.Codec.get(None, None), bpe.Tokens.get(None)
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.fst.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abtheing  \n\t'sd1$é漢😀\xa0\x1c\r-=")), max_size=60))
def test_encoding_is_the_librarys(text):
    assert CODEC.encode(text).tolist() == ENCODING.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_transducer_is_merging_by_rank(piece):
    want = [CODEC.fst.ranks[piece]] if piece in CODEC.fst.ranks else CODEC.fst.merge(piece)
    assert CODEC.fst.encode(piece) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abct hewo.,;:!?'\n-_\u0301é漢")), max_size=40))
def test_marks_after_words_are_encoded_alone(text):
    assert CODEC.encode(text).tolist() == ENCODING.encode_ordinary(text)


#: The longest a byte may wait to be emitted, in lengths of the longest token.
LOOKAHEAD = 2


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=300), st.lists(st.sampled_from(sorted(CODEC.fst.ranks)), min_size=1, max_size=40).map(b"".join)), st.integers(1, 7))
def test_ids_leave_after_a_bounded_lookahead(piece, step):
    fst, longest = CODEC.fst, max(map(len, CODEC.fst.ranks))
    run, out, fed = fst.start(), [], 0
    for i in range(0, len(piece), step):
        out += run.feed(piece[i : i + step])
        fed = min(len(piece), i + step)
        assert fed - sum(len(fst.bytes_of[t]) for t in out) <= LOOKAHEAD * longest
    assert out + run.end() == fst.merge(piece)


def test_long_runs_leave_too():
    fst, longest = CODEC.fst, max(map(len, CODEC.fst.ranks))
    for unit in (b"a", b" ", b"ab", b"the", b"=-", b"\xe6\xbc", b"0"):
        piece = unit * (20_000 // len(unit))
        run = fst.start()
        out = run.feed(piece)
        assert len(piece) - sum(len(fst.bytes_of[t]) for t in out) <= LOOKAHEAD * longest
        out += run.end()
        assert b"".join(map(fst.bytes_of.__getitem__, out)) == piece
        assert all(fst.merge(fst.bytes_of[a] + fst.bytes_of[b]) == [a, b] for a, b in set(zip(out, out[1:], strict=False)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(CODEC.fst.ranks.values())), min_size=2, max_size=2))
def test_pairs_that_may_follow_are_those_that_merging_leaves(pair):
    a, b = pair
    assert CODEC.fst.may_follow(a, b) == (CODEC.fst.merge(CODEC.fst.bytes_of[a] + CODEC.fst.bytes_of[b]) == [a, b])


def test_a_small_table_gives_the_same(odd_texts):
    small = bpe.Transducer(CODEC.fst.ranks, most=50)
    for text in odd_texts:
        for word in (text or "")[:400].split():
            assert small.encode(word.encode()) == CODEC.fst.encode(word.encode())


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=50), st.integers(1, 4))
def test_streaming_decoder_gives_whole_characters(text, step):
    ids, stream = CODEC.encode(text).tolist(), bpe.StreamDecoder(TOKENS)
    assert "".join(stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + stream.end() == text


def test_bytes_that_are_not_utf8_wait_or_are_marked():
    ids = [CODEC.fst.ranks[b"\xe6"], CODEC.fst.ranks[b"\xbc"]]
    stream = bpe.StreamDecoder(TOKENS)
    assert stream.feed(ids) == "" and stream.end() == "�"


def test_query_over_odd_texts(make, empty, odd_texts):
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(make(odd_texts)))).collect()}
    for i, text in enumerate(odd_texts):
        ids = ENCODING.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(bpe.decode(bpe.encode(empty))).count() == 0


def test_ids_outside_of_the_vocabulary_raise():
    with pytest.raises(IndexError):
        bpe.StreamDecoder(TOKENS).feed([10**6])
