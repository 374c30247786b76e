import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as pipeline
from quarry.llm import bpe, mixing, secrets
from tests.llm.conftest import prose
from tests.llm.test_minhash import brute

ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Codec.get(None, None).fst.ranks, special_tokens={})
GERMAN = "der die und das nicht ein straße fluß häuser gehen blau schön über weiß mit von zu ist".split()


def corpus(rng):
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(60)] + [prose(rng, rng.randint(30, 120), GERMAN + [f"{w}{x}" for w in GERMAN for x in "enst"]) for _ in range(40)]
    langs = ["en"] * 60 + ["de"] * 40
    texts += [texts[3], texts[3] + " more", texts[70], None, "", "123 456", prose(rng, 50) + ' password = "abcdef0123456789" end', "short text"]
    langs += ["en", "en", "de", "en", None, None, "en", None]
    return texts, langs


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "bpe"]


def test_pipeline_is_brute_force(spark, make):
    rng = random.Random(4)
    texts, langs = corpus(rng)
    docs = make(texts, langs=langs, sources=[rng.choice("aab") for _ in texts])
    columns = docs.columns
    one = pipeline.identify_language(spark, docs, "").cache()
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    two = pipeline.drop_near_duplicates(spark, one, "").cache()
    assert two.columns == columns
    left = {r.doc_id: r.text for r in one.collect()}
    want = {c for _, _, c in brute(list(left), list(left.values()), 80)}
    assert {r.doc_id for r in two.collect()} == want
    three = pipeline.redact_secrets(spark, two, "").cache()
    assert three.columns == columns
    for r in three.collect():
        assert r.text == secrets.redact(left[r.doc_id], secrets.find(left[r.doc_id]))
    assert any("<assign>" in r.text for r in three.collect()) and not any("abcdef0123456789" in r.text for r in three.collect())
    four = pipeline.mix_sources(spark, three, "").cache()
    assert four.columns == columns
    words = {}
    for r in four.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {r.doc_id: r.taken for r in mixing.mix(three).collect() if r.taken}
    five = pipeline.encode_bytes(spark, four, "").collect()
    ids = lambda t: ENCODING.encode_ordinary(t)
    digest = lambda t: hashlib.sha256(" ".join(map(str, ids(t))).encode()).hexdigest()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in five) == sorted((r.doc_id, len(ids(r.text)), digest(r.text)) for r in four.collect())


def test_run_over_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_of_no_learned_language_go(spark, make):
    rng = random.Random(9)
    texts, langs = corpus(rng)
    cyrillic, kana, noise = "абвгдежзийклмнопрстуфхцчшщ", "あいうえおかきくけこさしすせそ", "qxzjkvwbpfgh"
    strange = ["".join(rng.choice(letters + " ") for _ in range(n)) for letters in (cyrillic, kana, noise) for n in (40, 400)] + ["0123 " * 30 + "x"]
    clean = [prose(rng, 60), prose(rng, 60, GERMAN), "der die und"]
    docs = make(texts + strange + clean, langs=langs + [None] * (len(strange) + len(clean)))
    kept = {r.doc_id: r.lang for r in pipeline.identify_language(spark, docs, "").collect()}
    first = len(texts)
    assert not [i for i in range(first, first + len(strange)) if i in kept]
    assert [kept.get(first + len(strange) + i) for i in range(3)] == ["en", "de", "de"]


def test_without_labels_texts_with_letters_stay(spark, make):
    texts = [prose(random.Random(i), 40) for i in range(5)] + ["12 34", "", None, "ab"]
    kept = pipeline.identify_language(spark, make(texts, langs=[None] * len(texts)), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3, 4, 8] and {r.lang for r in kept} == {None}


def test_one_character_more_changes_little(spark, make):
    rng = random.Random(3)
    texts, langs = corpus(rng)
    asked = [pipeline.asked_likeness(n) for n in range(pipeline.FREE_CHARS, 300)]
    assert asked[0] == 0 and all(0 < b - a < 0.03 for a, b in zip(asked, asked[1:], strict=False))
    noise = ["".join(rng.choice("абвгдежзийклмн ") for _ in range(n)) for n in range(30, 120)]
    clean = [prose(rng, 30)[:n].rsplit(" ", 1)[0] for n in range(10, 100)]
    docs = make(texts + noise + clean, langs=langs + [None] * (len(noise) + len(clean)))
    kept = {r.doc_id for r in pipeline.identify_language(spark, docs, "").collect()}
    first = len(texts)
    assert not kept & set(range(first, first + len(noise)))
    assert set(range(first + len(noise), first + len(noise) + len(clean))) <= kept


def test_columns_of_any_name_and_rows_of_any_id(spark, tmp_path):
    rng = random.Random(6)
    texts, langs = corpus(rng)
    rows = [(None if i % 7 == 0 else i % 50, t, x, rng.choice("ab"), None, i, "q", "x") for i, (t, x) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `doc` string, `found``s` string")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "doc", "found`s"] and docs.count() > 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0
