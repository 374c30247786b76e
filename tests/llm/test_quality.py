import re

from quarry.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_are_brute_force(make, empty, odd_texts):
    texts = [*odd_texts, "a b c d e f g h i a b c d e f g h z a b c d e f g h", "$$ ## <b> | & *", "the cat " * 10 + "and " + "the cat " * 9]
    got = {r.doc_id: r for r in quality.judge(make(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, b = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, t
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r.kept and r.base_failed)
    assert got[7].kept and not got[3].kept
    assert quality.judge(empty).count() == 0


def test_clean_prose_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1 and toxic = 0")
    kept = quality.judge(docs).join(good, "doc_id").where("not base_failed")
    assert kept.where("kept").count() >= 0.97 * kept.count()


def test_projection_has_no_user_function(make):
    plan = quality.judge(make(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
