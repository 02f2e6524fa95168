import random

from chronolith.llm import cross_parsing as c
from chronolith.llm.common import held_out_py


def greedy(text, train):
    """Phrases by looking every candidate up in the training passages."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and any(text[i : j + 1] in t for t in train):
            j += 1
        n, i = n + 1, j
    return n


def test_phrase_counts_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    sample = [(lang, make(letters, 30)) for lang, letters in (("aa", "abc "), ("bb", "bcd ")) for _ in range(6)]
    parser = c.Parser(sample)
    texts = [make("abcdx ", rng.randint(1, 60)) for _ in range(60)] + [""]
    counts, sizes = parser.phrases(texts)
    by = {lang: [c.plain(t) for x, t in sample if x == lang] for lang in ("aa", "bb")}
    for i, t in enumerate(texts):
        assert sizes[i] == len(t)
        if t:
            assert [greedy(t, by[lang]) for lang in parser.langs] == counts[i].tolist()
    monkeypatch.setattr(c, "SEGMENT", 7)
    cut, _ = parser.phrases(texts)
    for i, t in enumerate(texts):
        if t:
            assert cut[i].tolist() == [sum(greedy(t[a : a + 7], by[lang]) for a in range(0, len(t), 7)) for lang in parser.langs]


def test_odd_documents(odd_docs, no_docs):
    got = {(r.doc_id, i): r for i, r in enumerate(c.identify(odd_docs, c.labelled_sample(odd_docs)).collect())}
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for (doc_id, _), r in got.items():
        assert r.lang_pred in ("en", "und") and 0 <= r.score <= 1
        assert r.held_out == held_out_py(doc_id)
        if doc_id is not None and doc_id != 4:
            assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in texts[doc_id] or ""))
    assert c.identify(no_docs, []).count() == 0
    assert {r.lang_pred for r in c.identify(odd_docs, []).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = c.identify(docs, c.labelled_sample(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("source", "n_chars").persist()
    from pyspark.sql import functions as F

    from chronolith.llm.common import held_out

    spoiled = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert c.labelled_sample(docs) == c.labelled_sample(spoiled)


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(3, 7)))
    stock = {f"l{i:02}": [word() for _ in range(12)] for i in range(70)}
    rows = [(n * 70 + i, " ".join(rng.choices(words, k=25)), lang) for n in range(9) for i, (lang, words) in enumerate(stock.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = c.labelled_sample(docs)
    assert {lang for lang, _ in sample} == set(stock)
    got = {r.doc_id: (r.lang_pred, r.score, r.n_phrases) for r in c.identify(docs, sample).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    whole = c.Parser(sample).predict([text for _, text, _ in rows])
    assert [got[i] for i, _, _ in rows] == whole
