import hashlib
import re
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from chronolith.llm import bpe_piece, cross_parsing, secret_linking
from tests.llm.test_simhash_bk import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def brute_windows(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(10, len(w))
    return w, {" ".join(w[i : i + 10]) for i in range(len(w) - n + 1)} if w else set()


def test_run_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    parser = cross_parsing.Parser(cross_parsing.labelled_sample(docs))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {d: x for d, x in rows.items() if parser.predict([x])[0][0] != "und"}
    prints = {d: brute_print(x) for d, x in rows.items()}
    comp = brute_components([(a, b) for a in rows for b in rows if (prints[a] ^ prints[b]).bit_count() <= 4])
    rows = {d: x for d, x in rows.items() if comp[d] == d}
    windows = set().union(*(brute_windows(r.text)[1] for r in bench.collect()))
    lengths = {len(w.split(" ")) for w in windows}
    held = lambda x: any(" ".join(w[i : i + n]) in windows for w in [brute_windows(x)[0]] for n in lengths for i in range(len(w) - n + 1))
    rows = {d: x for d, x in rows.items() if not held(x)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_piece.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for d, x in rows.items():
        base = secret_linking.base_spans(x)
        x = secret_linking.redacted(x, secret_linking.in_order([*base, *secret_linking.linked_spans(x, base)]))
        ids = enc.encode_ordinary(x)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    assert got == sorted(want)
    assert 0 < len(got) < docs.count()


def test_odd_documents(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, SF)
            assert docs.columns == start.columns and docs.dtypes == start.dtypes
            assert docs.count() <= before.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    kept = corpus_pipeline.simhash_near_dedup(spark, odd_docs, SF).filter("doc_id is not null").select("doc_id").collect()
    assert len(kept) == len(set(kept))


def test_secrets_are_masked(spark):
    docs = spark.createDataFrame([(1, "x password=0123456789abcdef y", "en", "s", 30), (2, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()}
    assert got == {1: ("x [assign] y", 12), 2: ("clean", 5)}


def test_decisions_are_by_row(spark):
    import random

    from tests.llm.conftest import words

    rng = random.Random(6)
    a, b, c, d, e, f = (words(rng, 80) for _ in range(6))
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(brute_windows(r.text)[0]) >= 10)
    schema = "doc_id long, text string, row string"
    left = lambda stage, rows: sorted(map(tuple, stage(spark, spark.createDataFrame(rows, schema), SF).select("doc_id", "text").collect()), key=repr)
    dedup = corpus_pipeline.simhash_near_dedup
    assert left(dedup, [(3, a, "x"), (5, a, "x"), (5, b, "x")]) == sorted([(3, a), (5, b)], key=repr)
    assert left(dedup, [(None, a, "x"), (None, a, "x"), (None, b, "x"), (7, b, "x")]) == sorted([(None, a), (7, b)], key=repr)
    # 4 is the first of two groups, and the other group keeps its next row; 6 has two texts and no other row
    assert left(dedup, [(4, c, "x"), (4, d, "x"), (9, d, "x"), (6, e, "x"), (6, f, "x")]) in (sorted([(4, c), (9, d), (6, e)], key=repr), sorted([(4, c), (9, d), (6, f)], key=repr))
    clean = corpus_pipeline.benchmark_decontamination
    assert left(clean, [(None, leak, "x"), (None, a, "x"), (8, leak, "x"), (8, b, "x")]) == sorted([(None, a), (8, b)], key=repr)


def test_columns_of_any_name_and_type(spark):
    schema = "doc_id long, text string, lang string, `my col` struct<`a b`:int,`c:d`:array<struct<`e-f`:string>>>, `x.y` int, n_chars long"
    rows = [(i, f"some text number {i} password=0123456789abcdef", "en", (i, [("z",)]), i, 5) for i in range(20)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.secret_scan):
        got = stage(spark, docs, SF)
        assert got.dtypes == docs.dtypes and got.count() == 20
    assert {tuple(r["my col"]["c:d"][0]) for r in got.collect()} == {("z",)}
