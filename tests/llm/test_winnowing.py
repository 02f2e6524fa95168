import random

import duckdb
import pytest

from chronolith.llm import winnowing
from tests.llm.conftest import words

ITEMS = "item_id string, text string, w string, doc_id long"


def against_sql(docs, items):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.sql("create table benchmark (item_id varchar, text varchar)")
    d, b = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()]
    if d:
        con.executemany("insert into documents values (?, ?)", d)
    if b:
        con.executemany("insert into benchmark values (?, ?)", b)
    return sorted(con.sql(winnowing.SQL).fetchall(), key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_sql(spark, odd_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    texts = [r.text for r in odd_docs.collect() if r.text]
    items = []
    for i in range(40):
        w = rng.choice(texts).split()
        a = rng.randrange(max(1, len(w) - 30))
        items.append((f"i{i}", " ".join(w[a : a + rng.randint(1, 40)]).upper() if i % 2 else words(rng, 20) + " " + " ".join(w[a : a + 25]), "c", 1))
    items += [("n", None, None, None), ("e", "", None, None), ("p", "!!", None, None), (None, " ".join(texts[1].split()[:12]), None, None), ("same", "a " * 60, None, None), ("one", "w5", None, None), items[1]]
    bench = spark.createDataFrame(items, ITEMS)
    same = spark.createDataFrame([(900, "b " + "a " * 300 + "c"), (901, "a " * 9), (902, "a-a.a " * 4)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "w", "row", "h").unionByName(same, allowMissingColumns=True)
    got = sorted((tuple(r) for r in winnowing.contaminated_words(docs, bench).drop("row").collect()), key=repr)
    # SQL counts an item without an id as one; here only its words count
    named = bench.filter("item_id is not null")
    want, every = against_sql(docs, named), against_sql(docs, bench.na.fill({"item_id": "~"}))
    want = sorted(((*w[:2], e[2], *w[3:5], e[2] > 0) for w, e in zip(sorted_by_doc(want), sorted_by_doc(every), strict=True)), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert got == want


def sorted_by_doc(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_winnowing_guarantee(spark):
    rng = random.Random(3)
    bench = " ".join(words(rng, 40, 5).split())
    w = bench.split()
    docs = spark.createDataFrame([(i, words(rng, 7) + " " + " ".join(w[i : i + 10]) + " " + words(rng, 9)) for i in range(len(w) - 9)], "doc_id long, text string")
    got = winnowing.contaminated_words(docs, spark.createDataFrame([("x", bench)], "item_id string, text string"))
    assert got.filter("n_hit >= 10").count() == len(w) - 9


def test_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], ITEMS)
    assert winnowing.contaminated_words(no_docs, none).count() == 0
    assert winnowing.contaminated_words(odd_docs, none).filter("n_hit > 0 or contaminated or n_items > 0").count() == 0


def test_native(spark):
    plan = winnowing.op8_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
