"""Embedding links against SQL over planted near copies, bounds, and odd rows."""

import duckdb
import numpy as np
import pytest

from chronolith.llm.quantised_pairs import SQL, Quantised, embedding_links, linked

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_links_equal_full_products():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    vectors = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.3, 0.4, 1e-4)])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = set(zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True))
    own = Quantised(vectors)
    assert {(a, b) for x, y in linked(own, own, same=True) for a, b in zip(x, y, strict=True)} == want
    cosine, bound = own.product(slice(0, 200), own, slice(0, 200))
    assert (np.abs(cosine - unit @ unit.T) <= bound).all()


@pytest.mark.parametrize("tile", [7, 1024])
def test_against_sql(spark, tile):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        base = rng.normal(size=(6, 8))
        for k in range(120):
            v = base[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.0, 0.2, 0.5])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1, 3])], label))
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [None] + [1.0] * 7, 1), (1003, [float("nan")] + [1.0] * 7, 1), (1004, [float("inf")] + [1.0] * 7, 1), (1005, [1.0], 1), (1006, [-0.0, 1.0], 0), (1007, [0.0, 1.0], 0), (1008, [], 0), (1009, [1e30, 1e30], 0), (1010, [1e-30, 1e-30], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, embedding_links(frame, tile=tile).collect()))
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    want = sorted(con.sql(SQL).fetchall())
    assert got == want


def test_empty(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_share_an_id(spark):
    """Per row by brute force: links and components are those of vectors, not of ids."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(8, 6))
    rows = [(2, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (7, [1.0, 0.01, 0.0, 0.0, 0.0, 0.0], 1), (7, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0], 1), (9, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1)]
    for _ in range(150):
        v = base[rng.integers(8)] + rng.normal(size=6) * rng.choice([0.0, 0.15, 0.3])
        rows.append((int(rng.integers(40)), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    unit = np.array([r[1] for r in rows])
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    linked_ = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])) & ~np.eye(len(rows), dtype=bool)
    comp = np.arange(len(rows))
    while True:
        new = np.array([min(comp[i], *comp[linked_[i]]) if linked_[i].any() else comp[i] for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    least = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp.tolist())}
    want = sorted((rows[i][0], int(linked_[i].sum()), least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(len(rows)))
    assert sorted(map(tuple, embedding_links(spark.createDataFrame(rows, SCHEMA), tile=16).collect())) == want


def test_hot_keys(spark, monkeypatch):
    from chronolith.llm import common

    left = spark.createDataFrame([(i % 7 if i < 3000 else i, i) for i in range(5000)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(4000)], "k long, name string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, common.join_hot(left, right, ["k"], how, few=10).select("k", "x", "name").collect()), key=repr) == want
    rng = np.random.default_rng(1)
    pairs = [(0, int(i)) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(60, 300, (150, 2))]
    from chronolith.llm.components import connected_components

    frame = spark.createDataFrame(pairs, "a long, b long")
    got, plain = (sorted(map(tuple, connected_components(frame, common.Workspace(spark, "c"), few=n).collect())) for n in (5, 10**6))
    assert got == plain
