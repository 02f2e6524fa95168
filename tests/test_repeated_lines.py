"""Conversations that repeat lines, begin late or lack texts, against the queries' SQL."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronolith.errors import LimitExceeded
from chronolith.functions import codec
from chronolith.plans import catalog

TURNS = [
    *[(1, t, x) for t, x in enumerate(["a\nb", "c", "a", "\n\nd", "b\nb\nb", "a", "", "e\n"])],  # repeats within a turn and across turns
    *[(2, t, x) for t, x in enumerate(["one\nsame", "two", "three", "four", "same", "five\nsix"])],  # a line that goes and comes back elsewhere
    *[(3, t, x) for t, x in enumerate([None, "x\ny", "z", None, "w"])],
    *[(4, t, x) for t, x in ((4, "p\nq"), (5, "r"), (8, "s"))],  # no version before the fourth
    *[(5, 0, "l1\nl2\nl3")] * 2, (5, 1, "l4"), (5, 2, "l5"),
    *[(6, t, "same") for t in range(12)],
    *[(7, t, f"g{t}") for t in (0, 9, 10)],
    *[(8, t, x) for t, x in ((-3, "m\nn"), (2, "m\nk"), (4, "h"))],
    *[(9, t, x) for t, x in ((-3, "m\nn"), (-2, "o"))],
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("turns")
    conv, turn, text = zip(*TURNS, strict=True)
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": ["user"] * len(conv), "text": pa.array(text, pa.string())}), path / "conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["blame_churn", "blame_indexed", "line_diff"])
def test_repeated_lines(spark, folder, name):
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert {r[0] for r in want} >= {1, 2, 3, 4, 5, 6, 7, 8}


def test_scripts_of_lines_in_order_are_the_greedy_ones():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([x for x in range(14) if rng.random() < 0.6] for _ in range(2))
        for side, own in ((a, 100), (b, 200)):
            for _ in range(rng.randint(0, 4)):
                side.insert(rng.randint(1, max(1, len(side))), own + rng.randint(0, 1))
        a, b = [-1, *a, 300], [-2, *b, 400]  # no common beginning
        assert codec._kept_in_order(a, b) is not None
        assert codec.align(a, b) == codec._greedy(a, b, 0, None)
    assert codec._kept_in_order([1, 2], [2, 1]) is None and codec._kept_in_order([1, 1], [1]) is None and codec._kept_in_order([1], [1, 1]) is None
    with pytest.raises(LimitExceeded):
        codec.align(list("ab"), list("xb"), max_edits=1)


def test_runs_of_repeated_numbers():
    starts = lambda *seqs: codec.run_starts(codec.np.array(seqs, "int64")).tolist()
    assert starts() == [] and starts(0, 1, 3, 4) == [3] and starts(4, 4) == [4, 4] and starts(5, 5, 6, 6) == [5, 6]
    assert starts(1, 3, 3) == [3, 1]  # the second 3 lies as far from its place as the 1
