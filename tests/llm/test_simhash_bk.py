import random
import re

import numpy as np
import pytest
import xxhash

from chronolith.llm import simhash_bk as s
from chronolith.llm.common import Workspace
from chronolith.llm.components import connected_components


def brute_print(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """Smallest vertex of each component."""
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(at)}


def test_bk_tree():
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(20)]
    tree = s.BKTree()
    nodes = [tree.add(v) for v in values]
    for v in values[:60]:
        assert sorted(tree.values[n] for n in tree.search(v)) == sorted({x for x in values if (x ^ v).bit_count() <= 4})
    asked = np.array(values, np.uint64)
    found = {(n, int(q)) for n, who in tree.search_all(asked) for q in who}
    assert found == {(nodes[i], j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= 4}
    links = s.forest(asked, None)
    want = brute_components([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    assert brute_components(links) == want


@pytest.mark.parametrize("m", [6, 7, 8])
def test_shards_hold_every_pair(spark, m):
    rng = random.Random(m)
    rows = []
    for i in range(0, 400, 2):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), 4))
        rows += [(x - (1 << 64) if x >> 63 else x, i + k) for k, x in enumerate((a, b))]
    met = s.shards(spark.createDataFrame(rows, "fp long, v long"), m)
    pairs = met.alias("a").join(met.alias("b"), ["k", "key"]).filter("a.v % 2 = 0 and b.v = a.v + 1").select("a.v").distinct()
    assert pairs.count() == 200


def test_links_over_small_tiles(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(63)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(100)})
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp long, v long")
    got = s.links_within(frame, Workspace(spark, "t"), tile=16).collect()
    assert all((values[r.a] ^ values[r.b]).bit_count() <= 4 for r in got)
    want = brute_components([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    assert brute_components([(r.a, r.b) for r in got]) == want


def test_documents(odd_docs, no_docs):
    got = sorted(map(tuple, s.near_duplicates(odd_docs).collect()), key=repr)
    rows = [(r.doc_id, brute_print(r.text)) for r in odd_docs.collect()]
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] is not None and b[0] is not None and (a[1] ^ b[1]).bit_count() <= 4]
    comp = brute_components(pairs)
    # rows without an id belong to the component of their fingerprint
    by_print = {p: comp[d] for d, p in rows if d is not None}
    by_print |= {p: min(comp[d] for d, q in rows if d is not None and q == p) for p in by_print}
    own = brute_components([(min(d for d, q in rows if q == a[1] and d is not None), min(d for d, q in rows if q == b[1] and d is not None)) for a in rows for b in rows if a[0] is not None and b[0] is not None and (a[1] ^ b[1]).bit_count() <= 4])
    want = [(d, f"{p:016x}", own[min(x for x, q in rows if q == p and x is not None)]) for d, p in rows]
    assert got == sorted(want, key=repr)
    assert s.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3), (7, None)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t")).collect()}
    want = brute_components([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0
