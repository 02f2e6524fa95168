"""Operators on small tables: regressions, skew, limits, streams."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.errors import LimitExceeded, NotFound
from chronolith.functions import scalar
from chronolith.operators import blame, index, linediff, log, objects, refs, treediff, trees
from chronolith.streaming import tail

FILES = "repo_id string, path string, mode string, oid string"


def tree(paths):
    """Paths -> tree_entries with ids that name the content."""
    rows, ids = set(), {}

    def put(prefix, names):
        here = {}
        for p in names:
            first, _, rest = p.partition("/")
            here.setdefault(first, []).append(rest)
        listed = []
        for name, rests in here.items():
            below = [r for r in rests if r]
            oid = put(f"{prefix}{name}/", below) if below else f"blob:{paths[prefix + name]}"
            listed.append((name, "directory" if below else "file", oid))
        own = "tree:" + repr(sorted(listed))
        rows.update(("r", own, 0, mode, name, oid) for name, mode, oid in listed)
        ids[prefix] = own
        return own

    return put("", sorted(paths)), rows


CASES = [
    ({"a/x": 1, "a/y": 2}, {"b": 3}, {("deleted", "a/x"), ("deleted", "a/y"), ("added", "b")}),
    ({"z": 1}, {"a/x": 2, "z": 1}, {("added", "a/x")}),
    ({"foo": 1, "one": 2}, {"foo/child": 3, "one": 2}, {("deleted", "foo"), ("added", "foo/child")}),
    ({"foo.txt": 1, "foo/c": 2}, {"foo/c": 2}, {("deleted", "foo.txt")}),
    ({"a/b/c/d": 1, "a/b/e": 2}, {"a/b/c/d": 5, "a/b/e": 2}, {("modified", "a/b/c/d")}),
    ({}, {"q": 1}, {("added", "q")}),
]


@pytest.mark.parametrize("old,new,want", CASES)
def test_tree_diff(spark, old, new, want):
    one, rows = tree(old)
    two, more = tree(new)
    entries = spark.createDataFrame(sorted(rows | more), "repo_id string, tree_oid string, ordinal int, mode string, name string, oid string")
    pair = spark.createDataFrame([("r", one if old else None, two)], "repo_id string, old_tree string, new_tree string")
    assert {(r.kind, r.path) for r in treediff.diff_trees(entries, pair).collect()} == want
    flat = lambda paths: spark.createDataFrame([("r", p, "file", f"blob:{v}") for p, v in paths.items()], FILES)
    assert {(r.kind, r.path) for r in treediff.diff_files(flat(old), flat(new)).collect()} == want


def test_mode_change_is_delete_and_add(spark):
    old = spark.createDataFrame([("r", "p", "file", "1"), ("r", "q", "file", "1")], FILES)
    new = spark.createDataFrame([("r", "p", "executable", "1"), ("r", "q", "symlink", "2")], FILES)
    assert {(r.kind, r.path, r.old_oid, r.new_oid) for r in treediff.diff_files(old, new).collect()} == {("deleted", "p", "1", None), ("added", "p", None, "1"), ("deleted", "q", "1", None), ("added", "q", None, "2")}


COMMITS = "repo_id string, oid string, tree string, parents array<string>, author_time long, committer_time long, message string"


def commits(spark, rows):
    return spark.createDataFrame([("r", o, "t", p, 0, t, "") for o, p, t in rows], COMMITS)


def test_log_order(spark):
    # e and d share a second; b is newer than its child c; the parent of a is missing
    rows = commits(spark, [("e", ["d"], 50), ("d", ["c"], 50), ("c", ["b", "a"], 30), ("b", ["a"], 60), ("a", ["gone"], 10), ("x", [], 99)])
    tips = spark.createDataFrame([("r", "e"), ("r", "absent")], "repo_id string, oid string")
    assert [r.oid for r in log.log(rows, tips).orderBy("rank").collect()] == ["b", "e", "d", "c", "a"]
    assert [r.oid for r in log.log(rows, tips, order="traversal").orderBy("rank").collect()] == ["e", "d", "c", "b", "a"]
    assert {r.oid: r.depth for r in log.reachable(rows, tips).collect()} == {"e": 0, "d": 1, "c": 2, "b": 3, "a": 4}
    assert {r.oid for r in log.reachable_by_rounds(rows, tips).collect()} == set("edcba")
    assert [r.oid for r in log.first_parent_chain(rows, tips).orderBy("depth").collect()] == list("edcba")
    assert [r.oid for r in log.log(rows, tips, spread=True).orderBy("rank").collect()] == ["b", "e", "d", "c", "a"]
    with pytest.raises(ValueError):
        log.log(rows, tips, order="traversal", spread=True)


def test_contracted_graph_equals_the_walk(spark):
    rng, rows, tips, want = random.Random(5), [], [], {}
    for repo in ("p", "q", "s"):
        n = 150
        parents = {i: sorted({i + 1} | ({min(n, i + rng.randint(2, 30))} if rng.random() < 0.1 else set())) if rng.random() < 0.98 else [] for i in range(n)}
        start = [0] + rng.sample(range(n), 2 if repo != "s" else 0)
        rows += [(repo, f"c{i}", "t", [f"c{p}" for p in ps] * (1 + (i % 40 == 0)), 0, 1000 - i + rng.randint(0, 3), "") for i, ps in parents.items()]
        tips += [(repo, f"c{i}") for i in start]
        far = {i: 0 for i in start}
        for i in range(n):  # parents have greater numbers
            for p in parents[i] if i in far else []:
                if p < n:
                    far[p] = max(far.get(p, 0), far[i] + 1)
        want |= {(repo, f"c{i}"): d for i, d in far.items()}
    frame, asked = spark.createDataFrame(rows, COMMITS), spark.createDataFrame(tips, "repo_id string, oid string")
    assert {(r.repo_id, r.oid): r.depth for r in log.reachable_contracted(frame, asked).collect()} == want
    whole, spread = ([tuple(r) for r in log.log(frame, asked, spread=x).select("repo_id", "rank", "oid", "depth").orderBy("repo_id", "rank").collect()] for x in (False, True))
    assert whole == spread
    assert log.reachable_contracted(frame, asked.limit(0)).count() == 0


def test_symbolic_refs(spark):
    rows = [("r", f"n{i}", None, f"n{i + 1}", "loose") for i in range(6)] + [("r", "n6", "1" * 40, None, "loose"), ("r", "loop", None, "loop", "loose"), ("r", "dangling", None, "no", "loose"), ("r", "both", "2" * 40, None, "packed"), ("r", "both", "3" * 40, None, "loose")]
    got = {r.name: (r.oid, r.error) for r in refs.resolve_refs(spark.createDataFrame(rows, "repo_id string, name string, oid string, symref_target string, source string")).collect()}
    assert got["n1"] == ("1" * 40, None) and got["n0"] == (None, "SymrefTooDeep") and got["loop"][1] == "SymrefTooDeep" and got["dangling"][1] == "NotFound" and got["both"][0] == "3" * 40


@pytest.mark.parametrize(
    "path,error",
    [("src/foo.c", None), ("a:b", None), ("../x", "PathTraversal"), ("a/../b", "PathTraversal"), ("/x", "AbsolutePath"), ("C:\\x", "AbsolutePath"), ("", "InvalidPath"), ("a\\b", "InvalidPath"), ("a//b", "InvalidPath"), ("a/", "InvalidPath"), ("./a", "InvalidPath"), ("a\0b", "InvalidPath"), ("x" * 4097, "PathTooLong"), ("x" * 4096, None), ("a//..", "InvalidPath")],
)
def test_paths(spark, path, error):
    assert spark.createDataFrame([(path,)], "p string").select(scalar.path_error(F.col("p"))).first()[0] == error


@pytest.mark.parametrize("name,ok", [("refs/heads/main", True), ("refs/tags/v1.0", True), ("HEAD", True), ("a//b", True), ("x@{1}", True), ("-x", False), (".x", False), ("x/", False), ("x.", False), ("a b", False), ("a\\b", False), ("a/.b", False), ("@", False), ("a.lock", False), ("a..b", False), ("a\x7f", False), ("a\x01", False), ("", False)])
def test_ref_names(spark, name, ok):
    assert (spark.createDataFrame([(name,)], "p string").select(scalar.ref_name_error(F.col("p"))).first()[0] is None) == ok


def test_walk_limit_and_submodules(spark):
    rows = [("r", "root", 0, "directory", "d", "t1"), ("r", "t1", 0, "directory", "d", "t2"), ("r", "t2", 0, "submodule", "s", "c"), ("r", "root", 1, "symlink", "l", "b")]
    entries = spark.createDataFrame(rows, "repo_id string, tree_oid string, ordinal int, mode string, name string, oid string")
    roots = spark.createDataFrame([("r", "root")], "repo_id string, root_tree string")
    assert [r.path for r in trees.in_walk_order(trees.walk_trees(entries, roots)).orderBy("rank").collect()] == ["d", "d/d", "d/d/s", "l"]
    with pytest.raises(LimitExceeded):
        trees.walk_trees(entries, roots, depth_max=1)


def test_missing_trees(spark):
    rows = [("r", "root", 0, "directory", "d", "t1"), ("r", "root", 1, "directory", "e", trees.EMPTY_TREE), ("r", "old", 0, "directory", "d", "t0"), ("r", "t0", 0, "file", "x", "b")]
    entries = spark.createDataFrame(rows, "repo_id string, tree_oid string, ordinal int, mode string, name string, oid string")
    roots = spark.createDataFrame([("r", "root")], "repo_id string, root_tree string")
    pair = spark.createDataFrame([("r", "old", "root"), ("r", "gone", "old")], "repo_id string, old_tree string, new_tree string")
    for f in (lambda: trees.walk_trees(entries, roots), lambda: treediff.diff_trees(entries, pair)):
        with pytest.raises(NotFound):
            f()
    got = {(r.path, r.mode, r.error) for r in trees.walk_trees(entries, roots, mode="PERMISSIVE").collect()}
    assert got == {("d", "directory", None), ("e", "directory", None), ("d", None, "NotFound")}
    got = {(r.old_tree, r.kind, r.path, r.old_oid, r.new_oid) for r in treediff.diff_trees(entries, pair, mode="PERMISSIVE").collect()}
    assert got == {("old", "error", "d", None, "t1"), ("old", "deleted", "d/x", "b", None), ("gone", "error", "", "gone", None), ("gone", "added", "d/x", None, "b")}


def test_delta_rounds_limits(spark):
    from chronolith.functions import codec

    schema = "repo_id string, pack string, offset long, oid string, type string, size long, base_offset long, base_oid string, data binary"
    step = codec.make_delta(b"x", b"x")
    chain = [("r", "p", 0, "o0", "blob", 1, None, None, b"x")] + [("r", "p", i, f"o{i}", "ref_delta" if i % 2 else "ofs_delta", 1, None if i % 2 else i - 1, f"o{i - 1}" if i % 2 else None, step) for i in range(1, 5)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert {r.oid: r.hops for r in objects.resolve_deltas(frame(chain), depth_max=4).collect()} == {f"o{i}": i for i in range(5)}
    with pytest.raises(LimitExceeded):
        objects.resolve_deltas(frame(chain), depth_max=3)
    circle = [("r", "p", 9, "c1", "ref_delta", 1, None, "c2", step), ("r", "p", 10, "c2", "ref_delta", 1, None, "c1", step)]
    with pytest.raises(NotFound):
        objects.resolve_deltas(frame(chain + circle))
    got = objects.resolve_deltas(frame(chain + circle), depth_max=9, mode="PERMISSIVE").collect()
    assert {(r.oid, r.error) for r in got if r.error} == {("c1", "NotFound"), ("c2", "NotFound")} and len(got) == 7
    assert sorted(r.oid for r in objects.resolve_deltas(frame(chain), depth_max=3, mode="PERMISSIVE").collect() if r.error == "LimitExceeded") == ["o4"]


def test_blame_of_delete_and_return(spark):
    rows = [("r", "f", i, f"c{i}", lines) for i, lines in enumerate((["a", "b"], ["b"], ["a", "b", "c"], []))]
    schema = "repo_id string, path string, seq int, commit string, lines array<string>"
    assert blame.blame(spark.createDataFrame(rows, schema)).count() == 0
    got = blame.blame(spark.createDataFrame(rows[:3], schema)).orderBy("line_no").collect()
    assert [(r.line, r.blame_oid) for r in got] == [("a", "c2"), ("b", "c0"), ("c", "c2")]


def test_index_errors(spark):
    entries = spark.createDataFrame([], "repo_id string, tree_oid string, ordinal int, mode string, name string, oid string")
    none = spark.createDataFrame([], "repo_id string, name string, oid string, symref_target string, source string")
    with pytest.raises(NotFound):
        index.build_index(commits(spark, [("a", ["gone"], 1)]), entries, none)
    with pytest.raises(LimitExceeded):
        index.build_index(commits(spark, [("a", ["a"] * 256, 1)]), entries, none)
    assert index.build_index(commits(spark, []), entries, none).count() == 0


def test_index_files(spark):
    from chronolith.functions import codec

    rows = [("r", f"{i:040x}", "a" * 40, 5 - i, [f"{i + 1:040x}"] * i, ["x"] * (i > 0), codec.bloom_build(["x"] * (i > 0)), "b" * 40) for i in range(3)]
    made = spark.createDataFrame(rows, "repo_id string, oid string, tree string, committer_time long, parents array<string>, changed_paths array<string>, bloom binary, ref_tips_digest string")
    files = index.pack_index(made)
    data = bytes(files.first().data)
    assert data[:10] == b"ZIDX\1\0\3\0\0\0" and data[10:30] == b"\xbb" * 20 and len(data) == 30 + 3 * 53 + 20 * 3 + 2 * 2
    got = index.unpack_index(files).orderBy("oid").collect()
    assert [(r.oid, r.tree, r.committer_time, r.parents, bytes(r.bloom), r.ref_tips_digest) for r in got] == [(r[1], r[2], r[3], r[4], r[6], r[7]) for r in rows]
    for bad in (b"", data[:-1], b"X" + data[1:], data[:4] + b"\2" + data[5:]):
        with pytest.raises(codec.MalformedObject):
            codec.read_index(bad)
    with pytest.raises(Exception, match="LimitExceeded"):
        index.pack_index(made, limit=100).collect()


def test_malformed_commits(spark):
    t = "a" * 40
    rows = [("r", "ok", "commit", f"tree {t}\ncommitter C <c> 7 -0100\n\nm".encode()), ("r", "tree", "commit", b"tree abc\ncommitter C 1 +0\n\n"), ("r", "parent", "commit", f"tree {t}\nparent abc\ncommitter C 1 +0\n\n".encode()), ("r", "time", "commit", f"tree {t}\ncommitter C\n\n".encode()), ("r", "blank", "commit", f"tree {t}\ncommitter C 1 +0\n".encode())]
    frame = spark.createDataFrame(rows, "repo_id string, oid string, type string, content binary")
    assert {r.oid: r.error for r in objects.commits_of(frame, "PERMISSIVE").collect()} == {"ok": None, "tree": "MalformedObject", "parent": "MalformedObject", "time": "MalformedObject", "blank": "MalformedObject"}
    assert [(r.oid, r.author_time, r.committer_time, r.parents) for r in objects.commits_of(frame, "DROPMALFORMED").collect()] == [("ok", 0, 7, [])]
    with pytest.raises(Exception, match="MalformedObject"):
        objects.commits_of(frame).collect()


def test_line_ops_column(spark):
    frame = linediff.diff_lines(spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, None, ["x"]), (3, [], [])], "id int, old_lines array<string>, new_lines array<string>"))
    got = [(r.id, r.op, r.a_idx, r.b_idx) for r in linediff.explode_ops(frame, "id").orderBy("id", "seq").collect()]
    assert got == [(1, "delete", 0, None), (1, "equal", 1, 0), (1, "insert", None, 1), (2, "insert", None, 0)]


def test_stream(spark, tmp_path):
    t = "a" * 40
    rows = [("r", f"{i:040x}", "commit", 0, f"tree {t}\ncommitter C <c> {1_700_000_000 + i * 40_000} +0000\n\nm".encode(), "loose") for i in range(10)]
    spark.createDataFrame(rows + rows[:3], "repo_id string, oid string, type string, size long, content binary, storage string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = tail.commit_stream(source).writeStream.format("memory").queryName("commits_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("commits_seen").count() == 10
    windows = tail.commits_per_window(spark.table("commits_seen")).collect()
    assert sum(r.n_commits for r in windows) == 10 and len(windows) > 3


def test_event_trees_hold_every_type(spark):
    from chronolith.plans import adapters

    rows = [(i, 1 + i % 2, f"2024-01-01 00:{i // 60:02}:{i % 60:02}", f"type{i % 75:03}") for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).persist()
    commits, entries = adapters.event_trees(events)
    named = adapters.event_tips(events).selectExpr("repo_id", "'HEAD' name", "oid", "cast(null as string) symref_target", "'loose' source")
    got = {r.oid: r.changed_paths for r in index.build_index(commits, entries, named).collect()}
    own = {r.oid: (r.event_type, len(r.parents)) for r in commits.collect()}
    assert len(got) == 200 and all(got[o] == ([t] if n else []) for o, (t, n) in own.items())
    trees = {r.oid: r.tree for r in commits.collect()}
    last = next(r.oid for r in commits.filter("event_id = 199").collect())
    assert entries.filter(F.col("tree_oid") == trees[last]).count() == len({t for i, u, _, t in rows if u == 2})
