"""The data source and the operators on real repositories, against the git command."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolith.operators import index, log, objects, refs, treediff
from chronolith.repo import open_repo
from tests.repos import Repo


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("repos") / "one")
    r.put("README.md", "hello\nworld\n")
    r.put("data.txt", "".join(f"base line {i}\n" for i in range(20)))
    r.put("a/b/c/leaf.txt", "deep\n")
    r.put("foo", "file\n")
    r.put("empty.txt", "")
    r.commit("initial")
    r.put("data.txt", "".join(f"{'modified' if i == 9 else 'base'} line {i}\n" for i in range(20)))
    r.commit("v2")
    r.git("checkout", "-q", "-b", "side")
    r.put("side.txt", "s\n")
    r.commit("side 1")
    r.git("checkout", "-q", "main")
    (r.path / "foo").unlink()
    r.put("foo/child.txt", "c\n")
    r.put("data.txt", "".join(f"{'modified' if i in (9, 14) else 'base'} line {i}\n" for i in range(20)) + "end")
    r.commit("v3")
    r.clock += 60
    r.git("merge", "-q", "--no-ff", "-m", "merge side", "side", GIT_AUTHOR_DATE=f"{r.clock} +0000", GIT_COMMITTER_DATE=f"{r.clock} +0000")
    r.git("gc", "-q")
    r.git("tag", "-a", "v1.0", "-m", "t")
    (r.path / "README.md").chmod(0o755)
    r.put("a/new.txt", "n\n")
    (r.path / "empty.txt").unlink()
    r.commit("last")
    r.git("symbolic-ref", "refs/heads/alias", "refs/heads/main")
    return r


@pytest.fixture(scope="module")
def frames(spark, made):
    return open_repo(spark, str(made.path), verify="full")


def test_objects_are_those_of_git(frames, made):
    want = {tuple(line.split()) for line in made.git("cat-file", "--batch-all-objects", "--batch-check").splitlines()}
    got = {(r.oid, r.type, str(r.size)) for r in frames.objects.collect()}
    assert got == want
    assert {r.storage for r in frames.objects.select("storage").distinct().collect()} == {"loose", "pack"}


def test_delta_rounds_equal_chains(frames):
    entries = frames.read("pack_entries")
    assert entries.filter(objects.is_delta()).count()
    resolved = {(r.oid, r.type, bytes(r.content)) for r in objects.resolve_deltas(entries).collect()}
    packed = {(r.oid, r.type, bytes(r.content)) for r in frames.objects.filter("storage = 'pack'").collect()}
    assert resolved == packed
    assert frames.read("pack_index").count() == len(packed)


def test_pushed_filters(frames):
    oid = frames.head.first().oid
    one = frames.read("objects").filter(F.col("oid") == oid)
    assert [r.type for r in one.collect()] == ["commit"]
    assert "EqualTo" not in one._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert {r.type for r in frames.read("objects").filter("type in ('tree', 'tag')").collect()} == {"tree", "tag"}


def test_log(frames, made):
    want = [line.split(" ", 2) for line in made.git("log", "--date-order", "--format=%H %ct %s").splitlines()]
    got = frames.log().orderBy("rank").collect()
    assert [(r.oid, str(r.committer_time), r.message.strip()) for r in got] == [tuple(w) for w in want]
    assert [r.oid for r in frames.log(order="traversal", offset=1, limit=2).orderBy("rank").collect()] == [w[0] for w in want[1:3]]
    assert {r.oid for r in log.reachable_by_rounds(frames.commits, frames.head).collect()} == {w[0] for w in want}
    chain = made.git("log", "--first-parent", "--format=%H").split()
    assert [r.oid for r in log.first_parent_chain(frames.commits, frames.head).orderBy("depth").collect()] == chain


def test_walk_and_find(frames, made):
    want = [line.split("\t") for line in made.git("ls-tree", "-r", "-t", "HEAD").splitlines()]
    got = frames.walk().orderBy("rank").collect()
    assert [(r.path, r.oid) for r in got] == [(p, meta.split()[2]) for meta, p in want]
    from chronolith.operators.trees import find_paths

    root = frames.head.join(frames.commits, ["repo_id", "oid"]).selectExpr("repo_id", "tree root_tree")
    asked = root.crossJoin(root.sparkSession.createDataFrame([("a/b/c/leaf.txt",), ("a/b",), ("nope",), ("README.md",), ("README.md/x",)], "path string"))
    found = {r.path: r.oid for r in find_paths(frames.tree_entries, asked).collect()}
    by = {p: meta.split()[2] for meta, p in want}
    assert found == {"a/b/c/leaf.txt": by["a/b/c/leaf.txt"], "a/b": None, "nope": None, "README.md": by["README.md"], "README.md/x": None}


def test_diff_of_every_commit(frames, made):
    for c in frames.commits.filter("size(parents) > 0").collect():
        raw = made.git("diff-tree", "-r", "--no-renames", c.parents[0], c.oid).splitlines()
        want = set()
        for line in raw:
            meta, path = line.split("\t")
            old_mode, new_mode, old, new, kind = meta.lstrip(":").split()
            if kind == "A" or kind == "D" or (kind in "MT" and old_mode != new_mode):
                want |= ({("deleted", path, old, None)} if kind != "A" else set()) | ({("added", path, None, new)} if kind != "D" else set())
            else:
                want.add(("modified", path, old, new))
        old_tree = frames.commits.filter(F.col("oid") == c.parents[0]).first().tree
        got = {(r.kind, r.path, r.old_oid, r.new_oid) for r in frames.diff(frames.spark.createDataFrame([(c.repo_id, old_tree, c.tree)], "repo_id string, old_tree string, new_tree string")).collect()}
        assert got == want


def test_blame(frames, made):
    indexed = frames.index().persist()
    for path in ("data.txt", "foo/child.txt", "side.txt"):
        want = [line.split(" ")[0].lstrip("^") for line in made.git("blame", "-l", "--root", "--first-parent", path).splitlines()]
        got = frames.blame(path).orderBy("line_no").collect()
        assert [r.blame_oid for r in got] == want
        for exact in (True, False):
            assert [r.blame_oid for r in frames.blame(path, index=indexed, exact=exact).orderBy("line_no").collect()] == want
    with pytest.raises(Exception, match="NotFound: nope"):
        frames.blame("nope").collect()
    assert [r.line for r in frames.blame("data.txt").orderBy("line_no").collect()] == (made.path / "data.txt").read_text().splitlines()


def test_blob_diff(frames, made, spark):
    old, new = (made.git("rev-parse", f"{c}:data.txt").strip() for c in ("HEAD~3", "HEAD"))
    repo = str(made.path)
    tree = made.git("rev-parse", "HEAD^{tree}").strip()
    rows = lambda *r: spark.createDataFrame([(repo, *x) for x in r], "repo_id string, old_oid string, new_oid string")
    for bad, error in ((tree, "MalformedObject"), ("0" * 40, "NotFound")):
        with pytest.raises(Exception, match=error):
            frames.diff_blobs(rows((old, new), (bad, new))).collect()
    assert open_repo(spark, repo, mode="PERMISSIVE").diff_blobs(rows((old, new), (tree, new), ("0" * 40, new))).count() == 1
    got = frames.diff_blobs(rows((old, new))).collect()
    assert [r.new_oid for r in got] == [new]
    changed = [(o.op, o.a_idx, o.b_idx) for o in got[0].ops if o.op != "equal"]
    assert changed == [("delete", 14, None), ("insert", None, 14), ("insert", None, 20)]


def test_refs(frames, made):
    want = {tuple(line.split(" ")) for line in made.git("for-each-ref", "--format=%(refname) %(objectname)").splitlines()} | {("HEAD", made.git("rev-parse", "HEAD").strip())}
    assert {(r.name, r.oid) for r in refs.resolve_refs(frames.refs).collect()} == want
    assert {r.oid for r in frames.tips.collect()} == {made.git("rev-parse", f"{n}^{{commit}}").strip() for n, _ in want}


def test_index(frames, spark, made, tmp_path):
    built = frames.index().persist()
    assert built.count() == int(made.git("rev-list", "--all", "--count"))
    index.write_index(built, str(tmp_path / "i"))
    assert index.open_index(spark, str(tmp_path / "i"), frames.refs).count() == built.count()
    moved = frames.refs.filter("name <> 'refs/tags/v1.0'")
    assert index.open_index(spark, str(tmp_path / "i"), moved).count() == 0
    asked = built.select("repo_id", "oid", F.explode("changed_paths").alias("path"))
    assert index.might_contain(asked, built, exact=False).filter("not might_contain").count() == 0
    other = spark.createDataFrame([(str(made.path), "0" * 40, "x")], "repo_id string, oid string, path string")
    assert index.might_contain(other, built).first().might_contain


def test_errors(spark, tmp_path):
    from chronolith.errors import NotAGitRepo

    with pytest.raises(NotAGitRepo):
        open_repo(spark, str(tmp_path))
    r = Repo(tmp_path / "bad")
    r.put("x", "1\n")
    r.commit("c")
    some = next((r.path / ".git/objects").glob("??/*"))
    some.chmod(0o644)
    some.write_bytes(some.read_bytes()[:-3])
    rows = open_repo(spark, str(r.path), mode="PERMISSIVE").read("objects").collect()
    assert Counter(x.error for x in rows) == {"CorruptedObject": 1, None: 2}
    with pytest.raises(Exception, match="CorruptedObject"):
        open_repo(spark, str(r.path)).read("objects").collect()


def test_bad_packs(spark, tmp_path):
    r = Repo(tmp_path / "p")
    for i in range(3):
        r.put("x", f"{i}\n" * 50)
        r.commit(f"c{i}")
    r.git("gc", "-q")
    r.put("x", "loose\n")
    r.commit("last")
    pack = next((r.path / ".git/objects/pack").glob("*.pack"))
    idx = pack.with_suffix(".idx")
    whole, index = pack.read_bytes(), idx.read_bytes()
    for path, bad in ((pack, whole[:50] + bytes([whole[50] ^ 1]) + whole[51:]), (idx, index[:900]), (pack, b"JUNK" + whole[4:])):
        path.chmod(0o644)
        path.write_bytes(bad)
        rows = open_repo(spark, str(r.path), mode="PERMISSIVE").read("objects").collect()
        assert Counter(x.error for x in rows if x.storage == "loose") == {None: 3}
        assert [x.oid for x in rows if x.error in ("CorruptedObject", "MalformedObject")] == [None]
        for table in ("pack_entries", "pack_index"):
            assert open_repo(spark, str(r.path), mode="PERMISSIVE").read(table).filter("error is not null").count() == 1
        with pytest.raises(Exception, match="CorruptedObject|MalformedObject"):
            open_repo(spark, str(r.path)).read("objects").collect()
        pack.write_bytes(whole)
        idx.chmod(0o644)
        idx.write_bytes(index)
    assert open_repo(spark, str(r.path)).objects.count() == 12
    assert open_repo(spark, f"file://{tmp_path}/*").objects.count() == 12


def test_many_ranges_and_bases_elsewhere(spark, tmp_path, monkeypatch):
    """A pack in ranges of one object each, whose bases by id lie in another pack and in loose files."""
    from chronolith.functions import codec
    from chronolith.sources import files

    r = Repo(tmp_path / "q")
    texts = [("blob", b"line\n" * 30 + str(i).encode()) for i in range(6)]
    one, one_idx = codec.write_pack(texts[:1])
    two, two_idx = codec.write_pack(texts, True, True)
    at = codec.PackIndex(two_idx)
    where = r.path / ".git/objects/pack"
    where.mkdir(exist_ok=True)
    for name, pack, idx in (("a", one, one_idx), ("b", two, two_idx)):
        (where / f"pack-{name}.pack").write_bytes(pack)
        (where / f"pack-{name}.idx").write_bytes(idx)
    monkeypatch.setattr("chronolith.sources.gitrepo.RANGE", 1)
    monkeypatch.setattr(files, "PIECE", 64)
    frames = open_repo(spark, str(r.path), verify="full")
    assert {(x.type, bytes(x.content)) for x in frames.objects.collect()} == set(texts)
    assert frames.read("pack_entries").filter("type = 'ref_delta'").count() == 5 == at.n - 1


def test_index_opened_or_built(spark, made, tmp_path):
    frames = open_repo(spark, str(made.path))
    path = str(tmp_path / "idx")
    n = frames.open_index(path).count()
    made.git("tag", "extra", "HEAD~1")
    made.git("branch", "more", "HEAD")
    again = open_repo(spark, str(made.path))
    assert index.open_index(spark, path, again.refs).count() == 0 or n == 0
    assert again.open_index(path).count() == n
    made.git("tag", "-d", "extra")
    made.git("branch", "-D", "more")


def test_binary_blobs_leave_text_alone(spark, tmp_path):
    r = Repo(tmp_path / "bin")
    (r.path / "x.bin").write_bytes(bytes(range(256)))
    r.put("t.txt", "a\nb\n")
    r.commit("c")
    frames = open_repo(spark, str(r.path))
    assert frames.blame("t.txt").count() == 2
    assert frames.walk().count() == 2
    assert open_repo(spark, str(r.path), textEncoding="ISO-8859-1").blame("x.bin").count() == bytes(range(256)).count(b"\n") + 1
    with pytest.raises(Exception):  # noqa: B017
        frames.blame("x.bin").collect()


def test_empty(spark, tmp_path):
    r = Repo(tmp_path / "none")
    f = open_repo(spark, str(r.path))
    assert f.objects.count() == 0
    assert f.log().count() == 0
    assert refs.ref_tips(f.refs).count() == 0
    assert treediff.diff_trees(f.tree_entries, spark.createDataFrame([("r", None, None)], "repo_id string, old_tree string, new_tree string")).count() == 0
