"""Repositories on disk made of the driver's conversations, and queries that read them through the data source.

Hundred conversations share a repository, so that the rows of one are bounded. Its commit k holds each conversation's
file talk/c<id>.txt with the turns up to k, and the first one's again as chat.txt. Objects lie in two packs, one with
deltas by offset and one with deltas by id, and those of the last commit loose; main is a loose ref that hides a packed one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import codec
from chronolith.operators import objects, refs
from chronolith.plans.adapters import table
from chronolith.plans.catalog import query
from chronolith.schemas import LIMITS
from chronolith.repo import RepoFrames, open_repo
from chronolith.sources.files import Store
from chronolith.workspace import Workspace

START, STEP, SHARED = 1_700_000_000, 60, 100


def versions(rows: list[tuple[int, int, str]]) -> list[list[tuple[str, bytes]]]:
    """(conv_id, turn, text) of one repository -> the objects of each commit, the commit itself last."""
    first, out, parent = min(r[0] for r in rows), [], None
    for k in range(max(r[1] for r in rows) + 1):
        files: dict[int, str] = {}
        for conv, turn, text in sorted(rows):
            if turn <= k:
                files[conv] = files.get(conv, "") + (text if text.endswith("\n") or not text else text + "\n")
        blobs = {conv: ("blob", body.encode()) for conv, body in files.items()}
        talk = "tree", codec.write_tree([("file", f"c{conv}.txt", codec.object_id(*b)) for conv, b in blobs.items()])
        chat = [("file", "chat.txt", codec.object_id(*blobs[first]))] if first in blobs else []
        root = "tree", codec.write_tree([*chat, ("directory", "talk", codec.object_id(*talk))])
        when = START + STEP * k
        head = f"tree {codec.object_id(*root)}\n" + (f"parent {parent}\n" if parent else "")
        commit = "commit", f"{head}author A <a@example.com> {when} +0000\ncommitter C <c@example.com> {when} +0000\n\nv{k}\n".encode()
        parent = codec.object_id(*commit)
        out.append([*blobs.values(), talk, root, commit])
    return out


def write_repository(path: str, made: list[list[tuple[str, bytes]]]) -> None:
    """A bare repository of the versions."""
    store = Store(path)

    def put(name: str, data: bytes) -> None:
        store.fs.create_dir(store.at(name).rsplit("/", 1)[0], recursive=True)
        with store.fs.open_output_stream(store.at(name)) as f:
            f.write(data)

    for name, by_id in (("a", False), ("b", True)):
        chosen = {codec.object_id(*o): o for k, each in enumerate(made[:-1]) if k % 2 == by_id for o in each}
        if chosen:
            ordered = sorted(chosen.values(), key=lambda o: o[0])
            pack, idx = codec.write_pack(ordered, True, by_id, longest=LIMITS["delta_depth_max"])
            put(f"objects/pack/pack-{name}.pack", pack)
            put(f"objects/pack/pack-{name}.idx", idx)
    for o in made[-1]:
        oid = codec.object_id(*o)
        put(f"objects/{oid[:2]}/{oid[2:]}", codec.loose_bytes(*o))
    commits = [codec.object_id(*each[-1]) for each in made]
    put("HEAD", b"ref: refs/heads/main\n")
    put("refs/heads/main", f"{commits[-1]}\n".encode())
    put("packed-refs", f"# pack-refs with: peeled\n{commits[0]} refs/heads/main\n{commits[0]} refs/tags/first\n".encode())


def repositories(spark: SparkSession, sf_dir: str, **options) -> tuple[RepoFrames, Workspace]:
    work = Workspace(spark, "repos")

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        path = f"{where}/{key[0].as_py()}"
        write_repository(path, versions(list(zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "text")), strict=True))))
        return pa.table({"path": [path]})

    where = work.at("git")
    talks = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").select(F.floor(F.col("conv_id") / SHARED).alias("g"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    talks.groupBy("g").applyInArrow(each, "path string").write.format("noop").mode("overwrite").save()
    return open_repo(spark, where + "/*", **options), work


def numbered(rows: DataFrame) -> DataFrame:
    """repo_id -> repo, the number that ends its path."""
    return rows.withColumn("repo", F.element_at(F.split("repo_id", "/"), -1).cast("long"))


BODY = "CASE WHEN text LIKE '%' || chr(10) OR coalesce(text, '') = '' THEN coalesce(text, '') ELSE text || chr(10) END"
MADE = f"""WITH RECURSIVE t AS (SELECT conv_id // {SHARED} AS repo, conv_id, turn, {BODY} AS body FROM conversations),
    m AS (SELECT repo, max(turn) AS most, min(conv_id) AS lead FROM t GROUP BY repo), ks AS (SELECT repo, lead, most, unnest(range(most + 1)) AS k FROM m),
    f AS (SELECT repo, lead, most, k, conv_id, string_agg(body, '' ORDER BY turn) AS text FROM t JOIN ks USING (repo) WHERE turn <= k GROUP BY ALL),
    b AS (SELECT *, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM f),
    h1 AS (SELECT repo, k, string_agg(hex('100644 c' || conv_id || '.txt') || '00' || oid, '' ORDER BY 'c' || conv_id || '.txt') AS h, max(oid) FILTER (conv_id = lead) AS chat FROM b GROUP BY repo, k),
    t1 AS (SELECT *, sha1(unhex(hex('tree ' || len(h) // 2) || '00' || h)) AS talk FROM h1),
    h2 AS (SELECT repo, k, talk, chat, coalesce(hex('100644 chat.txt') || '00' || chat, '') || hex('40000 talk') || '00' || talk AS h FROM t1),
    t2 AS (SELECT *, sha1(unhex(hex('tree ' || len(h) // 2) || '00' || h)) AS root, ' ' || ({START} + {STEP} * k) || ' +0000' AS stamp FROM h2),
    c AS (SELECT repo, k, sha1('commit ' || strlen(x) || chr(0) || x) AS oid FROM (SELECT repo, k, 'tree ' || root || chr(10) || 'author A <a@example.com>' || stamp || chr(10) || 'committer C <c@example.com>' || stamp || chr(10) || chr(10) || 'v' || k || chr(10) AS x FROM t2 WHERE k = 0)
        UNION ALL SELECT repo, k, sha1('commit ' || strlen(x) || chr(0) || x) FROM (SELECT t2.repo, t2.k, 'tree ' || root || chr(10) || 'parent ' || c.oid || chr(10) || 'author A <a@example.com>' || stamp || chr(10) || 'committer C <c@example.com>' || stamp || chr(10) || chr(10) || 'v' || t2.k || chr(10) AS x FROM t2 JOIN c ON c.repo = t2.repo AND t2.k = c.k + 1)),
    ob AS (SELECT DISTINCT repo, k, oid, 'blob' AS type FROM b UNION SELECT repo, k, talk, 'tree' FROM t1 UNION SELECT repo, k, root, 'tree' FROM t2 UNION SELECT repo, k, oid, 'commit' FROM c),
    tip AS (SELECT c.repo, c.oid, c.k FROM c JOIN m ON m.repo = c.repo AND m.most = c.k)"""


@query(f"{MADE} SELECT DISTINCT repo, oid, type FROM ob")
def repo_objects(spark, sf_dir):
    """Loose and packed objects with both kinds of deltas, every one hashed again."""
    frames, _ = repositories(spark, sf_dir, verify="full")
    return numbered(frames.objects).select("repo", "oid", "type")


@query(f"{MADE} SELECT DISTINCT repo, oid, type, 'loose' AS storage FROM ob JOIN m USING (repo) WHERE k = most UNION ALL SELECT DISTINCT repo, oid, type, 'pack-' || chr(97 + (k % 2)::INT) FROM ob JOIN m USING (repo) WHERE k < most")
def repo_storages(spark, sf_dir):
    """Each storage on its own: the index of every pack, and the loose files."""
    frames, _ = repositories(spark, sf_dir)
    kinds = frames.read("objects").select("repo_id", "oid", "type").distinct()
    loose = frames.read("objects").filter("storage = 'loose'").select("repo_id", "oid", "type", "storage")
    packed = frames.read("pack_index").join(kinds, ["repo_id", "oid"]).selectExpr("repo_id", "oid", "type", "pack storage")
    return numbered(loose.union(packed)).select("repo", "oid", "type", "storage")


@query(f"{MADE} SELECT DISTINCT b.repo, b.oid, strlen(text)::BIGINT AS size FROM b JOIN m USING (repo) WHERE k = m.most")
def repo_lookup(spark, sf_dir):
    """The blobs of the last commit, looked up among all objects."""
    frames, _ = repositories(spark, sf_dir)
    return numbered(objects.lookup(frames.objects, frames.walk().filter("mode = 'file'"))).select("repo", "oid", "size")


@query(f"{MADE} SELECT repo, 'HEAD' AS name, NULL::VARCHAR AS oid, 'refs/heads/main' AS symref_target, 'loose' AS source FROM m UNION ALL SELECT repo, 'refs/heads/main', oid, NULL, 'loose' FROM tip UNION ALL SELECT repo, n, oid, NULL, 'packed' FROM c, (SELECT unnest(['refs/heads/main', 'refs/tags/first']) AS n) WHERE k = 0")
def repo_refs(spark, sf_dir):
    return numbered(repositories(spark, sf_dir)[0].refs).select("repo", "name", "oid", "symref_target", "source")


@query(f"{MADE} SELECT repo, 'HEAD' AS name, oid FROM tip UNION ALL SELECT repo, 'refs/tags/first', oid FROM c WHERE k = 0")
def repo_head(spark, sf_dir):
    """HEAD resolved, and the refs below a prefix."""
    frames, _ = repositories(spark, sf_dir)
    head = refs.resolve_head(frames.refs).select("repo_id", "name", "oid")
    return numbered(head.union(refs.refs_under(frames.refs, "refs/tags/").select("repo_id", "name", "oid"))).select("repo", "name", "oid")


@query(f"{MADE} SELECT c.repo, c.oid, {START} + {STEP} * k AS committer_time, 'v' || k || chr(10) AS message, most - k AS rank FROM c JOIN m USING (repo)")
def repo_log(spark, sf_dir):
    return numbered(repositories(spark, sf_dir)[0].log()).select("repo", "oid", "committer_time", "message", F.col("rank").cast("long").alias("rank"))


@query(
    f"""{MADE}, w AS (SELECT b.repo, 'talk/c' || conv_id || '.txt' AS path, 'file' AS mode, oid FROM b JOIN m USING (repo) WHERE k = m.most UNION ALL SELECT repo, 'talk', 'directory', talk FROM t1 JOIN m USING (repo) WHERE k = most UNION ALL SELECT repo, 'chat.txt', 'file', chat FROM t1 JOIN m USING (repo) WHERE k = most)
    SELECT repo, path, mode, oid, row_number() OVER (PARTITION BY repo ORDER BY path || CASE WHEN mode = 'directory' THEN '/' ELSE '' END) - 1 AS rank FROM w"""
)
def repo_walk(spark, sf_dir):
    return numbered(repositories(spark, sf_dir)[0].walk()).select("repo", "path", "mode", "oid", F.col("rank").cast("long").alias("rank"))


BLAMED = f"""{MADE}, l AS (SELECT t.repo, turn, string_split(body, chr(10))[:-2] AS a FROM t JOIN m ON m.repo = t.repo AND m.lead = t.conv_id WHERE body <> ''),
    u AS (SELECT repo, turn, unnest(a) AS line, unnest(range(len(a))) AS i FROM l)
    SELECT u.repo, row_number() OVER (PARTITION BY u.repo ORDER BY turn, i) - 1 AS line_no, line, oid AS blame_oid FROM u JOIN c ON c.repo = u.repo AND c.k = u.turn"""


@query(BLAMED)
def repo_blame(spark, sf_dir):
    rows = repositories(spark, sf_dir)[0].blame("chat.txt")
    return numbered(rows).select("repo", F.col("line_no").cast("long").alias("line_no"), "line", "blame_oid")


@query(BLAMED)
def repo_blame_filtered(spark, sf_dir):
    """As repo_blame, the commits chosen by the Bloom filters of an index that was written and opened again."""
    frames, work = repositories(spark, sf_dir)
    rows = frames.blame("chat.txt", index=frames.open_index(work.at("index")), exact=False)
    return numbered(rows).select("repo", F.col("line_no").cast("long").alias("line_no"), "line", "blame_oid")


@query(f"{MADE}, v AS (SELECT b.repo, k, oid, len(text) - len(replace(text, chr(10), '')) AS n FROM b WHERE conv_id = lead) SELECT DISTINCT a.repo, a.oid AS old_oid, z.oid AS new_oid, a.n AS n_equal, z.n - a.n AS n_insert, 0::BIGINT AS n_delete FROM v a JOIN v z ON z.repo = a.repo AND z.k = a.k + 1 WHERE a.oid <> z.oid")
def repo_blob_diff(spark, sf_dir):
    """Every two neighbouring versions of a file as blobs of the repository."""
    frames, work = repositories(spark, sf_dir)
    trees = frames.commits.selectExpr("repo_id", "tree", "get(parents, 0) oid").join(frames.commits.selectExpr("repo_id", "oid", "tree old_tree"), ["repo_id", "oid"])
    changed = frames.diff(trees.selectExpr("repo_id", "old_tree", "tree new_tree")).filter("path = 'chat.txt' and kind = 'modified'")
    found = frames.diff_blobs(work.write("pairs", changed.select("repo_id", "old_oid", "new_oid").distinct()))
    n = lambda op: F.size(F.filter("ops", lambda o: o["op"] == op)).cast("long").alias(f"n_{op}")
    return numbered(found).select("repo", "old_oid", "new_oid", n("equal"), n("insert"), n("delete"))


@query(f"{MADE}, n AS (SELECT t.repo, turn AS k, count(DISTINCT conv_id) + count(DISTINCT conv_id) FILTER (conv_id = lead) AS n FROM t JOIN m USING (repo) WHERE body <> '' AND turn > 0 GROUP BY ALL) SELECT c.repo, c.oid, coalesce(n, 0)::BIGINT AS n_paths, true AS went_stale FROM c LEFT JOIN n ON n.repo = c.repo AND n.k = c.k")
def repo_index_stale(spark, sf_dir):
    """An index that no longer fits the refs is not opened, and is built anew."""
    from chronolith.operators import index

    frames, work = repositories(spark, sf_dir)
    frames.open_index(work.at("index"))
    first = frames.refs.filter("name = 'refs/tags/first'").select("repo_id", "oid")
    second = frames.commits.join(first.withColumnRenamed("oid", "root"), "repo_id").filter("array_contains(parents, root)").select("repo_id", "oid").collect()
    for r in second:  # one row a repository of this query
        store = Store(r.repo_id)
        with store.fs.open_output_stream(store.at("refs/heads/more")) as f:
            f.write(f"{r.oid}\n".encode())
    again = open_repo(spark, *frames.paths)
    stale = index.open_index(spark, work.at("index"), again.refs).select("repo_id").distinct().withColumn("fresh", F.lit(True))
    rows = again.open_index(work.at("index2")).join(stale, "repo_id", "left")
    return numbered(rows).select("repo", "oid", F.size("changed_paths").cast("long").alias("n_paths"), F.col("fresh").isNull().alias("went_stale"))


