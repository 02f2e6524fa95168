"""One call from a path to all tables of a repository, or of many."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import scalar
from chronolith.operators import blame as blaming
from chronolith.operators import index as indexing
from chronolith.operators import linediff, log, objects, refs, treediff, trees
from chronolith.session import importable
from chronolith.sources.gitrepo import git_dir, register, repositories
from chronolith.workspace import Workspace


def _fail(code: str, *what: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{code}: "), *[F.coalesce(w, F.lit("")) for w in what])).cast("string")


class RepoFrames:
    """Lazy tables of the repositories at some paths; options are those of the data source.

    textEncoding (UTF-8, or ISO-8859-1 which reads any bytes) is that of commits, names and blobs. Commits, trees and
    tags are read from the repositories once and kept as a table of the workspace; blobs are read where they are asked
    for. What is missing or of the wrong type fails as NotFound or MalformedObject; with mode=PERMISSIVE it gives no rows.
    """

    def __init__(self, spark: SparkSession, paths: list[str], textEncoding: str = "UTF-8", **options):  # noqa: N803
        self.spark, self.paths, self.options, self.encoding = importable(spark), repositories(",".join(paths)), options, textEncoding
        self.bare = {p: git_dir(p)[1] for p in self.paths}
        self.strict = str(options.get("mode", "FAILFAST")).upper() != "PERMISSIVE"
        register(spark)

    def read(self, table: str, **more) -> DataFrame:
        return self.spark.read.format("gitrepo").options(path=",".join(self.paths), table=table, **{k: str(v) for k, v in {**self.options, **more}.items()}).load()

    @cached_property
    def work(self) -> Workspace:
        return Workspace(self.spark, "repository")

    @cached_property
    def objects(self) -> DataFrame:
        """All objects, each once; every use reads the repositories."""
        return objects.first_storage(self.read("objects"))

    @cached_property
    def headers(self) -> DataFrame:
        """Objects other than blobs, kept."""
        return self.work.write("headers", objects.first_storage(self.read("objects").filter("type in ('commit', 'tree', 'tag')")))

    @cached_property
    def refs(self) -> DataFrame:
        return self.read("refs")

    @cached_property
    def commits(self) -> DataFrame:
        return self.work.write("commits", objects.commits_of(self.headers, "FAILFAST" if self.strict else "DROPMALFORMED", self.encoding))

    @cached_property
    def tree_entries(self) -> DataFrame:
        return self.work.write("entries", trees.tree_entries(self.headers, self.strict, self.encoding))

    @cached_property
    def tips(self) -> DataFrame:
        """Commits that refs lead to, tags peeled."""
        return objects.peel(refs.ref_tips(self.refs), objects.tags_of(self.headers), self.headers).filter("commit_oid is not null").selectExpr("repo_id", "commit_oid oid").distinct()

    @cached_property
    def head(self) -> DataFrame:
        return refs.resolve_head(self.refs).filter("error is null").select("repo_id", "oid")

    def log(self, tips: DataFrame | None = None, **how) -> DataFrame:
        return log.log(self.commits, self.head if tips is None else tips, **how)

    def walk(self, commits: DataFrame | None = None) -> DataFrame:
        roots = (self.head if commits is None else commits).join(self.commits, ["repo_id", "oid"]).selectExpr("repo_id", "tree root_tree")
        found = trees.walk_trees(self.tree_entries, roots, mode="FAILFAST" if self.strict else "PERMISSIVE")
        return trees.in_walk_order(found if self.strict else found.filter("error is null").drop("error"))

    def diff(self, pairs: DataFrame) -> DataFrame:
        """(repo_id, old_tree, new_tree) -> file changes."""
        found = treediff.diff_trees(self.tree_entries, pairs, mode="FAILFAST" if self.strict else "PERMISSIVE")
        return found if self.strict else found.filter("kind <> 'error'")

    def blobs(self, wanted: DataFrame) -> DataFrame:
        """(repo_id, oid) -> with lines. Only what is wanted is decoded; the objects are read anew."""
        got = wanted.select("repo_id", "oid").distinct().join(self.objects.select("repo_id", "oid", "type", "content"), ["repo_id", "oid"], "left")
        text = objects.content_text("blob", self.encoding)
        if self.strict:
            text = F.when(F.col("type").isNull(), _fail("NotFound", F.col("oid"))).when(F.col("type") != "blob", _fail("MalformedObject", F.lit("no blob "), F.col("oid"))).otherwise(text)
        return got.select("repo_id", "oid", scalar.split_lines(text).alias("lines")).filter("lines is not null")

    def diff_blobs(self, pairs: DataFrame) -> DataFrame:
        """(repo_id, old_oid, new_oid) -> with ops. Ids that are no blobs are MalformedObject, absent ones NotFound."""
        pairs = pairs.select("repo_id", "old_oid", "new_oid").distinct()
        text = self.blobs(pairs.selectExpr("repo_id", "explode(array(old_oid, new_oid)) oid"))
        rows = pairs.join(text.selectExpr("repo_id", "oid old_oid", "lines old_lines"), ["repo_id", "old_oid"]).join(text.selectExpr("repo_id", "oid new_oid", "lines new_lines"), ["repo_id", "new_oid"])
        return linediff.diff_lines(rows).select("repo_id", "old_oid", "new_oid", "ops")

    def blame(self, path: str, at: DataFrame | None = None, index: DataFrame | None = None, exact: bool = True) -> DataFrame:
        """blame_lines of a path at HEAD or at commits (repo_id, oid).

        An index spares the trees of commits that leave the path alone, by its exact paths or (exact=False) by its
        filters. A path that is missing at the start is NotFound.
        """
        start = self.head if at is None else at
        chain = log.first_parent_chain(self.commits, start).select("repo_id", F.col("oid"), "depth")
        chain = chain.join(self.commits.select("repo_id", "oid", "tree", F.size("parents").alias("n")), ["repo_id", "oid"])
        if index is not None:
            # the newest version counts, and each commit that changes the path; roots have no paths of their own
            asked = chain.select("repo_id", "oid").distinct().withColumn("path", F.lit(path))
            touched = indexing.might_contain(asked, index, exact).filter("might_contain").select("repo_id", "oid", F.lit(True).alias("_t"))
            chain = chain.join(touched, ["repo_id", "oid"], "left").filter("depth = 0 or n = 0 or _t")
        found = trees.find_paths(self.tree_entries, chain.select("repo_id", F.col("tree").alias("root_tree"), F.lit(path).alias("path")))
        history = chain.selectExpr("repo_id", "oid commit", "depth", "tree root_tree").join(found, ["repo_id", "root_tree"]).select("repo_id", "path", "depth", "commit", "oid")
        if self.strict:
            history = history.withColumn("oid", F.when((F.col("depth") == 0) & F.col("oid").isNull(), _fail("NotFound", F.col("path"), F.lit(" at "), F.col("commit"))).otherwise(F.col("oid")))
        versions = Workspace(self.spark, "blame").write("versions", blaming.version_chain(history))
        return blaming.blame(versions.join(self.blobs(versions), ["repo_id", "oid"]).selectExpr("repo_id", "path", "-depth seq", "commit", "lines"))

    def index(self) -> DataFrame:
        return indexing.build_index(self.commits, self.tree_entries, self.refs, log.reachable(self.commits, self.tips))

    def open_index(self, path: str) -> DataFrame:
        """The index written at a path, if it is that of the tips of now for every repository; else built and written anew."""
        try:
            found = indexing.open_index(self.spark, path, self.refs)
            stale = refs.ref_tips(self.refs).select("repo_id").distinct().join(found.select("repo_id").distinct(), "repo_id", "left_anti")
            if not stale.take(1):
                return found
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        indexing.write_index(self.index(), path)
        return indexing.open_index(self.spark, path, self.refs)


def open_repo(spark: SparkSession, *paths: str, **options) -> RepoFrames:
    return RepoFrames(spark, list(paths), **options)
