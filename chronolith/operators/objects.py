"""Objects: decoding loose files, storage precedence, lookups, delta resolution, header projections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith import schemas
from chronolith.errors import RepoError, raising
from chronolith.functions import codec, scalar
from chronolith.workspace import Workspace, sized


def decode_loose(files: DataFrame, limit: int = schemas.LIMITS["loose_object_max"], mode: str = "FAILFAST") -> DataFrame:
    """(repo_id, oid, data) -> objects; data is the compressed file. PERMISSIVE adds an error column instead of failing."""
    schema = schemas.OBJECTS + (", error string" if mode == "PERMISSIVE" else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, oid, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    kind, content = codec.read_loose(data, oid, limit)
                    rows.append((repo, oid, kind, len(content), content, "loose", None))
                except RepoError as e:
                    if mode != "PERMISSIVE":
                        raise
                    rows.append((repo, oid, None, None, None, "loose", e.code))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            names = ["repo_id", "oid", "type", "size", "content", "storage", "error"][: 7 if mode == "PERMISSIVE" else 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    return files.select("repo_id", "oid", "data").mapInArrow(each, schema)


def first_storage(objects: DataFrame) -> DataFrame:
    """One row per (repo_id, oid): packed copies come before loose ones."""
    ranked = objects.withColumn("_r", F.row_number().over(W.partitionBy("repo_id", "oid").orderBy(F.col("storage") != "pack")))
    return ranked.filter("_r = 1").drop("_r")


def lookup(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The objects whose (repo_id, oid) is wanted."""
    return objects.join(wanted.select("repo_id", "oid").distinct(), ["repo_id", "oid"], "left_semi")


def has_object(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted with a boolean `present`."""
    have = objects.select("repo_id", "oid").distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, ["repo_id", "oid"], "left").withColumn("present", F.coalesce("_have", F.lit(False))).drop("_have")


def missing_objects(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    return wanted.join(objects.select("repo_id", "oid"), ["repo_id", "oid"], "left_anti")


def is_delta(kind: str = "type") -> F.Column:
    return F.col(kind).isin("ofs_delta", "ref_delta")


def _apply(delta_first: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(…, base_content, data) -> content of each delta applied."""
    for batch in delta_first:
        base, data = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("base_content", "data"))
        content = [codec.apply_delta(b, d) for b, d in zip(base, data, strict=True)]
        keep = [n for n in batch.schema.names if n not in ("base_content", "data")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(content, pa.binary())], names=[*keep, "content"])


def resolve_deltas(entries: DataFrame, loose: DataFrame | None = None, depth_max: int = schemas.LIMITS["delta_depth_max"], work: Workspace | None = None, mode: str = "FAILFAST") -> DataFrame:
    """pack_entries (and loose objects as further bases) -> (repo_id, pack, offset, oid, type, content, hops).

    One round applies the deltas whose base is at hand: bases by offset are in the same pack, bases by id anywhere. The
    rounds are as many as the longest chain has hops. Chains of more than depth_max hops are LimitExceeded, entries
    without a base that can be reached (circles too) NotFound: FAILFAST raises, PERMISSIVE keeps them with an `error`.
    """
    work = work or Workspace(entries.sparkSession, "deltas")
    whole = entries.filter(~is_delta()).selectExpr("repo_id", "pack", "offset", "oid", "type", "data content", "0 hops")
    done, fresh = work.write("r0", whole), None
    waiting = work.write("w0", entries.filter(is_delta()).select("repo_id", "pack", "offset", "oid", "base_offset", "base_oid", "data"))
    extra = loose.selectExpr("repo_id", "oid base_oid", "type", "content base_content", "0 hops") if loose is not None else None
    fresh, n = done, 0
    while sized(waiting):
        n += 1
        by_offset = fresh.selectExpr("repo_id", "pack", "offset base_offset", "type", "content base_content", "hops")
        by_id = fresh.selectExpr("repo_id", "oid base_oid", "type", "content base_content", "hops")
        if n == 1 and extra is not None:
            by_id = by_id.union(extra)
        by_id = by_id.dropDuplicates(["repo_id", "base_oid"])
        columns = ["repo_id", "pack", "offset", "oid", "type", "hops", "base_content", "data"]
        ready = waiting.filter("base_offset is not null").join(by_offset, ["repo_id", "pack", "base_offset"]).select(columns)
        ready = ready.union(waiting.filter("base_offset is null").join(by_id, ["repo_id", "base_oid"]).select(columns))
        schema = "repo_id string, pack string, offset long, oid string, type string, hops int, content binary"
        fresh = work.write(f"r{n}", ready.withColumn("hops", F.col("hops") + 1).mapInArrow(_apply, schema).select("repo_id", "pack", "offset", "oid", "type", "content", "hops"))
        stuck = not sized(fresh)
        if stuck or n > depth_max:
            code = "NotFound" if stuck else "LimitExceeded"
            if mode != "PERMISSIVE":
                raise raising(code, "delta base" if stuck else "delta depth")
            bad = waiting.selectExpr("repo_id", "pack", "offset", "oid", "cast(null as string) type", "cast(null as binary) content", "cast(null as int) hops", f"'{code}' error")
            return done.withColumn("error", F.lit(None).cast("string")).union(bad)
        done = done.union(fresh)
        waiting = work.write(f"w{n}", waiting.join(fresh.select("repo_id", "pack", "offset"), ["repo_id", "pack", "offset"], "left_anti").select(waiting.columns))
    return done.withColumn("error", F.lit(None).cast("string")) if mode == "PERMISSIVE" else done


def content_text(kind: str, encoding: str = "UTF-8") -> F.Column:
    """The content of objects of one type as text, null for others.

    The type is asked within the expression: beside a filter the optimiser may decode before it has filtered, and fail
    at the bytes of another type. ISO-8859-1 reads any bytes without loss.
    """
    return F.when(F.col("type") == kind, F.decode("content", encoding if encoding == "ISO-8859-1" else "UTF-8"))


def commit_headers(objects: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """commit objects -> commits, with string functions alone; `error` is MalformedObject where the text is no commit."""
    text = content_text("commit", encoding)
    rows = objects.filter("type = 'commit'").select("repo_id", "oid", text.alias("text"))
    rows = rows.withColumn("cut", F.instr("text", "\n\n")).withColumn("head", F.split(F.expr("substring(text, 1, cut - 1)"), "\n"))

    def value(name: str) -> F.Column:
        return F.filter("head", lambda x: x.startswith(name + " "))

    tree = scalar.oid_from_hex(F.expr("substring(get(filter(head, x -> x like 'tree %'), 0), 6)"))
    parents = F.transform(value("parent"), lambda x: scalar.oid_from_hex(F.substring(x, 8, 4096)))
    rows = rows.select(
        "repo_id",
        "oid",
        tree.alias("tree"),
        parents.alias("parents"),
        F.coalesce(scalar.line_seconds(F.get(value("author"), F.lit(0))), F.lit(0)).alias("author_time"),
        scalar.line_seconds(F.get(value("committer"), F.lit(0))).alias("committer_time"),
        F.expr("substring(text, cut + 2)").alias("message"),
        "cut",
    )
    bad = (F.col("cut") == 0) | F.col("tree").isNull() | F.col("committer_time").isNull() | F.exists("parents", lambda p: p.isNull())
    return rows.withColumn("error", F.when(bad, "MalformedObject")).drop("cut")


def commits_of(objects: DataFrame, mode: str = "FAILFAST", encoding: str = "UTF-8") -> DataFrame:
    """commits; FAILFAST raises at a malformed one, PERMISSIVE keeps its error, DROPMALFORMED leaves it out."""
    rows = commit_headers(objects, encoding)
    if mode == "PERMISSIVE":
        return rows
    if mode == "DROPMALFORMED":
        return rows.filter("error is null").drop("error")
    checked = F.when(F.col("error").isNull(), F.col("tree")).otherwise(F.raise_error(F.concat(F.col("error"), F.lit(": commit "), F.col("oid"))).cast("string"))
    return rows.withColumn("tree", checked).drop("error")


def first_parent(commits: DataFrame) -> DataFrame:
    """(repo_id, oid, first_parent), null at a root."""
    return commits.select("repo_id", "oid", F.get("parents", F.lit(0)).alias("first_parent"))


def tags_of(objects: DataFrame) -> DataFrame:
    """tag objects -> (repo_id, oid, target_oid); null target where the header names none."""
    head = F.split(F.substring_index(content_text("tag", "ISO-8859-1"), "\n\n", 1), "\n")
    named = F.filter(head, lambda x: x.rlike(r"\Aobject [0-9a-fA-F]{40}\z"))
    return objects.filter("type = 'tag'").select("repo_id", "oid", F.lower(F.substring(F.get(named, F.lit(0)), 8, 40)).alias("target_oid"))


def peel(starts: DataFrame, tags: DataFrame, kinds: DataFrame, reads: int = 10) -> DataFrame:
    """(repo_id, oid) -> with commit_oid and error: tags are followed, at most `reads` objects being read.

    kinds: (repo_id, oid, type) of objects. Trees and blobs are MalformedObject, absent objects NotFound. The joins are
    unrolled, as their number is a constant.
    """
    at = starts.select("repo_id", "oid").distinct().withColumn("at", F.col("oid")).withColumn("commit_oid", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    known = kinds.join(tags, ["repo_id", "oid"], "left").selectExpr("repo_id", "oid at", "type _type", "target_oid _to")
    for _ in range(reads):
        read = at.join(known, ["repo_id", "at"], "left")
        open_ = F.col("commit_oid").isNull() & F.col("error").isNull()
        at = read.select(
            "repo_id",
            "oid",
            F.when(open_ & (F.col("_type") == "tag"), F.col("_to")).otherwise(F.col("at")).alias("at"),
            F.when(open_ & (F.col("_type") == "commit"), F.col("at")).otherwise(F.col("commit_oid")).alias("commit_oid"),
            F.when(open_ & F.col("_type").isNull(), "NotFound")
            .when(open_ & (F.col("_type").isin("tree", "blob") | ((F.col("_type") == "tag") & F.col("_to").isNull())), "MalformedObject")
            .otherwise(F.col("error"))
            .alias("error"),
        )
    left = F.col("commit_oid").isNull() & F.col("error").isNull()
    return at.withColumn("error", F.when(left, "LimitExceeded").otherwise(F.col("error"))).select("repo_id", "oid", "commit_oid", "error")
