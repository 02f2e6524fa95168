"""Refs: reading loose and packed ones, resolving symbolic ones, tips and their digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith.functions import scalar
from chronolith.schemas import LIMITS


def loose_refs(files: DataFrame) -> DataFrame:
    """(repo_id, name, text) -> refs with an error column; trailing white space of the file is cut."""
    text = F.regexp_replace("text", r"[ \t\r\n]+\z", "")
    rows = files.select("repo_id", "name", text.alias("_t"))
    symbolic = F.col("_t").startswith("ref: ")
    target = F.when(symbolic, F.expr("substring(_t, 6)"))
    rows = rows.select("repo_id", "name", F.when(~symbolic, scalar.oid_from_hex(F.col("_t"))).alias("oid"), F.when(target != "", target).alias("symref_target"), F.lit("loose").alias("source"))
    return rows.withColumn("error", F.when(F.col("oid").isNull() & F.col("symref_target").isNull(), "MalformedRef"))


def packed_refs(lines: DataFrame) -> DataFrame:
    """(repo_id, line) of packed-refs files -> refs; comments, peeled lines and blanks are skipped."""
    kept = lines.filter("line <> '' and not startswith(line, '#') and not startswith(line, '^')")
    rows = kept.select("repo_id", F.expr("substring(line, instr(line, ' ') + 1)").alias("name"), scalar.oid_from_hex(F.substring_index("line", " ", 1)).alias("oid"))
    rows = rows.select("repo_id", "name", "oid", F.lit(None).cast("string").alias("symref_target"), F.lit("packed").alias("source"))
    return rows.withColumn("error", F.when(F.col("oid").isNull(), "MalformedRef"))


def read_refs(refs: DataFrame) -> DataFrame:
    """One row per (repo_id, name): loose refs hide packed ones."""
    ranked = refs.withColumn("_r", F.row_number().over(W.partitionBy("repo_id", "name").orderBy(F.col("source") != "loose")))
    return ranked.filter("_r = 1").drop("_r")


def resolve_refs(refs: DataFrame, names: DataFrame | None = None, depth_max: int = LIMITS["symref_depth_max"]) -> DataFrame:
    """(repo_id, name) -> with oid and error, following up to depth_max symbolic steps.

    A step to a ref that does not exist is NotFound, one more step than allowed SymrefTooDeep. The joins are unrolled
    into one lazy plan, their number being a constant.
    """
    table = read_refs(refs).select("repo_id", "name", "oid", "symref_target")
    start = table if names is None else names.select("repo_id", "name").distinct().join(table, ["repo_id", "name"], "left")
    at = start.select("repo_id", "name", "oid", F.col("symref_target").alias("to"), F.when(F.col("oid").isNull() & F.col("symref_target").isNull(), "NotFound").alias("error"))
    steps = table.selectExpr("repo_id", "name to", "oid _oid", "symref_target _to", "true _there")
    for _ in range(depth_max):
        at = at.join(steps, ["repo_id", "to"], "left").select(
            "repo_id", "name", F.coalesce("oid", "_oid").alias("oid"), F.col("_to").alias("to"), F.when(F.col("to").isNotNull() & F.col("_there").isNull(), "NotFound").otherwise(F.col("error")).alias("error")
        )
    return at.select("repo_id", "name", "oid", F.when(F.col("to").isNotNull(), "SymrefTooDeep").otherwise(F.col("error")).alias("error"))


def resolve_head(refs: DataFrame) -> DataFrame:
    return resolve_refs(refs, refs.select("repo_id").distinct().withColumn("name", F.lit("HEAD")))


def refs_under(refs: DataFrame, prefix: str) -> DataFrame:
    return read_refs(refs).filter(F.col("name").startswith(prefix))


def ref_tips(refs: DataFrame) -> DataFrame:
    """(repo_id, oid): the distinct ids that refs resolve to; refs that do not resolve are left out."""
    return resolve_refs(refs).filter("oid is not null and error is null").select("repo_id", "oid").distinct()


def tips_digest(tips: DataFrame) -> DataFrame:
    """(repo_id, n_tips, digest): SHA-1 over the sorted tips' bytes. One repository's tips meet in one row."""
    joined = F.array_join(F.array_sort(F.collect_set("oid")), "")
    return tips.groupBy("repo_id").agg(F.count_distinct("oid").alias("n_tips"), F.sha1(F.unhex(joined)).alias("digest"))
