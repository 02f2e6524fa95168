"""A training corpus from raw documents, stage by stage.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps, the last
one the encoded result. Stages meet only in written tables.

Decisions are made by row: the second and third stage number the rows of their input and drop by that number.

Defined cases: a text without a letter, or null, is rejected by the first stage; of rows whose fingerprints are linked,
one stays, that with the smallest doc_id, or the first row where it has none or several such; of rows that stay, no
two have the same doc_id: where several groups would keep the same one, the group of the first row keeps it, and the
others keep their next row whose doc_id is free, or none where none is; rows with a null doc_id are linked, dropped and
found contaminated like others, and stay after rows with one; an empty table stays empty. Further columns of documents go along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe_piece, cross_parsing, secret_linking, simhash_bk, winnowing
from chronolith.llm.common import Workspace, sized, table
from chronolith.session import importable


def _others(docs: DataFrame, *without: str) -> Column:
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return F.struct(*[named(c) for c in docs.columns if c not in ("text", *without)]).alias("rest")


def _rest(docs: DataFrame, *without: str) -> DataFrame:
    """text, and all other columns as one struct, so that no name can clash."""
    return docs.select("text", _others(docs, *without))


def _back(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    return rows.select(*[new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _numbered(docs: DataFrame, work: Workspace) -> DataFrame:
    """(row, doc_id, text, rest): a row's number is that of its file and its place there, however often and in whatever
    parts the files are read. What is not read from files as it is, is written first.
    """
    place = ["_metadata.file_path", "_metadata.row_index"]
    try:
        rows = docs.select(*place, "text", _others(docs)) if "_metadata" not in docs.columns else None
    except AnalysisException:
        rows = None
    if rows is None:
        rows = work.write("rows", _rest(docs)).select(*place, "text", "rest")
    paths = sorted(r.file_path for r in rows.select("file_path").distinct().collect())
    files = work.write("files", docs.sparkSession.createDataFrame(list(enumerate(paths)), "file long, file_path string"))
    number = F.shiftleft("file", 40).bitwiseOR(F.col("row_index"))
    return rows.join(F.broadcast(files), "file_path").select(number.alias("row"), F.col("rest").getField("doc_id").cast("long").alias("doc_id"), "text", "rest")


def _kept(found: DataFrame, work: Workspace) -> DataFrame:
    """Rows (row, doc_id, component_id) -> (row, doc_id, component_id): one row a component, no doc_id twice.

    One round is enough unless components have the same doc_id for their first row; each further round serves the
    components that went without one.
    """
    kept, free, n = None, found, 0
    while True:
        first = free.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("x")).select("x.row", "x.doc_id", "component_id")
        first = work.write(f"first{n}", first)
        if not sized(first.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")):
            return first if kept is None else kept.union(first)
        one = first.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("row", "component_id")).alias("x")).select("x.row", "doc_id", "x.component_id")
        one = one.union(first.filter("doc_id is null"))
        kept = work.write(f"kept{n}", one if kept is None else kept.union(one))
        free = found.join(kept.select("component_id"), "component_id", "left_anti").join(kept.filter("doc_id is not null").select("doc_id"), "doc_id", "left_anti")
        n += 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found; documents in which none can be told go."""
    sample = cross_parsing.labelled_sample(docs)
    found = cross_parsing.identify(_rest(docs, "lang"), sample, keep=["rest"])
    return _back(found.filter(F.col("lang_pred") != "und"), docs, lang=F.col("lang_pred"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest doc_id stays."""
    rows = _numbered(docs, work := Workspace(spark, "dedup"))
    found = work.write("found", simhash_bk.near_duplicates(rows, work, row="row").select("row", "doc_id", "component_id"))
    gone = work.write("gone", found.join(_kept(found, work), "row", "left_anti").select("row"))
    return _back(rows.join(gone, "row", "left_anti"), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go."""
    rows = _numbered(docs, work := Workspace(spark, "decontamination"))
    found = winnowing.contaminated_words(rows, table(spark, sf_dir, "benchmark"), work, row="row")
    gone = work.write("gone", found.filter("contaminated").select("row"))
    return _back(rows.join(gone, "row", "left_anti"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked by their kind; n_chars follows the text."""
    masked = secret_linking.scan_secrets(_rest(docs, "n_chars"), keep=["rest"])
    new = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return _back(masked, docs, **new)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_piece.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither the suffix automata nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    work, docs = Workspace(importable(spark), "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(name, stage(spark, docs, sf_dir))
    return docs
