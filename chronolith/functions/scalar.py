"""Column functions without UDFs: ids, object headers, lines, time stamps, path and ref-name checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.schemas import TREE_MODES

PATH_MAX = 4096
ZERO_OID = "0" * 40


def oid_from_hex(text: Column) -> Column:
    """40 hexadecimal characters of either case as the id, else null."""
    return F.when(text.rlike(r"\A[0-9a-fA-F]{40}\z"), F.lower(text))


def oid_to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def oid_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def oid_is_zero(oid: Column) -> Column:
    return oid == ZERO_OID


def object_oid(kind: str, content: Column) -> Column:
    """Id of an object with binary content."""
    head = F.concat(F.lit(kind + " "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(bytearray(1)), content))


def blob_oid(text: Column) -> Column:
    return object_oid("blob", text.cast("binary"))


def loose_path(oid: Column) -> Column:
    return F.concat(F.lit("objects/"), F.substring(oid, 1, 2), F.lit("/"), F.substring(oid, 3, 38))


def oid_of_path(path: Column) -> Column:
    """The id that a loose object's path names, else null."""
    found = F.regexp_extract(path, r"(?:\A|/)objects/([0-9a-f]{2})/([0-9a-f]{38})\z", 0)
    return F.when(found != "", F.regexp_replace(F.right(found, F.lit(41)), "/", ""))


def split_lines(text: Column) -> Column:
    """Lines parted by \\n alone; a final \\n begins no further line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_seconds(line: Column) -> Column:
    """Epoch seconds of an author or committer line: its second-to-last part."""
    return F.try_element_at(F.split(line, " "), F.lit(-2)).try_cast("long")


def tree_mode(digits: Column) -> Column:
    """Name of an entry's mode, null for modes that the format does not have."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TREE_MODES.items() for x in pair]), digits)


def join_path(base: Column, relative: Column) -> Column:
    return F.concat_ws("/", base, relative)


def path_error(path: Column) -> Column:
    """What is wrong with a relative path, as an error code; null if nothing is."""
    odd = F.get(F.filter(F.split(path, "/", -1), lambda s: s.isin("", ".", "..")), F.lit(0))
    return (
        F.when(F.octet_length(path) > PATH_MAX, "PathTooLong")
        .when((path == "") | path.contains("\0"), "InvalidPath")
        .when(path.startswith("/") | path.rlike(r"\A[A-Za-z]:[/\\]"), "AbsolutePath")
        .when(path.contains("\\"), "InvalidPath")
        .when(odd == "..", "PathTraversal")
        .when(odd.isNotNull(), "InvalidPath")
    )


def ref_name_error(name: Column) -> Column:
    """What is wrong with a ref's name, as an error code; null if nothing is."""
    bad = (
        (name == "")
        | name.rlike(r"\A[-/.]|[/.]\z|[\x00-\x20\x7F~^:?*\[\\]")
        | (name == "@")
        | name.endswith(".lock")
        | name.contains("..")
        | name.contains("/.")
    )
    return F.when(F.octet_length(name) > PATH_MAX, "PathTooLong").when(bad, "InvalidPath")
