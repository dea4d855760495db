"""Facts that follow from rows of calls alone: kinds of calls, classes of sources, checks of callers, access to resources.

A call has a ``prefix``: null for a plain name, the identifier before the dot, or empty where something
longer stands there.

Defined cases: a null name, text or argument matches nothing; calls that repeat count once where the
docstring says so; empty tables give empty results.  Columns that begin with two underscores are the
module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars

# The producer's names and patterns.
BUILTINS = ("make", "new", "len", "cap", "append", "copy", "delete", "close", "panic", "recover", "print", "println", "complex", "real", "imag")
CONVERSIONS = (
    "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64",
    "float32", "float64", "complex64", "complex128", "string", "byte", "rune", "bool", "uintptr",
)
REQUEST_ACCESSORS = (
    ".BasicAuth(", ".FormValue(", ".PostFormValue(", ".URL.Query(", ".Header.Get(", ".Header.Values(",
    ".Cookie(", ".Cookies(", ".PathValue(", ".MultipartForm(", ".FormFile(",
)
NET_SOURCES = ("http_request", "http_body", "read_message", "network_read", "network_accept")
CONSOLE = "os.Stdin"
PRINCIPAL_CALL = r"^(?i:(must|require)?(have|get|current)?(user|principal|identity|claims|subject|caller|session|tenant)(from\w*|context)?)$|(?i:authoriz|permission|enforce|checkaccess|canaccess|isowner|isallowed|rbac|verifyaccess)"
ACCESS_CALL = r"^(?i:get|find|load|fetch|read|update|delete|remove|patch|save|put|download|upload|list|describe|export)"
REQUEST_ID = r"^(?i:request|req|input|params|in|body|args|r|c)\.([A-Za-z_]+\.)*[A-Za-z_]*(Id|ID|Ids|IDs)$"
ID_WORD = r"(?i)(^|[^a-z])ids?([^a-z]|$)|Ids?$|IDs?$"
OUTBOUND = ("http.Get", "http.Post", "http.Head", "http.PostForm")


def _aliased(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Calls with __path: the package that their prefix names in their file, or null."""
    paths = aliases.where("alias <> ''").groupBy("file", F.col("alias").alias("prefix")).agg(F.min("path").alias("__path"))
    return calls.join(paths, ["file", "prefix"], "left")


def call_types(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """function, callee, type and package of each callee of a function, once, as its first call has them.

    ``calls``: function, file, ord, prefix, name; ``aliases``: file, alias, path.  Builtins and
    conversions of types aren't calls.
    """
    plain = F.col("prefix").isNull()
    kind = F.when(plain, "local").when(F.col("__path").isNull(), "method").when(scalars.is_standard_package(F.col("__path")), "stdlib").otherwise("third_party")
    callee = F.when(F.col("prefix") != "", F.concat("prefix", F.lit("."), "name")).otherwise(F.col("name"))
    made = calls.where(F.col("name").isNotNull() & ~(plain & F.col("name").isin(*BUILTINS, *CONVERSIONS)))
    first = F.min(F.struct("ord", kind.alias("type"), F.coalesce("__path", F.lit("")).alias("package"))).alias("__first")
    return _aliased(made, aliases).groupBy("function", callee.alias("callee")).agg(first).select("function", "callee", "__first.type", "__first.package")


def source_class(code: Column, prefix: Column, args: Column, patterns: list[tuple[str, str]]) -> Column:
    """``src`` for data of a remote side, ``io`` for other data from outside, else empty.

    ``patterns``: (text, type) in order; of those that end in a parenthesis the first in the code counts.
    The process's own console isn't outside.
    """
    asked = F.exists(F.array(*map(F.lit, REQUEST_ACCESSORS)), lambda a: F.contains(code, a))
    calls = [F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("type")) for p, t in patterns if p.endswith("(")]
    first = F.get(F.filter(F.array(*calls), lambda s: F.contains(code, s["pattern"])), F.lit(0)) if calls else F.lit(None).cast("struct<pattern:string,type:string>")
    console = F.coalesce(prefix == CONSOLE, F.lit(False)) | F.coalesce(F.array_contains(args, CONSOLE), F.lit(False))
    return F.when(asked, "src").when(first.isNull(), "").when(first["type"].isin(*NET_SOURCES), "src").when(console, "").otherwise("io")


def is_outbound(prefix: Column, name: Column) -> Column:
    """Does a call ask a remote side for a response? Common names count on receivers named like a client only."""
    common = name.isin("Get", "Post", "Head", "PostForm") & prefix.rlike("(?i)client")
    return F.coalesce(F.concat_ws(".", prefix, name).isin(*OUTBOUND) | (prefix.isNotNull() & name.isin("Do", "RoundTrip")) | common, F.lit(False))


def principal_checks(calls: DataFrame) -> DataFrame:
    """function, principal_check: does any of its calls look at who the caller is?"""
    return calls.groupBy("function").agg(F.coalesce(F.bool_or(F.col("name").rlike(PRINCIPAL_CALL)), F.lit(False)).alias("principal_check"))


def resource_access(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """function, line, text of calls that read or write data by an identifier from the request; repeated calls come out as often.

    ``calls``: function, file, line, prefix, name, text and args, an array of (text, roots).  Functions of
    packages aren't such calls, nor are plain names.
    """
    outside = lambda a: F.exists(a["roots"], lambda r: r.isin("entry", "src"))
    by_id = F.exists("args", lambda a: F.coalesce(a["text"].rlike(REQUEST_ID), F.lit(False)) | F.coalesce(a["text"].rlike(ID_WORD) & outside(a), F.lit(False)))
    found = calls.where(F.col("prefix").isNotNull() & F.col("name").rlike(ACCESS_CALL) & by_id)
    return _aliased(found, aliases).where("__path is null").select("function", "line", F.substring("text", 1, 120).alias("text"))
