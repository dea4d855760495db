"""Scalar helpers over names, paths, identifiers, markers and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans import seeds


def qualified(receiver: Column, name: Column) -> Column:
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat_ws(".", receiver, name))


def function_key(file: Column, receiver: Column, name: Column) -> Column:
    """``file:Recv.Name``."""
    return F.concat_ws(":", file, qualified(receiver, name))


def file_of(key: Column) -> Column:
    return F.regexp_extract(key, r"^(.*):", 1)


def bare_name(key: Column) -> Column:
    return F.substring_index(F.substring_index(key, ":", -1), ".", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def line_of(location: Column) -> Column:
    """The number after the last colon, null if there is none."""
    return F.when(F.contains(location, F.lit(":")), F.substring_index(location, ":", -1).try_cast("int"))


def name_tokens(text: Column) -> Column:
    """Distinct lower-case words of camel-case names, longer than two letters, less the stop words, in order."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"), F.lit(0))
    lower = F.transform(parts, lambda p: F.lower(p))
    return F.array_sort(F.array_distinct(F.filter(lower, lambda p: (F.length(p) > 2) & ~p.isin(*seeds.STOP_WORDS))))


def is_standard_package(path: Column) -> Column:
    """No dot in the first segment of the import path, nor an extended module."""
    return ~F.contains(F.element_at(F.split(path, "/"), 1), F.lit(".")) & ~F.startswith(path, F.lit("golang.org/x"))


def alias_of(path: Column) -> Column:
    """The name by which a package is used: its last segment but a version, without prefix and after the last dot or dash."""
    unversioned = F.regexp_replace(path, r"/v\d+$", "")
    return F.regexp_replace(F.regexp_replace(F.substring_index(unversioned, "/", -1), r"^go-", ""), r"[.-].*$", "")


def json_text(text: Column) -> Column:
    """A text as JSON; null is null."""
    inside = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(inside, F.lit(2), F.length(inside) - 2))


def json_number(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("null"))


def json_texts(texts: Column) -> Column:
    """An array of texts as JSON with a space after each comma; null is empty."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), json_text), ", "), F.lit("]"))


def content_id(parts: list[Column], length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of a JSON array of JSON parts, a space after each comma."""
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256), 1, length)


def short_id(text: Column, algorithm: str = "sha1") -> Column:
    """8 digits of SHA-1 or 12 of MD5."""
    return F.substring(F.sha1(text), 1, 8) if algorithm == "sha1" else F.substring(F.md5(text), 1, 12)


def safe_name(text: Column, taken_before: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores; where it is taken, with a hash of the text."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
    return F.when(taken_before, F.concat_ws("_", plain, F.substring(F.sha2(text, 256), 1, 8))).otherwise(plain)


def scalar(text: Column) -> Column:
    """The number of a text; booleans are 1 and 0; anything else null."""
    t = F.lower(F.trim(text))
    return F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(t.try_cast("double"))


def compares(left: Column, op: Column, right: Column) -> Column:
    """left op right of numbers; null for nulls and unknown operators."""
    return (
        F.when(left.isNull() | right.isNull(), None).when(op == ">", left > right).when(op == ">=", left >= right)
        .when(op == "<", left < right).when(op == "<=", left <= right).when(op == "==", left == right).when(op == "!=", left != right)
    )


#: Result keys and values that change from run to run.
VOLATILE_KEY = r"(?i)(elapsed|duration|latency|_ms$|_ns$|_us$|_sec$|seconds|time|mem|alloc|rss|heap)"
VOLATILE_VALUE = r"(/tmp/|/var/folders/|TestRepro_\w+\d{6,}|\d{9,})"
#: Result keys that hold an HTTP status.
STATUS_KEYS = ("status", "status_code", "http_status", "code")


def stable(result: Column) -> Column:
    return F.map_filter(result, lambda k, v: ~k.rlike(VOLATILE_KEY) & ~v.rlike(VOLATILE_VALUE))


def measurably_differ(a: Column, b: Column) -> Column:
    """Does a key hold different numbers or booleans in two result maps?"""
    keys = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    value = lambda m, k: scalar(F.try_element_at(m, k))
    return F.exists(keys, lambda k: (value(a, k) != value(b, k)).eqNullSafe(True))


def rejected_status(result: Column) -> Column:
    """The first status of 400 to 599 in a result map, null without one; booleans aren't statuses."""
    found = [scalar(F.try_element_at(result, F.lit(k))) for k in STATUS_KEYS]
    return F.coalesce(*[F.when((v >= 400) & (v < 600), v.cast("int")) for v in found])


def json_or_inner(text: Column, ddl: str) -> Column:
    """A JSON text parsed without its code fence; if that fails, the part between the outermost braces."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = lambda t: F.from_json(t, f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = lambda t: F.when(F.startswith(F.trim(t), F.lit("{")) & parsed(t)["_bad"].isNull(), parsed(t))
    return F.coalesce(good(bare), good(inner)).dropFields("_bad")


def provenance(origin: Column, hops: Column, dispatch: Column, direct: Column) -> Column:
    """``<origin>_<distance>[_dispatch]`` of a taint state."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("net", "wire", "io", "cb", "llm")]), origin + 1)
    distance = F.when(direct & (hops == 0), "direct").when(hops == 0, "entry").when(hops == 1, "1hop").otherwise("nhop")
    return F.concat(name, F.lit("_"), distance, F.when(dispatch, F.lit("_dispatch")).otherwise(F.lit("")))


def patch_commit(urls: Column) -> Column:
    """repo, commit and ref of the first URL of a commit: on the usual host first, else on the language's own."""
    usual, own = r"github\.com/([^/]+/[^/]+)/commit/([0-9a-f]{7,40})", r"go\.googlesource\.com/[^/]+/\+/([0-9a-f]{7,40})"
    first = lambda p: F.get(F.filter(urls, lambda u: u.rlike(p)), F.lit(0))
    a, b = first(usual), first(own)
    there = F.struct(F.concat(F.lit("github.com/"), F.regexp_extract(a, usual, 1)).alias("repo"), F.regexp_extract(a, usual, 2).alias("commit"), a.alias("ref"))
    here = F.struct(F.lit("github.com/golang/go").alias("repo"), F.regexp_extract(b, own, 1).alias("commit"), b.alias("ref"))
    return F.when(a.isNotNull(), there).when(b.isNotNull(), here)


def repository(module: Column, patched: Column) -> Column:
    """The repository of a module: that of its patch, else its own path's, else the standard library's."""
    parts = F.split(module, "/")
    hosted = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(module)
    return F.coalesce(patched, F.when(F.startswith(module, F.lit("github.com/")), hosted).when(F.contains(module, F.lit("/")), "github.com/golang/go").otherwise(module))
