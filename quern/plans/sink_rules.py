"""Which calls are sinks, and what reaches them: by pattern, by the positions that matter, and by how a URL or query is built.

Tables of patterns are rules of a fixed size, so each call looks through them in a column expression, and no join
loops over them.  Roots of operands are those that ``flow`` finds.

Defined cases: null code matches nothing; a null or missing argument has no roots; a sink that no root reaches is none;
calls that repeat count as often; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.scratch import Scratch

# Patterns of calls that are sinks, in order, with their type and the imports of which a file needs one.
LDAP = ("github.com/go-ldap/ldap", "gopkg.in/ldap.v2", "gopkg.in/ldap.v3")
SQL = ("database/sql", "github.com/jmoiron/sqlx")
GORM = ("gorm.io/gorm", "github.com/jinzhu/gorm")
GIN_ECHO = ("github.com/gin-gonic/gin", "github.com/labstack/echo")
PATTERNS = (
    ("exec.Command(", "command_execution", ()), ("os.Create(", "file_write", ()), ("os.Open(", "file_read", ()), ("os.OpenFile(", "file_write", ()),
    ("os.WriteFile(", "file_write", ()), ("sql.Query(", "sql_query", ()), ("sql.Exec(", "sql_exec", ()), ("sql.QueryRow(", "sql_query", ()),
    ("http.Get(", "http_request", ()), ("http.Post(", "http_request", ()), ("template.HTML(", "html_injection", ()), ("template.JS(", "js_injection", ()),
    ("os.MkdirAll(", "file_write", ()), ("os.Stat(", "file_read", ()), ("os.ReadFile(", "file_read", ()), ("ioutil.ReadFile(", "file_read", ()),
    ("os.Chmod(", "file_write", ()), ("os.Rename(", "file_write", ()), ("os.RemoveAll(", "file_write", ()), ("exec.CommandContext(", "command_execution", ()),
    ("http.NewRequest(", "http_request", ()),
    ("ldap.NewSearchRequest(", "query_exec", ()), (".Search(", "query_exec", LDAP), (".Query(", "sql_query", SQL), (".QueryRow(", "sql_query", SQL),
    (".QueryContext(", "sql_query", SQL), (".QueryRowContext(", "sql_query", SQL), (".Exec(", "sql_exec", SQL), (".ExecContext(", "sql_exec", SQL),
    (".Where(", "query_exec", GORM), (".Raw(", "query_exec", GORM), ("http.Redirect(", "redirect", ()), ("http.NewRequestWithContext(", "http_request", ()),
    ("http.Head(", "http_request", ()), ("http.PostForm(", "http_request", ()), ("net.Dial(", "http_request", ()), ("net.DialTimeout(", "http_request", ()),
    (".ResolveReference(", "url_path", ()), (".JoinPath(", "url_path", ()), ("io.ReadAll(", "unbounded_read", ()), (".NewDecoder(", "unbounded_read", ()),
    ("ioutil.ReadAll(", "unbounded_read", ()), ("io.Copy(", "unbounded_read", ()), (".ReadFrom(", "unbounded_read", ()), ("c.Redirect(", "redirect", GIN_ECHO),
)
# The arguments of a pattern that matter; of others all do.
POSITIONS = {
    ".Query(": (0,), ".QueryRow(": (0,), ".Exec(": (0,), ".QueryContext(": (1,), ".QueryRowContext(": (1,), ".ExecContext(": (1,), ".Where(": (0,), ".Raw(": (0,),
    "http.Redirect(": (2,), "c.Redirect(": (1,), "os.Create(": (0,), "os.Open(": (0,), "os.OpenFile(": (0,), "os.WriteFile(": (0,), "os.MkdirAll(": (0,), "os.Stat(": (0,),
    "os.ReadFile(": (0,), "ioutil.ReadFile(": (0,), "os.Chmod(": (0,), "os.Rename(": (0, 1), "os.RemoveAll(": (0,), "http.Get(": (0,), "http.Post(": (0,), "http.Head(": (0,),
    "http.PostForm(": (0,), "http.NewRequest(": (1,), "http.NewRequestWithContext(": (2,), "net.Dial(": (1,), "net.DialTimeout(": (1,), "io.ReadAll(": (0,),
    "ioutil.ReadAll(": (0,), "io.Copy(": (1,), ".ReadFrom(": (0,), ".NewDecoder(": (0,), ".ResolveReference(": (0,),
}
DESTINATIONS = ("Address", "Addr", "URL", "Url", "BaseURL", "BaseUrl", "Endpoint", "Host", "ServerURL")
QUERY_CALL = r"^(?i:query|queryrow|querycontext|queryrowcontext|exec|execcontext|execute|search|raw|where|run|eval|mutate|newquery|do|dql|gql)$"
WRITERS_TO = ("fmt.Fprintf", "fmt.Fprint", "fmt.Fprintln", "io.WriteString")

_ROOTS = "array<string>"


def _none() -> Column:
    return F.array().cast(_ROOTS)


def _union(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(lists, lambda r: F.coalesce(r, _none())))))


def verbs(format_: Column) -> Column:
    """Of each verb of a URL's format, in order, whether it stands in the authority; null if the format has no scheme.

    Before ``://`` a verb is the scheme.  Behind it the first is the host, and one right after a colon the port; what
    follows a slash or a question mark, or is a further verb, is path or query.
    """
    scheme = F.instr(format_, "://")
    begun = F.struct(F.lit(False).alias("path"), F.lit(False).alias("host"), F.lit(False).alias("skip"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        at = lambda i: F.substring(format_, i, F.lit(1))
        path = s["path"] | ((k > scheme + 2) & at(k).isin("/", "?"))
        verb = (at(k) == "%") & ~s["skip"]
        literal = verb & (at(k + 1) == "%")
        placed = verb & ~literal
        port = at(k - 1) == ":"
        inside = (k >= scheme) & ~path
        authority = F.when(k < scheme, True).when(path, False).otherwise(~s["host"] | port)
        return F.struct(
            F.when(placed & inside & s["host"] & ~port, True).otherwise(path).alias("path"), (s["host"] | (placed & inside)).alias("host"), literal.alias("skip"),
            F.when(placed, F.concat(s["out"], F.array(authority))).otherwise(s["out"]).alias("out"))

    read = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(format_), F.lit(1))), begun, step)["out"]
    return F.when(scheme > 0, read)


_SPLIT = f"struct<auth:{_ROOTS},path:{_ROOTS}>"


def _split(auth: Column, path: Column) -> Column:
    return F.struct(auth.alias("auth"), path.alias("path"))


def format_split(format_: Column, args: Column) -> Column:
    """(auth, path): the roots of a formatted URL's arguments by where they land; null if it has no scheme.  ``args``: the roots of each argument behind the format."""
    places = verbs(format_)
    of = lambda here: _union(F.transform(F.filter(F.arrays_zip(places.alias("a"), args.alias("r")), lambda x: x["a"].eqNullSafe(F.lit(here))), lambda x: x["r"]))
    return F.when(places.isNotNull(), _split(of(True), of(False)))


def concat_split(parts: Column) -> Column:
    """(auth, path) of a URL put together from ``parts`` (literal, roots; a literal is not null for text); null without a scheme, or with a value before it."""
    begun = F.struct(F.lit(False).alias("seen"), F.lit(False).alias("in_path"), F.lit(False).alias("failed"), _none().alias("auth"), _none().alias("path"))

    def step(s: Column, p: Column) -> Column:
        text, roots = p["literal"], F.coalesce(p["roots"], _none())
        scheme = F.instr(text, "://")
        starts = text.isNotNull() & ~s["seen"] & (scheme > 0)
        behind = F.when(starts, F.substring(text, scheme + 3, F.length(text))).otherwise(text)
        slashed = text.isNotNull() & (starts | s["seen"]) & behind.rlike("[/?]")
        value = text.isNull()
        return F.struct(
            (s["seen"] | starts).alias("seen"), (s["in_path"] | slashed).alias("in_path"), (s["failed"] | (value & ~s["seen"])).alias("failed"),
            F.when(value & ~s["in_path"], F.concat(s["auth"], roots)).otherwise(s["auth"]).alias("auth"), F.when(value & s["in_path"], F.concat(s["path"], roots)).otherwise(s["path"]).alias("path"))

    read = F.aggregate(parts, begun, step)
    sorted_ = lambda c: F.array_sort(F.array_distinct(c))
    return F.when(read["seen"] & ~read["failed"], _split(sorted_(read["auth"]), sorted_(read["path"])))


def built(values: DataFrame, definitions: DataFrame, scratch: Scratch, depth: int = 3) -> DataFrame:
    """function, value, url (auth, path; null: no URL with a scheme) and built (put together as a string) of each value.

    ``values``: function, value (an id), kind (format, concat, ident, other), name (of an ident), format, args (the roots of
    each), parts (literal, roots).  ``definitions``: function, name, value, append (``+=``), roots.  An identifier is what
    it was defined as, ``depth`` steps back at most; what is appended to a URL is path.
    """
    literal = F.exists("parts", lambda p: p["literal"].isNotNull())
    url = F.when(F.col("kind") == "format", format_split(F.col("format"), F.col("args"))).when(F.col("kind") == "concat", concat_split(F.col("parts")))
    plain = values.where("kind <> 'ident'").select("function", "value", url.cast(_SPLIT).alias("url"), F.coalesce((F.col("kind") == "format") | ((F.col("kind") == "concat") & literal), F.lit(False)).alias("built"))
    plain = scratch.cut(plain, "plain")
    idents = scratch.cut(values.where("kind = 'ident'").select("function", "value", "name"), "idents")
    added = definitions.where("append").groupBy("function", "name").agg(F.flatten(F.collect_list(F.coalesce("roots", _none()))).alias("added"))
    means = scratch.cut(idents.join(definitions.where("not append").select("function", "name", F.col("value").alias("by")), ["function", "name"]).select("function", "value", "by").distinct(), "means")
    tail = idents.join(added, ["function", "name"], "left")
    known = plain
    for _ in range(depth):
        of = means.join(known.select("function", F.col("value").alias("by"), "url", "built"), ["function", "by"]).groupBy("function", "value").agg(
            F.collect_list("url.auth").alias("auth"), F.collect_list("url.path").alias("path"), F.count("url").alias("urls"), F.bool_or("built").alias("built"))
        some = tail.join(of, ["function", "value"], "left")
        path = F.concat("path", F.array(F.coalesce("added", _none())))
        here = some.select("function", "value", F.when(F.col("urls") > 0, _split(_union(F.col("auth")), _union(path))).alias("url"), (F.coalesce("built", F.lit(False)) | F.col("added").isNotNull()).alias("built"))
        known = scratch.cut(plain.unionByName(here), "known")
    return known


def call_sinks(calls: DataFrame, imports: DataFrame, built_: DataFrame, writers: DataFrame) -> DataFrame:
    """function, line, type, pattern and roots of calls that are sinks which some root reaches.

    ``calls``: function, file, call (an id), line, code (the called expression with its parenthesis), prefix and name as in
    ``producer``, package (its import path if the prefix names one), receiver (text before the name), text, and args: an array of (value, roots);
    ``imports``: file, package; ``built_`` as ``built`` gives it; ``writers``: function, name (parameters that are responses), safe (a content type is set).
    """
    held = imports.groupBy("file").agg(F.collect_set("package").alias("__imports"))
    rows = calls.join(held, "file", "left").join(writers.groupBy("function").agg(F.collect_set("name").alias("__writers"), F.bool_or("safe").alias("__safe")), "function", "left")
    of = built_.groupBy("function", "value").agg(F.first("url").alias("url"), F.bool_or("built").alias("built"))
    args = rows.select("function", "call", F.posexplode("args").alias("i", "a")).select("function", "call", "i", "a.value").join(of, ["function", "value"])
    per = args.groupBy("function", "call").agg(F.map_from_entries(F.collect_set(F.struct("i", "url"))).alias("__urls"), F.collect_set(F.when(F.col("built"), F.col("i"))).alias("__built"))
    rows = rows.join(per, ["function", "call"], "left")

    some = F.lit(None).cast("struct<pattern:string,type:string,at:array<int>>")
    for pattern, kind, gates in reversed(PATTERNS):
        gate = F.exists(F.coalesce("__imports", _none()), lambda x: F.exists(F.array(*map(F.lit, gates)), lambda g: (x == g) | F.startswith(x, F.concat(g, F.lit("/"))))) if gates else F.lit(True)
        at = F.array(*map(F.lit, POSITIONS[pattern])) if pattern in POSITIONS else F.lit(None)
        some = F.when(F.contains("code", F.lit(pattern)) & gate, F.struct(F.lit(pattern).alias("pattern"), F.lit(kind).alias("type"), at.cast("array<int>").alias("at"))).otherwise(some)
    rows = rows.withColumn("__hit", some)
    roots = F.transform("args", lambda a: F.coalesce(a["roots"], _none()))
    chosen = lambda keep: _union(F.filter(roots, lambda _, i: keep(i)))
    bound = F.col("__hit.type").isin("sql_query", "sql_exec") & F.contains(F.lower(F.coalesce("receiver", F.lit(""))), F.lit("stmt"))
    make = F.coalesce((F.col("name") == "make") & F.col("prefix").isNull() & (F.size("args") >= 2), F.lit(False))
    hit = F.when(make, "alloc_size").when(~F.coalesce(bound, F.lit(False)), F.col("__hit.type"))
    first = F.when(F.size("__hit.at") == 1, F.try_element_at("__urls", F.get("__hit.at", F.lit(0))))
    rows = rows.withColumn("__type", hit).withColumn("__url", F.when(F.col("__type") == "http_request", first))
    pattern_roots = F.when(make, chosen(lambda i: i >= 1)).when(F.col("__url").isNotNull(), F.col("__url.auth")).when(F.col("__hit.at").isNotNull(), chosen(lambda i: F.array_contains("__hit.at", i))).otherwise(_union(roots))
    query = F.col("__type").isNull() & F.col("prefix").isNotNull() & F.col("name").rlike(QUERY_CALL) & ~F.coalesce(scalars.is_standard_package(F.col("package")), F.lit(False))
    query_roots = F.when(F.coalesce(query, F.lit(False)), chosen(lambda i: F.array_contains(F.coalesce("__built", F.array().cast("array<int>")), i))).otherwise(_none())
    to_writer = lambda c: F.coalesce(F.array_contains("__writers", c), F.lit(False))
    function_name = F.concat_ws(".", "prefix", "name")
    own = (F.col("name") == "Write") & to_writer(F.col("prefix"))
    through = function_name.isin(*WRITERS_TO) & (F.size("args") > 1) & to_writer(F.get("args", F.lit(0))["value"])
    unsafe = F.col("__type").isNull() & F.col("__writers").isNotNull() & ~F.coalesce("__safe", F.lit(False)) & (F.size(query_roots) == 0)
    response = F.when(unsafe & F.coalesce(own, F.lit(False)), _union(roots)).when(unsafe & F.coalesce(through, F.lit(False)), chosen(lambda i: i >= 1)).otherwise(_none())
    sink = lambda kind, reached: F.struct(kind.alias("type"), reached.alias("roots"))
    sinks = F.array(
        F.when(F.col("__type").isNotNull(), sink(F.col("__type"), pattern_roots)), F.when(F.col("__url").isNotNull(), sink(F.lit("url_path"), F.col("__url.path"))),
        F.when(F.size(query_roots) > 0, sink(F.lit("query_built"), query_roots)), F.when(F.size(response) > 0, sink(F.lit("response_write"), response)))
    each = rows.select("function", "line", F.substring("text", 1, 120).alias("pattern"), F.explode(F.filter(sinks, lambda s: s.isNotNull() & (F.size(s["roots"]) > 0))).alias("s"))
    return each.select("function", "line", "s.type", "pattern", "s.roots")


def destination_sinks(assignments: DataFrame) -> DataFrame:
    """Sinks of values written into the destination of a client: ``assignments``: function, line, field, text, roots."""
    reached = assignments.where(F.col("field").isin(*DESTINATIONS) & (F.size("roots") > 0))
    return reached.select("function", "line", F.lit("http_request").alias("type"), F.substring("text", 1, 120).alias("pattern"), F.array_sort("roots").alias("roots"))
