"""Dimension tables. All values in this module are fixed values of the rule set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Source types that count as any external input.
ALL_SOURCES = (
    "read", "read_all", "channel_recv", "network_accept", "read_message", "network_read", "http_request",
    "http_body", "buffered_read", "json_decode", "xml_decode", "binary_read", "scan", "io_copy",
)

#: For each missing-step category, its source types and its sink types.
CATEGORY_HINTS = {
    "input_sanitization": (ALL_SOURCES, ("command_execution", "sql_query", "sql_exec", "string_format", "write", "html_injection", "js_injection")),
    "output_encoding": (ALL_SOURCES, ("string_format", "write", "html_injection", "js_injection")),
    "path_validation": (ALL_SOURCES, ("file_read", "file_write")),
    "bounds_check": (("json_decode", "xml_decode", "binary_read", "scan", "read", "read_all", "buffered_read", "io_copy", "http_body"), ()),
    "resource_limit": (("json_decode", "xml_decode", "binary_read", "scan", "read_all", "io_copy", "http_body", "network_accept", "read_message"), ()),
    "origin_validation": (("http_request", "http_body"), ()),
    "access_control": (("http_request", "http_body", "network_accept", "read_message"), ()),
    "identity_verification": (("http_request", "http_body", "network_accept", "read_message"), ()),
    "state_synchronization": (("channel_recv",), ()),
    "protocol_validation": (("network_read", "network_accept", "read_message", "scan", "binary_read"), ()),
    "cryptographic_verification": ((), ()),
    "error_handling": ((), ()),
}
CATEGORIES = tuple(sorted(CATEGORY_HINTS))
SOURCE_ONLY = tuple(sorted(c for c, (s, k) in CATEGORY_HINTS.items() if s and not k))

#: Source type of each model origin; origins that aren't here are dropped.
ORIGIN_TYPES = {"network": "http_request", "file": "read", "cli": "scan", "env": "read"}

#: Sink type of each model kind.
KIND_TYPES = {
    "file_write": "file_write", "file_read": "file_read", "command": "command_execution", "sql": "sql_query",
    "http_response": "write", "log": "write", "network": "http_request", "template": "string_format",
}

#: The kinds that shapes add, and the categories of shape-named sinks.
SHAPE_KIND_TYPES = {
    "query": "sql_query", "alloc": "alloc_size", "unbounded_read": "unbounded_read", "url_path": "url_path",
    "redirect": "redirect", "response_html": "response_write", "forward": "forward",
}
SHAPE_CATEGORIES = {
    "alloc_size": ("resource_limit",), "unbounded_read": ("resource_limit",), "url_path": ("path_validation",),
    "redirect": ("origin_validation",), "response_write": ("output_encoding",),
    "forward": ("identity_verification", "input_sanitization"),
}

#: Size sinks and what guards them.
SIZE_SOURCES = (
    "http_request", "http_body", "read_message", "network_read", "network_accept", "read", "read_all", "scan",
    "buffered_read", "json_decode", "xml_decode", "binary_read", "io_copy",
)
SIZE_CATEGORIES = {"alloc_size": "resource_limit", "index_access": "bounds_check"}
SIZE_GUARDS = ("resource_limit", "bounds_check")

#: Category of each sink that a tainted parameter may reach.
TAINT_CATEGORIES = {
    "command_execution": "input_sanitization", "sql_query": "input_sanitization",
    "sql_exec": "input_sanitization", "query_exec": "output_encoding",
    "file_read": "path_validation", "file_write": "path_validation",
    "html_injection": "output_encoding", "js_injection": "output_encoding",
    "redirect": "origin_validation", "alloc_size": "resource_limit",
    "http_request": "input_sanitization",
    "unbounded_read": "resource_limit",
    "url_path": "path_validation",
    "query_built": "input_sanitization",
    "response_write": "output_encoding",
}

#: Sinks too general to judge.
GENERIC_SINKS = ("string_format", "write")

#: Validator purposes: category, sinks that show the purpose, parameter names that suggest it,
#: and patterns of checks that settle it (strong) or don't (weak).
PURPOSES = {
    "redirect": ("origin_validation", ("redirect",), None,
                 (r'HasPrefix\([^,]+,\s*"//"\)', r'HasPrefix\([^,]+,\s*"/\\\\"\)', r"HasPrefix\([^,]+,\s*`/\\`\)", r"(?i)(allowed|allowlist|whitelist)\w*\("),
                 (r'HasPrefix\([^,]+,\s*"/"\)', r"\.Scheme\s*[!=]=", r"\.Host\s*[!=]=", r"url\.Parse\(")),
    "path": ("path_validation", ("file_read", "file_write"), None,
             (r"filepath\.IsLocal\(", r"filepath\.Rel\(", r"SecureJoin\(", r"OpenRoot\(|OpenInRoot\(", r"HasPrefix\(\s*filepath\.Clean\("),
             (r'Contains\([^,]+,\s*"\.\."\)', r"filepath\.Clean\(|path\.Clean\(")),
    "encoding": ("output_encoding", ("html_injection", "js_injection", "query_exec"), None,
                 (r"html\.EscapeString\(|template\.HTMLEscapeString\(|template\.JSEscapeString\(", r"url\.QueryEscape\(|url\.PathEscape\(", r"ldap\.EscapeFilter\(|ldap\.EscapeDN\(", r"bluemonday\."),
                 ()),
    "input": ("input_sanitization", ("command_execution", "sql_query", "sql_exec"), None,
              (r"\.MatchString\(|\.Match\(", r"IndexAny\(|ContainsAny\(|IndexFunc\(|ContainsFunc\(|ContainsRune\("),
              (r"Contains\(",)),
    "url_field": ("input_sanitization", (), r"(?i)url|uri|href|link",
                  (r"IndexAny\(|ContainsAny\(|IndexFunc\(|ContainsFunc\(|ContainsRune\(", r"\.MatchString\(|\.Match\(", r"html\.EscapeString\(|url\.QueryEscape\(|url\.PathEscape\("),
                  (r"url\.Parse\(|url\.ParseRequestURI\(", r"\.Scheme\s*[!=]=|\.IsAbs\(")),
    "outbound": ("input_sanitization", ("http_request",), None,
                 (r"\.IsPrivate\(|\.IsLoopback\(|\.IsLinkLocalUnicast\(|\.IsUnspecified\(|\.IsGlobalUnicast\(", r"(?i)(allowed|allowlist|whitelist)\w*\("),
                 (r"url\.Parse\(|url\.ParseRequestURI\(", r"\.Scheme\s*[!=]=")),
}

#: Validator names, and the verbs that need no boolean or error result.
VALIDATOR_NAME = r"^(?i:validate|valid|check|verify|sanitize)|^(?:is|Is)[A-Z].*(?:Valid|Allowed|Safe)"
VALIDATOR_VERB = r"^(?i:validate|verify|sanitize)"

#: The primary category of each role, and the generic chains written for it.
ROLES = {
    "resource_access": ("access_control", ("GEN-CWE639-1",)),
    "authorization": ("access_control", ("GEN-CWE862-1", "GEN-CWE863-1")),
    "authentication": ("identity_verification", ("GEN-CWE306-1",)),
    "trusted_forwarding": ("identity_verification", ("GEN-CWE290-1",)),
    "validator": ("input_sanitization", ("GEN-CWE20-VALIDATE-1",)),
    "redirect_origin": ("origin_validation", ("GEN-CWE601-1", "GEN-CWE352-1")),
    "protocol_handler": ("protocol_validation", ("GEN-CWE20-PROTO-1",)),
    "state_mutation": ("state_synchronization", ("GEN-CWE362-1",)),
}

#: Words that carry no meaning in names.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "that", "this", "are", "via", "its", "not", "without", "before",
    "after", "when", "then", "which", "each", "using", "use", "get", "set", "new", "err", "error",
)

#: Function priority.
RISKY_PACKAGES = (
    "os/exec", "database/sql", "net/http", "archive/zip", "archive/tar", "crypto/cipher", "crypto/rsa",
    "text/template", "html/template",
)
RISKY_NAMES = (
    "handle", "process", "parse", "execute", "write", "read", "serve", "dispatch", "validate", "verify", "auth",
    "login", "upload", "download", "import", "export", "create", "delete",
)
DANGEROUS_SINKS = ("string_format", "write", "command_execution", "sql_query")


def category_hints(spark: SparkSession) -> DataFrame:
    """category, source_type, sink_type (null: any); one row for each pair."""
    rows = [(c, s, k) for c, (sources, sinks) in CATEGORY_HINTS.items() for s in sources for k in (sinks or (None,))]
    return spark.createDataFrame(rows, "category string, source_type string, sink_type string")


def mapping(spark: SparkSession, values: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"{key} string, {value} string")


def shape_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c) for k, cs in SHAPE_CATEGORIES.items() for c in cs], "sink_type string, category string")


def roles(spark: SparkSession) -> DataFrame:
    """role, category, generics."""
    return spark.createDataFrame([(r, c, list(g)) for r, (c, g) in ROLES.items()], "role string, category string, generics array<string>")
