"""CVSS 3.1 base scores as column expressions, and metrics resolved with their provenance."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("AV", "AC", "PR", "UI", "S", "C", "I", "A")

#: The specification's metric values, weights, words for values, and severity bands.
VALUES = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}
AV_WEIGHT = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}
AC_WEIGHT = {"L": 0.77, "H": 0.44}
PR_WEIGHT = {"NU": 0.85, "NC": 0.85, "LU": 0.62, "LC": 0.68, "HU": 0.27, "HC": 0.50}
UI_WEIGHT = {"N": 0.85, "R": 0.62}
CIA_WEIGHT = {"H": 0.56, "L": 0.22, "N": 0.0}
WORDS = {
    "NETWORK": "N", "ADJACENT": "A", "ADJACENT_NETWORK": "A", "LOCAL": "L", "PHYSICAL": "P", "NONE": "N", "LOW": "L",
    "HIGH": "H", "REQUIRED": "R", "UNCHANGED": "U", "CHANGED": "C",
}
BANDS = ((9.0, "critical"), (7.0, "high"), (4.0, "medium"), (0.1, "low"))

#: Default vector of each category, and of any other.
DEFAULTS = {
    "input_sanitization": "AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N",
    "bounds_check": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H",
    "origin_validation": "AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:L/A:N",
    "access_control": "AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H",
    "output_encoding": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "resource_limit": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H",
    "cryptographic_verification": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "state_synchronization": "AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:H/A:H",
    "error_handling": "AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:L",
    "path_validation": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "identity_verification": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N",
    "protocol_validation": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:L",
}
OTHER_DEFAULT = "AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N"

#: Source types that show the attack vector, and what sinks raise.
NETWORK_SOURCES = ("http_request", "http_body", "network_accept", "network_read", "read_message")
LOCAL_SOURCES = ("read", "read_all", "buffered_read", "json_decode", "xml_decode", "binary_read", "scan", "io_copy", "channel_recv")
SINK_RAISES = {
    "command_execution": {"C": "H", "I": "H", "A": "H"},
    "sql_query": {"C": "H", "I": "H"},
    "sql_exec": {"C": "H", "I": "H"},
    "file_write": {"I": "H"},
    "file_read": {"C": "H"},
    "html_injection": {"C": "L", "I": "L"},
    "js_injection": {"C": "L", "I": "L"},
    "string_format": {"I": "L"},
    "write": {"I": "L"},
}


def _pairs(vector: str) -> dict[str, str]:
    return dict(x.split(":") for x in vector.split("/"))


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def metrics_struct(**values: Column) -> Column:
    return F.struct(*[values[m].alias(m) for m in METRICS])


def domain(spark: SparkSession) -> DataFrame:
    """All 2,592 combinations of metric values, a column each."""
    rows = list(itertools.product(*[VALUES[m] for m in METRICS]))
    return spark.createDataFrame(rows, ", ".join(f"{m} string" for m in METRICS))


def impact(m: Column) -> Column:
    weight = lambda k: _lookup(CIA_WEIGHT, m[k])
    iss = 1 - (1 - weight("C")) * (1 - weight("I")) * (1 - weight("A"))
    return F.when(m["S"] == "U", 6.42 * iss).otherwise(7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15)))


def exploitability(m: Column) -> Column:
    return 8.22 * _lookup(AV_WEIGHT, m["AV"]) * _lookup(AC_WEIGHT, m["AC"]) * _lookup(PR_WEIGHT, F.concat(m["PR"], m["S"])) * _lookup(UI_WEIGHT, m["UI"])


def round_up(value: Column) -> Column:
    """The smallest tenth that isn't below the value, by integers of 1/100000."""
    whole = F.rint(value * 100000).cast("long")
    return F.when(whole % 10000 == 0, whole / 100000.0).otherwise((F.floor(whole / 10000) + 1) / 10.0)


def base_score(m: Column) -> Column:
    """Score of a struct of the eight metrics."""
    i, scale = impact(m), F.when(m["S"] == "U", 1.0).otherwise(1.08)
    return F.when(i <= 0, 0.0).otherwise(round_up(F.least(scale * (i + exploitability(m)), F.lit(10.0))))


def severity(score: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def vector(m: Column) -> Column:
    return F.concat(F.lit("CVSS:3.1"), *[x for k in METRICS for x in (F.lit(f"/{k}:"), m[k])])


def normal_value(metric: str, value: Column) -> Column:
    """The canonical value of a metric, by letter or word in any case; null if it isn't one."""
    v = F.upper(F.trim(value))
    mapped = F.coalesce(F.when(v.isin(*VALUES[metric]), v), _lookup(WORDS, v))
    return F.when(mapped.isin(*VALUES[metric]), mapped)


def parse_vector(text: Column) -> tuple[Column, Column]:
    """(struct of the metrics, error): one is null. Errors name the first fault, in the order of the text."""
    parts = F.split(F.regexp_replace(F.trim(text), " ", ""), "/")
    prefix = F.upper(F.element_at(parts, 1))
    fields = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    key = lambda p: F.upper(F.substring_index(p, ":", 1))
    keys = F.transform(fields, key)

    def raw(m: str) -> Column:
        mine = F.filter(fields, lambda p: key(p) == F.lit(m))
        return F.get(F.transform(mine, lambda p: F.substring(p, F.lit(len(m) + 2), F.length(p))), F.lit(0))

    normal = {m: normal_value(m, raw(m)) for m in METRICS}

    def fault(p: Column, i: Column) -> Column:
        legal = F.lit(None).cast("string")
        for m in METRICS:
            legal = F.when(key(p) == m, normal_value(m, F.substring(p, F.lit(len(m) + 2), F.length(p)))).otherwise(legal)
        return (
            F.when(~F.contains(p, F.lit(":")), "bad segment").when(~key(p).isin(*METRICS), "unknown metric")
            .when(F.array_position(keys, key(p)) <= i, "duplicate metric").when(legal.isNull(), "illegal value")
        )

    faults = F.filter(F.transform(fields, fault), lambda x: x.isNotNull())
    missing = F.array_compact(F.array(*[F.when(~F.array_contains(keys, m), F.lit(m)) for m in METRICS]))
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), "empty vector")
        .when(~prefix.isin("CVSS:3.1", "CVSS:3.0"), "bad prefix")
        .when(F.size(faults) > 0, F.get(faults, F.lit(0))).when(F.size(missing) > 0, "missing metrics")
    )
    return F.when(error.isNull(), metrics_struct(**normal)), error


_RANK = {"N": 0, "L": 1, "H": 2}


def resolved(given: Column, category: Column, source_types: Column, sink_types: Column) -> tuple[Column, Column]:
    """(metrics, provenance), structs by metric.

    ``given``: a map of supplied metrics (may be null or partial, words allowed); types: arrays.
    Facts may raise what is supplied or defaulted, never lower it; if no impact is left, the
    category's default impacts come back.
    """
    default = {m: F.coalesce(_lookup({c: _pairs(v)[m] for c, v in DEFAULTS.items()}, category), F.lit(_pairs(OTHER_DEFAULT)[m])) for m in METRICS}
    own = {m: normal_value(m, F.try_element_at(given, F.lit(m))) for m in METRICS}
    has = lambda types, names: F.arrays_overlap(F.coalesce(types, F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    fact_av = F.when(has(source_types, NETWORK_SOURCES), "N").when(has(source_types, LOCAL_SOURCES), "L")
    weigh = lambda v: _lookup(AV_WEIGHT, v)
    by_fact = F.when(own["AV"].isNotNull(), weigh(fact_av) > weigh(own["AV"])).otherwise(weigh(fact_av) >= weigh(default["AV"])).eqNullSafe(True)
    values, origin = {}, {}
    values["AV"] = F.when(by_fact, fact_av).otherwise(F.coalesce(own["AV"], default["AV"]))
    origin["AV"] = F.when(by_fact, "ast_fact").when(own["AV"].isNotNull(), "llm").otherwise("category_default")
    for m in ("C", "I", "A"):
        top = F.lit(None).cast("string")
        for level in ("L", "H"):
            raising = [s for s, v in SINK_RAISES.items() if v.get(m) == level]
            if raising:
                top = F.when(has(sink_types, raising), level).otherwise(top)
        base = F.coalesce(own[m], default[m])
        raised = (_lookup(_RANK, top) > _lookup(_RANK, base)).eqNullSafe(True)
        values[m] = F.when(raised, top).otherwise(base)
        origin[m] = F.when(raised, "sink_upgrade").when(own[m].isNotNull(), "llm").otherwise("category_default")
    none = (values["C"] == "N") & (values["I"] == "N") & (values["A"] == "N")
    for m in ("C", "I", "A"):
        values[m], origin[m] = F.when(none, default[m]).otherwise(values[m]), F.when(none, "all_none_override").otherwise(origin[m])
    for m in ("AC", "PR", "UI", "S"):
        values[m], origin[m] = F.coalesce(own[m], default[m]), F.when(own[m].isNotNull(), "llm").otherwise("category_default")
    return metrics_struct(**values), metrics_struct(**origin)


def scored(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings with cvss (metrics), cvss_provenance, cvss_vector, cvss_score and severity.

    ``flows``: function, source_types, sink_types.  ``findings`` may hold cvss_metrics, a map of supplied metrics.
    """
    given = F.col("cvss_metrics") if "cvss_metrics" in findings.columns else F.lit(None).cast("map<string,string>")
    metrics, origin = resolved(given, F.col("category"), F.col("source_types"), F.col("sink_types"))
    out = findings.join(flows.select("function", "source_types", "sink_types"), "function", "left")
    out = out.withColumns({"cvss": metrics, "cvss_provenance": origin}).drop("source_types", "sink_types", "cvss_metrics")
    out = out.withColumns({"cvss_vector": vector(F.col("cvss")), "cvss_score": base_score(F.col("cvss"))})
    return out.withColumn("severity", severity(F.col("cvss_score")))
