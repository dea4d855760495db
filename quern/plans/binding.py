"""Answers of a model bound to what was asked, by identity.

``bound`` takes a batch's answer (JSON) whole or not at all: an answer that is no list, or in which an id is missing,
unknown or said twice, binds nothing, as its other entries can't be told apart from mistakes either.  Inside a batch that
stands, each entry is held to the schema of facts by its own types (a line "5" or 5.0 is no line).

Defined cases: a batch without an answer, or with one that is no JSON, is an invalid response; an empty list binds nothing and
misses every id; bounds that are null don't bound; ids asked for twice count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cvss
from quern.plans import seeds

#: Lists of facts, the field that names their kind, and what it may be.
FACTS = (
    ("semantic_inputs", "origin", (*seeds.ORIGIN_TYPES, "internal")),
    ("semantic_sinks", "kind", (*seeds.KIND_TYPES, *seeds.SHAPE_KIND_TYPES)),
    ("observed_checks", "category", (*cvss.DEFAULTS, "other_security")),
)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    """Is a value there, and of that JSON type?"""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _optional_text(v: Column) -> Column:
    return v.isNull() | _is(v, "STRING")


def valid_item(item: Column, low: Column, high: Column) -> Column:
    """Does an entry keep to the schema, with lines inside the function?"""

    def fact(f: Column, field: str, allowed: tuple[str, ...]) -> Column:
        line = F.when(_is(_at(f, "$.line"), "BIGINT"), F.try_variant_get(f, "$.line", "long"))
        within = F.coalesce((line > 0) & (low.isNull() | line.between(low, high)), F.lit(False))
        known = F.coalesce(_text(_at(f, f"$.{field}")).isin(*allowed), F.lit(False))
        return _is(f, "OBJECT") & within & known & _optional_text(_at(f, "$.desc"))

    good = _optional_text(_at(item, "$.purpose"))
    for name, field, allowed in FACTS:
        found = _at(item, f"$.{name}")
        good = good & _is(found, "ARRAY") & F.coalesce(F.forall(F.try_variant_get(found, "$", "array<variant>"), lambda f: fact(f, field, allowed)), F.lit(False))
    return good


def bound(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """batch, function_id, item (variant; null if not bound) and reason (null if bound) for every id asked for.

    ``answers``: batch, response (JSON, one a batch); ``asked``: batch, function_id, low, high (lines).
    An entry names its function by ``function_id``, or by ``function`` where it has no such field.
    """
    keys = asked.dropDuplicates(["batch", "function_id"])
    whole = answers.select("batch", F.try_parse_json("response").alias("v")).select("batch", F.when(_is(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", "array<variant>")).alias("items"))
    item = whole.where("items is not null").select("batch", F.explode("items").alias("item"))
    named = _at(F.col("item"), "$.function_id")
    id_ = F.when(_is(F.col("item"), "OBJECT"), F.when(named.isNotNull(), _text(named)).otherwise(_text(_at(F.col("item"), "$.function"))))
    item = item.withColumn("function_id", id_)
    known = item.join(keys.withColumn("__known", F.lit(True)), ["batch", "function_id"], "left")
    # a batch stands if all its ids are known and none repeats
    fit = known.groupBy("batch").agg((F.bool_and(F.coalesce("__known", F.lit(False))) & (F.count(F.lit(1)) == F.count_distinct("function_id"))).alias("__fit"))
    lists = whole.select("batch", F.col("items").isNotNull().alias("__list")).join(fit, "batch", "left")
    mine = known.where("__known").join(fit.where("__fit").select("batch"), "batch", "left_semi").select("batch", "function_id", "item", valid_item(F.col("item"), F.col("low"), F.col("high")).alias("__valid"))
    out = keys.join(lists, "batch", "left").join(mine, ["batch", "function_id"], "left")
    no = F.lit(False)
    reason = F.when(~F.coalesce("__list", no), "invalid_response").when(~F.coalesce("__fit", F.lit(True)), "duplicate_or_unknown_id").when(F.col("__valid").isNull(), "missing_id").when(~F.col("__valid"), "invalid_fact_schema")
    return out.select("batch", "function_id", F.when(reason.isNull(), F.col("item")).alias("item"), reason.alias("reason"))
