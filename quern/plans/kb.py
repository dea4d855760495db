"""The knowledge base: behaviour chains to templates, their indexes and coverage; retrieval for functions.

Defined cases: chains with an error, without steps or with none or several missing make no template; null lists count as
empty; of equal scores the smaller id comes first; a function whose role is unknown, or whose category has no chain, gets
none; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import aggregates, ranks
from quern.scratch import Scratch

CHAIN = (
    "go_id STRING, module_path STRING, primary_domain STRING, generic BOOLEAN, chain_type STRING, summary STRING, pattern_name STRING, "
    "cwe_alignment ARRAY<STRING>, chain ARRAY<STRUCT<step_id:INT, action:STRING, description:STRING, is_missing_step:BOOLEAN, "
    "missing_step_category:STRING, evidence:STRUCT<apis:ARRAY<STRING>, functions:ARRAY<STRING>>>>, error STRING"
)


def missing_step() -> Column:
    return F.get(F.filter("chain", lambda s: s["is_missing_step"]), F.lit(0))


def valid_chains(chains: DataFrame) -> DataFrame:
    """Chains without an error, of 2 to 8 steps with actions, exactly one of them missing; with category and apis."""
    steps = F.size("chain").between(2, 8) & F.forall("chain", lambda s: F.coalesce(F.trim(s["action"]), F.lit("")) != "")
    one = F.size(F.filter("chain", lambda s: s["is_missing_step"])) == 1
    apis = F.array_distinct(F.flatten(F.transform("chain", lambda s: F.coalesce(s["evidence"]["apis"], F.array().cast("array<string>")))))
    return chains.where(F.col("error").isNull() & steps & one).withColumns({"category": missing_step()["missing_step_category"], "missing_id": missing_step()["step_id"], "apis": apis})


def faults(chains: DataFrame) -> DataFrame:
    """go_id and errors: what is wrong with each chain."""
    n = F.coalesce(F.size("chain"), F.lit(0))
    missing = F.size(F.filter("chain", lambda s: s["is_missing_step"]))
    errors = F.array_compact(F.array(
        F.when(~n.between(2, 8), "steps"), F.when(missing != 1, "missing_step"),
        F.when(~F.forall("chain", lambda s: F.coalesce(F.trim(s["action"]), F.lit("")) != ""), "action")))
    return chains.select("go_id", errors.alias("errors"))


def templates(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """A template for each (domain, category): numbered, with its top APIs, positions, CWEs, patterns, dominant type, examples, summary."""
    group = ["primary_domain", "category"]
    base = chains.groupBy(*group).agg(
        F.count("*").alias("chain_count"), F.min("missing_id").alias("first_position"), F.max("missing_id").alias("last_position"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cwe_alignment")))).alias("cwes"), F.array_sort(F.collect_set("pattern_name")).alias("pattern_names"))
    apis = aggregates.top_values(chains.select(*group, F.explode("apis").alias("api")), group, "api", 10).withColumnRenamed("top", "api_indicators")
    kind = aggregates.most_common(chains, group, "chain_type", "go_id").withColumnRenamed("dominant", "chain_type")
    first = aggregates.best_of_each(chains.select(*group, "go_id", "summary"), group, [F.col("go_id")], 5).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", "go_id", "summary"))).alias("e"))
    first = first.select(*group, F.transform("e", lambda x: x["go_id"]).alias("examples"), F.array_join(F.transform(F.slice("e", 1, 3), lambda x: x["summary"]), "; ").alias("summary"))
    all_ = base.join(apis, group, "left").join(kind, group).join(first, group)
    numbered = ranks.global_rank(scratch.cut(all_, "templates"), [F.col(c) for c in group], "n", scratch)
    return numbered.withColumn("template_id", F.format_string("tpl_%03d", "n")).drop("n")


def indexes(templates_: DataFrame) -> dict[str, DataFrame]:
    """Inverted indexes of templates: by domain, category, API and pattern."""
    return {
        "domain": aggregates.inverted_index(templates_, F.col("primary_domain"), "template_id"),
        "category": aggregates.inverted_index(templates_, F.col("category"), "template_id"),
        "api": aggregates.inverted_index(templates_, F.explode("api_indicators"), "template_id"),
        "pattern": aggregates.inverted_index(templates_, F.explode("pattern_names"), "template_id"),
    }


def coverage(templates_: DataFrame) -> DataFrame:
    return aggregates.summary(templates_.select("primary_domain", "category", F.col("chain_count").cast("double").alias("chain_count")), ["primary_domain", "category"], "chain_count")


def candidates(templates_: DataFrame, domains: DataFrame, project_apis: DataFrame, scratch: Scratch) -> DataFrame:
    """template_id, score, overlap, rank: half the domain's confidence, half the share of APIs that the project uses.

    ``domains``: domain, confidence (null: 0.5), ord (of equal domains the last counts); ``project_apis``: api.
    """
    last = domains.groupBy("domain").agg(F.max_by(F.coalesce("confidence", F.lit(0.5)), "ord").alias("confidence"))
    met = templates_.join(last, F.col("primary_domain") == F.col("domain"))
    used = met.select("template_id", F.explode("api_indicators").alias("api")).join(project_apis.select("api").distinct(), "api").groupBy("template_id").agg(F.count("*").cast("int").alias("overlap"))
    scored = met.join(used, "template_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    score = 0.5 * F.col("confidence") + 0.5 * F.col("overlap") / F.greatest(F.size("api_indicators"), F.lit(1))
    ranked = ranks.global_rank(scored.withColumn("score", score), [F.desc("score"), F.col("template_id")], "rank", scratch)
    return ranked.select("template_id", "category", "pattern_names", "score", "overlap", F.col("rank").cast("int").alias("rank"))


def for_roles(functions: DataFrame, chains: DataFrame, roles: DataFrame, active: list[str], weights: DataFrame | None = None) -> DataFrame:
    """The best real and the best generic chain of each function: function, go_id, generic, score.

    ``functions``: function, role, text; ``chains``: go_id, category, primary_domain, generic, bag (array);
    ``roles``: role, category, generics (array of go_id).  Score: weights of shared tokens, 0.5 for an active domain.
    """
    f = functions.join(roles, "role").withColumn("tokens", scalars.name_tokens(F.col("text")))
    bonus = F.when(F.col("primary_domain").isin(*active) if active else F.lit(False), 0.5).otherwise(0.0)
    c = chains.select("go_id", F.col("category").alias("chain_category"), "primary_domain", "generic", "bag", bonus.alias("bonus"))
    real, listed = c.where("not generic"), c.where("generic")
    # generic chains meet by the role's list; real ones of the category by a token that they share
    generic = f.select("function", "tokens", F.explode("generics").alias("go_id")).join(listed, "go_id").select("function", "go_id", "generic", "bonus", F.array_sort(F.array_intersect("tokens", "bag")).alias("shared"))
    words = f.select("function", "category", F.explode("tokens").alias("token"))
    held = real.select("chain_category", "go_id", "bonus", F.explode(F.array_distinct("bag")).alias("token"))
    met = words.join(held, (F.col("category") == F.col("chain_category")) & (words.token == held.token)).groupBy("function", "go_id", "bonus").agg(F.array_sort(F.collect_list(words.token)).alias("shared"))
    # of those that share none, the category's best stands for all: no function meets every chain
    least = real.groupBy("chain_category").agg(F.min_by(F.struct("go_id", "bonus"), F.struct((-F.col("bonus")).alias("b"), "go_id")).alias("x"))
    none = f.join(least, F.col("category") == F.col("chain_category")).select("function", "x.go_id", F.lit(False).alias("generic"), "x.bonus", F.array().cast("array<string>").alias("shared"))
    both = met.select("function", "go_id", F.lit(False).alias("generic"), "bonus", "shared").unionByName(none).unionByName(generic)
    if weights is None:
        base = F.size("shared").cast("double")
    else:
        # a row for each shared token meets its weight by equality; summed in the tokens' order
        each = both.select("function", "go_id", "generic", "bonus", F.explode_outer("shared").alias("token")).distinct().join(weights.select("token", "idf"), "token", "left")
        idf = F.when(F.col("token").isNotNull(), F.coalesce("idf", F.lit(1.0)))
        both = each.groupBy("function", "go_id", "generic", "bonus").agg(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", idf.alias("idf"))))).alias("weighed"))
        base = F.aggregate("weighed", F.lit(0.0), lambda a, t: a + t["idf"])
    scored = both.withColumn("score", base + F.col("bonus"))
    return aggregates.best_of_each(scored, ["function", "generic"], [F.desc("score"), F.col("go_id")]).select("function", "go_id", "generic", "score")
