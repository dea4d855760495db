"""Prefix, substring and multi-strategy joins against dimension tables.

A substring has no equality to join by, but its grams of three characters have: a pattern meets the texts that hold
its rarest gram, and only those are looked into.  So no plan loops over patterns, however many there are; up to ``FEW``
of them, which a table of rules is, are an expression that texts evaluate where they lie.

Defined cases: a null text, path or key matches nothing; repeated rows each match; of ties the
smallest rank, then pattern, holds; empty tables give empty results (or, for what must not match,
all rows).  Columns that begin with two underscores are the module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import Scratch

#: Pattern tables beyond this many rows are not broadcast.
MAX_PATTERNS = 10_000


def bounded(patterns: DataFrame, limit: int = MAX_PATTERNS) -> DataFrame:
    """``patterns`` hinted for broadcasting if they are few (checked); more of them Spark joins in pieces."""
    return patterns if patterns.limit(limit + 1).count() > limit else F.broadcast(patterns)


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str, separator: str = "/") -> DataFrame:
    """Each row with the longest prefix that equals ``path`` or is followed by ``separator`` there; rows without one drop.

    A path has as many candidate prefixes as segments, so they are generated for each distinct
    path and joined by equality, whatever the number of prefixes: no nested loop and nothing to
    broadcast.  Rows that repeat come out as often; of prefixes that repeat, the largest other
    columns count.
    """
    parts = F.split(F.col("__path"), F.lit(rf"\Q{separator}\E"))
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    paths = rows.select(F.col(path).alias("__path")).where(F.col(path).isNotNull()).distinct()
    long_ = paths.select("__path", F.explode(heads).alias(prefix))
    extra = [c for c in prefixes.columns if c != prefix]
    best = long_.join(prefixes, prefix).groupBy("__path").agg(F.max(F.struct(F.length(prefix).alias("n"), prefix, *extra)).alias("__b"))
    met = rows.join(best, F.col(path) == F.col("__path"))
    return met.select(*rows.columns, f"__b.{prefix}", *[f"__b.{c}" for c in extra])


#: Characters in a gram; patterns that are looked through without a join.
GRAM, FEW = 3, 500


def _grams(c: str, n: int) -> Column:
    """The distinct runs of n characters; found by one pass, as a place in a string costs its length to find."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """__text, __pattern: each distinct text with each distinct pattern that it contains.  The empty pattern is a part of all."""
    t = texts.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    p = patterns.select(F.col(pattern).alias("__pattern")).where("__pattern is not null").distinct()
    few = [r[0] for r in p.limit(FEW + 1).collect()]
    if 0 < len(few) <= FEW:  # each text looks through them
        return t.select("__text", F.explode(F.filter(F.array(*map(F.lit, few)), lambda x: F.contains("__text", x))).alias("__pattern"))
    sizes = sorted(r[0] for r in p.select(F.least(F.length("__pattern"), F.lit(GRAM))).distinct().collect())  # at most GRAM + 1 numbers
    out = t.select("__text", F.lit("").alias("__pattern")) if 0 in sizes else t.select("__text", F.lit("").alias("__pattern")).where("false")
    for n in [n for n in sizes if n]:
        mine = p.where(F.length("__pattern") == n) if n < GRAM else p.where(F.length("__pattern") >= n)
        of_pattern = mine.select("__pattern", F.explode(_grams("__pattern", n)).alias("__gram"))
        of_text = t.select("__text", F.explode(_grams("__text", n)).alias("__gram")).join(of_pattern.select("__gram").distinct(), "__gram", "left_semi")
        rarest = of_pattern.join(of_text.groupBy("__gram").count(), "__gram").groupBy("__pattern").agg(F.min(F.struct("count", "__gram"))["__gram"].alias("__gram"))
        out = out.unionByName(of_text.join(rarest, "__gram").where(F.contains("__text", F.col("__pattern"))).select("__text", "__pattern"))
    return out


def first_pattern(rows: DataFrame, patterns: DataFrame, key: list[str], text: str, pattern: str = "pattern", kind: str = "kind", rank: str = "rank", gate: Column | None = None) -> DataFrame:
    """For each row, the pattern of least ``rank`` that its text contains (and whose gate holds); rows without one drop.

    Rows look through up to ``FEW`` patterns (a table of rules) where they are; more of them meet the texts by grams.
    """
    few = patterns.limit(FEW + 1).collect()
    if 0 < len(few) <= FEW:
        kinds = dict(patterns.dtypes)
        listed = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(f"__{c}") for c in patterns.columns]) for r in few])
        met = rows.withColumn("__h", F.explode(F.filter(listed, lambda p: F.contains(F.col(text), p[f"__{pattern}"])))).select(*rows.columns, "__h.*")
    else:
        known = patterns.select(*[F.col(c).alias(f"__{c}") for c in patterns.columns])
        pairs = contained(rows, text, patterns, pattern).withColumnRenamed("__pattern", "__p")
        met = rows.join(pairs, F.col(text) == F.col("__text")).join(known, F.col("__p") == F.col(f"__{pattern}"))
    met = met if gate is None else met.where(gate)
    return met.groupBy(*key).agg(F.min(F.struct(F.col(f"__{rank}").alias("r"), F.col(f"__{pattern}").alias("p"), F.col(f"__{kind}").alias("k"))).alias("m")).select(*key, F.col("m.p").alias(pattern), F.col("m.k").alias(kind))


def gated(rows: DataFrame, imports: DataFrame, group: str, gate: str, package: str = "package") -> DataFrame:
    """Rows whose gate is null, or is an import of their group or a path prefix of one."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(package, "/"))), lambda n: F.array_join(F.slice(F.split(package, "/"), F.lit(1), n), "/"))
    open_ = imports.select(F.col(group), F.explode(prefixes).alias(gate)).distinct()
    return rows.where(F.col(gate).isNull()).unionByName(rows.where(F.col(gate).isNotNull()).join(open_, [group, gate], "left_semi"))


def related(texts: DataFrame, text: str, others: DataFrame, other: str) -> DataFrame:
    """__text: the distinct texts that contain some other, or are a part of one."""
    inside = contained(texts, text, others, other).select("__text")
    around = contained(others, other, texts, text).select(F.col("__pattern").alias("__text"))
    return inside.unionByName(around).distinct()


def matching_calls(calls: DataFrame, names: DataFrame, key: list[str], call: str, name: str) -> DataFrame:
    """``key`` and matching (long): how many of each key's calls contain, or are contained in, some name."""
    hit = calls.join(related(calls, call, names, name), F.col(call) == F.col("__text"), "left_semi")
    return hit.groupBy(*key).agg(F.count("*").alias("matching"))


def best_tier(rows: DataFrame, key: list[str], tiers: list[tuple[int, DataFrame]], keep: list[str]) -> DataFrame:
    """Candidates of the best tier of each key: ``tiers`` are (number, candidates with ``key`` and ``keep``)."""
    tagged = None
    for number, found in tiers:
        t = found.select(*key, *keep, F.lit(number).alias("tier"))
        tagged = t if tagged is None else tagged.unionByName(t)
    least = Window.partitionBy(*key)
    return rows.select(*key).distinct().join(tagged, key).withColumn("__m", F.min("tier").over(least)).where("tier = __m").drop("__m").distinct()


def met_once(rows: DataFrame, key: list[str], candidates: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """``key`` and ``keep``, each pair once: ``rows`` (distinct ``key`` and ``on``) meet ``candidates`` (distinct ``on`` and ``keep``).

    Pairs may be many times the rows, so they come out of their join as they are: only those of keys with several
    rows can repeat, and those alone are shuffled.
    """
    counted = rows.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    met = lambda some: some.join(candidates, on).select(*key, *keep)
    return met(counted.where("__k = 1")).unionByName(met(counted.where("__k > 1")).distinct())


#: Candidates in an array, pairs in a block, and pairs that a task makes, about.
ARRAY, BLOCK, TASK = 1 << 12, 1 << 20, 1 << 22


def met_in_blocks(rows: DataFrame, key: list[str], candidates: DataFrame, on: list[str], keep: list[str], tasks: int) -> DataFrame:
    """``key`` and ``keep`` of each of ``rows`` with each of ``candidates`` (distinct ``on`` and ``keep``) of the same ``on``.

    Rows and candidates of a value are dealt into parts, and a task gets some blocks of a part of each: a value with most of
    the pairs is the work of many tasks, none of which holds more than an array of candidates.  What is shuffled is a
    row for each array, and an array for each block.
    """
    of_value = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__r")).join(candidates.groupBy(*on).agg(F.count(F.lit(1)).alias("__c")), on)
    parts = F.ceil(F.col("__r") * F.least("__c", F.lit(ARRAY)) / BLOCK)
    dealt = of_value.select(*on, F.ceil(F.col("__c") / ARRAY).alias("__arrays"), parts.alias("__parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    by = [*on, "__array", "__part"]
    listed = candidates.join(dealt, on).withColumn("__array", F.pmod(F.xxhash64(*keep), "__arrays")).groupBy(*on, "__array", "__parts").agg(F.collect_list(F.struct(*keep)).alias("__l"))
    held = F.col(f"__l.{keep[0]}") if len(keep) == 1 else F.col("__l")
    arrays = listed.select(*on, "__array", held.alias("__l"), each("__parts").alias("__part")).repartition(tasks, *by)
    asking = rows.join(dealt, on).select(*key, *on, F.pmod(F.xxhash64(*key), "__parts").alias("__part"), each("__arrays").alias("__array")).repartition(tasks, *by)
    met = asking.join(arrays.hint("merge"), by)
    return met.select(*key, F.explode("__l").alias(keep[0]) if len(keep) == 1 else F.inline("__l"))


def first_tier(rows: DataFrame, key: list[str], tiers: list[tuple[int, list[str], DataFrame]], keep: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Candidates of the best tier of each key, as ``best_tier``, where a tier is a look-up: number, columns to look up by, and a table of these and ``keep``.

    How many candidates the values of a tier lead to is known before any pair is made, so each key's tier is settled once, and
    pairs are counted: they are dealt to as many tasks as they need, whatever the size of the rows.  Only pairs of keys
    with several rows can repeat, and those alone are shuffled.
    """
    tiers = [(number, on, table.select(*on, *keep).distinct()) for number, on, table in sorted(tiers, key=lambda t: t[0])]
    asked = rows.dropna(subset=key).select(*dict.fromkeys([*key, *[c for _, on, _ in tiers for c in on]]))
    for number, on, known in tiers:
        asked = asked.join(known.groupBy(*on).agg(F.struct(F.lit(number).alias("tier"), F.count(F.lit(1)).alias("n")).alias(f"__t{number}")), on, "left")
    first = F.coalesce(*[f"__t{number}" for number, _, _ in tiers])
    asked = asked.select(*[c for c in asked.columns if not c.startswith("__t")], first.alias("__t")).where("__t is not null").repartition(*key).distinct()
    of_key = Window.partitionBy(*key)
    settled = asked.select("*", F.min("__t.tier").over(of_key).alias("__m"), (F.count(F.lit(1)).over(of_key) > 1).alias("__several")).where("__t.tier = __m")
    settled = (scratch or Scratch(rows.sparkSession)).cut(settled, "settled")
    pairs = {(r[0], r[1]): r[2] for r in settled.groupBy("__m", "__several").agg(F.sum("__t.n")).collect()}  # two numbers a tier
    of_number, out = {number: (on, known) for number, on, known in tiers}, None
    for (number, several), n in sorted(pairs.items()) or [((tiers[0][0], False), 1)]:
        on, known = of_number[number]
        here = settled.where((F.col("__m") == number) & (F.col("__several") == several)).select(*key, *on)
        met = met_in_blocks(here, key, known, on, keep, -(-n // TASK))
        met = (met.distinct() if several else met).withColumn("tier", F.lit(number))
        out = met if out is None else out.unionByName(met)
    return out


def arity_fits(nargs: Column, n_params: Column, variadic: Column) -> Column:
    return F.when(variadic, nargs >= n_params - 1).otherwise(nargs == n_params)


def resolve_callees(sites: DataFrame, functions: DataFrame, max_candidates: int = 5, scope: list[str] | None = None) -> DataFrame:
    """Candidate callees of each call site, by the first strategy that finds one.

    ``sites``: site, dir, recv_type, pkg_dir, name, nargs, dynamic.  ``functions``: fid, dir,
    recv_type, name, n_params, variadic, signature.  Both have the ``scope`` columns, inside which names are
    looked up.  Strategies: 0 the package that the call names; 1 a method of the receiver's own type in the
    package; 2 a function of the same package; 3 dispatch by name among methods, if at most ``max_candidates``
    fit, or all that fit share one signature.  Null ``nargs`` fit any function.  Returns scope, site, fid,
    resolution (exact or dispatch).

    The first three are one look-up by place and name.  Functions are listed once for each number of arguments that is asked
    for at their place, so which strategies find one is known before any site meets them; what dispatch allows is
    counted likewise, once for each (name, nargs).  A name of many methods that doesn't pass costs no more than its count.
    """
    scope = scope or []
    none = F.lit("\x00")  # no receiver
    f = functions.select(*scope, "fid", F.col("dir").alias("at"), F.coalesce("recv_type", none).alias("recv"), "name", "n_params", "variadic", "signature")
    fits = F.col("nargs").isNull() | arity_fits(F.col("nargs"), F.col("n_params"), F.col("variadic"))
    way = lambda held, tier, at, recv: F.when(held, F.struct(F.lit(tier).alias("tier"), at.alias("at"), recv.alias("recv")))
    local = F.col("pkg_dir").isNull() & F.col("recv_type").isNull()
    ways = F.array(way(F.col("pkg_dir").isNotNull(), 0, F.col("pkg_dir"), none), way(F.col("recv_type").isNotNull(), 1, F.col("dir"), F.col("recv_type")), way(local, 2, F.col("dir"), none))
    numbered = sites.withColumn("__n", F.coalesce("nargs", F.lit(-1)))
    asked = numbered.select(*scope, "site", "name", "nargs", "__n", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select(*scope, "site", "name", "nargs", "__n", "w.*").distinct()
    place, site = [*scope, "at", "recv", "name"], [*scope, "site"]
    by = [*place, "__n"]
    fitting = asked.select(*by, "nargs").distinct().join(f, place).where(fits).select(*by, "fid").distinct()
    open_ = asked.where("site is not null").join(fitting.select(*by).distinct(), by, "left_semi")
    chosen = open_.withColumn("__least", F.min("tier").over(Window.partitionBy(*site))).where("tier = __least").select(*site, *[c for c in by if c not in site]).distinct()
    exact = met_once(chosen, site, fitting, by, ["fid"]).withColumn("resolution", F.lit("exact"))

    rest = numbered.where("dynamic and name is not null").join(open_.select(*site).distinct(), site, "left_anti").select(*site, "name", "nargs", "__n").distinct()
    by = [*scope, "name", "__n"]
    named = rest.select(*by, "nargs").distinct().join(f.where(F.col("recv") != none), [*scope, "name"]).where(fits)
    passing = named.groupBy(*by).agg(F.count_distinct("fid").alias("n"), F.count_distinct("signature").alias("k")).where((F.col("n") <= max_candidates) | (F.col("k") == 1)).select(*by)
    allowed = named.join(passing, by, "left_semi").select(*by, "fid").distinct()
    dispatch = met_once(rest.select(*site, "name", "__n").distinct(), site, allowed, by, ["fid"]).withColumn("resolution", F.lit("dispatch"))
    return exact.unionByName(dispatch)


def not_covered(candidates: DataFrame, covered: DataFrame, name: str, pattern: str) -> DataFrame:
    """Candidates that contain, and are contained in, no covered pattern."""
    return candidates.join(related(candidates, name, covered, pattern), F.col(name) == F.col("__text"), "left_anti")
