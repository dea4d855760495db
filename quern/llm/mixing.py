"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. *Targets.*  Sources by code point, null last, weigh 1, 2, 3 in turn and share the words
   of all documents; a target stops at ``max_epochs`` times its source's size, and the
   excess is shared again by weight until none is above.
2. *Blocks.*  A source's documents are dealt by a seeded hash to shards of about
   ``shard_words``.  Each shard's words, documents in seeded order, are cut into blocks of
   equal size (to a word); block sizes agree between shards and sources, about
   ``1 / blocks`` of the mean source and at most ``1 / shard_blocks`` of ``shard_words``, so
   that shards have many blocks at any size.
3. *Quotas.*  The blocks that the targets pay for are seats: they go to sources by the
   highest quotients target / (2 q + 1), then each source's seats to its shards by the
   highest quotients size / (2 q + 1), both below ``max_epochs`` for each block.
4. *Selection.*  A shard with n blocks and quota q takes each block q div n times, and q mod n
   blocks once more: those whose place in a seeded permutation is below q mod n.  A
   document's words are taken as often as the blocks that cover them.

Quotas are found without sorting all quotients: seats that any divisor a little too large
gives are given at once, and only the few next quotients of each source or shard, at most
two for each in the mean, are ranked, by range-partitioned sorts.  Nothing is gathered but
scalars; documents move as (id, source, size) only.

Defined cases: a null text has size 0 and takes nothing; a null source is a source; rows
that repeat are rows of their own; no documents, no sources: empty result.  Extra columns
of any name are ignored, or kept by ``mixed``.  A long text is counted, never held as words,
but where ``mixed`` takes a part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import columns_of, n_words_of, words_of
from quern.operators.null_safe import null_safe_join
from quern.operators.ranks import global_rank
from quern.scratch import Scratch

#: Strides of the seeded permutations; primes above any shard's number of blocks.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)


def _by_code_point(c: str = "source") -> list[Column]:
    return [F.col(c).isNull(), F.col(c)]


def targets(sources: DataFrame, scratch: Scratch, max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with weight and target."""
    ranked = global_rank(sources, _by_code_point(), "place", scratch)
    ranked = scratch.cut(ranked.select("source", "source_size", ((F.col("place") - 1) % 3 + 1).alias("weight")), "weights")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left, share, full = float(total or 0), float(weights or 1), F.lit(False)
    cap = F.col("source_size") * float(max_epochs)
    while True:  # every round fills a source at least; few rounds fill all that will be
        each = left / share if share else 0.0
        now_full = cap <= F.col("weight") * each
        n, filled, gone = ranked.agg(F.count_if(now_full), F.sum(F.when(now_full, cap)), F.sum(F.when(now_full, F.col("weight")))).first()
        left, share = float(total or 0) - float(filled or 0), float((weights or 1) - (gone or 0))
        if not n or share == 0 or left / share <= each * (1 + 1e-15):
            full = now_full
            break
    each = left / share if share else 0.0
    return ranked.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * each))


def _seated(parties: DataFrame, keys: list[str], claim: str, most: str, seats: str, totals: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """``parties`` with ``quota``; where some are full, seats may remain that others have room for."""
    if group:
        both = null_safe_join(parties, totals.select(*group, "parties", "claims", seats), group)
    else:
        row = totals.first()  # one row of scalars
        both = parties.withColumns({c: F.lit(row[c]) for c in ("parties", "claims", seats)})
    # with this divisor at most `seats` quotients are above 1/2, and at least seats - 2 * parties
    sure = F.floor(F.col(claim) * F.greatest(F.col(seats) - F.col("parties") / 2, F.lit(0)) / F.col("claims") + 0.5)
    both = both.withColumn("sure", F.when(F.col("claims") > 0, F.least(F.greatest(sure, F.lit(0)), F.col(most))).otherwise(0).cast("long"))
    both = scratch.cut(both, "claims")
    given = both.groupBy(*group).agg(F.sum("sure").alias("given")) if group else both.agg(F.sum("sure").alias("given"))
    more = F.ceil(F.col(claim) * (F.col("parties") * 2 + 2) / F.col("claims")).cast("long") + 2
    upto = F.least(F.col(most), F.col("sure") + more)
    open_ = both.where((F.col("claims") > 0) & (F.col(claim) > 0) & (upto > F.col("sure")))
    next_ = open_.select(*keys, claim, F.explode(F.sequence(F.col("sure"), upto - 1)).alias("q"))
    next_ = next_.select(*keys, (F.col(claim) / (2 * F.col("q") + 1)).alias("quotient"))
    order = [x for g in group for x in _by_code_point(g)] + [F.col("quotient").desc()] + [x for k in keys if k not in group for x in _by_code_point(k)]
    ranked = global_rank(next_, order, "place", scratch)
    ranked = scratch.cut(ranked, "quotients")
    if group:
        first = ranked.groupBy(*group).agg(F.min("place").alias("first"))
        lots = null_safe_join(totals.select(*group, seats), given, group).select(*group, (F.col(seats) - F.col("given")).alias("rest"))
        lots = null_safe_join(lots, first, group)
        won = null_safe_join(ranked, lots, group).where(F.col("place") - F.col("first") < F.col("rest")).select(*keys)
    else:
        rest = (row[seats] or 0) - (given.first()[0] or 0)
        won = ranked.where(F.col("place") <= rest).select(*keys)
    extra = won.groupBy(*keys).agg(F.count("*").alias("extra"))
    out = null_safe_join(both, extra, keys, "left")
    return out.select(*parties.columns, (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("quota"))


def apportion(parties: DataFrame, keys: list[str], claim: str, most: str, seats: str, totals: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """``parties`` with ``quota``: in each group, ``seats`` by the highest quotients of ``claim``, at most ``most`` each.

    ``totals`` holds for each group its number of parties, sum of claims and seats.  A party that is full stays so as
    more seats are dealt; so where seats remain, the full ones keep theirs and the rest is dealt anew among the others.
    """
    per = lambda df, *cols: df.groupBy(*group).agg(*cols) if group else df.agg(*cols)
    done = None
    while True:
        given = scratch.cut(_seated(parties, keys, claim, most, seats, totals, group, scratch), "given")
        able = F.col(claim) > 0
        sums = per(given, F.sum("quota").alias("got"), F.sum(F.when(able, F.col(most))).alias("room"), F.count_if(able & (F.col("quota") < F.col(most))).alias("open"), F.sum(F.when(F.col("quota") >= F.col(most), F.col("quota"))).alias("full"))
        lack = (F.col("got") < F.least(F.col(seats), F.col("room"))) & (F.col("open") > 0) & (F.col("full") > 0)
        left = null_safe_join(totals.select(*group, seats), sums, group) if group else sums.withColumn(seats, F.lit(totals.first()[seats]))
        short = scratch.cut(left.where(lack).select(*group, (F.col(seats) - F.col("full")).alias(seats), F.lit(True).alias("__short")), "short")
        if short.isEmpty():
            return given if done is None else done.unionByName(given)
        told = null_safe_join(given, short.select(*group, "__short"), group, "left") if group else given.withColumn("__short", F.lit(True))
        told = scratch.cut(told, "told")
        on = F.coalesce("__short", F.lit(False)) & able & (F.col("quota") < F.col(most))
        rest = told.where(~on).select(*given.columns)
        done = rest if done is None else done.unionByName(rest)
        parties = scratch.cut(told.where(on).select(*parties.columns), "open")
        sizes = per(parties, F.count(F.lit(1)).alias("parties"), F.sum(claim).alias("claims"))
        totals = null_safe_join(sizes, short.select(*group, seats), group) if group else sizes.withColumn(seats, F.lit(short.first()[seats]))


def plan(docs: DataFrame, scratch: Scratch, seed: int = 17, max_epochs: int = 3, blocks: int = 2000, shard_words: int = 200_000, shard_blocks: int = 50) -> tuple[DataFrame, DataFrame]:
    """Rows and shards.

    Rows: one for each row of ``docs``: row (its number), doc_id, source, size, shard, begin (its first word's
    place in the shard).  Shards: source, shard, words, n (blocks), quota, stride, offset; source_size, target.
    """
    # rows without id are told apart by their texts, or all of one size would share a shard
    other = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    sized = docs.select("row", "doc_id", "source", n_words_of(F.col("text")).alias("size"), other.alias("other"))
    sized = scratch.cut(sized, "sizes")
    sources = scratch.cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aimed = scratch.cut(targets(sources, scratch, max_epochs), "targets")
    total, n_sources, wanted = aimed.agg(F.sum("source_size"), F.count("*"), F.sum("target")).first()
    block = max(1.0, min((total or 0) / (blocks * max(1, n_sources)), shard_words / shard_blocks))
    with_source = null_safe_join(sized, aimed.select("source", "source_size", "target"), ["source"])
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    spot = F.xxhash64(F.lit(seed), "doc_id", "size", "other")  # a null adds nothing to the hash
    dealt = with_source.withColumn("shard", F.pmod(spot, shards).cast("long"))
    in_shard = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size", "other", "row")
    placed = dealt.withColumn("begin", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = scratch.cut(placed, "placed")
    sharded = placed.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("words"))
    n = F.when(F.col("words") > 0, F.greatest(F.least(F.round(F.col("words") / block), F.col("words")), F.lit(1))).otherwise(0).cast("long")
    sharded = scratch.cut(sharded.withColumn("n", n), "shards")
    by_source = scratch.cut(sharded.groupBy("source", "target", "source_size").agg(
        F.sum("n").alias("n"), F.count("*").alias("parties"), F.sum("words").alias("claims")).withColumn("most", F.col("n") * max_epochs), "blocks")
    # a seat is worth the mean block, so that quotas in seats meet targets in words
    of_all = by_source.agg(F.count("*").alias("parties"), F.sum("target").alias("claims"), F.round(F.sum("target") / F.lit(block)).cast("long").alias("seats"))
    quotas = apportion(by_source.select("source", "target", "most"), ["source"], "target", "most", "seats", of_all, [], scratch)
    # a source's own blocks may be a little larger or smaller than the mean block
    own = null_safe_join(by_source, quotas.select("source", "quota"), ["source"]).select(
        "source", "parties", "claims",
        F.when(F.col("target") >= F.col("source_size") * float(max_epochs), F.col("most"))
        .when(F.col("claims") > 0, F.least("most", F.round(F.col("quota") * F.lit(block) * F.col("n") / F.col("claims")))).otherwise(0).cast("long").alias("seats"))
    own = scratch.cut(own, "quotas")
    claims = sharded.withColumn("most", F.col("n") * max_epochs)
    dealt_out = apportion(claims, ["source", "shard"], "words", "most", "seats", own, ["source"], scratch)
    seeded = F.xxhash64(F.lit(seed), "source", "shard")
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (F.pmod(seeded, F.lit(len(STRIDES))) + 1).cast("int")) % F.greatest("n", F.lit(1))
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.greatest("n", F.lit(1)))
    return placed, scratch.cut(dealt_out.withColumn("stride", stride.cast("long")).withColumn("offset", offset), "plan")


def _edge(k: Column) -> Column:
    """The first word of block k of a shard."""
    return F.floor(k * F.col("words").cast("decimal(38,0)") / F.col("n")).cast("long")


def taken_blocks(placed: DataFrame, shards: DataFrame) -> DataFrame:
    """``placed`` with source_size, target and cover: (from, upto, times) in the document's words, for each block that it meets."""
    joined = null_safe_join(placed.select("row", "doc_id", "source", "size", "shard", "begin"), shards, ["source", "shard"])
    ints = lambda a, b: F.floor(a.cast("decimal(38,0)") / b).cast("long")
    first = ints(F.col("begin") * F.col("n"), F.col("words"))
    final = ints((F.col("begin") + F.col("size") - 1) * F.col("n"), F.col("words"))
    # a word w is in block floor(w n / words) or, where edges are rounded down, the next
    span = F.when((F.col("size") > 0) & (F.col("n") > 0), F.sequence(F.greatest(first - 1, F.lit(0)), F.least(final + 1, F.col("n") - 1)))

    def block(k: Column) -> Column:
        times = ints(F.col("quota"), F.col("n")) + ((k * F.col("stride") + F.col("offset")) % F.col("n") < F.col("quota") % F.col("n")).cast("long")
        a = F.greatest(_edge(k) - F.col("begin"), F.lit(0))
        b = F.least(_edge(k + 1) - F.col("begin"), F.col("size"))
        return F.struct(a.alias("from"), b.alias("upto"), times.alias("times"))

    cover = F.filter(F.transform(span, block), lambda x: x["upto"] > x["from"])
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", cover.alias("cover"))


def _taken() -> Column:
    return F.coalesce(F.aggregate("cover", F.lit(0).cast("long"), lambda a, x: a + (x["upto"] - x["from"]) * x["times"]), F.lit(0))


def sizes_taken(docs: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, a row for each row of ``docs``."""
    docs = columns_of(docs, "doc_id", "text", "source").withColumn("row", F.lit(0).cast("long"))
    placed, shards = plan(docs, scratch, **settings)
    return taken_blocks(placed, shards).select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def mixed(docs: DataFrame, scratch: Scratch, max_epochs: int = 3, **settings) -> DataFrame:
    """The rows of ``docs`` as the mix takes them.

    A row comes out once for each epoch that takes words of it.  Where an epoch takes all its
    words, the text is unchanged; where it takes some, the text is those, joined by spaces.
    ``n_chars`` follows the text.
    """
    names = docs.columns
    numbered = scratch.cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("of")), "numbered")
    with Scratch(docs.sparkSession) as inner:
        placed, shards = plan(numbered.select("row", "of.doc_id", "of.text", "of.source"), inner, max_epochs=max_epochs, **settings)
        cover = scratch.cut(taken_blocks(placed, shards).where(_taken() > 0).select("row", "size", "cover"), "cover")
    epochs = F.explode(F.sequence(F.lit(1), F.array_max(F.transform("cover", lambda x: x["times"])).cast("int")))
    parts = cover.select("row", "size", "cover", epochs.alias("epoch")).select("row", "size", F.filter("cover", lambda x: x["times"] >= F.col("epoch")).alias("part"))
    whole = F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x["upto"] - x["from"]) == F.col("size")
    parts = parts.select("row", F.when(~whole, F.col("part")).alias("part"))
    joined = numbered.join(parts, "row").select("of", "part", F.when(F.col("part").isNotNull(), words_of(F.col("of.text"))).alias("w"))
    some = F.array_join(F.flatten(F.transform("part", lambda x: F.slice("w", (x["from"] + 1).cast("int"), (x["upto"] - x["from"]).cast("int")))), " ")
    text = F.when(F.size("w") > 0, some).otherwise(F.col("of.text"))
    out = joined.select("of", text.alias("mixed"))
    replaced = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*[replaced[c].alias(c) if c in replaced else F.col(f"of.`{c}`").alias(c) for c in names])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    out = sizes_taken(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return out.select("doc_id", "size", "source_size", "target", "taken")
