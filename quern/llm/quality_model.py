"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

*Model.*  Character n-grams of orders 1 to ``order`` of trusted text, that is, of whole
documents labelled good.  Training takes the share ``train_share`` of them, all their characters, by the
smallest seeded hash of doc_id, one text an id; the others are held out, so
that thresholds rest on texts the model hasn't seen.  ``max_train_docs`` and ``max_train_chars`` bound it further only
where a caller gives them (then no text above a quarter of those characters is taken).  Counts are aggregated
in Spark, partitioned by n-gram: raw counts at the highest order, continuation counts (by
how many characters an n-gram is preceded) below.  The three discounts of an order come
from its counts of counts; an n-gram's interpolated probability joins its discounted count
with its context's left-over weight and its suffix's probability, again by joins on the
n-gram.  Characters of text never seen share one unknown symbol.

*Shards.*  The resulting table, which grows with the distinct n-grams of the training texts and not with their length, is cut by n-gram hash into
direct-address shards that every executor holds; scoring joins each position of each text
to its longest n-gram there.  (Joining exploded positions over a shuffle would move some
20 bytes a character; the README has the figures.)

*Perplexity* of a document is exp of its mean surprise, where ``prior`` characters of the
language's median count in, so that a text of a few words isn't judged by noise.

*Thresholds* are language-specific quantiles of the perplexity of all held-out trusted
documents, copies of training texts left out: median + margin * (0.99 quantile - median).
They come from logarithmic histograms with bins of half a percent, which merge exactly.  A
language with fewer than ``min_trusted`` held-out documents takes the thresholds of all.

Defined cases: a null or empty text has no characters, its language's median perplexity and
is kept only if ``keep_empty``; a null language is a language; without trusted documents
both to train on and to hold out nothing can be judged and all is kept; repeated rows come
out as often; no documents give no rows; other columns, of any name, are ignored or pass through.
A text is scored whole, at some 150 bytes for each character.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import workers
from quern.llm.hashing import mix
from quern.llm.text import columns_of
from quern.operators import ranks
from quern.operators.null_safe import null_safe_join
from quern.scratch import Scratch

_BASE = np.uint64(0x9DDFEA08EB382D69)
_SMALLEST_BIN = 1.0
_GAMMA = 1.005
_START = "\x02"
_UNKNOWN = "\x03"


# -- counting and smoothing, in Spark ------------------------------------------------------------


def split(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_train_docs: int | None = None, train_share: float = 0.5, max_train_chars: int | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """doc_id and text to train on, and doc_id of the good documents held out.

    ``docs``: doc_id, text.  The first holds the share of good documents, or where they are given, at most ``max_train_docs``
    rows and ``max_train_chars`` characters of it.
    """
    good = scratch.cut(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "good")
    n = int(good.count() * train_share)
    n = n if max_train_docs is None else min(max_train_docs, n)
    rank = F.xxhash64(F.lit(seed), "doc_id")
    last = ranks.global_rank(good.withColumn("__rank", rank), [F.col("__rank"), F.col("doc_id")], "__n", scratch).where(F.col("__n") == n).first() if n else None
    # who is chosen is told by the hash alone, so texts of no chosen document are moved by the join only if they aren't good
    chosen = F.lit(False) if last is None else (rank < last["__rank"]) | ((rank == last["__rank"]) & (F.col("doc_id") <= last["doc_id"]))
    texts = docs.where(chosen & (F.length("text") > 0)).join(good.hint("merge"), "doc_id", "left_semi")
    if max_train_chars is not None:
        texts = texts.where(F.length("text") <= max_train_chars // 4)
    taken = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    if max_train_chars is not None:
        running = F.sum(F.length("text")).over(Window.orderBy(rank, "doc_id"))
        taken = taken.withColumn("upto", running).where(F.col("upto") <= max_train_chars).select("doc_id", "text")
    taken = scratch.cut(taken, "training")
    return taken, good.join(taken.select("doc_id").hint("merge"), "doc_id", "left_anti")


def counts(texts: DataFrame, order: int) -> DataFrame:
    """gram, n: how often each n-gram of ``order`` characters occurs; texts begin with order - 1 start symbols."""

    def of_batches(batches):
        for batch in batches:
            found: Counter = Counter()
            for text in batch["text"]:
                text = text.as_py()
                padded = _START * (order - 1) + text
                for at in range(0, len(text), 1 << 16):
                    found.update([padded[i : i + order] for i in range(at, min(at + (1 << 16), len(text)))])
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "n"])

    return texts.mapInArrow(of_batches, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def smoothed(top: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """gram, p: the interpolated probability of each n-gram's last character; gram, w: the weight that each context leaves.

    One table: gram, p, w (null where the gram is no context or has no probability of its own).
    """
    tables, raw = {order: top}, top
    for k in range(order - 1, 0, -1):
        raw = raw.select(F.substring("gram", 2, k).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        raw = tables[k] = scratch.cut(raw, f"order{k}")
    below, contexts = None, None
    out = []
    for k in range(1, order + 1):
        table = tables[k]
        n1, n2, n3, n4, vocabulary = table.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)], F.count("*")).first()
        d = _discounts(n1, n2, n3, n4)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = table.select(context, "n", cut.alias("cut")).groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        weight = sums.select("context", "total", (F.col("left") / F.col("total")).alias("w"))
        own = table.select("gram", "n", cut.alias("cut"), context, F.substring("gram", 2, k - 1).alias("suffix")).join(weight, "context")
        if below is None:  # characters: the rest is shared by all known ones and the unknown symbol
            own = own.withColumn("low", F.lit(1.0 / (vocabulary + 1)))
        else:
            own = own.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
        below = scratch.cut(own.select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("w") * F.col("low")).alias("p")), f"p{k}")
        out.append((below, weight.select(F.col("context").alias("gram"), "w"), vocabulary))
    grams = out[0][0]
    for p, _, _ in out[1:]:
        grams = grams.unionByName(p)
    contexts = out[0][1]
    for _, w, _ in out[1:]:
        contexts = contexts.unionByName(w)
    unknown = 1.0 / (out[0][2] + 1)
    return grams.join(contexts, "gram", "full").select("gram", "p", F.when(F.length("gram") == 0, F.col("w") * unknown).otherwise(F.col("w")).alias("w"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, kept inside (0, count)."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    clip = lambda d, top: min(max(d, 0.05), top)
    return clip(d1, 0.95), clip(d2, 1.9), clip(d3, 2.9)


# -- the table that executors hold -----------------------------------------------------------------


class Model:
    """Direct-address shards: by hash of the n-gram, its log probability and the log weight it leaves as a context."""

    def __init__(self, grams: list[str], p: np.ndarray, w: np.ndarray, order: int, shards: int = 16):
        self.order = order
        p, w = np.asarray(p, float), np.asarray(w, float)
        self.floor = float(np.log(w[grams.index("")]))
        self.alphabet = np.array(sorted({ord(g) for g in grams if len(g) == 1}), np.uint32)
        points = ["".join(g for g in grams if len(g) == k).encode("utf-32-le", "surrogatepass") for k in range(order + 1)]
        hashes = np.concatenate([self._hashes(np.frombuffer(g, np.uint32).reshape(-1, max(k, 1)).astype(np.uint64), k) for k, g in enumerate(points)])
        by_length = np.argsort([len(g) for g in grams], kind="stable")
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.stack([np.log(p), np.log(w)], 1).astype(np.float32)[by_length]
        which = (hashes >> np.uint64(60)).astype(np.int64) % shards
        sizes = [1 << max(4, math.ceil(math.log2(4 * max(1, int((which == s).sum()))))) for s in range(shards)]
        self.masks = np.array([n - 1 for n in sizes], np.uint64)
        self.bases = np.cumsum([0, *sizes[:-1]]).astype(np.uint64)
        self.keys, self.values = np.zeros(sum(sizes), np.uint64), np.full((sum(sizes), 2), np.nan, np.float32)
        todo = np.arange(len(hashes))
        place = self._place(hashes)
        while len(todo):  # open addressing, all that still seek a slot at once
            at = place[0][todo] + place[1][todo]
            _, first = np.unique(at, return_index=True)
            free = first[self.keys[at[first]] == 0]
            self.keys[at[free]], self.values[at[free]] = hashes[todo[free]], logs[todo[free]]
            todo = np.delete(todo, free)
            place[1][todo] = (place[1][todo] + np.uint64(1)) & place[2][todo]

    @staticmethod
    def _final(hashes: np.ndarray, k: int) -> np.ndarray:
        return mix(hashes + np.uint64(k)) | np.uint64(1)

    @classmethod
    def _hashes(cls, characters: np.ndarray, k: int) -> np.ndarray:
        """Hashes of n-grams of k characters, one for each row; of the empty one, a single hash."""
        h = np.zeros(len(characters) if k else 1, np.uint64)
        for j in range(k):
            h = h * _BASE + (characters[:, j] + np.uint64(1))
        return cls._final(h, k)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The beginning of each hash's shard, its slot there, and the shard's mask."""
        which = (hashes >> np.uint64(60)).astype(np.int64) % len(self.masks)
        masks = self.masks[which]
        return self.bases[which], hashes & masks, masks

    def _find(self, hashes: np.ndarray, column: int) -> np.ndarray:
        """Log probability (0) or weight (1) of each hash; nan where there is none."""
        out = np.full(len(hashes), np.nan, np.float32)
        base, slot, mask = self._place(hashes)
        todo = np.arange(len(hashes))
        while len(todo):
            at = base + slot
            found = self.keys[at]
            hit = found == hashes
            out[todo[hit]] = self.values[at[hit], column]
            go = ~hit & (found != 0)
            todo, hashes, base, mask = todo[go], hashes[go], base[go], mask[go]
            slot = (slot[go] + np.uint64(1)) & mask
        return out

    def surprise(self, texts: list[str]) -> np.ndarray:
        """Sum of -ln p over the characters of each text."""
        start = _START * (self.order - 1)
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer((start + start.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        known = (self.alphabet[place] == points) | (points == ord(_START))
        points = np.where(known, points, ord(_UNKNOWN)).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(lengths + self.order - 1)
        begins = ends - lengths
        at = np.arange(lengths.sum()) + np.repeat(begins - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        rolling = [np.zeros(len(points), np.uint64), points]  # of each length: the n-gram that ends at each place
        for _ in range(2, self.order + 1):
            rolling.append(np.concatenate((points[:1], rolling[-1][:-1] * _BASE + points[1:])))
        total, left, weight = np.zeros(len(at)), np.arange(len(at)), np.zeros(len(at))
        for k in range(self.order, 0, -1):  # the longest n-gram with a probability, less the weights of the contexts above it
            found = self._find(self._final(rolling[k][at[left]], k), 0)
            hit = ~np.isnan(found)
            total[left[hit]] = found[hit] + weight[left[hit]]
            left = left[~hit]
            if not len(left):
                break
            if k > 1:
                rest = self._find(self._final(rolling[k - 1][at[left] - 1], k - 1), 1)
                weight[left] += np.where(np.isnan(rest), 0, rest)
        total[left] = self.floor + weight[left]  # the unknown symbol
        sums = np.concatenate(([0.0], np.cumsum(total)))
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        return sums[cuts[:-1]] - sums[cuts[1:]]


def train(texts: DataFrame, scratch: Scratch, order: int = 5) -> Model | None:
    """The model of the texts; None without any.  Driver and executors hold its table, a row for each distinct n-gram."""
    top = scratch.cut(counts(texts, order), "counts")
    if top.isEmpty():
        return None
    table = smoothed(top, order, scratch).toArrow()  # distinct n-grams alone
    return Model(table["gram"].to_pylist(), table["p"].to_numpy(), table["w"].to_numpy(), order)


# -- perplexity, thresholds, verdicts ----------------------------------------------------------------


def surprises(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th, lang, chars, nats: the sum of surprises of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches):
        workers.enter("quality")
        held = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [t or "" for t in rows["text"].to_pylist()]
                nats, first, size = [], 0, 0
                for i, t in enumerate(texts, 1):
                    size += len(t)
                    if size > 1 << 17 or i == len(texts):
                        nats.append(held.surprise(texts[first:i]))
                        first, size = i, 0
                columns = [rows["doc_id"], rows["th"], rows["lang"], pa.array([len(t) for t in texts], pa.int64()), pa.array(np.concatenate(nats))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "lang", "chars", "nats"])

    docs = columns_of(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("th")).mapInArrow(of_batches, "doc_id long, th long, lang string, chars long, nats double")


def _bin(value: Column) -> Column:
    return F.greatest(F.ceil(F.log(value / _SMALLEST_BIN) / math.log(_GAMMA)), F.lit(0)).cast("int")


def quantiles(values: DataFrame, qs: dict[str, float]) -> DataFrame:
    """lang, total and a column for each of ``qs``: quantiles of ``perplexity`` by language, and of all under the level 0."""
    bins = values.groupBy("lang", _bin(F.col("perplexity")).alias("bin")).agg(F.count("*").alias("n"))
    both = bins.select("bin", "n", F.explode(F.array(F.struct(F.lit(1).alias("level"), "lang"), F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang")))).alias("g"))
    grouped = both.groupBy("g.level", "g.lang", "bin").agg(F.sum("n").alias("n"))
    packed = grouped.groupBy("level", "lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def quantile(q: float) -> Column:
        found = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bin"].isNull() & ((a["seen"] + x["n"]) >= F.col("total") * q), x["bin"]).otherwise(a["bin"]).alias("bin")),
            lambda a: a["bin"])
        return F.pow(F.lit(_GAMMA), found) * _SMALLEST_BIN

    return packed.select("level", "lang", "total", *[quantile(q).alias(n) for n, q in qs.items()])


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, order: int = 5, max_train_docs: int | None = None, train_share: float = 0.5, max_train_chars: int | None = None, prior: float = 150.0, margin: float = 2.5, min_trusted: int = 30, keep_empty: bool = True) -> DataFrame:
    """doc_id, th (hash of the text), lang, chars, perplexity, threshold, kept: a row for each row of ``docs``."""
    labels = columns_of(labels, "doc_id", "quality")
    keyed = columns_of(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts, held_out = split(keyed.select("doc_id", "text"), labels, scratch, max_train_docs, train_share, max_train_chars)
    model = train(texts.select("text"), scratch, order)
    if model is None:
        none = F.lit(None).cast("double")
        return keyed.select("doc_id", F.xxhash64("text").alias("th"), "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    scored = scratch.cut(surprises(docs, model), "surprises")
    # a held-out document with the text of a training one isn't new to the model
    seen = texts.select(F.xxhash64("text").alias("th")).distinct().hint("merge")

    def unseen(of: DataFrame) -> DataFrame:
        return of.where("chars > 0").join(held_out, "doc_id", "left_semi").join(seen, "th", "left_anti")

    trusted = unseen(scored)
    raw = trusted.select("lang", F.exp(F.col("nats") / F.col("chars")).alias("perplexity"))
    middle = _with_all(scored.select("lang").distinct(), quantiles(raw, {"median": 0.5}), min_trusted, "median")
    scored = null_safe_join(scored, _small(scratch.cut(middle, "medians")), ["lang"], "left")
    perplexity = F.exp((F.col("nats") + prior * F.log("median")) / (F.col("chars") + prior))
    scored = scratch.cut(scored.select("doc_id", "th", "lang", "chars", perplexity.alias("perplexity")), "perplexities")
    trusted = unseen(scored).select("lang", "perplexity")
    limits = quantiles(trusted, {"mid": 0.5, "high": 0.99}).select("level", "lang", "total", (F.col("mid") + margin * (F.col("high") - F.col("mid"))).alias("threshold"))
    limits = _with_all(scored.select("lang").distinct(), limits, min_trusted, "threshold")
    out = null_safe_join(scored, _small(scratch.cut(limits, "limits")), ["lang"], "left")
    kept = F.when(F.col("chars") == 0, keep_empty).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select("doc_id", "th", "lang", "chars", "perplexity", "threshold", kept.alias("kept"))


def _small(table: DataFrame, limit: int = 10_000) -> DataFrame:
    """A table of languages, for broadcasting if it has few rows; else it joins by a shuffle."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def _with_all(langs: DataFrame, found: DataFrame, min_trusted: int, column: str) -> DataFrame:
    """``column`` for each language: its own where it has enough documents, else that of all."""
    overall = found.where("level = 0").first()  # one row
    own = found.where(f"level = 1 and total >= {min_trusted}").select("lang", column)
    return null_safe_join(langs, own, ["lang"], "left").select("lang", F.coalesce(column, F.lit(overall[column] if overall else None).cast("double")).alias(column))


def filtered(docs: DataFrame, labels: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    on = ["doc_id", "th", "lang"]
    with Scratch(docs.sparkSession) as inner:
        verdicts = judged(docs, labels, inner, **settings)
        gone = scratch.cut(verdicts.where(~F.col("kept")).select(*on).distinct(), "gone")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("th"), "row.lang")
    # what is rejected grows with the input: a join by shuffle at any size
    return null_safe_join(keyed, gone.hint("merge"), on, "left_anti").select("row.*")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels, Scratch(spark)).select("doc_id", "chars", "perplexity", "threshold", "kept")
