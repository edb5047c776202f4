"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions. Documents of a source are dealt to blocks by a
hash. A source's target says how many of its blocks, over up to two epochs, the
mix draws (its quota). The quotas of all sources are split down a binary tree:
at every node, sequential hypergeometric draws send part of each source's quota
left and the rest right, so each output shard gets an exact number of blocks of
random composition, without permuting all blocks together. Each shard then takes
its range of the source's permuted blocks, and rows are ordered by a hash inside
the shard. Where the next block of a source would pass its target, that block and a
few after it give single documents, so that the words taken come near the target.

Per-source rows, ranges of a source's blocks and one array of quotas for each tree
node are all that meets in one place; documents never shuffle for the decision
(only a broadcast or shuffled join on the block), and a hot source is many blocks.
Blocks grow with the corpus beyond some ``MOST_BLOCKS``, so the table of drawn blocks has
a bound; texts find their places in it where they lie and shuffle once, to their shards.

Nulls: a null source is a source of its own, a null text has size 0, a null id is
kept. Texts of size 0 are taken only with a whole block. A very long text makes its
block long; it is passed over where it does not fit, and others come instead.
Repeated rows count each, and each is drawn by itself. Sources of equal name are
one; ties in an order are broken by keys. An empty table gives no rows. Extra columns
stay as they are, whatever their names; helper columns begin with ``__pm_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import HIDE, cut, table

SEED = 20240229
#: Words that a block should hold, and the most documents.
BLOCK_WORDS, BLOCK_DOCS = 8192, 512
#: Blocks of this size that a corpus has (twice as many by words and documents together); with more, blocks are larger.
MOST_BLOCKS = 1 << 17
#: Blocks that one task orders, blocks after the last whole one that give single documents, and rounds over those.
RANGE_ROWS, SPARE, ROUNDS = 1 << 14, 8, 4
#: Equal rows that one task numbers.
CHUNK = 1 << 16
#: Rows of the table of sources up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 50_000
#: Rows up to which drawn blocks, single documents and repeated rows are broadcast; beyond, texts join by a shuffle.
PLACED_ROWS = 1 << 19
#: Shards at least, and blocks that a shard should hold.
SHARDS, SHARD_BLOCKS = 64, 4096
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight): ``share`` of all sizes by weight, none above ``most`` times its size.

    Resharing the excess by weight until nobody is above has a closed form: the
    sources that stop at their limit are the first ones by limit over weight.
    """
    limit = F.col("source_size") * F.lit(most)
    by = W.orderBy((limit / F.col("weight")).asc(), F.col("__pm_rank"))
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = sizes.withColumn("__pm_rank", F.monotonically_increasing_id()) if "__pm_rank" not in sizes.columns else sizes
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - (F.sum(limit).over(upto) - limit)) / F.sum("weight").over(after)
    ranked = ranked.withColumn("__pm_level", level)
    # the first source whose limit is not reached fixes the level of all that follow; later levels are lower
    fixed = F.max(F.when(F.col("__pm_level") * F.col("weight") < limit, F.col("__pm_level"))).over(everything)
    target = F.when(F.col("__pm_level") * F.col("weight") >= limit, limit).otherwise(fixed * F.col("weight"))
    return ranked.withColumn("target", target).drop("__pm_level")


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on ``key`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, wherever ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(n: Column) -> Column:
    """1.0 to n, or nothing if n is below 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda v: v.cast("double"))).otherwise(F.array().cast("array<double>"))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Inverse-CDF draw: how many of ``draws`` from ``total`` items are among the ``good`` ones.

    Probabilities are walked outwards from the mode by the ratio of neighbours, as
    multiples of the mode's, over all values whose share a double can represent.
    """

    def rise(v: Column, k: Column) -> Column:  # share of k over that of k - 1
        return (v["good"] - k + 1) * (v["draws"] - k + 1) / (k * (v["total"] - v["good"] - v["draws"] + k))

    def reach(v: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), v["draws"] + v["good"] - v["total"]), F.least(v["draws"], v["good"])
        mode = F.greatest(low, F.least(high, F.floor((v["draws"] + 1) * (v["good"] + 1) / (v["total"] + 2)).cast("double")))
        share = v["good"] / v["total"]
        sd = F.sqrt(F.greatest(F.lit(0.0), v["draws"] * share * (1 - share) * (v["total"] - v["draws"]) / F.greatest(F.lit(1.0), v["total"] - 1)))
        far = F.ceil(sd * 12 + 12).cast("double")
        return F.struct(v["good"].alias("good"), v["total"].alias("total"), v["draws"].alias("draws"), v["u"].alias("u"), mode.alias("mode"), F.greatest(low, mode - far).alias("first"), F.least(high, mode + far).alias("last"))

    def step(p: Column, acc: Column) -> Column:
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"))

    def tails(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        up = F.aggregate(_upto(v["last"] - v["mode"]), start, lambda a, j: step(a["p"] * rise(v, v["mode"] + j), a))
        down = F.aggregate(_upto(v["mode"] - v["first"]), start, lambda a, j: step(a["p"] / rise(v, v["mode"] - j + 1), a))
        return F.struct(v.alias("v"), down["p"].alias("p"), (v["u"] * (1 + up["sum"] + down["sum"])).alias("goal"))

    def find(t: Column) -> Column:  # the first value at which the running sum passes the goal
        start = F.struct(t["p"].alias("p"), t["p"].alias("sum"), t["v"]["first"].alias("k"))

        def go(a: Column, j: Column) -> Column:
            p = a["p"] * rise(t["v"], t["v"]["first"] + j)
            on = a["sum"] <= t["goal"]
            return F.struct(p.alias("p"), F.when(on, a["sum"] + p).otherwise(a["sum"]).alias("sum"), F.when(on, t["v"]["first"] + j).otherwise(a["k"]).alias("k"))

        return F.aggregate(_upto(t["v"]["last"] - t["v"]["first"]), start, go)["k"]

    given = F.struct(good.cast("double").alias("good"), total.cast("double").alias("total"), draws.cast("double").alias("draws"), u.alias("u"))
    drawn = let(let(let(given, reach), tails), find)
    return F.when((good <= 0) | (draws <= 0), F.lit(0.0)).otherwise(drawn).cast("long")


def _draw(seed: int, level: int):
    """Fold step of one tree node: how much of a source's quota goes left."""

    def draw(acc: Column, q: Column) -> Column:
        u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(acc["left"]))
        got = hypergeometric(q, acc["pool"], acc["room"], u)
        return let(got, lambda g: F.struct(F.concat(acc["left"], F.array(g)).alias("left"), (acc["pool"] - q).alias("pool"), (acc["room"] - g).alias("room")))

    return draw


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """From one row with ``quota`` (array of long, by source) to one row a shard: (shard, quota)."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.lit(shards).cast("long").alias("width"), "quota")
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x)
        left_width = F.ceil(F.col("width") / 2).cast("long")
        nodes = nodes.withColumn("total", total).withColumn("left_width", left_width)
        nodes = nodes.withColumn("left_total", F.round(F.col("total") * F.col("left_width") / F.col("width")).cast("long"))
        state = F.struct(F.array().cast("array<bigint>").alias("left"), F.col("total").alias("pool"), F.col("left_total").alias("room"))

        nodes = nodes.withColumn("left", F.aggregate("quota", state, _draw(seed, level))["left"])
        right = F.zip_with("quota", "left", lambda q, a: q - a)
        child = F.array(
            F.struct(F.col("node").alias("node"), F.col("left_width").alias("width"), F.col("left").alias("quota")),
            F.struct((F.col("node") + F.col("left_width")).alias("node"), (F.col("width") - F.col("left_width")).alias("width"), right.alias("quota")),
        )
        nodes = nodes.select(F.explode(child).alias("c")).select("c.*").filter("width > 0")
    return cut(nodes.select(F.col("node").alias("shard"), "quota"))


def _running(rows: DataFrame, key: list[str], count: str, sums: dict[str, str], order: list[str]) -> DataFrame:
    """Adds, for rows in ``order`` (whose first column is a 64-bit hash) within ``key``, sums of columns up to and with the row.

    A key with ``count`` rows is cut into ranges of the hash that hold some
    ``RANGE_ROWS`` rows each, so no task sorts a whole key.
    """
    ranges = F.greatest(F.lit(1), F.ceil(F.col(count) / RANGE_ROWS)).cast("double")
    share = (F.col(order[0]).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    cut_rows = rows.withColumn("__pm_range", F.least(F.floor(share * ranges), ranges - 1).cast("long"))
    ends = W.partitionBy(*key).orderBy("__pm_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*key, "__pm_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = cut_rows.groupBy(*key, "__pm_range").agg(*(F.sum(v).alias(f"__pm_own_{v}") for v in sums))
    before = own.select(*key, "__pm_range", *(F.coalesce(F.sum(f"__pm_own_{v}").over(ends), F.lit(0)).alias(f"__pm_before_{v}") for v in sums))
    out = cut_rows.join(before, [*key, "__pm_range"], "inner")
    for v, into in sums.items():
        out = out.withColumn(into, F.col(f"__pm_before_{v}") + F.sum(v).over(inside))
    return out.drop("__pm_range", *(f"__pm_before_{v}" for v in sums))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, seed: int = SEED, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """From (key, source, size) rows: those rows with their block, and for each block and epoch what is drawn of it.

    A drawn row has (block, epoch, shard, room): room is null for a whole block, else
    the words still wanted where the block is the first that no longer fits or one of
    the ``SPARE`` blocks after it. A document's own block is one of many, so a long one
    makes only its block long.
    """
    n = len(weights)
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = sources.withColumn("__pm_rank", F.row_number().over(by_source).cast("long") - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__pm_rank") % n + 1).cast("int"))
    sources = targets(sources.withColumn("weight", weight), share, most)
    n_blocks = lambda words, docs: F.greatest(F.lit(1), F.ceil(F.col("source_size") / words), F.ceil(F.col("docs") / docs)).cast("long")
    each = lambda c, least: F.greatest(F.lit(least), F.ceil(F.sum(c).over(W.partitionBy()) / most_blocks))
    sources = sources.withColumn("small", n_blocks(block_words, block_docs))
    sources = cut(sources.withColumn("n_blocks", n_blocks(each("source_size", block_words), each("docs", block_docs))))
    known = sources.agg(F.count("*"), F.sum("small"), F.sum("n_blocks")).first()
    shards = shards or max(SHARDS, min(-(-(known[1] or 0) // SHARD_BLOCKS), known[2] or 0))

    side = sources.select(F.col("source").alias("__pm_source"), "source_size", "target", "n_blocks", "__pm_rank")
    side = F.broadcast(side) if known[0] <= BROADCAST_ROWS else side
    dealt = sized.join(side, sized["source"].eqNullSafe(side["__pm_source"]), "inner").drop("__pm_source")
    dealt = dealt.withColumn("block", _block(seed))
    blocks = dealt.groupBy("__pm_rank", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("n_blocks").alias("n_blocks"))

    # each epoch has a permutation of its own; running words say where the target is reached
    epochs = F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))
    drawn = blocks.withColumn("epoch", F.explode(epochs)).withColumn("order", F.xxhash64(F.lit(seed), "__pm_rank", "epoch", "block"))
    drawn = _running(cut(drawn.withColumn("one", F.lit(1))), ["__pm_rank", "epoch"], "n_blocks", {"words": "upto", "one": "at"}, ["order", "block"])
    left = F.col("target") - F.col("epoch") * F.col("source_size") - (F.col("upto") - F.col("words"))
    drawn = cut(drawn.withColumn("left", left).select("__pm_rank", "block", "epoch", "order", "n_blocks", "one", "words", "at", "left"))
    whole = drawn.filter("left > 0 and left >= words")
    # the first block that does not fit, and the next ones of the same permutation
    edge = drawn.filter("left > 0 and left < words").select("__pm_rank", "epoch", F.col("at").alias("from"), F.col("left").alias("room"))
    spare = drawn.drop("left").join(edge, ["__pm_rank", "epoch"], "inner").filter(F.col("at").between(F.col("from"), F.col("from") + SPARE))
    names = ["__pm_rank", "block", "epoch", "order", "n_blocks", "one"]
    wanted = whole.select(*names, F.lit(None).cast("double").alias("room")).unionByName(spare.select(*names, "room"))
    # draws of a source, in the order of epoch and permutation
    wanted = _running(cut(wanted), ["__pm_rank", "epoch"], "n_blocks", {"one": "position"}, ["order", "block"])
    per_epoch = wanted.groupBy("__pm_rank", "epoch").agg(F.count("*").alias("n"))
    earlier = per_epoch.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("__pm_rank").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    wanted = wanted.join(earlier.drop("n"), ["__pm_rank", "epoch"], "inner").withColumn("draw", F.col("earlier") + F.col("position"))
    wanted = cut(wanted.select("__pm_rank", "block", "epoch", "room", "draw"))

    quotas = sources.select("__pm_rank").join(wanted.groupBy("__pm_rank").agg(F.count("*").alias("q")), "__pm_rank", "left")
    one = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("__pm_rank", F.coalesce("q", F.lit(0)).cast("long").alias("q")))), lambda s: s["q"]).alias("quota"))
    leaves = splitting_tree(one, shards, seed).select("shard", F.posexplode("quota").alias("__pm_rank", "q"))
    ends = F.sum("q").over(W.partitionBy("__pm_rank").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranges = leaves.withColumn("last", ends).withColumn("first", F.col("last") - F.col("q") + 1).filter("q > 0").drop("q").withColumn("__pm_rank", F.col("__pm_rank").cast("long"))
    placed = wanted.join(ranges, (wanted["__pm_rank"] == ranges["__pm_rank"]) & F.col("draw").between(F.col("first"), F.col("last")), "inner").drop(ranges["__pm_rank"])
    return dealt, placed.select("__pm_rank", "block", "epoch", "shard", "room")


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("n_blocks"))


def _picked(dealt: DataFrame, spare: DataFrame, seed: int) -> DataFrame:
    """(key, epoch): documents of partly drawn blocks whose words together come just below the room.

    Rounds over the documents of a few blocks a source: in the order of a hash all
    that fit together are taken, then, of those that fit what is left, all that do.
    """
    rest = dealt.join(spare, ["__pm_rank", "block"], "inner").filter("size > 0 and size <= room")
    rest = cut(rest.select("__pm_rank", "epoch", "key", "size", "room", F.xxhash64(F.lit(seed + 1), "epoch", "key").alias("h")))
    taken = None
    by = W.partitionBy("__pm_rank", "epoch").orderBy("h", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    for _ in range(ROUNDS):
        rest = cut(rest.withColumn("upto", F.sum("size").over(by)))
        now = rest.filter("upto <= room")
        taken = now.select("key", "epoch") if taken is None else taken.unionByName(now.select("key", "epoch"))
        used = now.groupBy("__pm_rank", "epoch").agg(F.max("upto").alias("used"))
        rest = rest.filter("upto > room").join(used, ["__pm_rank", "epoch"], "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
        rest = rest.drop("used", "upto").filter("size <= room")
    return taken


def _drawn(sized: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``sized`` with their block, places of whole blocks (__pm_rank, block), and of single documents (__pm_key).

    Where the next block no longer fits, it and the blocks after it give single
    documents, passing over those that no longer fit, so a source's words end just
    below its target.
    """
    dealt, placed = plan(sized, **options)
    placed = cut(placed)
    place = F.struct("epoch", "shard")
    whole = placed.filter("room is null").groupBy("__pm_rank", "block").agg(F.collect_list(place).alias("blocks"))
    spare = placed.filter("room is not null")
    picked = _picked(dealt, spare.drop("shard"), options.get("seed", SEED))
    single = picked.join(dealt.select("key", "__pm_rank", "block"), "key", "inner").join(spare.drop("room"), ["__pm_rank", "block", "epoch"], "inner")
    return dealt, whole, cut(single.groupBy(F.col("key").alias("__pm_key")).agg(F.collect_list(place).alias("single")))


def _places() -> Column:
    none = F.array().cast("array<struct<epoch:int,shard:bigint>>")
    return F.array_sort(F.concat(F.coalesce("blocks", none), F.coalesce("single", none)))


def mix(sized: DataFrame, **options) -> DataFrame:
    """Rows of ``sized`` with source_size, target, taken and places (array of epoch, shard)."""
    return _placed(*_drawn(sized, **options)).select(*sized.columns, "source_size", "target", "taken", "places")


def _placed(dealt: DataFrame, whole: DataFrame, single: DataFrame) -> DataFrame:
    # left joins keep every document: what is not drawn has no place
    joined = dealt.join(whole, ["__pm_rank", "block"], "left").join(single, dealt["key"] == single["__pm_key"], "left").drop("__pm_key")
    return joined.withColumn("places", _places()).withColumn("taken", (F.size("places") * F.col("size")).cast("long"))


def _row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row, but for columns of a kind that has no hash."""
    return F.xxhash64(F.lit(SEED), *(F.col(f"`{n}`") for n, kind in docs.dtypes if "map<" not in kind and kind != "variant"))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The narrow table that all decisions use: id, source, size, hash of the whole row, and a key of its own for each row.

    Equal rows are counted before they meet and numbered by chunks of ``CHUNK``.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _row_hash(docs).alias("row"))
    counted = cut(narrow.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("copies")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = counted.filter(F.col("copies") <= CHUNK).withColumn("copy", F.explode(upto(F.col("copies"))))
    many = counted.filter(F.col("copies") > CHUNK).withColumn("chunk", F.explode(upto(F.ceil(F.col("copies") / CHUNK).cast("long"))))
    many = many.repartition("row", "chunk").withColumn("copy", F.explode(F.transform(upto(F.least(F.lit(CHUNK).cast("long"), F.col("copies") - F.col("chunk") * CHUNK)), lambda i: F.col("chunk") * CHUNK + i)))
    names = ["doc_id", "source", "size", "row", "copies", "copy"]
    rows = few.select(*names).unionByName(many.select(*names))
    return cut(rows.withColumn("key", _key(F.col("copy"))).drop("copy"))


def _key(copy: Column) -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", "source", "size", "row", copy.cast("long"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", placed_rows: int = PLACED_ROWS, **options) -> DataFrame:
    """The mixed table: every column of ``docs``, a row for each time it is taken, with epoch, shard and its order there.

    Each of several equal rows is taken as often as its own key says.
    """
    seed = options.get("seed", SEED)
    narrow = sized(docs, id_col, text, source)
    dealt, whole, single = _drawn(narrow, **options)
    whole = cut(whole)
    sources = cut(dealt.select("source", "__pm_rank", "n_blocks").distinct())
    several = cut(narrow.filter("copies > 1").select("row").distinct())
    extra = [HIDE + "epoch", HIDE + "shard", HIDE + "order"]
    place = F.col("place")
    at = lambda key: (place["epoch"].alias(extra[0]), place["shard"].alias(extra[1]), F.xxhash64(F.lit(seed + 2), place["epoch"], key).alias(extra[2]))
    small = sources.count() <= BROADCAST_ROWS and max(t.count() for t in (whole, single, several)) <= placed_rows
    drawn = _placed(dealt.filter("copies > 1") if small else dealt, whole, single)
    drawn = cut(drawn.select("row", "copies", "key", F.explode("places").alias("place")).select(F.col("row").alias(HIDE + "of"), "copies", *at(F.col("key"))))
    keyed = docs.withColumn(HIDE + "row", _row_hash(docs))
    take = lambda rows, of: rows.join(of.drop("copies"), rows[HIDE + "row"] == of[HIDE + "of"], "inner").select(*docs.columns, *extra)
    if small:
        # texts stay where they are: their key names their block, and the table of blocks comes to them
        own = keyed.join(F.broadcast(several.withColumnRenamed("row", HIDE + "several")), F.col(HIDE + "row") == F.col(HIDE + "several"), "left_anti")
        own = own.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(HIDE + "row").alias("row"))
        own = own.select("doc", F.col("source").alias("of"), _key(F.lit(0)).alias("key"))
        own = own.join(F.broadcast(sources), F.col("of").eqNullSafe(F.col("source")), "inner").withColumn("block", _block(seed))
        own = own.join(F.broadcast(whole), ["__pm_rank", "block"], "left").join(F.broadcast(single), F.col("key") == F.col("__pm_key"), "left")
        once = own.select("doc", "key", F.explode(_places()).alias("place")).select("doc.*", *at(F.col("key")))
    else:
        once = take(keyed, drawn.filter("copies = 1"))
    again = drawn.filter("copies > 1")
    if again.isEmpty():
        return once
    # of rows that are equal in every column one stands for all
    repeated = keyed.join(again.select(HIDE + "of").distinct(), keyed[HIDE + "row"] == F.col(HIDE + "of"), "left_semi").dropDuplicates([HIDE + "row"])
    return once.unionByName(take(repeated, again))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the mix as one folder a shard, rows shuffled inside each."""
    rows = mix_rows(docs, **options)
    rows.repartition(HIDE + "shard").sortWithinPartitions(HIDE + "shard", HIDE + "order").write.partitionBy(HIDE + "shard").parquet(path)


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken", F.transform("places", lambda p: p["shard"]).alias("shards"))
