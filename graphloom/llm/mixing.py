"""Mixing sources to target weights.

1. Targets: sources in code point order (null last) weigh 3, 1, 2, repeating;
   they share ``share`` of all words; a target stops at ``limit`` times its
   source's words and the excess is reshared by weight. The fixed point of that
   is water filling, solved in one ordered pass over the sources.
2. Quotas: documents of a source are permuted by a keyed hash and cut into
   blocks of equal probability. Every whole pass takes all blocks; the rest of
   the target takes blocks in permuted order, which gives each source an exact
   number of blocks to draw. The one boundary block is cut into smaller ones in
   the same way, and of these the boundary one is resolved by document: long
   ones, then a prefix of its permutation, then fill-ins that still fit, then
   the single document closest to what is missing. The outcome is a handful of
   cut-offs per source, so the choice for a document is an expression over its
   own hash and size: no text is shuffled.
3. Splitting tree: the root holds each source's quota of blocks. A node with
   several output shards gives its left half of them their share of its blocks;
   how many come from each source is a multivariate hypergeometric draw, made
   source by source from the conditional (univariate) distribution with a keyed
   uniform number. The right half gets the others. So every node's quotas add
   up to its parent's, and a leaf's are those of its shard.
4. Draws: each source's blocks, in an order permuted by a keyed hash, are dealt
   to the shards by their quotas: disjoint, and all of them. ``mixed`` repeats
   the documents and shuffles each shard locally.

Only DataFrame operations. Block tables have at most ``BLOCKS`` rows and one
for each source, whatever the number of documents; a hot source only has more
blocks. Null texts have no words and may be drawn or not; a text of any length
is one document, drawn or not as a whole. An empty table gives an empty result;
repeated rows with one doc_id, and all rows without one, are taken or left
together. Columns made here win over others of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import n_words, quoted
from graphloom.session import materialize

#: Fixed values of the task: weights by position of the source, share of all words, limit of repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
#: Blocks of all sources together, and documents a block has at least on average.
BLOCKS = 8192
BLOCK_DOCS = 64
OUTPUT_SHARDS = 16


def permuted(id_col: Column, seed: str) -> Column:
    """A 60-bit key that permutes ids; the same value in any engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(source, source_size, n_docs, n_blocks, n_cuts, target)`` from rows ``(source, size)``."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("weight"), (F.col("source_size") * limit).alias("cap"), (F.sum("source_size").over(every) * share).alias("all"), F.sum("n_docs").over(every).alias("all_docs"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("at", F.row_number().over(fill))
    # The first source, by cap / weight, whose cap is not under the level that the rest would share.
    stop = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("at", "level"))).over(every)["level"]
    wanted = F.ceil(F.col("n_docs") * BLOCKS / F.col("all_docs"))
    blocks = F.greatest(F.lit(1), F.least(wanted, F.floor(F.col("n_docs") / BLOCK_DOCS))).cast("long")
    # The boundary block is cut again, into parts of that many documents.
    cuts = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("n_docs") / blocks / BLOCK_DOCS))).cast("long")
    return per.select("source", F.col("source_size").cast("long"), "n_docs", blocks.alias("n_blocks"), cuts.alias("n_cuts"), F.coalesce(F.least("cap", stop * F.col("weight")), F.col("cap")).alias("target"))


#: Passes over the boundary block. The first takes only documents above a quarter of what is missing: short ones can't make up for them.
PASSES = (1, 2, 3, 4)


def _fits(i: int, size: Column, gap: Column) -> Column:
    fits = (size <= gap) & (size > 0)
    return fits & (size * 4 > gap) if i == 1 else fits


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _boundary(blocks: DataFrame, name: str, target: str) -> DataFrame:
    """``(source, at, need)``: the first block whose words, with those before, pass ``target``, and what is still needed there."""
    run = Window.partitionBy("source").orderBy(name)
    upto = blocks.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") > F.col(target))
    need = F.col(target) - F.col("upto") + F.col("words")
    return upto.groupBy("source").agg(F.min(F.struct(F.col(name).alias("at"), need.alias("need"))).alias("e")).select("source", "e.at", "e.need")


def part_of(h: Column) -> Column:
    """The part of its block that a hash falls into."""
    return F.floor(h / F.col("n_blocks")).cast("long") % F.col("n_cuts")


def plan(rows: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """Cut-offs per source from rows ``(doc_id, source, size)``.

    Columns: those of ``source_targets`` and ``full`` (whole passes), ``rest``,
    ``edge`` (the boundary block; blocks before it are drawn once more), ``cut``
    (its boundary part; documents in parts before it are taken),
    ``g1, c1`` to ``g4, c4`` (in the boundary part, pass i takes hashes up to
    ``ci`` among documents of at most ``gi`` words) and ``star`` (the hash of
    one closing document).
    """
    per = source_targets(rows, **targets)
    passes = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    per = materialize(per.withColumn("full", passes.cast("int")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-sources")
    keyed = rows.select(F.col("source").alias("s"), "size", permuted(F.col("doc_id"), seed).alias("h"))
    keyed = keyed.join(per.select("source", "n_blocks", "n_cuts", "rest"), _same("s", "source")).withColumn("block", F.col("h") % F.col("n_blocks"))
    blocks = keyed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    edge = _boundary(blocks, "block", "rest").select(F.col("source").alias("es"), F.col("at").alias("edge"), "need")
    docs = keyed.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("edge"))).withColumn("part", part_of(F.col("h")))
    parts = docs.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    cut = _boundary(parts, "part", "need").select(F.col("source").alias("cs"), F.col("at").alias("cut"), F.col("need").alias("left"))
    docs = docs.join(cut, F.col("source").eqNullSafe(F.col("cs")) & (F.col("part") == F.col("cut"))).select("source", "size", "h", "edge", "cut", F.col("left").alias("need"))

    by_hash = Window.partitionBy("source").orderBy("h")
    whole = Window.partitionBy("source")
    taken = F.lit(False)
    docs = docs.withColumn("gap", F.col("need"))
    for i in PASSES:
        free = (~taken) & _fits(i, F.col("size"), F.col("gap"))
        docs = docs.withColumn(f"g{i}", F.col("gap"))
        docs = docs.withColumn("run", F.sum(F.when(free, F.col("size")).otherwise(0)).over(by_hash))
        docs = docs.withColumn(f"c{i}", F.max(F.when(free & (F.col("run") <= F.col("gap")), F.col("h"))).over(whole))
        now = free & (F.col("h") <= F.coalesce(F.col(f"c{i}"), F.lit(-1)))
        docs = docs.withColumn(f"t{i}", now)
        docs = docs.withColumn("gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col(f"t{i}"), F.col("size"))).over(whole), F.lit(0)))
        taken = taken | F.col(f"t{i}")
    closer = F.abs(F.col("gap") - F.col("size"))
    best = F.min(F.when((~taken) & (F.col("size") > 0) & (closer < F.col("gap")), F.struct(closer.alias("d"), F.col("h").alias("h"))))
    cut = docs.groupBy("source").agg(*[F.first(c).alias(c) for c in ("edge", "cut", *[f"{x}{i}" for i in PASSES for x in "gc"])], best["h"].alias("star"))
    cut = cut.withColumnRenamed("source", "cs")
    return per.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")


def copies(h: Column, size: Column, block: Column) -> Column:
    """How often a document is taken, given its source's columns of ``plan``."""
    inside = F.lit(False)
    for i in PASSES:
        inside = inside | (_fits(i, size, F.col(f"g{i}")) & (h <= F.coalesce(F.col(f"c{i}"), F.lit(-1))))
    inside = inside | (h == F.coalesce(F.col("star"), F.lit(-1)))
    part = part_of(h)
    inside = (part < F.col("cut")) | ((part == F.col("cut")) & inside)
    more = F.when(F.col("rest") <= 0, False).when(F.col("edge").isNull() | (block < F.col("edge")), True).otherwise((block == F.col("edge")) & inside)
    return F.col("full") + more.cast("int")


def log_factorial(n: Column) -> Column:
    """ln n!: exact below 16, else Stirling's series, good to 1e-12."""
    x = n.cast("double")
    few = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), (F.least(n, F.lit(15)) + 1).cast("int"))
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (x * 12) - 1 / (x * x * x * 360) + 1 / (x * x * x * x * x * 1260)
    return F.when(n < 16, few).otherwise(series)


def hypergeometric(u: Column, total: Column, special: Column, drawn: Column) -> Column:
    """How many of ``special`` among ``total`` blocks are in ``drawn`` of them: the quantile of ``u``."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - special)), F.least(special, drawn)
    f = log_factorial

    def step(acc: Column, k: Column) -> Column:
        ways = f(special) - f(k) - f(special - k) + f(total - special) - f(drawn - k) - f(total - special - drawn + k) - f(total) + f(drawn) + f(total - drawn)
        upto = acc["upto"] + F.exp(ways)
        return F.struct(upto.alias("upto"), F.when((acc["upto"] < u) & (upto >= u), k).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("upto"), high.alias("k")), step)["k"]


def _uniform(seed: str, *of: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in of]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _draws(seed: str, level: int):
    """A node's draw from one source after the other, each given what is left of the node and of its left half."""

    def draw(acc: Column, q: Column) -> Column:
        u = _uniform(seed, F.lit(level), F.col("node"), F.size(acc["picks"]))
        k = hypergeometric(u, acc["rest"], q["blocks"], acc["left"])
        after = lambda k: F.struct((acc["rest"] - q["blocks"]).alias("rest"), (acc["left"] - k).alias("left"), F.array_append(acc["picks"], k).alias("picks"))
        return F.transform(F.array(k), after)[0]

    return draw


def splitting_tree(quotas: DataFrame, shards: int = OUTPUT_SHARDS, seed: str = "mix") -> DataFrame:
    """``(level, node, lo, hi, n, quotas)`` of all nodes, from ``(source, blocks)``, one row for each source.

    A node's shards are ``lo..hi - 1``; ``quotas array<struct<source, blocks>>``
    is in the order of sources. Nodes of one shard are leaves.
    """
    every = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("blocks").cast("long").alias("blocks"))))
    root = quotas.agg(F.transform(every, lambda q: F.struct(q["source"].alias("source"), q["blocks"].alias("blocks"))).alias("quotas"))
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["blocks"])
    level = root.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"), total.alias("n"), "quotas")
    levels = [level]
    for i in range((shards - 1).bit_length()):
        inner = materialize(level.where("hi - lo > 1"), "mix-tree")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.floor(F.col("n") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")

        start = F.struct(F.col("n").alias("rest"), left.alias("left"), F.array().cast("array<bigint>").alias("picks"))
        inner = inner.withColumn("picks", F.aggregate("quotas", start, _draws(seed, i))["picks"])
        ours = F.transform("quotas", lambda q, i: F.struct(q["source"].alias("source"), F.col("picks")[i].alias("blocks")))
        theirs = F.transform("quotas", lambda q, i: F.struct(q["source"].alias("source"), (q["blocks"] - F.col("picks")[i]).alias("blocks")))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("lo").alias("lo"), mid.alias("hi"), left.alias("n"), ours.alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), mid.alias("lo"), F.col("hi").alias("hi"), (F.col("n") - left).alias("n"), theirs.alias("quotas")),
        )
        level = inner.select(F.explode(halves).alias("x")).select(F.lit(i + 1).alias("level"), "x.node", "x.lo", "x.hi", "x.n", "x.quotas")
        level = materialize(level, "mix-tree")
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def _drawn() -> Column:
    """How often a block is drawn, given its source's columns of ``plan``."""
    return F.col("full") + ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("block") <= F.col("edge")))).cast("int")


def draw_blocks(per: DataFrame, shards: int = OUTPUT_SHARDS, seed: str = "mix") -> DataFrame:
    """``(source, block, pass, shard)``: every block of every pass, dealt by the quotas of the splitting tree."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    units = per.select("*", block.alias("block")).withColumn("drawn", _drawn()).where("drawn > 0")
    units = units.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("drawn"))).alias("pass"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("block"), F.col("pass")))
    units = materialize(units.withColumn("key", key), "mix-units")
    leaves = splitting_tree(units.groupBy("source").agg(F.count(F.lit(1)).alias("blocks")), shards, seed).where("hi - lo = 1")
    leaves = leaves.select(F.col("lo").alias("shard"), F.explode("quotas").alias("q")).select("shard", F.col("q.source").alias("qs"), "q.blocks")
    upto = F.sum("blocks").over(Window.partitionBy("qs").orderBy("shard"))
    places = leaves.withColumn("upto", upto).where("blocks > 0").select("qs", "shard", F.explode(F.sequence(F.col("upto") - F.col("blocks"), F.col("upto") - 1)).alias("place"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("key")) - 1  # of at most LIMIT * BLOCKS blocks
    ranked = units.withColumn("rank", rank.cast("long"))
    return ranked.join(places, F.col("source").eqNullSafe(F.col("qs")) & (F.col("rank") == F.col("place"))).select("source", "block", "pass", "shard")


def mix(docs: DataFrame, seed: str = "mix", shards: int = OUTPUT_SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken_times`` and ``draws``: the output shard of each time it is taken.

    Each row stays once; ``mixed`` repeats it.
    """
    added = ("size", "source_size", "target", "taken_times", "draws", "h")
    kept = [c for c in docs.columns if c not in added]
    key, size = permuted(F.col(quoted(id_col)), seed), n_words(F.col(quoted(text_col)))
    rows = materialize(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), size.alias("size")), "mix-rows")
    per = materialize(plan(rows, seed, **targets), "mix-plan")
    drawn = draw_blocks(per, shards, seed)
    # At most BLOCKS + one row for each source; a block is drawn at most 3 times.
    by_block = drawn.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("all_draws"))
    info = materialize(
        per.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .join(by_block.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "all_draws"), F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")), "left")
        .drop("bs", "bb", "source_size", "target", "n_docs", "n_blocks", "n_cuts")
        .withColumnRenamed("source", "is"),
        "mix-blocks",
    )
    sources = per.select(F.col("source").alias("ps"), "source_size", "target", "n_blocks", "n_cuts")
    few = per.count() <= 100_000  # both tables are then under 110,000 small rows
    hint = F.broadcast if few else (lambda x: x)
    # The input's own columns travel in one struct, so that no name of theirs meets one of ours.
    out = docs.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), F.col(quoted(source_col)).alias("own_source"), size.alias("size"), key.alias("h"))
    out = out.join(hint(sources), F.col("own_source").eqNullSafe(F.col("ps"))).withColumn("own_block", F.col("h") % F.col("n_blocks"))
    out = out.join(hint(info), F.col("own_source").eqNullSafe(F.col("is")) & (F.col("own_block") == F.col("block")))
    out = out.withColumn("taken_times", copies(F.col("h"), F.col("size"), F.col("block")))
    draws = F.slice(F.coalesce("all_draws", F.array().cast("array<int>")), F.lit(1), F.col("taken_times"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "size", "source_size", "target", "taken_times", "h", draws.alias("draws"))


def mixed(table: DataFrame, columns: list[str], seed: str = "mix") -> DataFrame:
    """The mix itself from ``mix``: each row as often as taken, with its ``shard``, shuffled within it."""
    kept = [c for c in columns if c != "shard"]
    out = table.select(F.struct(F.lit(0).alias("0"), *[F.col(quoted(c)) for c in kept]).alias("row"), "h", F.posexplode("draws").alias("pass", "shard"))
    key = F.xxhash64(F.lit(seed), "shard", "pass", "h")
    out = out.repartition("shard", F.pmod(key, F.lit(64))).sortWithinPartitions("shard", key)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "shard")
