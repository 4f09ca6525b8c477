"""Mixing sources to target weights by Sainte-Lague apportionment.

The word total is cut into blocks of equal size, small enough for the smallest
target to be several. Blocks go to sources by highest quotients of their
targets, then to each source's shards by highest quotients of their sizes, so
that every shard has an integer quota. Inside a shard documents lie end to end
in a seeded order; its quota takes whole passes over its words and, for the
rest, the blocks that come first by a keyed hash.

Defined results: null or wordless text has size 0 and takes 0; a null source is
a source of its own, last in order; sources of size 0 have target 0; repeated
rows each count; an empty table gives an empty table; ties between quotients go
to the first source by code point, then to the first shard; other columns of
the input stay as they are, and apportion() refuses an input that already has
one of the columns it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.llm.common import free_name, materialise, table

#: Words of a block at most, blocks of the smallest target at least, documents of a shard (about), and how often a word may be taken.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_DOCS, MAX_REPEATS = 64, 8, 2048, 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last. One row a source goes through the window."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def capped_targets(sources: DataFrame, limit: int = MAX_REPEATS) -> DataFrame:
    """Targets that share the total by weight, none above limit times its size, the excess going to the others by weight.

    The filling level is where sum(min(cap, weight * level)) is the total: sources in the order of cap over weight
    are capped as long as the level that the rest would have is not below theirs.
    """
    cap = limit * F.col("source_size").cast("double")
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    every = W.partitionBy(F.lit(0))
    order = every.orderBy("ratio", "source").rowsBetween(W.unboundedPreceding, -1)
    x = sources.withColumn("cap", cap).withColumn("ratio", ratio)
    x = x.withColumn("total", F.sum(F.col("source_size").cast("double")).over(every)).withColumn("weights", F.sum("weight").over(every))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    x = x.withColumn("level", F.when(F.col("ratio") >= level, level))
    x = x.withColumn("level", F.max("level").over(every))
    return x.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("cap", "ratio", "total", "weights", "cap_before", "weight_before", "level")


def sainte_lague(parties: DataFrame, votes: str, seats: Column, within: list[str], tie: list[str], name: str) -> DataFrame:
    """parties with their seats, the highest quotients votes / (2 k + 1) of each group winning.

    Rounding votes / (total / seats) gives all but a few seats of the highest-quotient result; those are settled
    among the next (or last) quotients of each party, of which a party can win or lose about its share.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    x = parties.withColumn("_v", v).withColumn("_n", seats.cast("double"))
    x = x.withColumn("_all", F.sum("_v").over(group)).withColumn("_k", F.count("*").over(group))
    share = F.when(F.col("_all") > 0, F.col("_v") / F.col("_all")).otherwise(0.0)
    x = x.withColumn("_share", share).withColumn("_q", F.round(F.col("_share") * F.col("_n")).cast("long"))
    x = x.withColumn("_gap", F.when(F.col("_all") > 0, F.col("_n") - F.sum("_q").over(group)).otherwise(0).cast("long"))
    reach = (F.ceil((F.abs("_gap") + F.col("_k")) * F.col("_share")) + 1).cast("int")
    up = F.transform(F.sequence(F.lit(0), reach - 1), lambda i: F.col("_v") / (2 * (F.col("_q") + i) + 1))
    down = F.transform(F.sequence(F.lit(1), F.least(reach.cast("long"), F.col("_q")).cast("int")), lambda i: F.col("_v") / (2 * (F.col("_q") - i) + 1))
    none = F.array().cast("array<double>")
    moves = F.when(F.col("_gap") > 0, up).when((F.col("_gap") < 0) & (F.col("_q") > 0), down).otherwise(none)
    x = x.withColumn("_place", F.row_number().over(group.orderBy(*tie)))
    m = x.select(*within, *tie, "_gap", "_place", F.explode(moves).alias("_quotient"))
    # seats won go to the first of equal quotients, seats lost come from the last
    sign = F.when(F.col("_gap") > 0, -1).otherwise(1)
    m = m.withColumn("_rank", F.row_number().over(group.orderBy(sign * F.col("_quotient"), -sign * F.col("_place")))).where(F.col("_rank") <= F.abs("_gap"))
    moved = m.groupBy(*within, *tie).agg(F.sum(F.signum("_gap")).cast("long").alias("_moved"))
    condition = F.lit(True)
    for c in dict.fromkeys([*within, *tie]):
        condition = condition & F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}"))
    y = x.alias("x").join(moved.alias("m"), condition, "left")
    y = y.select(*[F.col(f"x.{c}").alias(c) for c in parties.columns], (F.col("_q") + F.coalesce(F.col("_moved"), F.lit(0))).alias(name))
    return y


#: Columns that apportion() adds.
ADDED = ("source_size", "target", "shard", "shard_quota", "taken")


def apportion(sizes: DataFrame, seed: int = SEED, most: int = BLOCK_WORDS) -> DataFrame:
    """sizes (row key _id, source, size) with source_size, target, shard, its quota (in blocks) and the words taken of each row."""
    if clash := {c.lower() for c in sizes.columns} & set(ADDED):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    sources = materialise(capped_targets(cycle_weights(per_source)), "mix-sources")
    total, smallest = sources.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(1, min(most, int((smallest or 0) / LEAST_BLOCKS)))
    seats = F.lit(round((total or 0) / block))
    quotas = sainte_lague(sources, "target", seats, [], ["source"], "quota")

    # many rows a source: shards spread a hot one; the small side is repeated for them
    wide = quotas.withColumn("_shards", F.ceil(F.col("_docs") / SHARD_DOCS).cast("int"))
    quotas = materialise(wide, "mix-quotas")
    draw = F.xxhash64(F.lit(seed), F.col("_id"))
    # one row a source (source, five numbers); a salt keeps the rows of a hot source apart where this is no broadcast
    salts = 32
    left = sizes.withColumn("_draw", draw).withColumn("_salt", F.pmod(F.col("_draw"), F.lit(salts)))
    right = quotas.select(F.col("source").alias("_s"), "source_size", "target", "_shards").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = left.join(right, left["source"].eqNullSafe(right["_s"]) & (left["_salt"] == right["_salt2"])).drop("_s", "_salt", "_salt2")
    placed = placed.withColumn("shard", F.pmod(F.shiftrightunsigned("_draw", 8), F.col("_shards")).cast("int"))

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("_words"))
    s, q = shards.alias("s"), quotas.alias("q")
    shards = s.join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).select("s.source", "shard", "_words", "quota", F.least(F.col("target"), F.lit(float(MAX_REPEATS)) * F.col("source_size")).alias("_goal"), "source_size")
    shards = sainte_lague(shards, "_words", F.col("quota"), ["source"], ["shard"], "_quota")
    # words that a quota stands for, as blocks of this shard: whole passes, then so many blocks of all
    blocks = F.greatest(F.lit(1), F.round(F.col("_words") / block)).cast("long")
    words = F.least(F.col("_quota") * block, MAX_REPEATS * F.col("_words"), F.ceil(F.col("_goal") * F.col("_words") / F.col("source_size") + block).cast("long"))
    shards = shards.withColumn("_blocks", blocks).withColumn("_take", F.when(F.col("_words") > 0, words).otherwise(0))
    shards = shards.withColumn("_passes", F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).cast("long"))
    shards = shards.withColumn("_more", F.when(F.col("_words") > 0, F.round((F.col("_take") - F.col("_passes") * F.col("_words")) * F.col("_blocks") / F.col("_words"))).otherwise(0).cast("long"))
    # the hash up to which a shard's blocks are taken; a shard has few enough blocks for one row
    hashed = lambda k: F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("shard"), k)
    in_order = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), hashed))
    shards = shards.withColumn("_up_to", F.when(F.col("_more") > 0, F.get(in_order, F.least(F.col("_more"), F.col("_blocks")).cast("int") - 1)))

    lay = W.partitionBy("source", "shard").orderBy("_draw", "_id").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(lay))
    a, b = laid.alias("a"), shards.alias("b")
    x = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard"))).select("a.*", "_words", "_blocks", "_passes", "_more", "_up_to", "_quota")
    start = F.col("_end") - F.col("size")
    edge = lambda k: F.floor(k * F.col("_words") / F.col("_blocks"))  # noqa: E731  first word of block k
    first = F.floor(start * F.col("_blocks") / F.greatest(F.col("_words"), F.lit(1))) - 1
    last = F.floor(F.col("_end") * F.col("_blocks") / F.greatest(F.col("_words"), F.lit(1))) + 1
    lowest, highest = F.greatest(first, F.lit(0)), F.least(last, F.col("_blocks") - 1)
    x = x.withColumn("_low", lowest).withColumn("_high", highest)
    overlap = lambda k: F.greatest(F.lit(0), F.least(F.col("_end"), edge(k + 1)) - F.greatest(start, edge(k)))
    picked = lambda k: hashed(k) <= F.col("_up_to")
    part = F.aggregate(F.sequence(F.col("_low"), F.col("_high")), F.lit(0).cast("long"), lambda acc, k: acc + F.when(picked(k), overlap(k)).otherwise(0).cast("long"))
    taken = F.col("_passes") * F.col("size") + F.when((F.col("size") > 0) & (F.col("_more") > 0), part).otherwise(0)
    return x.select(*sizes.columns, "source_size", "target", "shard", F.col("_quota").alias("shard_quota"), taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialise(docs.select(F.col("doc_id").alias("_id"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return apportion(sizes).select(F.col("_id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "shard_quota")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fourth stage of the pipeline: each document as often as the mix takes it.

    Taken words over size is how many copies a document is worth; a seeded draw rounds that up or down, so each
    source's words still come near its target. A source all of whose documents were rounded down keeps the one that is
    worth most. Rows of one id, repeated or with different texts, are together worth what they take and each get the
    same number of copies; rows without an id go by their text. Wordless documents, which weigh nothing, stay once.
    """
    ident = lambda key, text: F.when(key.isNotNull(), F.concat(F.lit("i"), key.cast("string"))).otherwise(F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    own = ident(F.col("doc_id"), F.col("text")).alias("_id")
    sizes = materialise(docs.select(own, "source", word_count(F.col("text")).alias("size")), "mix-stage")
    mixed = materialise(apportion(sizes), "mix-taken")
    draw = F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("_doc")), F.lit(1 << 30)) / float(1 << 30)
    worth = mixed.groupBy(F.col("_id").alias("_doc")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + draw)).otherwise(1).cast("int")
    counts = worth.select("_doc", copies.alias("_copies"))
    with_words = mixed.where("size > 0").select("source", F.col("_id").alias("_doc"), (F.col("taken") / F.col("size")).alias("_worth")).join(counts, "_doc")
    none = with_words.groupBy("source").agg(F.max("_copies").alias("_any"), F.max_by("_doc", F.struct("_worth", "_doc")).alias("_doc")).where("_any = 0")
    saved = none.select(F.col("_doc").alias("_saved")).distinct()
    counts = counts.join(saved, F.col("_doc") == F.col("_saved"), "left").select("_doc", F.when(F.col("_saved").isNotNull(), 1).otherwise(F.col("_copies")).alias("_copies")).where("_copies > 0")
    copy = free_name(docs, "_copy")
    d, c = docs.alias("d"), counts.hint("shuffle_hash").alias("c")
    out = d.join(c, ident(F.col("d.doc_id"), F.col("d.text")) == F.col("c._doc")).select("d.*", F.explode(F.sequence(F.lit(1), F.col("c._copies"))).alias(copy))
    return out.drop(copy)
