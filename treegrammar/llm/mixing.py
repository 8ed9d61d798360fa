"""Mixing sources to target weights with DataFrame functions only.

Each source's words form one stream (documents in a fixed pseudorandom order), packed into blocks of block_words; the last
block of a stream may be short.  Targets come from weights by water filling under a cap.  A source whose target is t
passes e = floor(t / stream) whole times through its blocks and then takes the rest from one more pass, its last block cut.
Each pass has its own pseudorandom permutation of block indices (a mixed-radix Feistel network with cycle walking).  All output
shards but the last have the same number of slots, filled by sources at random without replacement: a permutation of all slots of
the mix is cut into shards, and counting gives each shard's source counts (multinomial, given the sources' totals), whose
running sums hand each shard its range of the source's slots.  Slots meet blocks in a join on (source, block).

Defined results: a null text has no words; documents without words take nothing; null sources form one source, ordered
last; repeated rows are separate documents; an empty table gives an empty result; other columns are ignored by mix() and kept as they are, whatever
their names, by mixed_texts() (which has no row for a document that the mix takes no word of).  A stream may have up to 2**31 blocks (a larger one fails with a message: raise block_words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegrammar.llm.common import WORD, cut, forget, partitions, quoted, read

WEIGHTS = (5, 2, 1)
BUCKETS = 1024  # pieces of a source whose sizes are summed apart, so that no source is ordered in one task
CHUNK = 4096  # slots made by one row
ROUNDS, WALK = 4, 64


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target): one row a source.  The level is the greatest of (total - caps before) / weights from here on, sources in the order of cap by weight; a target is weight times level, or its cap if that is less."""
    one = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))  # one row a source
    one = one.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    one = one.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"), "cap": F.col("source_size") * F.lit(float(cap))})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    one = one.withColumns({"total": F.sum("source_size").over(everything) * F.lit(float(share)), "before": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), "left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    level = F.max((F.col("total") - F.coalesce("before", F.lit(0.0))) / F.col("left")).over(everything)
    return one.withColumn("level", level).select("source", "rank", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def placed(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with their source's rank and the offset of their first word in the stream; two-level running sums."""
    at = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)))
    inside = Window.partitionBy("source", "bucket").orderBy(F.asc_nulls_first("doc_id"), "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = at.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    at = at.join(sums, at["source"].eqNullSafe(sums["s"]) & (at["bucket"] == sums["b"]))
    goals = goals.withColumnRenamed("source", "of")
    return at.join(goals, at["source"].eqNullSafe(goals["of"])).select("doc_id", "size", "rank", "source_size", "target", (F.col("inside") + F.col("ahead")).alias("offset"), "text_hash")


def permuted(index: str, n: str, seed: str) -> str:
    """SQL for the place of index (0 to n - 1) in a permutation that the seed columns name."""
    step = "acc"
    for r in range(ROUNDS):  # halves of radix w: (l, r) -> (r, l + f(r) mod w)
        step = f"transform(array({step}), p -> (p % w) * w + pmod(p div w + pmod(xxhash64({r}, {seed}, p % w), w), w))[0]"
    walk = f"aggregate(sequence(1, {WALK}), s, (acc, i) -> if(i > 1 and acc < {n}, acc, {step}))"
    return f"transform(transform(array(cast(ceil(sqrt({n})) as bigint)), w -> transform(array({index}), s -> {walk})[0]), x -> if(x < {n}, x, raise_error('permutation did not settle')))[0]"


def slots(goals: DataFrame, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """(rank, epoch, block, take, shard): one row for each slot of the mix; take: how many words of the block it may use."""
    spark = goals.sparkSession
    L = F.lit(block_words).cast("long")
    plan = goals.where("source_size > 0").withColumn("want", F.least(F.round("target").cast("long"), 2 * F.col("source_size")))
    plan = plan.withColumns({"blocks": F.expr(f"cast(ceil(source_size / {block_words}) as bigint)"), "passes": F.expr("want div source_size"), "rest": F.expr("want % source_size")})
    plan = plan.withColumns({"full": F.expr(f"rest div {block_words}"), "cut": F.expr(f"rest % {block_words}")})
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("full") + F.when(F.col("cut") > 0, 1).otherwise(0))
    plan = plan.where("slots > 0").withColumn("blocks", F.when(F.col("blocks") < 1 << 31, F.col("blocks")).otherwise(F.raise_error(F.lit("more than 2**31 blocks in a source: raise block_words"))))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    plan = plan.withColumns({"ahead": F.coalesce(F.sum("slots").over(before), F.lit(0)), "all_slots": F.sum("slots").over(Window.partitionBy())})
    plan = cut(spark, plan, "mix-plan")
    per_shard = max(1, shard_words // block_words)

    def each(df: DataFrame, count: str, name: str) -> DataFrame:
        """One row for each of 0 .. count - 1, dealt evenly whatever the largest count."""
        chunks = df.withColumn("c", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {CHUNK})"))).repartition(partitions(spark), *[c for c in ("rank", "shard") if c in df.columns], "c")
        return chunks.withColumn(name, F.explode(F.expr(f"sequence(c * {CHUNK}, least({count}, (c + 1) * {CHUNK}) - 1)"))).drop("c")

    drawn = each(plan.select("rank", "slots", "ahead", "all_slots"), "slots", "draw").withColumn("at", F.col("ahead") + F.col("draw"))
    drawn = drawn.select("rank", F.expr(f"({permuted('at', 'all_slots', f'{seed}, -1L, -1L')}) div {per_shard}").alias("shard"))
    counted = drawn.groupBy("rank", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(plan.select("rank", "blocks", "passes", "full", "cut"), "rank")
    slot = each(counted, "n", "k").withColumn("slot", F.col("first") + F.col("k"))
    slot = slot.withColumns({"epoch": F.expr("slot div blocks"), "pos": F.expr("slot % blocks")})
    take = F.when((F.col("epoch") == F.col("passes")) & (F.col("pos") == F.col("full")), F.col("cut")).otherwise(L)
    return slot.select("rank", "epoch", F.expr(permuted("pos", "blocks", f"{seed}, rank, epoch")).alias("block"), take.alias("take"), "shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 128, shard_words: int = 1 << 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents as placed(); pieces (rank, offset, epoch, block, shard, first, words): which of a document's words each slot takes."""
    spark = docs.sparkSession
    rows = cut(spark, sized(docs, id_col, text_col, source_col), "sized")
    at = cut(spark, placed(rows, targets(rows, weights, share, cap)), "placed")
    forget(rows)
    goals = at.groupBy("rank").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    parts = at.where("size > 0").select("rank", "offset", "size", F.explode(F.expr(f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})")).alias("block"))
    base = F.col("block") * block_words
    parts = parts.withColumns({"begin": F.greatest(F.col("offset") - base, F.lit(0)), "end": F.least(F.col("offset") + F.col("size") - base, F.lit(block_words))})
    took = parts.join(slots(goals, block_words, shard_words, seed).hint("merge"), ["rank", "block"])  # both sides grow with the input
    words = F.least(F.col("end"), F.col("take")) - F.col("begin")
    pieces = took.select("rank", "offset", "epoch", "block", "shard", (F.col("begin") + base - F.col("offset")).alias("first"), words.alias("words")).where("words > 0")
    return at, pieces


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as the mix holds them, same columns: one row for each document and pass it is taken in, its text cut to the words taken (unchanged if all are)."""
    at, pieces = mix(docs, id_col, text_col, source_col, **how)
    one = pieces.groupBy("rank", "offset", "epoch").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("ranges"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    twins = Window.partitionBy("id", "hash").orderBy("rank", "offset")  # repeated rows only
    keys = at.where("size > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "rank", "offset", "size")
    keys = keys.withColumn("twin", F.row_number().over(twins)).join(one, ["rank", "offset"]).alias("k")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col(source_col).cast("string").alias("source"))
    rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.asc_nulls_last("source")))).alias("r")
    joined = rows.join(keys, F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.hash") == F.col("k.hash")) & (F.col("r.twin") == F.col("k.twin")))
    joined = joined.select("r.row", "k.taken", "k.size", "k.ranges", F.col("r.row").getField(text_col).cast("string").alias("text"))
    part = F.expr("array_join(flatten(transform(ranges, r -> slice(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), cast(r.first + 1 as int), cast(r.words as int)))), ' ')")
    cut_text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(part)
    return joined.select(F.col("row").withField(quoted(text_col), cut_text).alias("row")).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, pieces = mix(read(spark, sf_dir, "documents"))
    taken = pieces.groupBy("rank", "offset").agg(F.sum("words").alias("taken"))
    whole = at.where("size > 0").join(taken, ["rank", "offset"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return whole.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).union(at.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
