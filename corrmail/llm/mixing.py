"""Mixing sources to target weights (operator 5), with DataFrame functions only.

The words of each source form one stream, cut into blocks of a fixed number of words.  A target says how many slots a
source gets: whole passes over its blocks, then some more blocks, of which the last one is cut where the target is
met.  The slots of all sources are dealt to output shards in two steps:

1. Each slot draws a source by a hash, with the sources' numbers of slots as odds, so the counts of a shard are a
   multinomial draw.  Slots are numbered within their source over all shards.
2. A source with more slots than its target hands the surplus to those that drew too few, by number.

Slot k of a source takes a block by a pseudorandom permutation of its full blocks (another one for each pass; a
shorter last block closes the pass), and blocks join the documents by index.

The permutation is the swap-or-not shuffle of Hoang, Morris and Rogaway: in each round a number is swapped with its
mirror at a round's key or not, as a hash of the larger one says, so any range is mapped to itself.

Null text has no words.  Null is a source of its own, after all others.  Repeated rows count as often as they
occur.  Rows keep their columns, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, chunk_count, chunk_of, materialize, prefix_sum, shuffle_partitions

#: Weights of the sources in their order, repeating; how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Rounds of the index permutation, and up to how many sources their table is broadcast (some 100 bytes each).
ROUNDS = 32
MOST_BROADCAST = 100_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """One row per source: sid (place in code point order, null last), source_size, target.

    All sizes are shared by weight; a source stops at ``most`` times its size and the rest shares what it leaves.
    Ordered by size over weight, the sources that stop come first, so running sums find the level of the others.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = sums.withColumn("sid", place).withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * float(most))
    by = [F.col("most") / F.col("weight"), F.col("sid")]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*by).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    stops = F.col("most") <= F.col("weight") * F.col("level")
    rows = rows.withColumn("level", F.min_by("level", F.when(~stops, F.struct(*by))).over(all_rows))
    target = F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.lit(0.0))
    return rows.select("source", "sid", "source_size", target.alias("target"), "total")


def _permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, n at least 1."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *seed), n) - x, n)
        swap = F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *seed)
        return F.when(swap > 0, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, step)


def source_slots(sources: DataFrame, block: int, most: int = MOST_PASSES) -> DataFrame:
    """``sources`` with their blocks (``full`` ones and the words of the ``tail``), and ``n_slots`` from ``first`` on, the last one of ``last`` words."""
    words = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    rows = sources.filter("source_size > 0").withColumn("words", words).withColumn("full", F.expr(f"source_size div {block}"))
    rows = rows.withColumn("tail", F.col("source_size") - F.col("full") * block).withColumn("n_blocks", F.col("full") + (F.col("tail") > 0).cast("long"))
    rows = rows.withColumn("rest", F.col("words") % F.col("source_size")).withColumn("more", F.expr(f"(rest + {block - 1}) div {block}"))
    rows = rows.withColumn("n_slots", F.expr("words div source_size") * F.col("n_blocks") + F.col("more")).filter("n_slots > 0")
    rows = rows.withColumn("last", F.when(F.col("more") > 0, F.col("rest") - (F.col("more") - 1) * block))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("sid", "full", "tail", "n_blocks", "n_slots", "last", F.coalesce(F.sum("n_slots").over(before), F.lit(0)).cast("long").alias("first"))


def slot_plan(sources: DataFrame, block: int, slots: int, seed: int, most: int = MOST_PASSES) -> DataFrame:
    """(shard, slot, sid, pass, block, words): which words of which block each slot of each output shard takes."""
    spark = sources.sparkSession
    plan = checkpointed(source_slots(sources, block, most))
    total, n_sources = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if n_sources <= MOST_BROADCAST else lambda df: df
    parts = shuffle_partitions(spark)
    width = max(1, total // max(4 * n_sources, 64 * parts))  # a draw meets its source in a cell of this width
    cells = plan.withColumn("cell", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + n_slots - 1) div {width}"))))
    drawn = spark.range(0, total, 1, max(1, min(total, 2 * parts))).select(F.expr(f"id div {slots}").alias("shard"), (F.col("id") % slots).alias("slot"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("draw"))
    drawn = drawn.withColumn("cell", F.expr(f"draw div {width}")).join(small(cells), "cell")
    drawn = drawn.filter((F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("n_slots")))
    counts = checkpointed(drawn.groupBy("sid", "shard").agg(F.count("*").alias("drawn")).withColumn("run", F.expr("shard div 1024")))
    firsts = prefix_sum(counts, ["sid"], "run", [F.col("shard")], F.col("drawn"), "nth").select("sid", "shard", "nth")
    nth = F.col("nth") + F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    numbered = drawn.join(firsts, ["sid", "shard"]).select("shard", "slot", "sid", "full", "tail", "n_blocks", "n_slots", "last", nth.alias("k"))
    met = plan.join(counts.groupBy("sid").agg(F.sum("drawn").alias("met")), "sid", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("met") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("met"), F.lit(0))
    met = checkpointed(met.withColumn("over", F.coalesce(F.sum(over).over(before), F.lit(0))).withColumn("under", F.coalesce(F.sum(under).over(before), F.lit(0))))
    gaps = met.filter("met < n_slots").withColumn("k", F.explode(F.sequence("met", F.col("n_slots") - 1))).withColumn("j", F.col("under") + F.col("k") - F.col("met"))
    surplus = numbered.filter("k >= n_slots").join(small(met.select("sid", "over")), "sid").select("shard", "slot", (F.col("over") + F.col("k") - F.col("n_slots")).alias("j"))
    moved = surplus.join(gaps, "j").select("shard", "slot", "sid", "full", "tail", "n_blocks", "n_slots", "last", "k")
    dealt = numbered.filter("k < n_slots").unionByName(moved).withColumn("pass", F.expr("k div n_blocks")).withColumn("i", F.col("k") % F.col("n_blocks"))
    at = _permuted(F.col("i"), F.greatest("full", F.lit(1).cast("long")), F.lit(seed), F.col("sid"), F.col("pass"))
    size = F.when((F.col("k") + 1 == F.col("n_slots")) & F.col("last").isNotNull(), F.col("last")).when(F.col("i") < F.col("full"), block).otherwise(F.col("tail"))
    return dealt.select("shard", "slot", "sid", "pass", F.when(F.col("i") < F.col("full"), at).otherwise(F.col("full")).alias("block"), size.cast("long").alias("words"))


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their source and place in its stream, the sources)."""
    sized = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size")
    sources = checkpointed(source_targets(sized))
    chunks = chunk_count(docs.sparkSession, sized.count())
    rows = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop("source")
    rows = rows.withColumn("chunk", chunk_of(chunks, F.col("doc_id")))
    rows = prefix_sum(rows, ["sid"], "chunk", [F.col("doc_id"), F.col("size"), F.col("_row")], F.col("size"), "start").drop("chunk")
    return rows, sources


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: words [lo, hi) of the document, the first one at ``at`` in the block."""
    reach = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    cut = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, reach)))
    cut = cut.withColumn("lo", F.greatest(F.col("block") * block - F.col("start"), F.lit(0))).withColumn("hi", F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")))
    return cut.withColumn("at", F.col("start") + F.col("lo") - F.col("block") * block)


def _spans(docs: DataFrame, block: int, slots: int, seed: int) -> DataFrame:
    """For each row and block of it: its words [lo, hi), how many slots take how many words of the block, and the words taken in all.

    A source's last slot may take a part of its block; all others take theirs whole.
    """
    rows, sources = _placed(docs)
    plan = slot_plan(sources, block, slots, seed)
    uses = plan.groupBy("sid", "block", "words").agg(F.count("*").alias("n")).groupBy("sid", "block").agg(F.collect_list(F.struct("words", "n")).alias("takes"))
    cut = _in_blocks(rows, block).join(uses.hint("merge"), ["sid", "block"], "left")
    many = F.aggregate(F.transform("takes", lambda t: t.n * F.greatest(F.least(t.words - F.col("at"), F.col("hi") - F.col("lo")), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.withColumn("taken", F.coalesce(many, F.lit(0))).select("_row", "doc_id", "size", "source_size", "target", "lo", "hi", "at", "takes", "taken")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("_row"))


def mix(docs: DataFrame, block: int = 128, slots: int = 4096, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    sized = checkpointed(_sized(docs).select("_row", "doc_id", "source", "size"))
    cut = _spans(sized, block, slots, seed)
    taken = cut.groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").cast("long").alias("taken"))
    return taken.drop("_row")


def _cut_words(words: Column, lo: Column, hi: Column) -> Column:
    return F.slice(words, (lo + 1).cast("int"), (hi - lo).cast("int"))


#: A word with the white space before it.
_SPACED = r"(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def mixed_blocks(docs: DataFrame, block: int = 128, slots: int = 4096, seed: int = 7) -> DataFrame:
    """The output shards: (shard, slot, sid, pass, block, words, text) with the block's words, as they stand in the documents."""
    rows = materialize(_sized(docs), "mix")
    placed, sources = _placed(rows)
    spans = _in_blocks(placed, block).filter("size > 0").join(rows.select("_row", F.col("row.text").cast("string").alias("text")), "_row")
    words = _cut_words(F.regexp_extract_all("text", F.lit(_SPACED), F.lit(0)), F.col("lo"), F.col("hi"))
    blocks = spans.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", words.alias("words")))).alias("parts"))  # `block` words at most
    plan = slot_plan(sources, block, slots, seed).join(blocks, ["sid", "block"])
    joined = F.flatten(F.transform("parts", lambda p: F.transform(p.words, lambda w, i: F.when((i == 0) & (p.at > 0), F.concat(F.lit(" "), F.ltrim(w))).otherwise(w))))
    text = F.array_join(F.slice(joined, F.lit(1), F.col("words").cast("int")), "")
    return plan.select("shard", "slot", "sid", "pass", "block", "words", text.alias("text"))


def mixed_documents(docs: DataFrame, block: int = 128, slots: int = 4096, seed: int = 7) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each pass over a document, with the words that pass takes.

    A pass that takes all words keeps the text as it is; ``n_chars`` follows the text.
    """
    rows = materialize(_sized(docs), "mix")
    cut = _spans(rows.drop("row"), block, slots, seed).filter("taken > 0")
    # a block's uses, those that take most of it first, are passes one after the other
    ordered = F.reverse(F.array_sort("takes"))
    each = F.flatten(F.transform(ordered, lambda t: F.array_repeat(t.words, t.n.cast("int"))))
    cut = cut.select("_row", "lo", "hi", "at", F.posexplode(each).alias("pass", "words")).withColumn("hi", F.least("hi", F.col("lo") + F.col("words") - F.col("at"))).filter("hi > lo")
    parts = cut.groupBy("_row", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"))
    found = rows.select("_row", "row", "size").join(parts, "_row").withColumn("text", F.col("row.text").cast("string"))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.hi - p.lo) == F.col("size")
    found = found.withColumn("words", F.when(~whole, F.regexp_extract_all("text", F.lit(_SPACED), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: _cut_words(F.col("words"), p.lo, p.hi))), "")
    text = F.when(whole, F.col("text")).otherwise(F.trim(some))
    kinds = dict(docs.dtypes)
    changed = {"text": text} | ({"n_chars": F.length(text).cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return found.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])
