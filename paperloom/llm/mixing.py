"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that depends on the seed
and doc_id alone. A document's virtual finish time is its source's cumulative size up
to its end, over the source's target. The mix range-sorts all documents of all sources
by finish time and takes them in that order until the total budget is spent; the
document that crosses the budget is cut there. As the targets sum to the budget, that is
about virtual time 1, and every source ends within a document of its target. A source
whose target is above its size queues its documents a second time; no target is above
``MOST_PASSES`` times the source's size.

Cumulative sizes are two-level, in the queues and over the whole mix: sums by slice (of
the shuffle key, or of virtual time), a running sum over those sums, then a running sum
inside each slice. No source, however large, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, reused

WEIGHTS = (5, 2, 1)
MOST_PASSES = 2
#: The budget is three halves of all sizes; kept as a fraction so that targets round once.
BUDGET = (3, 2)
SEED = "mix-1"
SLICE_DIGITS = 3  # of the hexadecimal shuffle key: 4,096 slices of a source
SLICES = 4096  # of the virtual time that the mix takes


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): the capped shares of the budget.

    Sources by code point, null last, weigh WEIGHTS in turn. The level at which the
    uncapped sources share what the capped ones leave is found in one pass: by size over
    weight, a source is capped if the level that its larger fellows would share is not
    below its own cap. One row for each source takes part, never a row for each document.
    """
    up, down = BUDGET
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # capped before this source: their sizes; from this source on: the weights that share the rest
    ranked = ranked.withColumns(
        {
            "all_size": F.sum("source_size").over(whole),
            "before": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "sharing": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    free = up * F.col("all_size") - down * MOST_PASSES * F.col("before")
    ranked = ranked.withColumn("capped", F.col("weight") * free >= down * MOST_PASSES * F.col("source_size") * F.col("sharing"))
    ranked = ranked.withColumns(
        {
            "left": up * F.col("all_size") - down * MOST_PASSES * F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(whole),
            "shared": F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(whole),
        }
    )
    share = (F.col("weight") * F.col("left")).cast("double") / (down * F.col("shared")).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("capped"), (MOST_PASSES * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def queued(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, size, ...) with source_size, target and done: the words before this document in its source's queue.

    sizes is read several times: pass a stored table.
    """
    per_source = targets(sizes)
    keyed = sizes.withColumn("order", shuffle_key(F.col("doc_id"))).withColumn("slice", F.substring("order", 1, SLICE_DIGITS))
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    offset = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    slices = slices.select("source", "slice", offset.alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("order", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    placed = local.alias("d").join(slices.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice")))
    placed = placed.select("d.*", (F.col("offset") + F.col("within")).alias("done"))
    return placed.alias("d").join(per_source.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target").drop("within", "slice", "order")


def _turns(queue: DataFrame) -> DataFrame:
    """A row for each pass in which a row of the queue may be sent, with turn and finish, its virtual finish time."""
    each = F.array(*[F.struct(F.lit(k).alias("turn"), ((F.col("done") + k * F.col("source_size") + F.col("size")).cast("double") / F.col("target")).alias("finish")) for k in range(MOST_PASSES)])
    return queue.filter("size > 0 AND target > 0").select("*", F.explode(each).alias("each_turn")).select("*", "each_turn.*").drop("each_turn")


def schedule(queue: DataFrame) -> DataFrame:
    """Rows of queue, a stored or kept table, with turn, finish, before (words of the mix before it) and taken (its words within the budget).

    Rows are range-sorted by finish over all partitions; equal times go by source, nulls
    last, then by place in the queue. Rows that the budget doesn't reach are left out: it is
    spent by the time at which the last source sends the document that completes its target.
    """
    turns, (up, down) = _turns(queue), BUDGET
    completed = turns.filter("finish >= 1").groupBy("source").agg(F.min("finish").alias("finish"))
    last = completed.agg(F.max("finish")).first()[0] or 1.0
    budget = up * (queue.agg(F.sum("size")).first()[0] or 0) // down
    near = turns.filter(F.col("finish") <= last)
    near = near.withColumn("slice", F.floor(F.col("finish") / last * SLICES))
    sums = near.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    sums = sums.select("slice", (F.sum("slice_size").over(Window.orderBy("slice")) - F.col("slice_size")).alias("earlier"))
    inside = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "turn", "done").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.repartitionByRange("slice").withColumn("within", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(F.broadcast(sums), "slice").withColumn("before", F.col("earlier") + F.col("within"))
    taken = F.least(F.col("size"), F.lit(budget) - F.col("before")).cast("long")
    return placed.withColumn("taken", taken).filter("taken > 0").drop("slice", "earlier", "within")


def mix(sizes: DataFrame) -> DataFrame:
    """One row per row of sizes (doc_id, source, size): doc_id, size, source_size, target, taken.

    A null source is a source, last in order; a null doc_id is shuffled like any other
    id; equal rows take their turns one after the other; size 0 takes nothing. Source
    sizes of 0 give target 0. An empty table gives no rows.
    """
    queue = reused(queued(sizes))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    none = F.lit(0).cast("long").alias("taken")
    sent = schedule(queue).select("source", "done", *names)
    # a row's place in its queue tells it from all others that have words
    both = sent.union(queue.filter("size > 0").select("source", "done", *names[:-1], none))
    summed = both.groupBy("source", "done", *names[:-1]).agg(F.sum("taken").alias("taken"))
    return summed.select(*names).union(queue.filter("size = 0").select(*names[:-1], none))


def served(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs (doc_id, text, source, ...) once for each time they are sent, in no order.

    Whole documents are sent: the one that crosses the budget if half of it is within. The
    schedule sorts ids and sizes only, and texts move once, to meet it. Rows that are equal
    throughout go together. Rows without words are never sent: they take nothing of a
    budget of words.
    """
    row = free(docs, "row")
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    sizes = marked.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.col(row).alias("row"))
    queue = reused(queued(reused(sizes.groupBy("doc_id", "source", "row").agg(F.sum("size").alias("size")))))
    sent = schedule(queue).filter("2 * taken >= size").groupBy("doc_id", "row").agg(F.count("*").alias("times"))
    sent = sent.select(F.col("doc_id").alias("__id"), F.col("row").alias("__sent"), "times")
    rows = marked.alias("d").join(sent.alias("s"), (F.col(f"d.{row}") == F.col("s.__sent")) & F.col("d.doc_id").eqNullSafe(F.col("s.__id")))
    return rows.select("d.*", F.explode(F.array_repeat(F.lit(0), F.col("s.times").cast("int")))).select(*docs.columns)
