"""Mixing sources to target weights by weighted fair queueing (operator 4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are counted up together: a source has as many buckets as it needs, however hot it is.
ROWS_PER_BUCKET = 5_000
#: A source's target is served in packets of this fraction of it, so that a long document doesn't take its source far past it.
PACKETS = 256
#: Copies of one row that are written out together.
COPIES = 10_000


def n_words(text: Column) -> Column:
    """Words of a text; null and empty have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, place) of each row; place is the md5 of seed, id and text, by which documents are shuffled, so
    that neither rows without an id nor different texts of one id fall together. Null texts have size 0, null ids and sources
    stay null; repeated rows repeat; all other columns are left out."""
    parts = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))]
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat_ws(":", *parts).cast("binary")).alias("place"))


def in_order(rows: DataFrame, order: list, size: str, out: str) -> DataFrame:
    """rows with `out`: the sum of size over all rows before each in a global order. The rows are range-sorted over the
    cluster and summed up in each range; what is before a range is a sum over one row a range."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(F.broadcast(offsets), "part")  # a row a shuffle partition
    return summed.withColumn(out, F.col("_before") + F.coalesce(F.sum(size).over(run), F.lit(0))).drop("part", "_before")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """(source, source_size, n, rank, target), one row a source, of sizes(source, size, copies); and the mix's total budget.

    Sources take the weights in code-point order, null last, repeating. They share `share` times the sum of all sizes;
    a target stops at `most` times its source's size and the excess goes to the others by weight until none is above. Each
    round of that is one sum over the sources' rows, and the level only rises."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = in_order(per.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one", "rank").drop("one")
    w = F.lit(float(weights[0]))
    for i, x in enumerate(weights):
        w = F.when(F.col("rank") % len(weights) == i, float(x)).otherwise(w)
    per = written(per.withColumns({"w": w, "cap": most * F.col("source_size")}))
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap")).first()
    level, full = 0.0, None
    while True:
        over = F.col("cap") < level * F.col("w")
        got = per.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if got["full"] == full or not got["w"]:
            break
        full, level = got["full"], (share * total["words"] - got["held"]) / got["w"]
    target = F.least(F.col("cap"), level * F.col("w")) if got["w"] else F.col("cap")
    return per.select("source", "source_size", "n", "rank", target.alias("target")), int(min(share * total["words"], total["cap"]))


def placed(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """groups(doc_id, source, size, place, copies) with their source's row of targets and `begin`: the source's words before
    them in its shuffled order. Sums go in two steps, within buckets of a source and over bucket sums, so that a source with
    a third of all rows is spread out. Ties fall by doc_id and size."""
    t = targets.withColumnRenamed("source", "_s")
    base = groups.join(t, groups["source"].eqNullSafe(t["_s"])).drop("_s")
    buckets = F.ceil(F.col("n") / ROWS_PER_BUCKET).cast("long")
    base = base.withColumn("bucket", (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")).withColumn("words", F.col("size") * F.col("copies"))
    sums = base.groupBy("rank", "bucket").agg(F.sum("words").alias("_sum"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = Window.partitionBy("rank", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_run", F.coalesce(F.sum("words").over(run), F.lit(0))).join(offsets, ["rank", "bucket"])
    return base.withColumn("begin", F.col("_run") + F.col("_before")).drop("_run", "_before", "bucket", "n")


def packets(documents: DataFrame, most: float = 2.0) -> DataFrame:
    """The packets of placed documents: a row for each slice of a document and pass, with its words and virtual_finish: the
    source's words up to the slice's end, over the source's target.

    One pass follows the other, as many as a target of `most` times its source's size needs. Sources with their full targets reach time 1 together, so what begins a packet after
    that can't be within the budget and isn't made."""
    packet = F.ceil(F.col("target") / PACKETS).cast("long")
    d = documents.where("words > 0 AND target > 0").withColumn("packet", packet).withColumn("pass", F.explode(F.array(*map(F.lit, range(math.ceil(most))))))
    d = d.withColumn("begin", F.col("begin") + F.col("pass") * F.col("source_size"))
    open_ = F.ceil("target").cast("long") + F.col("packet") - F.col("begin")
    d = d.withColumn("open", F.least(open_, F.col("words"))).where("open > 0")
    d = d.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(open - 1) div packet"))))
    first = F.col("slice") * F.col("packet")
    d = d.withColumn("n_words", F.least(F.col("packet"), F.col("words") - first))
    return d.withColumn("virtual_finish", (F.col("begin") + first + F.col("n_words")) / F.col("target")).drop("open", "packet", "begin")


def mix(documents: DataFrame, budget: int, most: float = 2.0) -> DataFrame:
    """The packets of the mix, in one stream by virtual finish time: range-sorted over the cluster, mix_start counting the
    words before each, and cut off at the budget (`taken` words of each; the packet at the cut in part)."""
    ordered = in_order(packets(documents, most), ["virtual_finish", "rank", "place", "doc_id", "pass", "slice"], "n_words", "mix_start")
    return ordered.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n_words"), F.lit(budget) - F.col("mix_start")))).where("taken > 0")


def taken(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs(doc_id, source, size, place), as sized() makes them, one row each with source_size, target, taken (words the mix
    takes, repeats counted) and first_start (where the mix first has it, null if never).

    Each source gets its target but for a packet of it at most (one word where targets are small), because the cut falls
    within a packet of virtual time 1. Rows that agree in all four columns are one document of their summed size, whose
    words are shared out among them, the first ones a word more where it doesn't divide; so reruns agree. A null source is a
    source; documents of size 0 are never taken; an empty table gives no rows. Columns but doc_id, source and size of docs are
    left out; a text's length doesn't matter, as it is cut in packets."""
    own = ["doc_id", "source", "size", "place"]
    groups = written(docs.groupBy(*own).agg(F.count(F.lit(1)).alias("copies")))
    targets, budget = source_targets(groups, weights, share, most)
    documents = written(placed(groups, targets))
    whole = [*own, "copies", "source_size", "target"]
    none = documents.select(*whole, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("mix_start"))
    got = none.union(mix(documents, budget, most).select(*whole, "taken", "mix_start")).groupBy(*whole).agg(F.sum("taken").alias("words"), F.min("mix_start").alias("first_start"))
    # copies in two steps, so that no array is longer than COPIES
    first = got.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = first.withColumn("_copy", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + COPIES, F.col("copies")) - 1)))
    more = F.when(F.col("_copy") < F.col("words") % F.col("copies"), 1).otherwise(0)
    return each.withColumn("taken", (F.floor(F.col("words") / F.col("copies")) + more).cast("long")).drop("_at", "_copy", "copies", "words", "place")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    out = taken(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "first_start")
