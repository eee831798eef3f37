"""What filters do to each other, for every order they can be applied in (operator 13)."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table

WORD_GAP = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
COUNTS = ("rows", "good", "toxic")
REPORT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts that rows without an id are dealt over, so that they don't meet in one task of the join with labels.
SPREAD = 1024


def flags(text: str = "text") -> dict[str, Column]:
    """For each filter that looks at one text, whether the text fails it. A null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    # blanks at the ends give empty parts, as an empty text does
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * upper > 5 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows(part, pattern, rows, good, toxic): how many documents fail exactly the filters whose bit is set (A is 1, E 16).

    E fails a text that a smaller doc_id has anywhere in the table; a null id is larger than any and no smaller than
    another null. A null part counts as empty. Repeated rows count each; a document is good or toxic if any row of labels
    for its id says so. Texts are told apart by 128 bits and don't leave the scan; other columns don't count.

    Copies are added up before any shuffle by text, by (part, labels, text) with the number of rows at the smallest id, so
    a group of copies, however large, is a few rows a part when its members meet."""
    fails = flags()
    t = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), start=F.lit(0))
    narrow = docs.select(
        F.coalesce(F.col(part), F.lit("")).alias("part"), "doc_id", F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), bits.alias("bits"),
    )
    same = ["k1", "k2", "part", "bits"]
    ids = narrow.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    ).withColumn("place", F.lit(0))
    ids = ids.withColumn("place", F.when(F.col("doc_id").isNull(), F.pmod("k1", F.lit(SPREAD))).otherwise(0).cast("int"))
    ids = ids.join(known, ["doc_id", "place"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    # structs compare by their fields in turn; the flag puts null ids last
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    per_text = ids.groupBy(*same, "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(who.alias("who"), "n")).alias("least"))
    first = F.min("least.who").over(Window.partitionBy("k1", "k2"))
    alone = F.when(F.col("least.who") == F.col("first"), F.col("least.n")).otherwise(0)
    counted = per_text.withColumn("first", first).select("part", "bits", "good", "toxic", F.explode(F.array(F.struct(alone.alias("m"), F.lit(0).alias("e")), F.struct((F.col("n") - alone).alias("m"), F.lit(16).alias("e")))).alias("x"))
    number = lambda c: F.sum(F.when(F.col(c), F.col("x.m")).otherwise(0)).alias(c)
    return counted.where("x.m > 0").groupBy("part", (F.col("bits") + F.col("x.e")).alias("pattern")).agg(F.sum("x.m").alias("rows"), number("good"), number("toxic"))


def interactions(tensor: np.ndarray) -> pd.DataFrame:
    """The report of one part from its counts, an array of len(COUNTS) x 2 x 2 x 2 x 2 x 2 whose axis of a filter is 0 where
    documents pass it and 1 where they fail.

    A step contracts each axis with one of three vectors: pass (1, 0) for filters already applied, fail (0, 1) or pass for
    its own, all (1, 1) for later ones."""
    passes, failing, all_ = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    axes = "abcde"[: len(FILTERS)]

    def take(chosen: dict[str, np.ndarray], rest: np.ndarray) -> np.ndarray:
        return np.einsum(f"z{axes},{','.join(axes)}->z", tensor, *(chosen.get(f, rest) for f in FILTERS))

    rows = []
    for order in permutations(FILTERS):
        done: dict[str, np.ndarray] = {}
        for step, own in enumerate(order, 1):
            removed, fails = take(done | {own: failing}, all_), take({own: failing}, all_)
            kept, only = take(done | {own: passes}, all_), take({own: failing}, passes)
            rows.append(("".join(order), step, own, kept[0], removed[0], fails[0] - removed[0], only[0], removed[1], removed[2]))
            done[own] = passes
    out = pd.DataFrame(rows, columns=["filter_order", "step", "own", *REPORT[:-1]])
    out["shapley"] = out.groupby("own")["removed"].transform("sum")
    return out.drop(columns="own")


def audited(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row per part, order of the five filters (all 120) and step, with the counts of REPORT, zeros included. Parts without
    documents don't exist, so an empty table gives no rows. shapley is the sum over all orders, not divided by 120."""
    small_batches(docs.sparkSession)
    counts = failures(docs, labels, part)

    def report(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """At most 32 rows come in, 600 go out."""
        flat = np.zeros((len(COUNTS), 32), np.int64)
        # bit 0 is A, the first axis, so bits run from the last axis to the first
        at = [int(f"{p:05b}"[::-1], 2) for p in rows["pattern"]]
        flat[:, at] = rows[list(COUNTS)].to_numpy(np.int64).T
        return interactions(flat.reshape(len(COUNTS), 2, 2, 2, 2, 2)).assign(part=key[0])[["part", "filter_order", "step", *REPORT]]

    return counts.groupBy("part").applyInPandas(report, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in REPORT))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
