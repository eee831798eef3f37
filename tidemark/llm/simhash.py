"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, written
from .components import components

BITS = 64
SEED = 42


def fingerprint(text: str | None, n: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text as a signed long: A-Z lower-cased, words between ASCII blanks, every n-word
    shingle counted as often as it stands (fewer words: the whole sequence). A bit is set if more than half of the
    shingle hashes have it. A null text, and one without words, gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(n, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with the SimHash of the text column, in place of a column of the output's name."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(out, prints(F.col(text)))


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, each once) that connect all pairs within radius bits.

    Every fingerprint emits all variants within half the radius, itself included (65 of them for radius 2), and the
    variants are shuffled. Fingerprints that meet at a variant lie within the radius of each other, so one link from each
    to the smallest of them joins them all; a variant's ball holds 65 fingerprints at most, whatever the corpus. Two
    fingerprints within the radius always meet, midway. Links are deduplicated and their distance is verified. Fingerprints
    are dealt over all shuffle partitions first: a small table of them makes 65 times as many rows."""
    if radius != 2:
        raise ValueError("variants are made for a radius of 2")
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a hash of them: by themselves they may be partitioned already, and few in number, into few tasks
    emitted = prints.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("variant"))
    met = emitted.groupBy("variant").agg(F.collect_list("fp").alias("ball")).where(F.size("ball") > 1)
    links = met.select(F.array_min("ball").alias("b"), F.explode("ball").alias("a")).where("a <> b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of docs(doc_id, text), and `more` of its columns: components of the
    links between fingerprints that differ in 2 bits or fewer; root is a component's smallest fingerprint, component_id its
    smallest doc_id.

    Copies count once: links are made between distinct fingerprints. Repeated rows come out as often as they went in, a
    null doc_id never is a component's id unless all are null, empty and null texts share fingerprint 0, and an empty
    table gives an empty result."""
    own = ["doc_id", *(more or [])]
    prints = written(fingerprints(docs.select(*own, "text")).select(*own, "fp"))
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = ball_links(each.select("fp"))
    roots = components(links)
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # every root is a fingerprint of its own; both tables hold each key once
    labels = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select(*own, "fp", "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, all columns kept: the one with the smallest doc_id, null last, and of rows that
    share it the one with the smallest hash of all columns, so reruns agree. Different texts that share a doc_id stay, each
    for its own component; rows that agree in all columns stay once. Maps, which have no hash, don't count."""
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    a, b = fresh(docs, "_a"), fresh(docs, "_b")
    keyed = docs.withColumns({a: F.xxhash64(*hashed), b: F.xxhash64(F.lit(1), *hashed)})
    found = near_duplicates(keyed.select("doc_id", "text", F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"])
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "a", "b")
    firsts = found.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.a").alias(a), F.col("first.b").alias(b))
    # rows that agree are made one where they are read; that shuffle of the texts serves the join as well
    return keyed.dropDuplicates([a, b]).join(firsts, [a, b], "left_semi").select(docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
