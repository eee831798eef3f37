"""Quality rules with compression bands (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bytes up to which a band holds, and the ratios (compressed bytes / bytes) that a text, or a chunk, of that length may have.
#: Short texts hold few repeats and long ones many, so both limits fall with length; up to 100 bytes nothing is judged,
#: and up to 200 only what is too dense (of 140 to 200 bytes of prose 99.9 % stay under 0.86, of noise all are over 0.91).
#: The upper limits lie between the prose of sf0.1 and words of random letters and digits at the band's longest: 0.88, 0.81,
#: 0.76, 0.73, 0.72, 0.72. Hex, and random a-z under 2 000 bytes, compress as prose does, so no limit tells them apart.
BANDS = ((100, 0.0, 9.9), (140, 0.0, 0.99), (200, 0.0, 0.905), (300, 0.18, 0.86), (500, 0.18, 0.78), (1_000, 0.12, 0.72), (2_000, 0.12, 0.68), (8_000, 0.08, 0.60), (10**18, 0.05, 0.55))
#: Bytes of a chunk (the last one has what is left), and the share of a text's bytes that may lie in chunks outside their bands.
CHUNK, BAD_CHUNKS = 4096, 0.5
LEVEL = 3
SCHEMA = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("whole_ratio", pa.float64()), ("bad_chunks", pa.float64()), ("kept", pa.bool_()), ("base_failed", pa.bool_())])
SPARK_SCHEMA = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,whole_ratio:double,bad_chunks:double,kept:boolean,base_failed:boolean>"


def repeated_words(words: list, window: int = 8) -> int:
    """Words that stand in a window of so many words which the text has twice or more. Exact: windows are ranked by
    doubling (pairs of words, pairs of pairs, ...), so equal ranks mean equal words."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    span = 1
    while span < window:
        pair = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        span *= 2
        if len(count) == len(rank):
            return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[rank] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def within(ratio: float, size: int) -> bool:
    """Whether a ratio lies in the band for so many bytes."""
    low, high = next((a, b) for most, a, b in BANDS if size <= most)
    return low <= ratio <= high


def compression(raw: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its bytes in chunks outside the band for their length. Every chunk is
    judged, the last one whatever its length; an empty text has ratio 1 and no bad chunk."""
    if not raw:
        return 1.0, 0.0
    whole = len(zip_.compress(raw)) / len(raw)
    if len(raw) <= CHUNK:  # the text is its only chunk
        return whole, float(not within(whole, len(raw)))
    chunks = (raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))
    return whole, sum(len(c) for c in chunks if not within(len(zip_.compress(c)) / len(c), len(c))) / len(raw)


def judge(text: str | None, zip_: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines: set = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in lines
            lines.add(line)
    repeat = repeated_words(words)
    whole, bad = compression(raw, zip_)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS)) if words else 0
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeat, whole, bad, not failed and within(whole, len(raw)) and bad <= BAD_CHUNKS, failed


def _judged(texts: pa.Array) -> pa.Array:
    zip_ = zstandard.ZstdCompressor(level=LEVEL)
    rows = list(zip(*(judge(t, zip_) for t in texts.to_pylist()), strict=True))
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in SCHEMA], fields=list(SCHEMA))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `quality`: the counts, the compression ratios and `kept`. A null text counts as empty and fails;
    rows are judged alone, so repeated rows agree; a text's time and memory grow with its own length only. A column of
    docs named quality is replaced, all others stay."""
    small_batches(docs.sparkSession)
    return docs.withColumn("quality", F.arrow_udf(_judged, SPARK_SCHEMA)(F.col(text)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "bad_chunks"]
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])
