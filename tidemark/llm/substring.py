"""Substring deduplication over sliding sentence spans (operator 3)."""

from __future__ import annotations

import re
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import fresh, small_batches, table, with_row_key, written

#: A span is the shortest run of at least so many consecutive sentences with at least so many words.
SENTENCES, WORDS = 2, 25
#: A line, or a whole text, of several sentences that has fewer words than a span, but so many, is a span as a whole.
SHORT = 8
#: Sentences of more words are cut before each word whose hash is the least of some window of so many words of the sentence,
#: so that the same words are cut alike wherever they stand. Two places of one passage agree in their pieces but for LONGEST
#: or 2 * WINDOW - 2 words at each end: a passage of WORDS + 2 * LONGEST words (51) always holds a whole span.
LONGEST, WINDOW = 13, 7
# end marks: ASCII, 。 ． ！ ？ ｡ … ‼ ⁇-⁉ । ॥ ؟ ۔ ።
_END = rb"[.!?]|\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]|\xef\xbd\xa1|\xe2\x80[\xa6\xbc]|\xe2\x81[\x87-\x89]|\xe0\xa5[\xa4\xa5]|\xd8\x9f|\xdb\x94|\xe1\x8d\xa2"
_SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+|\n|\Z)\s*")
_SENTENCE_WIDE = re.compile(rb"(?s:(?!%b|\n).)*+(?:(?:%b)++|\n|\Z)\s*" % (_END, _END))
_WIDE_END = re.compile(_END.removeprefix(b"[.!?]|"))
#: Kana and Han stand without blanks: each character counts as a word. These bytes lead three-byte characters only.
_UNSPACED = re.compile(rb"[\xe3-\xe9]")
_WORD = re.compile(rb"\S+\s*")
_WORD_UNSPACED = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}|[^\s\xe3-\xe9]+)\s*")


def _words(raw: bytes) -> list[bytes]:
    return [w.strip() for w in _WORD_UNSPACED.findall(raw)] if _UNSPACED.search(raw) else raw.split()


def _cuts(words: list[bytes], window: int = WINDOW) -> list[int]:
    """Places in words where a piece begins: 0, and every word with the least hash (of equals the last) of some window."""
    n = len(words)
    keys = [(crc32(w) << 32) + n - i for i, w in enumerate(words)]
    return sorted({0, *(n - (m & 0xFFFFFFFF) for m in map(min, *(keys[i:] for i in range(window))))})


def sentences(raw: bytes, longest: int = LONGEST) -> list[bytes]:
    """The text in pieces that join to the whole text: sentences, those of more than `longest` words cut by their words.
    Marks are whole characters and white space is ASCII, so no character is split."""
    return [piece for piece, _ in _pieces(raw, longest)]


def _pieces(raw: bytes, longest: int = LONGEST) -> list[tuple[bytes, bool]]:
    """Each piece, and whether a sentence ends with it."""
    out = []
    for s in (_SENTENCE_WIDE if _WIDE_END.search(raw) else _SENTENCE).findall(raw):
        if not s:
            continue
        plain = _words(s.lower())
        if len(plain) <= longest:
            out.append((s, True))
            continue
        words = (_WORD_UNSPACED if _UNSPACED.search(s) else _WORD).findall(s)
        words[0] = s[: len(s) - sum(map(len, words))] + words[0]
        cuts = _cuts(plain)
        out += [(b"".join(words[i:j]), j == len(words)) for i, j in zip(cuts, [*cuts[1:], len(words)], strict=True)]
    return out


def spans(raw: bytes, n_sentences: int = SENTENCES, n_words: int = WORDS) -> list[tuple[int, int, int, bool]]:
    """(start, length, hash, is the text's first with that hash) of the span that begins at each sentence, places counted in
    sentences; the hash covers the words, A-Z lower-cased, so white space doesn't matter. Starts too near the text's end
    have none, and blank pieces begin none. Lines and texts of several sentences that are too short for a span, but have
    SHORT words, are spans of their own."""
    words: list[bytes] = []
    upto, runs = [0], []
    line, ends, all_ends = 0, 0, 0  # where the line began, and its and the text's sentences so far
    pieces = _pieces(raw)
    for i, (s, last) in enumerate(pieces):
        own = _words(s.lower())
        words += own
        upto.append(len(words))
        ends += last and bool(own)
        if b"\n" in s or i + 1 == len(pieces):
            if ends >= n_sentences and SHORT <= upto[-1] - upto[line] < n_words:
                runs.append((line, i + 1))
            line, ends, all_ends = i + 1, 0, all_ends + ends
    if all_ends >= n_sentences and SHORT <= len(words) < n_words and runs != [(0, len(pieces))]:
        runs.append((0, len(pieces)))
    text = b" ".join(words)
    begin = [0, *accumulate(len(w) + 1 for w in words)]
    end = 0
    for i in range(len(upto) - 1):
        end = max(end, i + n_sentences)
        while end < len(upto) and upto[end] - upto[i] < n_words:
            end += 1
        if end >= len(upto):
            break
        if upto[i + 1] > upto[i]:
            runs.append((i, end))
    out, seen = [], set()
    for i, j in runs:
        h = xxhash.xxh64_intdigest(text[begin[upto[i]] : begin[upto[j]] - 1]) - (1 << 63)
        out.append((i, j - i, h, h not in seen))
        seen.add(h)
    return out


def _spans(texts: pa.Array) -> pa.Array:
    each = [spans(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    flat = [x for e in each for x in e]
    columns = list(zip(*flat, strict=True)) or [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["start", "n", "h", "own_first"])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, each))], pa.int32()), rows)


_CUT = pa.struct([("text", pa.string()), ("n_removed", pa.int64())])


def _cut(texts: pa.Array, covered: pa.Array) -> pa.Array:
    out = []
    for t, runs in zip(texts.cast(pa.binary()).to_pylist(), covered.to_pylist(), strict=True):
        gone = {i for r in runs or () for i in range(r["start"], r["start"] + r["n"])}
        out.append({"text": b"".join(s for i, s in enumerate(sentences(t)) if i not in gone).decode("utf-8", "surrogatepass"), "n_removed": len(gone)} if gone else None)
    return pa.array(out, _CUT)


def told_apart(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key that tells rows of one doc_id but different texts apart: the row key where doc_id is null or has
    several texts, else 0, which takes next to no room in a shuffle of spans. Ids that aren't whole numbers say nothing of
    the order, so their rows all have the row key."""
    keyed = with_row_key(docs, key)
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return keyed
    shared, by = fresh(keyed, "_shared"), fresh(keyed, "_by")
    named = keyed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(shared)).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    several = written(named.where("a < b").select(shared))
    # rows without an id are no one's match, and are dealt by their key rather than all to one task
    both = keyed.withColumn(by, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col(key).cast("string"))))
    both = both.join(several, F.col("doc_id").isNotNull() & (F.col(by) == F.col(shared).cast("string")), "left")
    own = F.when(F.col("doc_id").isNull() | F.col(shared).isNotNull(), F.col(key)).otherwise(F.lit(0).cast("long"))
    return both.withColumn(key, own).drop(shared, by)


def repeats(docs: DataFrame) -> DataFrame:
    """(place, runs) of each document of docs(doc_id, key, text) that has spans which another place has first; place is (not
    doc_id, not key), bits turned, so that the largest is the first and a null doc_id comes last.

    All spans of all documents are written once. Their hashes are grouped, with map-side combine, to the first place
    (smallest doc_id, null last, then smallest key) that has each; those that stand twice or more are written too and joined
    back to the spans, both sides shuffled, so that adaptive execution splits a passage which a third of all documents share.
    No task gathers a passage's places. Spans are told apart by 64 bits: among 10^12 of them about 30 000 pairs agree by
    chance, so that one sentence in tens of millions goes without a twin; wider hashes don't fit the disk budget."""
    small_batches(docs.sparkSession)
    each = F.explode(F.arrow_udf(_spans, "array<struct<start:int,n:int,h:long,own_first:boolean>>")(F.col("text")))
    every = written(docs.select("doc_id", "key", each.alias("s")).select("doc_id", "key", "s.start", "s.n", "s.h", "s.own_first"))
    firsts = every.groupBy("h").agg(F.max(_place("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("places"))
    firsts = written(firsts.where("places > 1").select("h", "first"))
    again = every.join(firsts, "h").where((_place("doc_id", "key") < F.col("first")) | ~F.col("own_first"))
    return again.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs")).select(_place("doc_id", "key").alias("place"), "runs")


def _place(doc_id: str, key: str) -> Column:
    return F.struct(F.bitwise_not(F.col(doc_id).try_cast("long")).alias("doc_id"), F.bitwise_not(key).alias("key"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with the text less every sentence that a non-first repeated span covers, and n_removed.

    A span's first place, in the document with the smallest doc_id (null last), stays; spans that repeat inside a text
    count too. Rows are one document only if they agree in doc_id and text: those are cut alike. Of different texts that
    share a doc_id, or have none, the one with the smallest row key is the first. Null and empty texts have no sentence and
    come back as they are; other columns stay, but for one named n_removed, which is replaced. A document's runs are at most
    its sentences."""
    key, cut, gone = (fresh(docs, x) for x in ("_key", "_cut", "_gone"))
    keyed = told_apart(docs, key)
    found = repeats(keyed.select("doc_id", F.col(key).alias("key"), "text")).select(F.col("place").alias(cut), F.col("runs").alias(gone))
    out = keyed.join(found, _place("doc_id", key) == F.col(cut), "left")
    # only texts that lose something go to Python
    out = out.withColumn(cut, F.arrow_udf(_cut, "struct<text:string,n_removed:long>")(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone)))
    return out.withColumns({"text": F.coalesce(F.col(cut)["text"], "text"), "n_removed": F.coalesce(F.col(cut)["n_removed"], F.lit(0).cast("long"))}).drop(cut, gone, key)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")
