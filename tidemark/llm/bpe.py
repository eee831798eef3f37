"""BPE encoding and decoding through an index of pair occurrences (operator 11)."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from .common import small_batches, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Characters of text that are split, indexed and encoded together; a piece of a longer text ends at white space.
BLOCK = 2_000_000
PIECE = 1_000_000
#: Words kept between blocks: how many, and up to which length. Longer words are encoded where they stand.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64

# White space as \s of the tokenizer's pattern has it, and the pre-tokenizer that split_fast stands for.
WHITE = "\t-\r \x85\xa0  -     　"
LOWER_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def _splitter() -> re.Pattern:
    """The words of a normalised text without characters above U+FFFF: as LOWER_WORDS splits it, but twice as fast."""

    def ranges(kind: str) -> str:
        found = np.array([c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind])
        cut = np.flatnonzero(np.diff(found) > 1)
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(found[np.r_[0, cut + 1]], found[np.r_[cut, -1]], strict=True))

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")


class PairIndex:
    """Symbols of many words on one line of places, and for every rank the places where its pair stands.

    A word is a run of places that prv and nxt link; a merge takes the pair's right place out of the links. Ranks that
    stand somewhere wait in a heap and are applied in ascending order, each to all its places at once; only the pairs next
    to a merged place change, and their places join the lists of their ranks. Places whose pair went meanwhile are told by
    their symbols when their rank's turn comes. Where pairs of one rank overlap (a a a), the leftmost wins, then every
    second one of the run. That equals merging pair by pair because no merge makes a pair of a lower rank (checked when
    the vocabulary is read)."""

    def __init__(self, bpe: Bpe, words: list[str]):
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        self.bpe, self.ends = bpe, np.cumsum([len(w) for w in raw])
        n = int(self.ends[-1])
        line = np.frombuffer(b"".join(raw), np.uint8)
        last = self.ends - 1
        self.sym = bpe.inner[line]
        self.sym[last] = bpe.final[line[last]]
        self.nxt, self.prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.nxt[last] = -1
        self.prv[np.r_[0, self.ends[:-1]]] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.flatnonzero(self.nxt >= 0).astype(np.int32))

    def add(self, at: np.ndarray) -> None:
        """Puts the pairs that begin at these places into the index."""
        rank = self.bpe.ranks(self.sym[at], self.sym[self.nxt[at]])
        known = rank >= 0
        rank, at = rank[known], at[known]
        if not rank.size:
            return
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), rank.size]
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = int(rank[a])
            if r not in self.places:
                self.places[r] = []
                heapq.heappush(self.active, r)
            self.places[r].append(at[a:b])

    def merged(self) -> np.ndarray:
        """Applies all ranks; the places that are left, in order."""
        sym, nxt, prv, bpe = self.sym, self.nxt, self.prv, self.bpe
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.places.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right, new = bpe.left[r], bpe.right[r], bpe.made[r]
            at = at[(sym[at] == left) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == right]
            if left == right and at.size > 1:
                begins = np.r_[True, nxt[at[:-1]] != at[1:]]
                place = np.arange(at.size)
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            if not at.size:
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -1
            nxt[at] = after
            follows = after >= 0
            prv[after[follows]] = at[follows]
            before = prv[at]
            before = before[before >= 0]
            self.add(np.concatenate([before[sym[before] != new], at[follows]]))
        return np.flatnonzero(sym >= 0)

    def encoded(self) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        left = self.merged()
        flat = self.bpe.ids[self.sym[left]].astype("<u4").tobytes()
        cuts = np.searchsorted(left, self.ends).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class Bpe:
    """A byte-level BPE vocabulary from a tokenizers file; encodes as the library does without special tokens added, and
    decodes as its decode does with special tokens kept.

    Strings of special tokens in a text become their ids. Between them text is normalised and split into words by the
    file's own rules: for lower-case word vocabularies in Python, where Python's tables agree with the library's, else by
    the library's normaliser and pre-tokenizer. Words are encoded by PairIndex alone."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, whole = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a plain BPE vocabulary: {path}")
        vocab, suffix = dict(model["vocab"]), model.get("end_of_word_suffix") or ""
        names = list(vocab)
        number = {name: i for i, name in enumerate(names)}
        self.ids = np.array([vocab[x] for x in names], np.int64)
        signs = byte_signs()
        self.signs = {s: b for b, s in enumerate(signs)}
        self.inner = np.array([number[s] for s in signs], np.int32)
        self.final = np.array([number[s + suffix] for s in signs], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left, self.right, self.made = ([number[x] for x in side] for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        first_use = np.full(len(names), len(pairs))
        ranks = np.arange(len(pairs))
        np.minimum.at(first_use, self.left, ranks)
        np.minimum.at(first_use, self.right, ranks)
        if (first_use[self.made] < ranks).any():
            raise ValueError("a merge makes a pair of a lower rank; ranks can't be applied in ascending order")
        key = np.array(self.left, np.int64) * len(names) + np.array(self.right, np.int64)
        order = np.argsort(key)
        self.n, self.keys, self.key_rank = len(names), key[order], order.astype(np.int32)
        self.tokens: dict[int, str] = {vocab[x]: x for x in names} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with rules of their own are not supported")
        # the longest string first, as the library prefers it among those that begin at one place
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normal, self.pre, self.decoder = whole.normalizer, whole.pre_tokenizer, whole.decoder
        if self.decoder is not None and not isinstance(self.decoder, decoders.ByteLevel):
            raise ValueError("only byte-level decoders and none are supported")
        self.fast = (spec["normalizer"], spec["pre_tokenizer"]) == LOWER_WORDS
        if self.fast:
            self.compose = self.normal[0]
            self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.known: dict[str, bytes] = {}
        self.seen: set[str] = set()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    def assigned(self, text: str) -> bool:
        """Whether this Python's tables know all characters of the text; the library's may know more, so it gets the others."""
        new = set(text) - self.seen
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.seen |= new
        return True

    def words(self, text: str) -> list[str]:
        """A text without special tokens as words, normalised; their bytes are what the vocabulary's signs stand for."""
        if self.fast and (text.isascii() or self.assigned(text)):
            # what is composed by newer tables is so by older ones, so only other texts need the library's
            if not unicodedata.is_normalized("NFC", text):
                text = self.compose.normalize_str(text)
            text = text.replace("Σ", "σ").lower()  # Σ: letter by letter, wherever it stands
            return (_splitter() if text.isascii() or max(text) < "\U00010000" else self.word).findall(text)
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        back = self.signs
        return [bytes(back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in self.pre.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[str]:
        """Pieces of about a million characters that end before white space, so no word is cut; special tokens stand alone."""
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                yield part
                continue
            at = 0
            while len(part) - at > PIECE and self.fast:
                cut = regex.compile(f"[{WHITE}]").search(part, at + PIECE)
                if not cut:
                    break
                yield part[at : cut.start()]
                at = cut.start()
            yield part[at:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers; null texts count as empty."""
        made: list[list[bytes]] = [[] for _ in texts]
        block: list[tuple[int, bytes | list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self.parts(text or ""):
                if part in self.special:
                    block.append((i, self.special[part].to_bytes(4, "little")))
                elif part:
                    block.append((i, self.words(part)))
                    size += len(part)
                if size > BLOCK:
                    self.fill(block, made)
                    block, size = [], 0
        self.fill(block, made)
        return [b"".join(x) for x in made]

    def fill(self, block: list[tuple[int, bytes | list[str]]], made: list[list[bytes]]) -> None:
        """Encodes the words of a block that are not known yet through one index, then puts the block's parts together."""
        new: set[str] = set()
        for _, part in block:
            if not isinstance(part, bytes):
                new.update(part)
        words = [w for w in new if w not in self.known]
        if words:
            self.known.update(zip(words, PairIndex(self, words).encoded(), strict=True))
        for i, part in block:
            made[i].append(part if isinstance(part, bytes) else b"".join(map(self.known.__getitem__, part)))
        for w in words:
            if len(w) > KEPT_LENGTH:
                del self.known[w]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined as the library's decode joins them, special ones kept; unknown ids are left out."""
        found = [t for t in map(self.tokens.get, ids) if t is not None]
        return " ".join(found) if self.decoder is None else self.decoder.decode(found)


@lru_cache(2)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def _in_blocks(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, path: str = VOCABULARY, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, an array of int; null and empty texts have none.

    Rows are encoded alone, so repeated rows agree; other columns stay, one named out is replaced. A task holds a block of
    texts of about 2 million characters, or one text, at a time. The file at path is read on the executors."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _bpe(path)
        for held in _in_blocks(batches):
            done = iter(bpe.encode([t for b in held for t in b.to_pylist()]))
            for b in held:
                ids = [next(done) for _ in range(len(b))]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return docs.withColumn(out, encode(F.col(text)))


def decoded(df: DataFrame, path: str = VOCABULARY, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null arrays and null or unknown ids in them count as none. Other columns stay,
    one named out is replaced."""
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def decode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _bpe(path)
        for a in arrays:
            yield pa.array([bpe.decode(x or []) for x in _lists(a)], pa.string())

    return df.withColumn(out, decode(F.col(ids)))


def _lists(arrays: pa.Array) -> Iterator[list]:
    for x in arrays:
        yield x.values.to_pylist() if x.is_valid else []


def digested(df: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """df with the SHA-256 of each array of ids (none null) as little-endian unsigned 32-bit integers, in lowercase hex; of
    nothing for a null array."""

    @F.arrow_udf("string")
    def digest(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            yield pa.array([hashlib.sha256(x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else b"").hexdigest() for x in a], pa.string())

    return df.withColumn(out, digest(F.col(ids)))


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    """A row per document: its number of tokens and the digests of its ids and of the text that they decode to."""
    ids = encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return digested(decoded(ids)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
