"""Token counts of a unigram vocabulary by count-only Viterbi (operator 6)."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Below the lowest score by this much: what a character costs that no piece covers.
UNKNOWN = 10.0
#: Units kept between texts: how many, and up to which length; longer ones are counted where they stand.
CACHE, KEPT_LENGTH = 800_000, 64


class Unigram(dict):
    """Counts the pieces of texts: best sum of piece scores, as a unigram tokenizer finds it.

    The vocabulary file's pieces and scores are taken as a unigram model. Aho-Corasick enumerates the pieces that end at
    every place; a forward pass keeps, for each place, the best score and the number of pieces on the best path, no back
    pointers. Ties go as in the tokenizer: of pieces that end together the earliest start comes first, and only a better
    score replaces one. Scores are sums of doubles. Characters without a piece join the unknown run next to them;
    a run counts its UTF-8 bytes if the vocabulary has byte pieces, else 1.

    No piece has a space sign after another character, so the best path parts there, and texts are counted unit by unit,
    short ones kept in this dict up to a bound."""

    def __init__(self, path: str = VOCABULARY):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): float(model.get_score(i)) for i in plain}
        self.bytes = any(model.is_byte(i) for i in range(n))
        self.unknown = min(self.scores.values()) - UNKNOWN
        self.parts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        self.auto = ahocorasick.Automaton()
        for p, s in self.scores.items():
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        # a line feed in no piece is a place where the best path parts, too (byte pieces don't care about runs)
        lines = self.bytes and not any("\n" in p for p in self.scores)
        self.unit = re.compile("(?s).+" if not self.parts else f"\n|{SPACE}*[^{SPACE}\n]*" if lines else f"{SPACE}*[^{SPACE}]*")

    def __missing__(self, unit: str) -> int:
        n = self.viterbi(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) > CACHE:
                self.clear()
            self[unit] = n
        return n

    def viterbi(self, text: str) -> int:
        # of each place: the best score, pieces on its path without the open unknown run, where that run began
        n = len(text)
        score, pieces, open_ = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)

        def close(at: int, top: float | None, begin: int, single: bool) -> None:
            if not single and (top is None or score[at - 1] + self.unknown > top):
                score[at], pieces[at] = score[at - 1] + self.unknown, pieces[at - 1]
                open_[at] = open_[at - 1] if open_[at - 1] >= 0 else at - 1
            else:
                score[at] = top
                pieces[at] = pieces[begin] + 1 + (self.run(text, open_[begin], begin) if open_[begin] >= 0 else 0)

        # matches come by their end, those with one end from the earliest start: the order in which ties go
        at, top, begin, single = 0, None, 0, False
        for end, (size, s) in self.auto.iter(text):
            end += 1
            if end != at:
                if at:
                    close(at, top, begin, single)
                for gap in range(at + 1, end):
                    close(gap, None, 0, False)
                at, top, single = end, None, False
            x = score[end - size] + s
            if top is None or x > top:
                top, begin = x, end - size
            if size == 1:
                single = True
        if at:
            close(at, top, begin, single)
        for gap in range(at + 1, n + 1):
            close(gap, None, 0, False)
        return pieces[n] + (self.run(text, open_[n], n) if open_[n] >= 0 else 0)

    def run(self, text: str, start: int, end: int) -> int:
        return len(text[start:end].encode("utf-8", "surrogatepass")) if self.bytes else 1

    def count(self, text: str | None) -> int:
        """Pieces of a whole text with the dummy space before it; none for a null or empty text."""
        if not text:
            return 0
        return sum(map(self.__getitem__, filter(None, self.unit.findall(SPACE + text.replace(" ", SPACE)))))


@lru_cache(1)
def _tokenizer(path: str) -> Unigram:
    return Unigram(path)


def counted(docs: DataFrame, path: str = VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of the whole text. Null and empty texts have 0; rows are counted alone, so repeated
    rows agree; other columns stay. The vocabulary is read on the executors from the path, which every machine has."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        t = _tokenizer(path)
        return pa.array(map(t.count, texts.to_pylist()), pa.int64())

    return docs.withColumn(out, count(F.col(text)))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs).select("doc_id", "n_tokens", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
