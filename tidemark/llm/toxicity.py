"""Toxicity by Levenshtein automata over a lexicon trie and context windows (operator 1)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, table, written

#: Labelled rows that lexicon and weights are learned from, about; terms of the lexicon at most.
ROWS, TERMS = 20_000, 4_000
#: Letters from which on two edits, not one, make a misspelling. From nine on, 201 of sf0.1's labelled rows had a misspelled
#: term, three quarters of them clean; from twelve on, the same 74 as with one edit.
LONG = 12
#: Terms that are known before any label is seen.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "imbecile", "bastard", "retard", "vermin", "degenerate")
#: Words before or after a term that report speech, and words that address someone.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word term phrase according dit dire écrit appelé mot sagte sagt schrieb nannte wort zitat dijo dice escribió llamó palabra".split())
ADDRESSING = frozenset("you your you're u du dich dir dein deine ihr tu te toi ton ta vous votre tú usted ustedes vosotros".split())
QUOTES = "\"“”„«»‘’"
WINDOW = 5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FEATURES = 4
#: What the search for contexts' factors tries, and by how much of log likelihood others must beat the usual ones. Words near a
#: term by chance are too many in clean texts, and misspelled terms too few in toxic ones, for labels to set that factor.
QUOTED, DIRECTED, BETTER = (0.1, 0.25, 0.4, 0.7, 1.0), (1.0, 1.5, 2.5, 4.0), 3.0
#: Words kept between texts: how many, and up to which length.
CACHE, KEPT_LENGTH = 300_000, 64


@dataclass(frozen=True)
class Contexts:
    """What a term's weight is multiplied by if it is misspelled, quoted, and directed at someone."""

    misspelled: float = 0.8
    quoted: float = 0.4
    directed: float = 1.0


class Levenshtein:
    """The automaton of all strings within k edits of a word, a swap of neighbours being one edit: a state is a set of (place
    in the word, edits so far, whether the second half of a swap is still to come)."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> frozenset:
        return self._spread({(0, 0, False)})

    def step(self, state: frozenset, c: str) -> frozenset:
        out, n = set(), len(self.word)
        for i, e, swap in state:
            if swap:
                if self.word[i] == c:
                    out.add((i + 2, e, False))
                continue
            if i < n and self.word[i] == c:
                out.add((i + 1, e, False))
            if e < self.k:
                out.add((i, e + 1, False))
                if i < n:
                    out.add((i + 1, e + 1, False))
                if i + 1 < n and self.word[i + 1] == c:
                    out.add((i, e + 1, True))
        return self._spread(out)

    def _spread(self, state: set) -> frozenset:
        todo = list(state)
        while todo:
            i, e, swap = todo.pop()
            if not swap and e < self.k and i < len(self.word) and (x := (i + 1, e + 1, False)) not in state:
                state.add(x)
                todo.append(x)
        return frozenset(state)

    def edits(self, state: frozenset) -> int | None:
        return min((e for i, e, swap in state if i == len(self.word) and not swap), default=None)


class Lexicon:
    """A trie of terms with weights, and of stems, whose node accepts every word that goes on from it. Exact words walk the
    trie; others are met with their automaton. `ordinary` words are near a term by chance, so they are never taken for a
    misspelling."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float] | None = None, ordinary: frozenset = frozenset(), contexts: Contexts = Contexts()):
        self.terms, self.stems, self.ordinary, self.contexts, self.root = terms, stems or {}, ordinary, contexts, {}
        for kind, entries in (("", terms), ("*", self.stems)):
            for t in entries:
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[kind] = t
        # a term within one edit of a word agrees with it in the whole of its first or of its second half, or in all but
        # its two middle letters, which are swapped
        self.heads: dict[int, set] = {}
        self.tails: dict[int, set] = {}
        self.swaps: set = set()
        # with two edits a long term keeps one of four pieces whole, at most two letters off its place, or, if both are swaps
        # over pieces' ends, all its letters
        self.letters = {"".join(sorted(t)) for t in terms if len(t) >= LONG}
        self.pieces: set[tuple[int, str]] = set()
        self.piece_sizes: set[tuple[int, int]] = set()
        for t in terms:
            n = len(t) // 2
            if len(t) >= LONG:
                cuts = [len(t) * j // 4 for j in range(5)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    self.pieces.update((a + off, t[a:b]) for off in range(-2, 3) if a + off >= 0)
                    self.piece_sizes.update((a + off, b - a) for off in range(-2, 3) if a + off >= 0)
            if len(t) >= 5:
                self.heads.setdefault(n, set()).add(t[:n])
                self.tails.setdefault(len(t) - n, set()).add(t[n:])
                self.swaps.add((t[: n - 1], t[n + 1 :]))

    def weight(self, term: str) -> float:
        return self.terms.get(term) or self.stems[term]

    def near(self, word: str) -> tuple[str, int] | None:
        """The term itself, else the longest stem that the word begins with (0 edits), else the nearest term within an edit,
        or within two of a term of LONG letters, and the edits, ties to the first in order; terms under 5 letters, and words
        of under 5, match exactly only."""
        node, stem = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            stem = node.get("*", stem)
        if node is not None and "" in node:
            return word, 0
        if stem is not None:
            return stem, 0
        k = self.edits_worth(word)
        if not k or word in self.ordinary:
            return None
        auto = Levenshtein(word, k)
        todo, best = [(self.root, auto.start())], None
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "*":
                    continue
                if c:
                    if after := auto.step(state, c):
                        todo.append((child, after))
                elif len(child) >= 5 and (e := auto.edits(state)) is not None and (e < 2 or len(child) >= LONG):
                    best = min(best or (e, child), (e, child))
        return (best[1], best[0]) if best else None

    def edits_worth(self, word: str) -> int:
        """How many edits the automaton has to allow for, by pieces that a term so near must share with the word; 0 if no
        term can be near."""
        if len(word) < 5:
            return 0
        if len(word) >= LONG - 2 and (any((at, word[at : at + n]) in self.pieces for at, n in self.piece_sizes) or "".join(sorted(word)) in self.letters):
            return 2
        if any(word[:n] in s for n, s in self.heads.items()) or any(word[-n:] in s for n, s in self.tails.items()):
            return 1
        n = len(word) // 2
        return int((word[: n - 1], word[n + 1 :]) in self.swaps)


class Matcher(dict):
    """What Lexicon.near says of each word, kept up to a bound."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        found = self.lexicon.near(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) > CACHE:
                self.clear()
            self[word] = found
        return found


#: Numbers of a text that parts() gives: four for each context (quoted or not, directed or not), and its words.
PARTS = 17


def parts(text: str | None, match: Matcher) -> list[float]:
    """Of a whole text: for each context (bit 0 quoted, bit 1 directed) the summed weight of the terms in it, of the
    misspelled ones, and the largest of either; then the number of words. All zero without terms, as for a null or empty text.

    A term is quoted if it stands between quotation marks of its line or within WINDOW words of a reporting word, and
    directed if a word that addresses someone is that near and it isn't quoted."""
    low = (text or "").lower()
    words = WORD.findall(low)
    out = [0.0] * PARTS
    hits = [i for i, w in enumerate(words) if match[w]]
    if not hits:
        return out
    places = [m.start() for m in WORD.finditer(low)]
    quotable = any(q in low for q in QUOTES)
    for i in hits:
        term, edits = match[words[i]]
        w = match.lexicon.weight(term)
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        inside = False
        if quotable:
            line = low[low.rfind("\n", 0, places[i]) + 1 : places[i]]
            inside = sum(map(line.count, QUOTES)) % 2 == 1
        quoted = inside or not REPORTING.isdisjoint(near)
        at = 4 * (quoted + 2 * (not ADDRESSING.isdisjoint(near))) + (edits > 0)
        out[at] += w
        out[at + 2] = max(out[at + 2], w)
    out[-1] = len(words)
    return out


def combined(x: np.ndarray, contexts: Contexts) -> np.ndarray:
    """The model's features of rows of parts(): the summed strength of terms, the strongest, what of it is directed at
    someone, and its density. A term's strength is its weight times its context's factors; one that is quoted is no stronger
    for being directed. The model gives no feature a negative weight (fit), so each term raises the score."""
    x = np.asarray(x, float).reshape(-1, PARTS)
    total = directed = strongest = np.zeros(len(x))
    for context in range(4):
        quoted, at = context % 2, 4 * context
        factor = contexts.quoted if quoted else contexts.directed if context >= 2 else 1.0
        own = factor * (x[:, at] + contexts.misspelled * x[:, at + 1])
        total = total + own
        directed = directed + own * (context >= 2)
        strongest = np.maximum(strongest, factor * np.maximum(x[:, at + 2], contexts.misspelled * x[:, at + 3]))
    return np.column_stack([np.log1p(total), strongest, np.log1p(directed), np.log1p(100 * total / np.maximum(x[:, -1], 1))])


def features(text: str | None, match: Matcher) -> list[float]:
    return combined(np.array(parts(text, match)), match.lexicon.contexts)[0].tolist()


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about `rows` labelled documents that aren't held out, chosen by hash of the id. Repeated
    labels of a document give one, the larger; different texts of one id each count, equal ones once; rows without id or
    label are left out, other columns too."""
    ours = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ours = ours.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, ours.count()))
    mark = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1e6
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (mark < share)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ours.where(mark < share), "doc_id").distinct()


def learn_lexicon(rows: DataFrame, terms: int = TERMS) -> Lexicon:
    """Terms that stand in toxic rows far more often than chance gives, and in clean ones hardly ever.

    Rows are counted: among all words tried, chance must give less than one such count (the bound is the binomial tail's,
    over the words' number). So are contexts, the words before a term, because copies of one passage make many rows
    toxic by the same words: a term's contexts must be a good part of its places. Half of the rows propose terms, the other
    half must bear them out where it has them. Stems are beginnings of four to six letters that several such words share,
    none with more than half of the contexts, judged alike. Weights grow with support. Clean rows also name the ordinary words within an edit of a term, which are no
    misspellings. All of it is counted in aggregates over rows; what comes to the driver is `terms` terms, as many stems,
    and words next to them at most."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD.pattern), F.lit(0))
    pairs = F.transform(F.col("w"), lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.get(F.col("w"), i - 1)).otherwise("").alias("before")))
    half = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(2)) == 0
    base = written(rows.select((F.col("toxic") == 1).alias("bad"), half.alias("half"), F.xxhash64("text").alias("row"), w.alias("w")))

    def exploded(bad: bool) -> DataFrame:
        own = base.where("bad" if bad else "NOT bad")
        return own.select("half", "row", F.explode(pairs).alias("p")).select("half", "row", "p.word", "p.before").where(F.length("word") >= 4)

    whole = F.struct(F.col("word").alias("part"), F.lit(False).alias("is_stem"))
    begins = F.transform(F.sequence(F.lit(4), F.lit(6)), lambda n: F.when(F.length("word") > n, F.struct(F.substring("word", F.lit(1), n).alias("part"), F.lit(True).alias("is_stem"))))
    parts = F.explode(F.concat(F.array(whole), F.filter(begins, F.isnotnull)))

    def rows_with(part: DataFrame, name: str) -> DataFrame:
        per_row = part.groupBy("part", "is_stem", "row", "half").agg(F.count(F.lit(1)).alias("n"))
        return per_row.groupBy("part", "is_stem").agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.count_if("half").alias(f"{name}_first"))

    bad = exploded(True).select("half", "row", "word", "before", parts.alias("s")).select("s.*", "half", "row", "word", "before")
    by_word = bad.groupBy("part", "is_stem", "word", "before").agg(F.count(F.lit(1)).alias("n")).groupBy("part", "is_stem", "word").agg(
        F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("places")
    )
    in_context = by_word.groupBy("part", "is_stem").agg(
        F.sum("contexts").alias("contexts"), F.sum("places").alias("places"), F.count(F.lit(1)).alias("words"), F.max("contexts").alias("largest")
    )
    found = written(rows_with(bad, "bad").join(in_context, ["part", "is_stem"]))
    tried, total = found.count(), base.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    if not total["bad"] or not tried:
        return Lexicon(dict.fromkeys(SEED_TERMS, 0.8))
    # clean rows are only asked for what could be a term
    asked = written(found.where("contexts >= 3 AND bad_rows >= 2 AND contexts >= 0.4 * places"))
    good = exploded(False).select("half", "row", parts.alias("s")).select("s.*", "half", "row").join(asked.select("part", "is_stem"), ["part", "is_stem"], "left_semi")
    stats = asked.join(rows_with(good, "good"), ["part", "is_stem"], "left").fillna(0, ["good_rows", "good_first"])
    share = (total["bad"] + 1) / (total["bad"] + total["good"] + 2)

    def surprise(bad: str, good: str) -> Column:
        """Minus the log of the chance (Chernoff's bound) that so many of a word's rows are toxic."""
        n = F.col(bad) + F.col(good)
        p = F.col(bad) / n
        kl = F.when(F.col(bad) > 0, p * F.log(p / share)).otherwise(0.0) + F.when(F.col(good) > 0, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
        return F.when(p > share, n * kl).otherwise(0.0)

    d = written(stats).withColumns({"bad_second": F.col("bad_rows") - F.col("bad_first"), "good_second": F.col("good_rows") - F.col("good_first")})
    telling = (surprise("bad_rows", "good_rows") > math.log(tried)) & (F.col("bad_rows") >= 8 * F.col("good_rows"))
    # either half proposes what the other one doesn't contradict
    borne_out = (F.col("bad_first") >= 2 * F.col("good_first")) & (F.col("bad_second") >= 2 * F.col("good_second"))
    terms_of = d.where(telling & borne_out)

    def contexts(found: DataFrame) -> dict[str, int]:
        return {r["part"]: r["contexts"] for r in found.orderBy(F.desc("contexts"), "part").limit(terms).collect()}

    def weights(found: dict[str, int]) -> dict[str, float]:
        return {x: min(1.0, 0.5 + n / 20) for x, n in found.items()}

    stems = contexts(terms_of.where((F.col("words") >= 3) & (F.col("largest") <= 0.5 * F.col("contexts")) & F.col("is_stem")))
    # a stem that is little more than a longer one goes: it would take in words that no row spoke of
    shorter = {x[:n] for x, c in stems.items() for n in (4, 5) if n < len(x) and x[:n] in stems and c >= 0.8 * stems[x[:n]]}
    lexicon = Lexicon({t: 0.8 for t in SEED_TERMS} | weights(contexts(terms_of.where("NOT is_stem"))), weights({x: n for x, n in stems.items() if x not in shorter}))
    return Lexicon(lexicon.terms, lexicon.stems, ordinary_words(exploded(False), lexicon, terms))


def ordinary_words(each: DataFrame, lexicon: Lexicon, most: int = TERMS) -> frozenset:
    """Words of clean rows (row, word) that are within an edit of a term, in two rows or more; the commonest if they are more
    than `most`."""
    terms, stems = lexicon.terms, lexicon.stems
    kept: dict = {}

    @F.arrow_udf("boolean")
    def close(words: pa.Array) -> pa.Array:
        if "l" not in kept:
            kept["l"] = Lexicon(terms, stems)
        return pa.array([bool((found := kept["l"].near(w)) and found[1]) for w in words.to_pylist()], pa.bool_())

    # each word is looked at once: a filter on the words alone would be moved to before they are made distinct
    seen = each.where(F.length("word") >= 5).groupBy("word").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count(F.lit(1)).alias("places")).where("a <> b")
    return frozenset(r["word"] for r in seen.where(close.asNondeterministic()("word")).orderBy(F.desc("places"), "word").limit(most).collect())


def scored(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """docs with `toxicity`: parts() of each text, or, given weights, the probability. A null text counts as empty; rows are
    scored alone, so repeated rows agree; other columns stay, one named toxicity is replaced."""
    small_batches(docs.sparkSession)
    kept: dict = {}
    terms, stems, ordinary, contexts = lexicon.terms, lexicon.stems, lexicon.ordinary, lexicon.contexts

    def rows(texts: pa.Array) -> list[list[float]]:
        if "m" not in kept:
            kept["m"] = Matcher(Lexicon(terms, stems, ordinary, contexts))
        return [parts(t, kept["m"]) for t in texts.to_pylist()]

    if weights is None:

        @F.arrow_udf("array<double>")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(rows(texts), pa.list_(pa.float64()))
    else:

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(probability(combined(np.array(rows(texts)), contexts), weights), pa.float64())

    return docs.withColumn("toxicity", score(F.col(text)))


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[1:] + weights[0], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, bias first, no feature's weight below 0: those that a fit makes negative are left
    out of the next one. What is left of the last fit is all positive."""
    keep = list(range(x.shape[1]))
    while True:
        a = np.hstack([np.ones((len(x), 1)), x[:, keep]])
        w = np.zeros(a.shape[1])
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(steps):
            p = probability(x[:, keep], w)
            move = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
            w += move
            if np.abs(move).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(k + 1 for k in keep)]] = w
            return out
        keep = [k for k, v in zip(keep, w[1:], strict=True) if v >= 0]


def fit_contexts(x: np.ndarray, y: np.ndarray) -> Contexts:
    """The factors, of all that are tried, under which a model of rows of parts() is likeliest. The usual ones stay unless
    others are BETTER: labels that say nothing of a context don't set its factor."""

    def likelihood(contexts: Contexts) -> float:
        z = combined(x, contexts)
        w = fit(z, y)
        p = np.clip(probability(z, w), 1e-12, 1 - 1e-12)
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

    usual = Contexts()
    tried = {c: likelihood(c) for c in (Contexts(quoted=q, directed=d) for q, d in product(QUOTED, DIRECTED))}
    best = max(tried, key=lambda c: (round(tried[c], 6), -abs(c.quoted - usual.quoted), -abs(c.directed - usual.directed)))
    return best if tried[best] > tried[usual] + BETTER else usual


#: Used where no labels can be learned from (none given, or all of one class): a term in the text makes it toxic.
DEFAULT_WEIGHTS = np.array([-3.0, 2.0, 3.0, 0.5, 0.5])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon, with contexts' factors, and weights from a bounded sample of labelled rows outside the held-out fold. Ids with many texts could make
    it larger, so at most twice `rows` of it are fitted on, by hash."""
    sample = written(labelled(docs, labels, rows))
    lexicon = learn_lexicon(sample)
    found = scored(sample, lexicon).select("toxic", "toxicity", F.xxhash64("doc_id", "text").alias("h"))
    got = found.orderBy("h", "toxic").limit(2 * rows).collect()
    y = np.array([float(r["toxic"] == 1) for r in got])
    if not got or y.min() == y.max():
        return lexicon, DEFAULT_WEIGHTS
    x = np.array([r["toxicity"] for r in got])
    contexts = fit_contexts(x, y)
    return Lexicon(lexicon.terms, lexicon.stems, lexicon.ordinary, contexts), fit(combined(x, contexts), y)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, weights = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, lexicon, weights)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
