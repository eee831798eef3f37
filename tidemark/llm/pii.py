"""Personal data by patterns, checksums and nearby words, in SQL functions only (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: Patterns in Java's syntax. Each finds what its plain form finds, leftmost and without overlap:
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
#: Possessive loops, and starts only at the head of a run (or where the last match ended), keep them linear on any text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:token|secret|password)\x20?=\x20?\"[A-Za-z0-9_-]{16,128}+\")",
}
#: In this order kinds that start together are listed; the first four are the base.
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: What a text must hold for a pattern to match at all: cheap, exact, and most texts stop here.
NEEDS = {"email": "@", "phone": "+", "key": None, "ip": None, "card": None, "iban": None}
#: Words near a span that speak for it, and words that speak against it.
CONTEXT = {
    "email": ("mail|contact|write|courriel|correo|kontakt", "example|test"),
    "ip": ("ip|server|host|address|adresse|client|login", "version|release|section"),
    "card": ("card|visa|credit|carte|karte|tarjeta|payment", "order|serial|isbn|tracking"),
    "phone": ("phone|call|tel|mobile|fax|telefon|appel", "version|score"),
    "iban": ("iban|bank|account|konto|compte|cuenta|transfer", "order|serial"),
    "key": ("token|secret|password|key|access", "example"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.95, "key": 0.9}
NEAR = 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes mod 97: the first four characters go last, letters count from A = 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email" or kind == "key":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?<=0))"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    iban = F.regexp_replace(found, " ", "")
    return F.when(F.length(iban).between(15, 34), mod97(iban)).otherwise(False)


def running(values: Column, add, zero: int = 0) -> Column:
    """What `add` makes of all values before each of an int array, from zero. The array is gone through in parts of about
    the root of its length, so that no step copies all that came before it."""
    part = F.ceil(F.sqrt(F.size(values))).cast("int")
    starts = F.sequence(F.lit(1), F.size(values), F.greatest(part, F.lit(1)))
    parts = F.transform(starts, lambda i: F.slice(values, i, part))

    def scan(own: Column, first: Column) -> Column:
        def step(state: Column, v: Column) -> Column:
            return F.struct(add(state["at"], v).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

        return F.aggregate(own, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda state: state["out"])

    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), add))
    whole = F.flatten(F.transform(F.arrays_zip(parts.alias("p"), scan(totals, F.lit(zero)).alias("s")), lambda x: scan(x["p"], x["s"])))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


#: Characters of a block: a piece of a text is cut out of its blocks, not from the text's beginning.
BLOCK = 1024


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(cut: Column, start: Column, n: Column) -> Column:
    """n code points from place `start` of a text in blocks."""
    first = (start / BLOCK).cast("int")
    held = F.slice(cut, first + 1, ((start % BLOCK + F.greatest(n, F.lit(0))) / BLOCK).cast("int") + 1)
    return F.substring(F.array_join(held, ""), start % BLOCK + 1, n)


def _ranked(kind: str):
    """A span of a match zipped with its place, or null if it fails the kind's check."""
    rank = KINDS.index(kind)
    return lambda x: F.when(
        valid(kind, x["m"]), F.struct(x["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["m"])).alias("end"))
    )


def _is(kind: str):
    return lambda x: x["kind"] == kind


def may_hold(text: Column, kind: str) -> Column:
    if NEEDS[kind]:
        return text.contains(NEEDS[kind])
    return text.rlike(PATTERNS[kind]) if kind in ("key", "iban", "ip") else text.rlike("[0-9]")


def spans(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """docs with out: array<struct<start,rank,kind,end>> of all kinds, by start, then kind as listed, in code points.

    A text split at a pattern gives what lies between the matches; running lengths of both give the matches' places."""
    found, gaps = {k: fresh(docs, f"_m_{k}") for k in KINDS}, {k: fresh(docs, f"_g_{k}") for k in KINDS}
    none = F.array().cast("array<string>")
    both = {found[k]: F.when(may_hold(text, k), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS}
    both |= {gaps[k]: F.when(may_hold(text, k), F.transform(F.split(text, PATTERNS[k], -1), F.length)).otherwise(F.array().cast("array<int>")) for k in KINDS}
    # columns of their own, step by step: within a lambda an expression would be worked out anew each time
    steps, places = {k: fresh(docs, f"_s_{k}") for k in KINDS}, {k: fresh(docs, f"_p_{k}") for k in KINDS}
    docs = docs.withColumns(both)
    docs = docs.withColumns({steps[k]: F.zip_with(F.slice(gaps[k], F.lit(1), F.size(found[k])), F.transform(found[k], F.length), _plus) for k in KINDS})
    docs = docs.withColumns({places[k]: running(F.col(steps[k]), _plus) for k in KINDS})
    each = []
    for k in KINDS:
        at = F.zip_with(places[k], F.slice(gaps[k], F.lit(1), F.size(found[k])), _plus)
        each.append(F.filter(F.transform(F.arrays_zip(F.col(found[k]).alias("m"), at.alias("at")), _ranked(k)), F.isnotnull))
    return docs.withColumn(out, F.array_sort(F.concat(*each))).drop(*both, *steps.values(), *places.values())


def score(cut: Column, span: Column) -> Column:
    """The kind's prior, up by 0.1 if a word that speaks for it stands within NEAR characters, down by 0.3 for one against."""
    first = F.greatest(span["start"] - NEAR, F.lit(0))
    near = F.lower(F.concat(piece(cut, first, span["start"] - first), F.lit(" "), piece(cut, span["end"], F.lit(NEAR))))
    out = F.lit(0.0)
    for kind in KINDS:
        good, bad = CONTEXT[kind]
        here = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{good})"), 0.1).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{bad})\b"), 0.3).otherwise(0.0)
        out = F.when(span["kind"] == kind, F.least(F.lit(1.0), here)).otherwise(out)
    return out


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with pii_spans: array<struct<start,rank,kind,end,score>>. A null text counts as empty and has no span; rows
    are handled alone, so repeated rows agree; other columns stay, one of the output's name is replaced. Time grows with the
    text's length and with the power 1.5 of its matches."""
    t, cut, found = (fresh(docs, x) for x in ("_t", "_cut", "_found"))
    d = spans(docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))), F.col(t), found)
    d = d.withColumn(cut, F.when(F.size(found) > 0, blocks(F.col(t))))
    scored = F.transform(found, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], score(F.col(cut), s).alias("score")))
    return d.withColumn(out, scored).drop(t, cut, found)


def redact(docs: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs with the text's spans of at least the given score replaced by [KIND]; of spans that overlap, the first stands
    for all and what they cover goes. Null texts stay null, and all other columns as they are."""
    kept, ends, upto, cut = (fresh(docs, x) for x in ("_kept", "_ends", "_upto", "_cut"))
    d = find(docs, text, kept).withColumn(kept, F.filter(kept, lambda s: s["score"] >= least))
    d = d.withColumn(ends, F.transform(kept, lambda s: s["end"]))
    # of each span the furthest end before it: one that starts there or later begins a new run of spans
    d = d.withColumn(upto, running(F.col(ends), _larger)).withColumn(cut, F.when(F.size(kept) > 0, blocks(F.col(text))))
    heads = F.filter(F.arrays_zip(F.col(kept).alias("s"), F.col(upto).alias("upto")), lambda x: x["s"]["start"] >= x["upto"])
    parts = F.transform(heads, lambda x: F.concat(piece(F.col(cut), x["upto"], x["s"]["start"] - x["upto"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
    end = F.array_max(ends)
    clean = F.concat(F.array_join(parts, ""), piece(F.col(cut), end, F.length(text) - end))
    return d.withColumn(text, F.when(F.size(kept) > 0, clean).otherwise(F.col(text))).drop(kept, ends, upto, cut)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("pii_spans")
    counts = [F.size(F.filter(s, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = joined(F.filter(s, lambda x: x["rank"] < len(BASE)))
    top = F.coalesce(F.array_max(F.transform(s, lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"), top.alias("max_score"))
