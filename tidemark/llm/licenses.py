"""License scans by diagonal voting over word k-grams (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Fixed values. Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_CC = {"nc": ("nc", "noncommercial", "non commercial"), "sa": ("sa", "sharealike", "share alike"), "nd": ("nd", "noderivatives", "no derivatives")}
_GNU = {"gpl": ("gpl", "general public license"), "lgpl": ("lgpl", "lesser general public license"), "agpl": ("agpl", "affero general public license")}


#: Names as license identifiers write them, with their labels.
_SPDX = {"mit": "mit", "isc": "isc", "unlicense": "unlicense", "apache 2 0": "apache-2.0", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "mpl 2 0": "mpl-2.0", "epl 2 0": "epl-2.0", "cc0 1 0": "cc0", "bsl 1 0": "boost"}
#: What stands before or after a bare name and number that could be anything else: scores of games, say.
_NAMED = ("license {}", "licence {}", "license is {}", "licensed under {}", "licensed under the {}", "under the {}", "{} license", "{} licence", "license identifier {}")


def _short() -> dict[str, tuple[str, ...]]:
    """Names of licenses with the words that tell their versions and kinds apart; all their words must stand in a row."""
    out: dict[str, tuple[str, ...]] = {
        "mit": ("mit license", "mit licence", "license mit", "licence mit", "licensed under mit", "under the mit"),
        "isc": ("isc license", "isc licence", "license isc", "under the isc"),
        "cc0": ("cc0 1 0", "creative commons zero"),
        "bsd-2": ("bsd 2 clause", "simplified bsd license"),
        "bsd-3": ("bsd 3 clause", "new bsd license"),
        "boost": ("boost software license",),
        "artistic": ("artistic license 1 0", "artistic license version 1 0"),
        "artistic-2.0": ("artistic license 2 0", "artistic license version 2 0", "artistic license 2"),
    }

    def add(label: str, *phrases: str) -> None:
        out[label] = tuple(dict.fromkeys((*out.get(label, ()), *phrases)))

    for name, label, versions in (("apache", "apache", ("1 1", "2 0")), ("mozilla public", "mpl", ("1 1", "2 0")), ("eclipse public", "epl", ("1 0", "2 0"))):
        for v in versions:
            own = f"{label}-{v.replace(' ', '.')}"
            add(own, f"{name} license version {v}", f"{name} license v {v}", f"{name} license v{v}", f"{name} license {v}", *(c.format(f"{label} {v}") for c in _NAMED))
    add("apache-2.0", "apache license version 2", *(c.format("apache 2") for c in _NAMED))
    for label, (short, name) in _GNU.items():
        for v in ("2", "2 1", "3"):
            own = f"{label}-{v.replace(' ', '.')}"
            add(own, f"{name} version {v}", f"{name} v{v}", f"{name} v {v}", f"{short} {v}", f"{short} v{v}", f"{short} v {v}", f"{short} version {v}")
            add(own, f"{name} as published by the free software foundation either version {v}", f"{name} as published by the free software foundation version {v}")
            if " " not in v:
                add(own, f"{short} {v} 0")
    for kinds in (("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        own = "cc-by-" + "-".join(kinds)
        for order in dict.fromkeys((kinds, kinds[::-1])):
            forms = [" ".join(_CC[k][i] for k in order) for i in range(3)]
            add(own, f"cc by {forms[0]}", *(f"creative commons attribution {f}" for f in forms[1:]))
            add(own, *(f"attribution {f} {v}" for f in forms[1:] for v in ("2 0", "2 5", "3 0", "4 0")))
    for name, label in _SPDX.items():
        add(label, f"license identifier {name}")
        for other in _SPDX:
            if other != name:  # the first of the two has its label from the identifier before it
                add(label, f"{other} or {name}", f"{other} and {name}")
    return out


SHORT = _short()
#: Longer notices, and words that must stand in a row in what is found of them; other edits and insertions are allowed.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public"),
    "lgpl": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general"),
    "agpl": ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived"),
}
#: Letters of other scripts and ASCII letters and digits; everything else parts words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram, or all of a shorter phrase: common pairs such as "of the" cast no vote.
K = 4
#: A notice is found where its grams vote on diagonals at most DRIFT apart and, in order, cover so much of its words.
SHARE, DRIFT = 0.7, 4
#: Grams of templates that are broadcast, about 200 bytes each; a larger table is left to a shuffled join.
BROADCAST = 50_000
#: Copies of one row that are written out together.
COPIES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams(base: dict = BASE, short: dict = SHORT, notices: dict = NOTICES) -> list[tuple]:
    """(template, label, kind, at, n, k, drift, must, w0, w1, w2, w3) of each gram of each template: n words, grams of k; must
    marks grams that hold the words which tell the template from others."""
    every = [(label, phrase, "base", None) for phrase, label in base.items()]
    every += [(label, p, "short", None) for label, phrases in short.items() for p in phrases]
    every += [(label, phrase, "notice", must) for label, (phrase, must) in notices.items()]
    rows = []
    for i, (label, phrase, kind, must) in enumerate(every):
        w = phrase.split()
        k = min(K, len(w))
        for j in range(len(w) - k + 1):
            own = w[j : j + k]
            telling = must is None or f" {must} " in f" {' '.join(own)} "
            rows.append((i, label, kind, j, len(w), k, 0 if must is None else DRIFT, telling, *own, *[None] * (K - k)))
    return rows


def templates(spark, **parts) -> DataFrame:
    """grams() as a table with a hash h of the first two words; as many rows as the templates have words, a few hundred. The
    row at -1 meets the mark that every document emits. Up to BROADCAST rows it is broadcast; Spark can't tell its size."""
    names = "template int, label string, kind string, at int, n int, k int, drift int, must boolean, w0 string, w1 string, w2 string, w3 string"
    rows = [(-1, "", "mark", -1, 0, 0, 0, False, None, None, None, None), *grams(**parts)]
    out = spark.createDataFrame(rows, names).withColumn("h", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("w0", "w1")))
    return F.broadcast(out) if len(rows) <= BROADCAST else out


def votes(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, key, i, template, label, kind, n, k, drift, must, at, diagonal) for each k-gram of a document that stands in a
    template, all its words verified, and a row with template -1 for each document.

    All rolling k-grams of the corpus are joined to the templates' by hash. With templates that are broadcast nothing is
    shuffled before the join, and only matches are after it."""
    w = F.col("w")
    every = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(i.alias("i"), F.xxhash64(F.get(w, i), F.get(w, i + 1)).alias("h"), *[F.get(w, i + j).alias(f"g{j}") for j in range(K)]))
    none = [F.lit(None).cast("string").alias(f"g{j}") for j in range(K)]
    mark = F.array(F.struct(F.size(w).alias("i"), F.lit(0).cast("long").alias("h"), *none))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    each = docs.select("doc_id", key.alias("key"), words(F.col("text")).alias("w"))
    each = each.select("doc_id", "key", F.explode(F.when(F.size(w) >= 2, F.concat(mark, every)).otherwise(mark)).alias("g")).select("doc_id", "key", "g.*")
    same = (F.col("g0") == F.col("w0")) & (F.col("g1") == F.col("w1"))
    for j in range(2, K):
        same &= F.col(f"w{j}").isNull() | (F.col(f"g{j}") == F.col(f"w{j}"))
    met = each.join(parts, "h").where((F.col("at") < 0) & F.col("g0").isNull() | same)
    return met.select("doc_id", "key", "i", "template", "label", "kind", "n", "k", "drift", "must", "at", (F.col("i") - F.col("at")).alias("diagonal"))


def chain(met: Column, k: Column) -> Column:
    """Of an array of (at, i, must): words of the template that its grams cover if only those count that stand in the document
    after all grams of smaller at, and whether one of these is a telling one. Of a gram's places the first counts."""
    def state(seen, at, i, covered, must) -> Column:
        return F.struct(seen.alias("seen"), at.alias("at"), i.alias("i"), covered.alias("covered"), must.alias("must"))

    def step(s: Column, x: Column) -> Column:
        on = (x["at"] > s["seen"]) & (x["i"] > s["i"])
        taken = state(x["at"], x["at"], x["i"], s["covered"] + F.least(k, x["at"] - s["at"]), s["must"] | x["must"])
        return F.when(on, taken).otherwise(state(x["at"], s["at"], s["i"], s["covered"], s["must"]))

    start = state(F.lit(-1), F.lit(-K), F.lit(-1), F.lit(0), F.lit(False))
    return F.aggregate(F.array_sort(met), start, step, lambda s: F.struct(s["covered"], s["must"]))


def scan(docs: DataFrame, **parts) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Votes are gathered by diagonal (a k-gram's place less its place in the template). A phrase stands where all its k-grams
    vote on one diagonal: consecutive words, verified. Of short names that lie within another one found, "general public
    license version 2" in its "lesser" version say, only the longer gives its label. For a notice, every diagonal voted on
    is tried together with those up to DRIFT after it, so that words put in or left out don't split a passage, but
    no more than DRIFT of them in all; the passage is verified by aligning its grams with the notice in order: they must
    cover SHARE of its words and the words that tell it from others. score is the largest share of a template found, 1 for
    a phrase, 0 without any. Null text counts as empty; repeated rows give repeated results; a document's hits are
    gathered by (doc_id, text), never all hits of a template; columns but doc_id and text are left out."""
    v = votes(docs, templates(docs.sparkSession, **parts))
    by = ["doc_id", "key", "template", "label", "kind", "n", "k"]
    v = v.withColumn("start", F.explode(F.sequence(F.col("diagonal") - F.col("drift"), F.col("diagonal"))))
    own = F.max(F.col("diagonal") == F.col("start"))
    spans = v.groupBy(*by, "start").agg(F.collect_set(F.struct("at", "i", "must")).alias("met"), F.count(F.lit(1)).alias("copies"), F.max("i").alias("i"), own.alias("own")).where("own")
    spans = spans.withColumn("chain", F.when(F.col("kind") != "mark", chain(F.col("met"), F.col("k"))))
    share = F.col("chain.covered") / F.col("n")
    enough = F.when(F.col("kind") == "notice", (share >= SHARE) & F.col("chain.must")).otherwise(share == 1)
    found = spans.withColumn("share", share).where((F.col("kind") == "mark") | enough)
    within = Window.partitionBy("doc_id", "key", "kind").orderBy("start", F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    found = found.withColumn("inner", (F.col("kind") == "short") & (F.coalesce(F.max(end).over(within), F.lit(0)) >= end))
    is_mark, based = F.col("kind") == "mark", F.col("kind") == "base"
    out = found.where(~F.col("inner")).groupBy("doc_id", "key").agg(
        F.max(F.when(is_mark, F.col("copies"))).alias("copies"),
        F.max(F.when(is_mark, F.col("i"))).cast("long").alias("n_words"),
        F.count_if(based).alias("n_base"),
        F.min(F.when(based, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(based, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(based, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(~is_mark, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(~is_mark, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    # copies in two steps, so that no array is longer than COPIES
    first = out.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + COPIES, F.col("copies")) - 1))
    return first.withColumn("_copy", each).drop("key", "copies", "_at", "_copy")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
