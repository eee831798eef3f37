"""Nulls, repeats, clashing columns, short and long pieces; and the registered queries as they are called."""

import os
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, licenses, mixing, pii, quality, queries, simhash, substring, tokens, toxicity
from tidemark.llm.common import fresh, held_out

SF = "/root/testdata/sf0.001"
PASSAGE = "The first sentence of a long passage stands here. A second one follows it with some more words in it. Then a third one ends the passage, which has more than fifty words in all, as it goes on and on for quite a while until it stops."


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    cur = duck.execute(queries.ORACLE[name])
    columns = sorted(c[0] for c in cur.description)
    want = sorted(map(str, ([dict(zip([c[0] for c in cur.description], row, strict=True))[c] for c in columns] for row in cur.fetchall())))
    assert sorted(map(str, ([r[c] for c in columns] for r in queries.QUERIES[name](spark, SF).collect()))) == want


def test_queries_give_the_contracts_columns(spark, documents):
    contracts = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_licenses": "doc_id n_words n_base first_word last_word base_labels labels score", "op4_mixing": "doc_id size source_size target taken",
        "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9_language_id": "doc_id held_out lang_pred score", "op10_simhash": "doc_id fingerprint component_id",
    }
    for name, columns in contracts.items():
        out = queries.QUERIES[name](spark, SF)
        assert out.columns[: len(columns.split())] == columns.split(), name
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(documents), name


def test_quality_query_against_plain_rules(spark, documents):
    import zstandard

    def fits(raw):
        ratio = len(zstandard.compress(raw, quality.LEVEL)) / len(raw)
        return next(a <= ratio <= b for most, a, b in quality.BANDS if len(raw) <= most)

    for r in quality.op7_quality(spark, SF).collect():
        t = documents[r["doc_id"]] or ""
        raw, w = t.encode(), words(t)
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        bad = sum(len(c) for c in chunks if not fits(c)) / max(1, len(raw))
        assert r["bad_chunks"] == pytest.approx(bad) and r["kept"] == (not r["base_failed"] and fits(raw) and bad <= 0.5)


def test_every_chunk_is_judged_whatever_its_length():
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=quality.LEVEL)
    assert quality.compression(b"ab" * 700, zip_)[1] == 1.0
    rng = np.random.default_rng(1)
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and", "in"], 4000).tolist())[: 4096 + 3000].encode()
    tail = prose[:4096] + b"ab" * 1500
    whole, bad = quality.compression(tail, zip_)
    assert bad == pytest.approx(3000 / len(tail)) and quality.compression(b"", zip_) == (1.0, 0.0)


def test_no_long_passage_of_an_earlier_text_is_left(spark, documents):
    """Independent of the operator's spans: windows of 51 words by themselves."""
    size, first = 51, {}
    rows = {d: [w.lower() for w in words(t)] for d, t in documents.items()}
    for d in sorted(rows):
        for i in range(len(rows[d]) - size + 1):
            first.setdefault(tuple(rows[d][i : i + size]), d)
    repeated = {d for d in rows if any(first[tuple(rows[d][i : i + size])] != d for i in range(len(rows[d]) - size + 1))}
    assert repeated
    left, untouched = [], 0
    for r in substring.op3_substring_dedup(spark, SF).collect():
        d, out = r["doc_id"], [w.lower() for w in words(r["text"])]
        untouched += d not in repeated and r["n_removed"] == 0
        left += [d for i in range(len(out) - size + 1) if first.get(tuple(out[i : i + size]), d) < d]
    assert len(set(left)) <= 0.01 * len(documents), sorted(set(left))
    assert untouched >= 0.5 * (len(documents) - len(repeated))


def test_clashing_columns_stay(spark):
    names = ["runs", "_key", "_cut", "_gone", "pii_spans", "leaks", "_leaks", "_lang", "_pred", "_fp", "_a", "_b", "_T", "_found"]
    docs = spark.createDataFrame([(1, f"Own start. {PASSAGE} a@b.org", "en", *["x"] * len(names)), (2, f"Other start. {PASSAGE}", "en", *["y"] * len(names))], f"doc_id long, text string, lang string, {', '.join(f'{n} string' for n in names)}")
    items = spark.createDataFrame([(1, "nothing that stands in any of the texts above at all")], "item_id long, text string")
    net = langid.ByteCNN(["de", "en"])
    outputs = {
        "substring": substring.deduplicate(docs).drop("n_removed"), "redact": pii.redact(docs), "decontaminated": decontam.decontaminated(docs, items), "recognised": langid.recognised(docs, net), "keep_first": simhash.keep_first(docs)
    }
    for name, out in outputs.items():
        assert out.columns == docs.columns, name
        got = out.orderBy("doc_id").collect()
        assert len(got) == 2 and all(r[n] == "xy"[i] for i, r in enumerate(got) for n in names), name
    assert fresh(docs, "_KEY") == "_KEY_" and fresh(docs, "new") == "new"
    for out in (pii.find(docs), langid.identify(docs, net), decontam.leaks(docs, items), tokens.counted(docs.withColumn("n_tokens", F.lit("z"))), quality.judged(docs.withColumn("quality", F.lit("z"))), licenses.scan(docs)):
        assert out.count() in (0, 2)


def test_items_without_ids_and_with_shared_ones(spark):
    item = "what is the tallest tower in the old town and who built it first of all the people there"
    other = "which of the seven rivers runs dry in summer although the snow melts late in the mountains"
    docs = spark.createDataFrame([(1, f"some words before it {item} and after"), (2, f"quite different {other} words"), (3, "nothing of the kind"), (4, "short one"), (5, "a short one within more text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (7, other), (7, "some words of another item that stand nowhere"), (7, other), (None, None), (8, ""), (9, "short one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect() if r["doc_id"] != 1)
    assert got == [(2, 7), (4, 9)]
    assert [r["item_id"] for r in decontam.leaks(docs, items).where("doc_id = 1").collect()] == [None]
    assert sorted(r["doc_id"] for r in decontam.decontaminated(docs, items).collect()) == [3, 5]


def test_recall_of_paraphrased_items(spark):
    """Items with words replaced, left out or moved, each in a host text: what share is found, by strength of the edits."""
    import random

    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(9)
    hosts = [w for r in docs.where("doc_id < 400").orderBy("doc_id").collect() if 150 < len(w := words(r["text"])) < 600]

    def edited(ws, how, share):
        n = max(1, round(share * len(ws)))
        out = list(ws)
        if how == "replaced":
            for i in rng.sample(range(len(ws)), n):
                out[i] = f"q{rng.randrange(10**6)}"
        elif how == "left out":
            gone = set(rng.sample(range(len(ws)), n))
            out = [w for i, w in enumerate(ws) if i not in gone]
        else:  # neighbours swapped
            for i in rng.sample(range(len(ws) - 1), n):
                out[i], out[i + 1] = out[i + 1], out[i]
        return out

    rows, plan = [], []
    items = [(r["item_id"], words(r["text"])) for r in bench.orderBy("item_id").collect()]
    for how in ("replaced", "left out", "swapped"):
        for share in (0.05, 0.1, 0.2, 0.3):
            for k, ws in rng.sample(items, min(60, len(items))):
                if len(ws) >= 12:
                    host = rng.choice(hosts)
                    at = rng.randrange(len(host))
                    rows.append((len(rows), " ".join(host[:at] + edited(ws, how, share) + host[at:])))
                    plan.append((how, share, k))
    space = decontam.latent_space(docs, bench)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, space).collect()}
    hit, all_ = defaultdict(int), defaultdict(int)
    for i, (how, share, k) in enumerate(plan):
        all_[how, share] += 1
        hit[how, share] += (i, k) in found
    recall = {k: round(hit[k] / all_[k], 2) for k in all_}
    print("recall of paraphrases:", recall)
    # of items with 30 % of their words gone the answer must stand, so fewer are found
    assert all(r >= 0.9 for (_, share), r in recall.items() if share <= 0.2), recall


def test_language_network_pass_and_padding():
    net = langid.ByteCNN(["a", "b", "c"])
    x = np.concatenate([langid.windows("hello wörld, this is a text of more than one window ".encode() * 4), langid.windows(b"short"), langid.windows(b"")])
    got = net.log_probs(x)
    for row, want in zip(x, got, strict=True):
        h = []
        for w in langid.WIDTHS:
            places = [i for i in range(len(row) - w + 1) if row[i] != 0]
            for f in range(langid.FILTERS):
                z = [sum(net.p["emb"][row[i + j]] @ net.p[f"k{w}"][j * langid.EMBED : (j + 1) * langid.EMBED, f] for j in range(w)) for i in places]
                h.append(max(0.0, max(z) + net.p[f"b{w}"][f]) if z else 0.0)
        z = np.array(h) @ net.p["out"] + net.p["bias"]
        assert np.allclose(z - np.log(np.exp(z).sum()), want, atol=1e-4)


def test_language_learning_takes_any_ids_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hashed = docs.withColumn("doc_id", F.xxhash64("doc_id"))
    assert set(langid.train(hashed).langs) == set(langid.train(docs.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))).langs) >= {"de", "en", "es", "fr"}
    # one row that stands a thousand times counts once
    many = docs.union(docs.where("doc_id = 1").withColumn("doc_id", F.explode(F.array_repeat("doc_id", 1000))))
    assert langid.training_windows(many).count() <= 2 * 4 * langid.ROWS_PER_LANG * langid.WINDOWS_PER_ROW
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.recognised(none, langid.train(none))
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 0 and kept.columns == docs.columns


def test_toxicity_query_against_its_parts(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lexicon, weights = toxicity.train(docs, labels)
    match = toxicity.Matcher(lexicon)
    for r in toxicity.op1_toxicity(spark, SF).collect():
        z = weights[0] + sum(w * f for w, f in zip(weights[1:], toxicity.features(documents[r["doc_id"]], match), strict=True))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)
    # repeated labels and rows, and labels of no document
    twice = toxicity.labelled(docs.union(docs), labels.union(labels.withColumn("toxic", F.lit(0))).union(spark.createDataFrame([(None, 1, 1), (10**9, 1, 1)], labels.schema)))
    assert twice.count() == toxicity.labelled(docs, labels).count() and twice.where("toxic = 1").count() == toxicity.labelled(docs, labels).where("toxic = 1").count()


def test_license_labels(spark):
    notice = licenses.NOTICES["mit"][0].split()
    texts = {
        "Licensed under CC BY 4.0": "cc-by", "CC BY-SA 4.0": "cc-by,cc-by-sa", "cc by-nc-sa": "cc-by,cc-by-nc-sa", "General Public License version 2": "gpl,gpl-2", "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "Apache License, version 1.1": "apache-1.1", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License": "mit", "SPDX-License-Identifier: MIT": "mit", "SPDX: BSD-3-Clause": "bsd-3",
        " ".join(notice): "mit", " ".join(notice[:8] + ["really"] + notice[8:13] + notice[14:]): "mit", " ".join(notice[::-1]): "", "a license of some kind": "",
        " ".join(x for a, b in zip(notice, notice[1:], strict=False) for x in (a, b, "fill", "er")): "", " ".join(x for i, w in enumerate(notice) for x in ([w, "so", "very"] if i % 4 == 3 else [w])): "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_links_of_one_id_and_identical_rows(spark):
    rows = [(5, "one two three four five six")] * 3 + [(None, "one two three four five six"), (6, "seven words that are not those other ones")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["5"] * 4 + ["6"]
    assert mixing.taken(mixing.sized(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string"))).count() == 5
    assert held_out(F.lit(None)) is not None


def test_search_by_a_sampled_space_against_brute_force(spark):
    """Pairs that pass the word-by-word checks, every passage compared with every item, are found by cosine in a space that is
    fitted on a sample of the documents, too."""
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    space = decontam.latent_space(docs.select("doc_id", "text"), items, sample=150)
    texts = docs.where("doc_id % 5 = 0").select("doc_id", "text").collect()
    searcher = decontam.Searcher(next(decontam.passes(items)), *space)
    hashes = decontam.hashed([(r.text or "").encode() for r in texts])

    def found():
        return {(r.doc_id, x[0]) for r, f in zip(texts, searcher.find_all(hashes), strict=True) for x in f if not x[-1]}

    by_cosine = found()
    for kept, _ in searcher.sizes.values():
        for item in kept:
            item.cosine = -9.0
    brute = found()
    assert by_cosine <= brute and len(brute) >= 3 and len(by_cosine) >= 0.9 * len(brute)
