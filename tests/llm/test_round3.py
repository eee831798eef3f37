"""BPE, whitening and the filter audit against the library, exact arithmetic and plain loops."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import audit, bpe, whitening
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "a<|endoftext|>B <|startoftext|>x", "<|endoftext|><|endoftext|>", "<|endoftext", "Σ ΟΔΟΣ ΣΑΣ", "aaaa aaaaa " + "a" * 999, "İstanbul ǅ ﬁ ẞ", "é Ẹ̇",
    "각", "\U0001f600 \U0010ffff ͸ \U00010d50 ok", "it's WE'LL i'd 'tis y'all're", "漢字" * 3000, "x" * 60_000, "ab" * 50_000, "\x1c\x1d\x85​\xa0q \x00 z", "½ ⅷ ٣ 12",
    "e꧀᷺ࣛ", "one two " * 300_000,
]


def mixed_texts(n=400, seed=3):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0xE000, 0x110000), rng.randrange(0x300, 0x370), rng.randrange(97, 103)]))
    return ["".join(pick() for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_librarys(name):
    path = public_tokenizers.path(name)
    own, lib = bpe.Bpe(path), Tokenizer.from_file(path)
    texts = [*(HARD if "word" in name else [t for t in HARD if not t or len(t) < 100_000]), *mixed_texts()]
    for text, got in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)[:80]
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_composed_texts_are_left_alone():
    """What Python's tables call composed, the library doesn't change, though its tables are older."""
    import unicodedata

    lib = bpe.Bpe().compose
    rng = random.Random(7)
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    for _ in range(30_000):
        text = unicodedata.normalize("NFC", "".join(rng.choice([rng.choice(marks), rng.choice("aeoAÅ가ᅡ")]) for _ in range(6)))
        assert lib.normalize_str(text) == text


def test_pair_index_against_one_merge_at_a_time():
    own = bpe.Bpe()
    rank = {(a, b): r for r, (a, b) in enumerate(zip(own.left, own.right, strict=True))}

    def plain(word):
        raw = word.encode()
        sym = [int(own.inner[b]) for b in raw[:-1]] + [int(own.final[raw[-1]])]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(itertools.pairwise(sym)) if p in rank), default=None)
            if best is None:
                return [int(own.ids[s]) for s in sym]
            r, i = best
            sym[i : i + 2] = [own.made[r]]

    rng = random.Random(1)
    words = ["a" * n for n in range(1, 40)] + ["".join(rng.choice("abehinst") for _ in range(rng.randrange(1, 25))) for _ in range(500)] + ["é", "ßß", "!!!!!!!", "........."]
    for word, got in zip(words, bpe.PairIndex(own, words).encoded(), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(word), word


def test_bpe_blocks_and_cache(monkeypatch):
    texts = ["alpha beta gamma " * 50, "delta", None, "épsilon " * 30, "<|endoftext|>zeta"] * 3
    whole = bpe.Bpe().encode(texts)
    for name, small in (("BLOCK", 40), ("PIECE", 25), ("KEPT_WORDS", 2), ("KEPT_LENGTH", 3)):
        monkeypatch.setattr(bpe, name, small)
    assert bpe.Bpe().encode(texts) == whole


def test_op11(spark):
    lib = Tokenizer.from_file(bpe.VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "", 6), (None, "Hello World", None), (None, "Hello World", None), (4, "x" * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.digested(bpe.decoded(bpe.encoded(docs))).collect()
    assert len(got) == 6 and {r.decoded for r in got if r.doc_id in (1, 2)} == {""}
    assert {(r.decoded, tuple(r.ids)) for r in got if r.doc_id is None} == {("hello</w> world</w>", (3306, 1002))}
    assert {r.ids_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encoded(docs.where("false")).collect() == []
    odd = spark.createDataFrame([([1, None, 99_999_999],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded(odd).collect()] == ['"', ""]


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [range(1, 65), [np.exp(-i / 3) for i in range(64)], [1 + i * 1e-9 for i in range(8)] + list(range(2, 30)), [1.0] * 10 + [2.0] * 9 + [2 + 1e-12, 5], [1e-20, 1, 1e12, 1e12 + 1], [0.0] * 30 + [1, 2], [1 + i * 1e-13 for i in range(9)], [3.0]],
)
def test_refined(values):
    a = spectrum(list(values))
    value, x = whitening.refined(a)
    top = np.abs(a).max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 5e-15
    assert np.abs(a @ x - x * value).max() < 2e-15 * max(top, np.abs(value).max())
    assert np.abs(np.sort(value) - np.sort(np.linalg.eigvalsh(a))).max() < 4e-15 * np.abs(value).max()
    assert (np.diff(value) <= 0).all()


def test_refined_beats_float32():
    a = spectrum(range(1, 65))
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    value, x = whitening.refined(a)
    assert np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max() > 1e-6
    assert whitening.refined(np.zeros((4, 4)))[0].tolist() == [0] * 4
    exact = np.abs(np.abs((x * np.linalg.eigh(a)[1][:, ::-1]).sum(axis=0)) - 1).max()
    assert exact < 1e-14


def test_sliced_products_are_exact():
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=(20, 20)).astype(np.longdouble) + rng.normal(size=(20, 20)) * np.longdouble(1e-18) for _ in range(2))
    want = [[sum((Fraction(*x.as_integer_ratio()) * Fraction(*y.as_integer_ratio()) for x, y in zip(r, c, strict=True)), Fraction(0)) for c in b.T] for r in a]
    got = whitening.product(a, b)
    assert max(abs(float(Fraction(*got[i, j].as_integer_ratio()) - want[i][j])) for i in range(20) for j in range(20)) < 1e-17


def test_op12(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = {k: np.floor(1024 * np.array(v, float)).astype(int) + 100_000 for k, v in rows.items()}
    m = np.array(list(x.values()))
    n, s = len(m), m.sum(axis=0)
    z = m - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    got = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(got) == 8 * n == len({(r.vec_id, r.component) for r in got})
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        row, c = x[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))
        want = float((row - s / n) @ v[:, c] / np.sqrt(e[c]))
        sign.setdefault(c, np.sign(want * r.whitened))
        assert abs(r.whitened - sign[c] * want) < 1e-8
        assert abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9


def test_whitening_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(i), float(i * i % 7), 1.5] for i in range(20)]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(0, good[0], 1), (None, good[3], 2), (90, None, 1), (91, [], 1), (92, [1.0, None, 2.0], 1), (93, [1.0, nan, 2.0], 1), (94, [1.0, -inf, 2.0], 1), (95, [1.0, 2.0], 1), (96, [1e300, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    vectors = whitening.whole_vectors(df)
    assert vectors.count() == 22 and vectors.columns == ["vec_id", "embedding", "x"]
    model = whitening.fit(vectors)
    got = whitening.whitened(vectors, model, 8, deviation="deviation").collect()
    assert model.n == 22 and len(got) == 22 and all(len(r.whitened) == 3 for r in got)
    assert all(r.whitened[2] is None for r in got), "the third entry has no variance"
    assert whitening.identity_error(vectors, model) < 1e-9
    assert [r.deviation for r in got if r.vec_id == 5] == [sum((22 * (int(1024 * a) + 100_000) - t) ** 2 for a, t in zip(good[5], model.sums, strict=True))]
    alone = whitening.whole_vectors(df.where("vec_id = 4"))
    fit = whitening.fit(alone)
    assert alone.count() == 1 and whitening.whitened(alone, fit).first().whitened == [None] * 3
    assert fit.explained(3) == [None] * 3 and whitening.identity_error(alone, fit) is None
    assert whitening.fit(whitening.whole_vectors(df.where("false"))) is None
    wide = spark.createDataFrame([(1, [1e14, 0.0]), (2, [-1e14, 3.0]), (3, [5e13, 1.0])], "vec_id long, embedding array<double>")
    big = whitening.whole_vectors(wide)
    assert [r.d for r in whitening.whitened(big, whitening.fit(big), 2, deviation="d").collect()] == [None] * 3, "too large for a long"


def test_op12_without_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_whitening"](spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain_audit(docs, labels):
    marks = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            good, bad = marks.get(doc_id, (False, False))
            marks[doc_id] = (good or quality == 1, bad or toxic == 1)
    seen = {}
    for doc_id, text, _ in docs:
        key = (doc_id is None, doc_id or 0)
        seen[text or ""] = min(seen.get(text or "", key), key)
    rows = []
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (doc_id is None, doc_id or 0) > seen[t]}
        rows.append((source or "", fails, *marks.get(doc_id, (False, False))))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                all_ = [r for r in rows if r[0] == part and r[1][f]]
                out.append([part, "".join(order), step, len(stay), len(gone), len(all_) - len(gone), sum(sum(r[1].values()) == 1 for r in all_), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = stay
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_against_plain_loops(spark):
    text = "Some words that are all unlike each other here: " + " ".join(f"w{i}" for i in range(60))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    docs += [(i, text, "s") for i in (7001, 7002, 7003, 7001)] + [(None, text, None), (None, text, "s"), (None, "only here", "s"), (None, "only here", "s"), (8001, None, None), (8002, "", ""), (8003, "a a a a " * 30, "x"), (8004, "ABC " * 60, "x"), (8005, "# é" * 99, "x"), (8006, "w " * 200_000, "y")]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    labels += [(7001, 1, None), (7001, 0, 1), (7002, None, None), (None, 1, 1), (99_999, 1, 1), (8003, 1, 0)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, part int, n int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit.audited(frame, marks).collect())) == plain_audit(docs, labels)
    assert audit.audited(frame.where("false"), marks).collect() == []
    assert sum(r.kept for r in audit.audited(frame, marks.where("false")).where("filter_order = 'ABCDE' and step = 1").collect()) == sum(len(re.findall(r"\S+", t or "")) >= 50 for _, t, _ in docs)


def test_short_repeats_go(spark):
    from tidemark.llm import substring

    short = "Hello there my friend. This is a test of it. See you all again."
    rows = [(i, short) for i in range(5)] + [(5, "One sentence of words alone that stands on its line\nYes. No.\n"), (6, "One sentence of words alone that stands on its line\nYes. No.\n")]
    rows += [(7, "Something before.\n" + short + "\nSomething after it."), (None, None), (8, "")]
    got = {r.doc_id: r for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].text == "" for i in range(1, 5))
    assert "friend" not in got[7].text and "before" in got[7].text and "after" in got[7].text
    # one sentence a line is no run of several; the whole text, of three sentences, is
    assert got[6].text == "" and got[5].n_removed == 0
    assert substring.spans(b"Yes. No. Yes. No.") == [] and len(substring.spans(b"One sentence alone with some nine or ten words. ")) == 0


def test_short_items_are_reported_and_ids_keep_their_type(spark):
    from tidemark.llm import decontam

    docs = spark.createDataFrame([(1, "they say the capital of Atlantis is under water " * 3), (2, "nothing of that kind here, only the capital"), (3, "The capital of Atlantis"), (4, None)] + [(i, f"word{i} and more of it {i} " * 9) for i in range(5, 60)], "doc_id long, text string")
    items = spark.createDataFrame([("a1", "the capital of atlantis"), ("b", "word7 and more of it 7 word7 and more of it"), (None, "under water is")], "item_id string, text string")
    space = decontam.latent_space(docs, items)
    got = {(r.doc_id, r.item_id): r.short for r in decontam.leaks(docs, items, space, short=True).collect()}
    assert (1, "a1") not in {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items, space).collect()}
    assert got[1, "a1"] and got[3, "a1"] is False and got[7, "b"] is False and (2, "a1") not in got
    kept = lambda **how: {r.doc_id for r in decontam.decontaminated(docs, items, space, **how).collect()}
    assert {1, 2, 4} <= kept() and not kept() & {3, 7}
    assert 1 not in kept(short=True) and {2, 4} <= kept(short=True)


def test_mixing_makes_as_many_passes_as_most_allows(spark):
    from tidemark.llm import mixing

    docs = spark.createDataFrame([(i, "w " * (50 + i % 7), "s") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.taken(mixing.sized(docs), share=3.0, most=4.0).collect()
    size = got[0].source_size
    assert got[0].target == 3 * size and abs(sum(r.taken for r in got) - 3 * size) <= 3 * size / mixing.PACKETS + 1
    assert max(r.taken / r.size for r in got) <= 4


def test_caches_hold_short_words_only():
    from tidemark.llm import tokens

    t = tokens.Unigram()
    texts = ["漢字" * 5000 + str(i) for i in range(5)] + ["plain words here"]
    counts = [t.count(x) for x in texts]
    assert counts[0] > 0 and sum(map(len, t)) < 1000 and [t.count(x) for x in texts] == counts


def test_many_equal_rows_are_written_out_in_steps(spark, monkeypatch):
    from tidemark.llm import licenses

    monkeypatch.setattr(licenses, "COPIES", 7)
    docs = spark.createDataFrame([(None, "")] * 50 + [(1, "all rights reserved")] * 15 + [(2, "x")], "doc_id long, text string")
    got = licenses.scan(docs).groupBy("doc_id", "n_base").count().collect()
    assert sorted((r.doc_id or 0, r.n_base, r["count"]) for r in got) == [(0, 0, 50), (1, 1, 15), (2, 0, 1)]


def test_training_windows_are_bounded_in_all(spark, monkeypatch):
    from tidemark.llm import langid

    docs = spark.createDataFrame([(i, f"some text number {i} of it", f"l{i % 20}") for i in range(2000)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_WINDOWS", 600)
    n = langid.training_windows(docs).count()
    assert 0 < n <= 1200


def test_short_noise_is_rejected():
    import random
    import string

    import zstandard

    from tidemark.llm import quality

    rng, zip_ = random.Random(4), zstandard.ZstdCompressor(level=quality.LEVEL)
    noise = lambda n: " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(3, 9))) for _ in range(60))[:n]
    kept = [quality.judge(noise(rng.randrange(145, 200)), zip_)[7] for _ in range(200)]
    assert sum(kept) <= 4
    prose = "it was a quiet day in the small town and the people who had come to see the market went home with what they had bought there in the early morning"
    assert quality.judge(prose, zip_)[7]


def test_license_names_and_versions(spark):
    from tidemark.llm import licenses

    header = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"
    want = {
        "GPL version 3": "gpl-3", "GNU GPL version 2 or later": "gpl-2", "License: Apache 2": "apache-2.0", "License: MIT": "mit", "Boost Software License 1.0": "boost",
        "Artistic License 2.0": "artistic-2.0", "Attribution-NonCommercial 4.0 International": "cc-by-nc", header: "gpl,gpl-3", "CC BY-ND-NC": "cc-by,cc-by-nc-nd",
        "SPDX-License-Identifier: ISC OR MIT": "isc,mit", "MPL 1 1 in the match": "", "EPL 2-0 win": "", "licensed under the MPL 2.0": "mpl-2.0", "LGPL v2.1": "lgpl-2.1",
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(want.values())


def test_two_edits_of_long_terms():
    import random

    from tidemark.llm import toxicity

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = dict.fromkeys(("worthlessness", "disgustingly", "degenerating", "idiot", "pathetic"), 1.0)
    lexicon, rng = toxicity.Lexicon(terms), random.Random(8)
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                del w[i]
            elif kind == 1:
                w.insert(i, rng.choice("abxyz"))
            elif kind == 2:
                w[i] = rng.choice("abxyz")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        near = [(distance(word, t), t) for t in terms]
        near = [(e, t) for e, t in near if e <= (2 if len(t) >= toxicity.LONG else 1)]
        got = lexicon.near(word)
        if len(word) < 5 or not near:
            assert got is None or got[1] == 0, word
        else:
            assert got == (min(near)[1], min(near)[0]), (word, got, near)


def test_contexts_are_learned_from_labels(spark):
    """Directed uses are abuse, quoted ones are not: a model fitted on such labels tells new ones apart. Where quoted uses are
    abuse as well, it learns that they weigh more; labels that don't say so leave the usual factors."""
    import random

    from tidemark.llm import toxicity

    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    fill = lambda n: " ".join(rng.choices(plain, k=n))
    terms = ["idiot", "moron", "pathetic", "worthless"]
    uses = {
        "directed": lambda t: f"{fill(20)} you are such a {t} {fill(20)}",
        "quoted": lambda t: f'{fill(20)} the article had "{t}" in it {fill(20)}',
        "said": lambda t: f"{fill(20)} the report said {t} was used {fill(20)}",
        "none": lambda t: fill(42),
    }
    made = [(kind, make(rng.choice(terms))) for kind, make in uses.items() for _ in range(300)]
    rows = [(i, kind, text) for i, (kind, text) in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    labels = docs.select("doc_id", (docs["kind"] == "directed").cast("int").alias("toxic"))
    lexicon, weights = toxicity.train(docs, labels)
    new = spark.createDataFrame([(kind, make(rng.choice(terms))) for kind, make in uses.items() for _ in range(100)], "kind string, text string")
    share = {}
    for r in toxicity.scored(new, lexicon, weights).collect():
        share.setdefault(r.kind, []).append(r.toxicity >= 0.5)
    share = {k: sum(v) / len(v) for k, v in share.items()}
    assert share["directed"] >= 0.95 and max(share["quoted"], share["said"], share["none"]) <= 0.05, share
    found = [(kind, toxicity.parts(text, toxicity.Matcher(toxicity.Lexicon(dict.fromkeys(terms, 1.0))))) for kind, text in made]
    x, kinds = np.array([p for _, p in found]), np.array([k for k, _ in found])
    noise = np.random.default_rng(1).random(len(kinds))
    alike = np.where(kinds == "none", noise < 0.1, noise < 0.7)
    assert toxicity.fit_contexts(x, alike).quoted == 1.0, "quoted or not, the share of abuse is the same"
    assert toxicity.fit_contexts(x, noise < 0.3) == toxicity.Contexts(), "labels by chance"


def plain_toxicity(text, lexicon, weights):
    """A document's score, from the lexicon's terms and the model's weights alone: distances by the textbook's table, contexts
    by counting marks."""
    import math

    from tidemark.llm import toxicity as t

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    def term(word):
        if word in lexicon.terms:
            return lexicon.terms[word], 1.0
        stem = max((s for s in lexicon.stems if word.startswith(s)), key=len, default=None)
        if stem:
            return lexicon.stems[stem], 1.0
        if len(word) < 5 or word in lexicon.ordinary:
            return None
        near = [(e, x) for x in lexicon.terms if len(x) >= 5 and abs(len(x) - len(word)) <= 2 and (e := distance(word, x)) <= (2 if len(x) >= t.LONG else 1)]
        return (lexicon.terms[min(near)[1]], 0.8) if near else None

    low, cache = (text or "").lower(), plain_toxicity.__dict__.setdefault("cache", {})
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    total = directed = strongest = 0.0
    for i, m in enumerate(found):
        if m[0] not in cache:
            cache[m[0]] = term(m[0])
        if cache[m[0]] is None:
            continue
        w = cache[m[0]][0] * cache[m[0]][1]
        around = {x[0] for x in found[max(0, i - 5) : i] + found[i + 1 : i + 6]}
        line = low[: m.start()].rpartition("\n")[2]
        aimed = bool(around & t.ADDRESSING)
        if len([c for c in line if c in t.QUOTES]) % 2 or around & t.REPORTING:
            w *= lexicon.contexts.quoted
        elif aimed:
            w *= lexicon.contexts.directed
        total, strongest, directed = total + w, max(strongest, w), directed + w * aimed
    z = weights @ [1.0, math.log1p(total), strongest, math.log1p(directed), math.log1p(100 * total / max(len(found), 1))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_op1_against_a_plain_version(spark):
    from tidemark.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lexicon, weights = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    plain_toxicity.__dict__["cache"] = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op1_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.score == pytest.approx(plain_toxicity(texts[r.doc_id], lexicon, weights), abs=1e-9)
        assert r.predicted == (r.score >= 0.5)
    rows = [f'{a} {t} {b}' for t in ("idiot", "idoit", "moron", "pathetic", "table") for a, b in (("you", "there"), ('he said "', '" of it'), ("the", "you all now and then here"), ('x "y" z', ""), ('line " one\n', "two"))]
    hard = toxicity.scored(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), lexicon, weights).collect()
    for r in hard:
        assert r.toxicity == pytest.approx(plain_toxicity(r.text, lexicon, weights), abs=1e-9), r.text


def test_all_windows_of_a_text_vote(spark):
    from tidemark.llm import langid

    net = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["a short one", "ein etwas längerer Text. " * 40, "x" * 128, "y" * 129, "de la un " * 9000, "é" * 64]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    assert len(got) == len(rows)

    def forward(window):
        """Filters at every place that starts on a byte of the text, one place at a time."""
        pooled = []
        for width in langid.WIDTHS:
            best = np.full(langid.FILTERS, -1e9)
            for at in range(len(window) - width + 1):
                if window[at]:
                    best = np.maximum(best, np.concatenate([net.p["emb"][b] for b in window[at : at + width]]) @ net.p[f"k{width}"])
            pooled.append(np.maximum(best + net.p[f"b{width}"], 0))
        z = np.concatenate(pooled) @ net.p["out"] + net.p["bias"]
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    for r in got:
        raw = r.text.encode()
        if len(raw) > 3000:
            continue
        votes = np.mean([forward(raw[i : i + 128].ljust(128, b"\0")) for i in range(0, len(raw), 128)], axis=0)
        assert r.lang_pred == net.langs[int(votes.argmax())]
        assert r.lang_score == pytest.approx(float(np.exp(votes.max()) / np.exp(votes).sum()), abs=1e-4)
    same_text = [(r.lang_pred, r.lang_score) for r in got if r.text == texts[1]]
    assert len(same_text) == 2 and len(set(same_text)) == 1, "a row without an id is scored as any other"


def test_repeated_rows_and_missing_ids(spark):
    from tidemark.llm import decontam, tokens

    texts = ["plain words", "plain words", None, "", "a\x00b c", "plain words"]
    docs = spark.createDataFrame([(i if i % 3 else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = tokens.counted(docs).collect()
    mine = tokens.Unigram()
    assert sorted((r.text or "", r.n_tokens) for r in got) == sorted((t or "", mine.count(t)) for t in texts)
    filler = [(100 + i, f"filler text number {i} with words of its own {i * 7} {i * 11}") for i in range(60)]
    leaky = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(1, leaky), (1, leaky), (None, leaky), (2, leaky + " and more"), *filler], "doc_id long, text string")
    items = spark.createDataFrame([(5, leaky), (5, leaky), (6, leaky)], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id) for r in decontam.leaks(docs, items).collect())
    assert found == [(0, 5), (0, 6), (1, 5), (1, 5), (1, 6), (1, 6), (2, 5), (2, 6)]


def test_word_hashes_against_their_definition():
    from tidemark.llm import decontam

    rng = np.random.default_rng(4)
    lengths = [1, 2, 23, 24, 25, 26, 63, 64, 65, 300, 2_000]
    long = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in lengths]
    texts = [b"", None, b" ", b"One two, THREE", b" ".join(long), b"a", "日本語の文は一語になる 一 二".encode() * 3, b"x" * 100, b" . "]

    def plain(word: bytes) -> int:
        h = sum(c * int(decontam._FACTORS[i % 64]) for i, c in enumerate(word)) % 2**64
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64

    for some in (texts, texts[:3], texts[-2:-1], texts[::-1]):
        assert [h.tolist() for h in decontam.hashed(some)] == [[plain(w) for w in decontam.words(t)] for t in some]


def test_passage_frequencies_against_a_count_of_each_passage(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from tidemark.llm import decontam

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()] + ["", None, "few words", " . "]
    size, want = decontam.BLOCK * decontam.PASSAGE_BLOCKS, Counter()
    for h in decontam.hashed([t.encode() if t else t for t in texts]):
        ids = decontam.dims_of(h).tolist()
        for i in range(0, len(ids), size):
            want.update({*ids[i : i + size], decontam.DIMS})
    got = decontam._statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.0)
    assert {r["dim"]: r["df"] for r in got.where("dim >= 0").groupBy("dim").agg(F.sum("df").alias("df")).collect() if r["df"]} == dict(want)


def _search_of_sf(spark):
    from tidemark.llm import decontam

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    searcher = decontam.Searcher(next(decontam.passes(items)), *decontam.latent_space(docs.select("doc_id", "text"), items, sample=150))
    return searcher, decontam.hashed([(r["text"] or "").encode() for r in docs.orderBy("doc_id").limit(200).select("text").collect()])


def test_search_of_blocks_against_each_passage_alone(spark, monkeypatch):
    """Every run of blocks, its words' vectors summed by itself: runs that the text or a piece of the matrix ends, too."""
    from tidemark.llm import decontam

    searcher, texts = _search_of_sf(spark)
    host = max(texts, key=len)
    some = [texts[0], host[:5], np.zeros(0, np.uint64), host[:8], host[:9], host]
    for items, _ in searcher.sizes.values():
        for item in items[:5]:  # items at both ends of a text, alone and without an end
            ws = np.fromiter((w for i in range(item.n) for w, m in item.masks.items() if m >> i & 1), np.uint64, item.n)
            some += [ws, np.append(host[:37], ws), np.append(ws, host[:41]), ws[: -item.n // 5], np.append(host[:50], ws[: -item.n // 5])]
    want = []
    for ws in some:
        best: dict = {}
        for blocks, (items, z) in searcher.sizes.items():
            for at in range(0, len(ws), decontam.BLOCK):
                x = searcher.v[decontam.dims_of(ws[at : at + blocks * decontam.BLOCK])].sum(axis=0, dtype=np.float64)
                for j, cos in enumerate(x @ z / max(float(np.linalg.norm(x)), 1e-9)):
                    if cos >= items[j].cosine:
                        searcher.check(ws, items[j], at, at + blocks * decontam.BLOCK, float(cos), best)
        want.append(best)
    assert sum(map(len, want)) > 60
    for pieces in (1, 16, 2_048):
        monkeypatch.setattr(decontam, "BLOCKS_AT_ONCE", pieces)
        for best, got in zip(want, searcher.find(some), strict=True):
            assert {f[0]: (*f[2:5], min(f[5], 10**9)) for f in got} == {k: f[2:] for k, f in best.items()}
            assert all(f[1] == pytest.approx(best[f[0]][1], abs=1e-5) for f in got)


def test_passages_without_an_items_words_are_not_read_word_by_word(spark, monkeypatch):
    from tidemark.llm import decontam

    searcher, texts = _search_of_sf(spark)
    read, check = [], decontam.Searcher.check
    monkeypatch.setattr(decontam.Searcher, "check", lambda self, ws, item, start, end, *rest: (read.append(sum(w in item.masks for w in ws[start:end].tolist()) / item.n), check(self, ws, item, start, end, *rest))[1])
    searcher.find(texts)
    assert read and sum(r >= decontam.LCS_WITH_ANSWER for r in read) >= 0.9 * len(read)
