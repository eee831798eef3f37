"""The queries' contracts against plain versions in Python, over whole small tables and over hand-made hard rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from tidemark.llm import langid, licenses, mixing, pii, quality, simhash, substring, tokens, toxicity
from tidemark.llm.common import held_out

SF = "/root/testdata/sf0.001"
HARD = [
    (1, "", "a", "en"),
    (2, None, None, None),
    (3, "   \n\t\x0b ", "b", "de"),
    (4, "one", "a", "en"),
    (5, "Cc By cc-by general public license. ALL RIGHTS reserved all rights reserved é", "c", "fr"),
    (6, "a@b.co x.y@z a@b.c_d@e.f.g +1 (222) 333-4444 1.2.3.256 1.2.3.255.4.5.6.7 4111 1111 1111 1111 0 12-34", "a", "en"),
    (7, "é😀 mail 😀x@y.org 10.0.0.1 +12 4111111111111111😀 +++5555555555", "a", "en"),
    (8, "w " * 3000, "b", "es"),
    (9, "a b c d e f g h i j k a b c d e f g h z y x\n\nfoo\nfoo \nfoo\n", "b", "es"),
    (9, "a b c d e f g h i j k a b c d e f g h z y x\n\nfoo\nfoo \nfoo\n", "b", "es"),
    (None, "no id here", "a", "en"),
    (11, "1" * 5000 + " " + "1." * 3000 + "@" * 2000 + "+1" * 2000, None, "en"),
    (12, "\x1c\x85\xa0 x\x1cy", "a", "en"),
]


@pytest.fixture(scope="module")
def rows(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    return [tuple(r) for r in got] + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in HARD]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)


def same(got, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_simhash(docs, rows):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        n = min(3, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [plain(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = [(r[0], f"{p:016x}", min(least[find(i)], default=None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    same(got, want)


def test_ball_links_find_all_pairs_within_two_bits(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base) | {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in base for _ in range(6)} | {0}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = {frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)) for a, b in simhash.ball_links(spark.createDataFrame(signed, "fp long")).collect()}
    assert all((min(x) ^ max(x)).bit_count() <= 2 for x in links)
    reach = {x: x for x in prints}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for x in links:
        reach[find(min(x))] = find(max(x))
    assert all(find(a) == find(b) for a in prints for b in prints if (a ^ b).bit_count() <= 2)


def test_components_of_a_long_chain(spark):
    from tidemark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


def phrase_places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def test_licenses(docs, rows):
    want = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = {v: phrase_places(w, k) for k, v in licenses.BASE.items()}
        every = sorted(i for x in at.values() for i in x)
        want.append((d, len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v))))
    out = licenses.scan(docs)
    same(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), want)
    for r in out.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_notice_with_an_edit(spark):
    text = "x y Permission is hereby granted, free of any charge, to any person obtaining a copy of the software and associated documentation files z"
    assert licenses.scan(spark.createDataFrame([(1, text), (2, "permission is a word")], "doc_id long, text string")).orderBy("doc_id").collect()[0]["labels"] == "mit"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def test_pii(docs, rows):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    n = lambda s: sum(c.isdigit() for c in s)
    small = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255
    ok = {"email": lambda s: True, "ip": lambda s: all(map(small, s.split("."))), "card": lambda s: 12 <= n(s) <= 19 and luhn(s), "phone": lambda s: 9 <= n(s) <= 15}
    want = []
    for d, t, *_ in rows:
        found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok[k](m[0])]
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        want.append((d, *(sum(f[2] == k for f in found) for k in kinds), hashlib.sha256(text.encode()).hexdigest()))
    from pyspark.sql import functions as F

    s = F.col("pii_spans")
    counts = [F.size(F.filter(s, pii._is(k))) for k in pii.BASE]
    out = pii.find(docs).select("doc_id", *counts, F.sha2(pii.joined(F.filter(s, lambda x: x["rank"] < 4)).cast("binary"), 256))
    same(out.collect(), want)


def test_redaction_and_iban(spark):
    text = "write to a.b@c.org or pay to iban GB82 WEST 1234 5698 7654 32 é, card 4111 1111 1111 1111."
    got = pii.redact(spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, extra string")).orderBy("doc_id").collect()
    assert got[0]["text"] == "write to [EMAIL] or pay to iban [IBAN] é, card [CARD]." and got[1]["text"] is None and got[0]["extra"] == "x"


def test_quality(docs, rows):
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)))
    out = quality.judged(docs).select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed")
    same(out.collect(), want)


def test_mixing(docs, rows):
    sizes = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s, _ in rows]
    names = sorted({s for *_, s in sizes if s is not None}) + [None]
    total = {s: sum(n for _, n, x in sizes if x == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            rest -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    got = mixing.taken(mixing.sized(docs)).collect()
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted((str(d), n, str(s)) for d, n, s in sizes)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == total[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(1, target[s] / mixing.PACKETS + 1)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    again = mixing.taken(mixing.sized(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_is_one_stream_cut_at_the_budget(docs):
    sizes = mixing.sized(docs)
    from pyspark.sql import functions as F

    groups = sizes.groupBy("doc_id", "source", "size", "place").agg(F.count(F.lit(1)).alias("copies"))
    targets, budget = mixing.source_targets(groups)
    items = mixing.mix(mixing.placed(groups, targets), budget).orderBy("mix_start").collect()
    at = 0
    for a in items:
        assert a["mix_start"] == at and 0 < a["taken"] <= a["n_words"]
        at += a["taken"]
    assert at == budget
    times = [a["virtual_finish"] for a in items]
    assert times == sorted(times)
    # what is taken is a prefix of the order: nothing that finishes earlier is left out
    every = mixing.packets(mixing.placed(groups, targets)).where(F.col("virtual_finish") < times[-1]).agg(F.sum("n_words")).first()[0]
    assert every <= budget


def test_mix_of_rows_without_ids_is_spread_out(spark):
    rows = spark.range(40_000).selectExpr("cast(null as long) AS doc_id", "concat('word ', id) AS text", "'s' AS source")
    groups = mixing.sized(rows).selectExpr("*", "1L AS copies")
    targets, _ = mixing.source_targets(groups)
    d = mixing.placed(groups, targets)
    assert d.selectExpr("conv(substring(place, 1, 1), 16, 10) AS x").groupBy("x").count().count() == 16 and d.select("begin").distinct().count() == 40_000


def test_substring(spark):
    p = "The first sentence of a long passage stands here. A second one follows it with some more words in it. Then a third one ends the passage, which has more than fifty words in all, as it goes on and on for quite a while until it stops."
    docs = [(3, f"Own start. {p} Own end of three."), (1, f"Begin {p} Another end."), (2, "Nothing in common here. Really nothing at all. Short."), (4, ""), (5, None), (6, f"x\n{p}\ny"), (6, f"x\n{p}\ny")]
    got = substring.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["text"] == docs[1][1] and by[2][0]["n_removed"] == 0 and by[5][0]["text"] is None and by[4][0]["text"] == ""
    assert "second one follows" not in by[3][0]["text"] and by[3][0]["text"].startswith("Own start. ") and by[3][0]["text"].endswith("Own end of three.")
    assert len(by[6]) == 2 and by[6][0] == by[6][1] and "third one ends" not in by[6][0]["text"]


def test_substring_against_brute_force(spark, rows, docs):
    places = defaultdict(list)
    for d, t, *_ in rows:
        for start, n, h, _ in substring.spans((t or "").encode()):
            places[h].append((d if d is not None else 1 << 62, t, start, n))
    gone = defaultdict(set)
    for v in places.values():
        first = min((d, t, s) for d, t, s, _ in v)
        for d, t, s, n in v:
            if (d, t, s) != first:
                gone[d, t] |= set(range(s, s + n))
    want = [(d, len(gone[d if d is not None else 1 << 62, t])) for d, t, *_ in rows]
    same(substring.deduplicate(docs.select("doc_id", "text")).select("doc_id", "n_removed").collect(), want)
    assert all(b"".join(substring.sentences((t or "").encode())) == (t or "").encode() for _, t, *_ in rows)


def test_substring_finds_every_long_passage_at_any_offset():
    import random

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    han = [chr(c) for c in range(0x4E00, 0x5600)]

    def text(n, marks, words=vocabulary, joint=" "):
        return joint.join(rng.choice(words) + (rng.choice(".!?") if rng.random() < marks else "") for _ in range(n))

    for marks in (0, 0.02, 0.05, 0.08, 0.12, 0.3):
        for size in (51, 60, 150):
            for _ in range(40):
                p = text(size, marks)
                a, b = (f"{text(rng.randrange(1, 40), marks)} {p} {text(rng.randrange(1, 40), marks)}" for _ in range(2))
                assert {h for *_, h, _ in substring.spans(a.encode())} & {h for *_, h, _ in substring.spans(b.encode())}, (marks, size)
                windows = [{tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)} for t in (a, b)]
                assert windows[0] & windows[1]
    for mark in ("", "\u3002"):
        for _ in range(40):
            p = mark.join(text(13, 0, han, "") for _ in range(5))
            a, b = (text(rng.randrange(1, 40), 0, han, "") + p + text(rng.randrange(1, 40), 0, han, "") for _ in range(2))
            assert {h for *_, h, _ in substring.spans(a.encode())} & {h for *_, h, _ in substring.spans(b.encode())}
            assert b"".join(substring.sentences(a.encode())).decode() == a
    assert len(substring.sentences("eins\u3002zwei\u061f drei\u2026vier".encode())) == 4
    other = [{h for *_, h, _ in substring.spans(text(500, 0.1).encode())} for _ in range(20)]
    assert sum(map(len, other)) == len(set().union(*other))


def test_substring_of_texts_with_null_or_shared_ids(spark):
    p = "The first sentence of a long passage stands here. A second one follows it with some more words in it. Then a third one ends the passage, which has more than fifty words in all, as it goes on and on for quite a while until it stops."
    docs = [(i, f"Start {n}. {p} End {n}.") for i, n in ((None, 1), (None, 2), (None, 3), (None, 3))] + [(7, f"Other {q}. {p[::-1]} Last {q}.") for q in (1, 2)]
    got = substring.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 6
    # one text of each keeps the passage, in all its rows
    assert len({r["text"] for r in got if r["doc_id"] is None and "second one follows" in r["text"]}) == 1
    assert sum(r["n_removed"] == 0 for r in got if r["doc_id"] == 7) == 1


def test_token_counts_against_the_tokenizers_library(docs, rows):
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    low = min(s for _, s in vocabulary)
    # control and byte pieces never match text as they are; the library has no kinds of pieces
    own = [(p, s) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) else (f"\x00{i}", low) for i, (p, s) in enumerate(vocabulary)]
    t = Tokenizer(models.Unigram(own, unk_id=0, byte_fallback=False))
    mine = tokens.Unigram()
    for _, text, *_ in rows:
        if text and "\x00" not in text:
            pieces = t.encode(tokens.SPACE + text.replace(" ", tokens.SPACE), add_special_tokens=False)
            want = sum(len(tokens_text.encode()) if i == 0 else 1 for i, tokens_text in zip(pieces.ids, pieces.tokens, strict=True))
            assert mine.count(text) == want, text[:80]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.counted(docs).collect()}
    assert got[10_001] == 0 and got[10_002] == 0 and got[10_004] == mine.count("one")


def test_language_id(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(whole)
    out = langid.identify(whole, net).where(held_out(whole["doc_id"])).collect()
    right = [r for r in out if r["lang_pred"] == r["lang"]]
    assert len(right) >= 0.95 * len(out) and all(0 <= r["lang_score"] <= 1 for r in out)
    hard = spark.createDataFrame([(1, ""), (2, None), (3, "123 !?"), (4, "é")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(hard, net).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r["lang_pred"] for r in langid.identify(hard, None).collect()} == {"und"}


def test_held_out_is_crc32(docs, rows):
    got = docs.select("doc_id", held_out(docs["doc_id"])).collect()
    same(got, [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0) for d, *_ in rows])


def test_levenshtein_automaton_over_the_trie():
    def distance(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = {"idiot": 1.0, "moron": 1.0, "pathetic": 1.0, "scum": 1.0, "worthless": 1.0}
    lex = toxicity.Lexicon(terms, {"achl": 0.7, "achlich": 0.9}, frozenset({"morons"}))
    words = "idiot idiott idot idoit 1diot iddiot morons mornn mroon moorn pathetc pathteic scum scums scu worthles xworthless worhtless wortlhess table wortless orthless wrothlses orthles worthlessly wxrthlexs woless wtorhless worhtelss wworthlesss".split()
    for w in words:
        best = min(((e, t) for e, t in ((distance(w, t), t) for t in terms if len(t) >= 5) if e <= (2 if len(t) >= toxicity.LONG else 1)), default=None)
        want = (w, 0) if w in terms else (best[1], best[0]) if best and len(w) >= 5 and w != "morons" else None
        assert lex.near(w) == want, w
    # stems take what begins with them, the longest first
    assert lex.near("achlichkeit") == ("achlich", 0) and lex.near("achlos") == ("achl", 0) and lex.near("ach") is None


def test_each_term_raises_the_score_less_if_misspelled_or_quoted():
    import numpy as np

    match = toxicity.Matcher(toxicity.Lexicon({"idiot": 1.0}))
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.array([toxicity.features("you are an idiot and more words" if t and rng.random() < 0.7 else "plain words only here", match) for t in y])
    for weights in (toxicity.fit(x, y), toxicity.DEFAULT_WEIGHTS):
        assert (weights[1:] >= 0).all()
        texts = ("plain words only here", 'the text has "idiot" in it', "they said the idiot in it", "the text has idoit in it", "the text has idiot in it")
        got = toxicity.probability(np.array([toxicity.features(t, match) for t in texts]), weights).tolist()
        assert got[0] < got[1] and got[0] < got[2] and max(got[1], got[2]) < got[3] < got[4]
    assert toxicity.features(None, match) == toxicity.features("", match) == [0.0] * toxicity.FEATURES


def test_planted_misspellings_are_found_by_the_automaton_only(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon, weights = toxicity.train(docs, labels)
    assert {"trash", "clown", "disgusting", "idiot", "pathetic"} <= set(lexicon.terms) and "verein" not in lexicon.terms
    rng = random.Random(4)

    def misspelled(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + rng.choice("xyz01") + w[i + 1 :], w[:i] + w[i] + w[i:]])

    held = docs.join(labels, "doc_id").where(held_out(docs["doc_id"]))
    clean = [r["text"] for r in held.where("toxic = 0 AND length(text) BETWEEN 200 AND 3000").orderBy("doc_id").limit(300).collect()]
    rows = []
    for i, t in enumerate(clean):
        w = t.split()
        for kind in ("clean", "exact", "misspelled"):
            own = list(w)
            for at in sorted(rng.sample(range(len(w)), 3), reverse=True):
                term = rng.choice(["idiot", "pathetic", "worthless", "trash", "clown", "disgusting"])
                own.insert(at, {"clean": "", "exact": term, "misspelled": misspelled(term)}[kind])
            rows.append((3 * i + len(kind) % 3, kind, " ".join(own)))
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, kind string, text string"), lexicon, weights).collect()
    share = {k: sum(r["toxicity"] >= 0.5 for r in got if r["kind"] == k) / len(clean) for k in ("clean", "exact", "misspelled")}
    # long texts with three misspelled words may stay under one half, as the labels have it
    assert share["clean"] <= 0.02 and share["exact"] >= 0.98 and share["misspelled"] >= 0.8, share
    match, terms = toxicity.Matcher(lexicon), ("idiot", "pathetic", "worthless", "trash", "clown", "disgusting")
    wrong = [w for w in (misspelled(t) for t in terms for _ in range(100)) if len(w) >= 5 and w not in terms]
    assert sum(bool(match[w]) and match[w][1] == 1 for w in wrong) >= 0.97 * len(wrong)


def test_keep_first_handles_nulls_repeats_and_extra_columns(spark):
    a, b, c = "one two three four five six", "quite another text that shares nothing", "a third text with words of its own"
    rows = [(3, a, "x"), (1, a, "y"), (1, a, "z"), (2, b, "x"), (None, b, "n"), (None, c, "n"), (None, c, "m"), (4, "", "e"), (5, None, "e")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", a), ("2", b), ("4", ""), ("None", c)]
    # unrelated texts that share an id each stay, whole repeats once, and reruns agree
    mixed = spark.createDataFrame([(7, a, "x"), (7, b, "x"), (7, b, "x"), (7, a + " and more", "y"), (None, c, "n")], "doc_id long, text string, _a string")
    got = sorted(simhash.keep_first(mixed).collect(), key=str)
    assert {r["text"] for r in got} >= {b, c} and len({r["text"] for r in got}) == len(got) and got == sorted(simhash.keep_first(mixed.repartition(3)).collect(), key=str)
    assert simhash.keep_first(spark.createDataFrame([], "doc_id long, text string, fp string")).count() == 0


def test_empty_tables(spark):
    from tidemark.llm import decontam

    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    assert simhash.near_duplicates(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert substring.deduplicate(none).count() == 0
    assert mixing.taken(mixing.sized(none)).count() == 0
    assert pii.redact(none).count() == 0
    assert tokens.counted(none).count() == 0
    assert quality.judged(none).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(none, *toxicity.train(none, labels)).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(none, items).count() == 0
    some = spark.createDataFrame([(1, "a few words of text here", "s", "en", 9)], none.schema)
    assert decontam.decontaminated(some, items).count() == 1


def test_decontamination_finds_planted_and_edited_passages(spark):
    from tidemark.llm import decontam

    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r["item_id"]: decontam.words(r["text"]) for r in bench.collect()}
    docs = {r["doc_id"]: decontam.words(r["text"]) for r in whole.select("doc_id", "text").collect()}
    joined = {d: b" ".join(w) for d, w in docs.items()}
    want = {(d, i) for i, w in items.items() for d, t in joined.items() if b" ".join(w) in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(whole, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2
    # a paraphrase: every eighth word of an item replaced, within another text
    text = next(r["text"] for r in bench.collect() if len(items[r["item_id"]]) >= 40).split()
    text = ["zzz" if i % 8 == 3 else w for i, w in enumerate(text)]
    host = next(t for t in joined.values() if 200 < len(t.split()) < 400).decode().split()
    edited = spark.createDataFrame([(1, " ".join(host[:90] + text + host[90:])), (2, " ".join(host)), (3, ""), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(whole.select("doc_id", "text").where("doc_id > 900").withColumn("doc_id", whole["doc_id"] + 10_000).union(edited), bench).collect() if r["doc_id"] < 10} == {1}


def test_toxicity_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon, weights = toxicity.train(docs, labels)
    out = toxicity.scored(docs.join(labels, "doc_id").where(held_out(docs["doc_id"])), lexicon, weights).collect()
    right = sum((r["toxicity"] >= 0.5) == (r["toxic"] == 1) for r in out)
    assert right >= 0.97 * len(out) and all(0 <= r["toxicity"] <= 1 for r in out)


def test_compression_bands_keep_prose_and_reject_repeats(spark):
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 1").collect()[0]["text"]
    rows = [(1, prose), (2, "abcdefgh " * 400), (3, "".join(chr(33 + (i * i * 7919 + i * 31) % 90) + (" " if i % 9 == 0 else "") for i in range(4000)))]
    got = {r["doc_id"]: r["quality"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[2]["whole_ratio"] < 0.05


def test_compression_bands_reject_noise_of_every_length(spark):
    import base64
    import random
    import string

    import zstandard

    rng, zip_ = random.Random(5), zstandard.ZstdCompressor(level=quality.LEVEL)
    for n in (250, 300, 400, 500, 800, 1000, 1500, 2000, 4000, 8000, 9000, 50_000):
        letters = " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(3, 9))) for _ in range(n // 4))[:n]
        coded = base64.b64encode(rng.randbytes(n)).decode()
        for noise in (letters, " ".join(coded[i : i + 8] for i in range(0, n, 8))[:n]):
            *_, kept, base_failed = quality.judge(noise, zip_)
            assert not kept and not base_failed, n
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    judged = [quality.judge(t, zip_)[-2:] for t in texts]
    passed = [kept for kept, base_failed in judged if not base_failed]
    assert len(passed) > 500 and sum(passed) >= 0.995 * len(passed)


def test_pipeline_stages_return_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900, None, "en", None, None), (901, "", None, "s", 0), (902, "12 !", "en", "s", 4), (0, docs.where("doc_id = 0").first()["text"], "fr", "src0", 1)], docs.schema)
    now = docs.union(odd)
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns and 0 < after.count() <= now.count(), name
        now = after
    assert now.where("doc_id >= 900").count() == 0
    last = p.STAGES[-1][1](spark, now, SF)
    assert last.count() == now.count() and abs(last.agg({"taken": "sum"}).first()[0] - 1.5 * last.agg({"size": "sum"}).first()[0]) < 25
    assert p.run(spark, SF).count() > 100


def test_very_long_texts(spark):
    from tidemark.llm import decontam

    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    item = bench.where("item_id = 0").first()["text"]
    filler = [f"w{i * 7919 % 50_021}x{i % 13}" for i in range(300_000)]
    long = " ".join(filler[:131_000]) + " " + item + " " + " ".join(filler[131_000:]) + " idiot general public license 4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, "short text", "en", "a", 10), (3, "x" * 2_000_000, "en", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()] == [(1, 0)]
    assert licenses.scan(docs).where("doc_id = 1").first()["n_base"] == 1
    assert "[CARD]" in pii.redact(docs).where("doc_id = 1").first()["text"][-20:]
    assert tokens.counted(docs).where("n_tokens > 0").count() == 3
    assert quality.judged(docs).count() == simhash.near_duplicates(docs).count() == substring.deduplicate(docs).count() == 3
    assert langid.identify(docs, langid.train(docs)).count() == 3
    lexicon = toxicity.Lexicon({"idiot": 1.0})
    assert toxicity.scored(docs, lexicon, toxicity.DEFAULT_WEIGHTS).where("doc_id = 1").first()["toxicity"] > 0.5
