"""Language identification by a byte convolutional network (operator 9)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, small_batches, table

#: Bytes of a window; the last window of a text is filled up with zero bytes, which no filter may start on.
WINDOW = 128
#: Training takes at most about this many labelled rows of each language, and so many windows of each row, of so many
#: languages, the commonest; of many languages fewer rows each, so that about MOST_WINDOWS windows come to the driver.
ROWS_PER_LANG, WINDOWS_PER_ROW, MOST_LANGS, MOST_WINDOWS = 600, 6, 200, 60_000
WIDTHS, FILTERS, EMBED, EPOCHS, RATE, BATCH = (2, 3, 4), 16, 12, 6, 0.004, 128
UNKNOWN = "und"
#: A filter's output where it may not start.
NEVER = np.float32(-1e9)


def windows(raw: bytes, width: int = WINDOW) -> np.ndarray:
    """All of a text's bytes as rows of fixed length; consecutive, so that none is left out."""
    n = max(1, -(-len(raw) // width))
    return np.frombuffer(raw.ljust(n * width, b"\0"), np.uint8).reshape(n, width)


class ByteCNN:
    """Embedding, filters of several widths, max pooling over the window, softmax. float32 throughout."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": rng.normal(0, 0.3, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.05, (FILTERS * len(WIDTHS), len(langs)))
        self.p["bias"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def tables(self) -> dict[int, np.ndarray]:
        """Per width, what each byte at each offset adds to each filter: a convolution becomes sums of table rows."""
        return {w: np.stack([self.p["emb"] @ self.p[f"k{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]) for w in WIDTHS}

    def pooled(self, x: np.ndarray, t: dict[int, np.ndarray]) -> np.ndarray:
        """Max-pooled, rectified filter outputs of windows x; a position counts only if it starts on a byte other than 0."""
        parts, padded = [], not x.all()
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            y = t[w][0][x[:, :n]]
            for j in range(1, w):
                y += t[w][j][x[:, j : j + n]]
            if padded:
                y[x[:, :n] == 0] = NEVER
            parts.append(y.max(axis=1) + self.p[f"b{w}"])
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def log_probs(self, x: np.ndarray, t: dict[int, np.ndarray] | None = None) -> np.ndarray:
        t = t or self.tables()
        z = np.concatenate([self.pooled(x[i : i + 64], t) for i in range(0, len(x), 64)]) @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteCNN:
        """Adam on the cross-entropy of windows, gradients through the arg max of each filter."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                b = order[at : at + BATCH]
                step += 1
                g = self.gradients(x[b], y[b])
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        e = self.p["emb"][x]
        pooled, best = [], []
        for w in WIDTHS:
            length = x.shape[1] - w + 1
            k = self.p[f"k{w}"]
            z = e[:, :length] @ k[:EMBED]
            for j in range(1, w):
                z += e[:, j : j + length] @ k[j * EMBED : (j + 1) * EMBED]
            z[x[:, :length] == 0] = NEVER
            at = z.argmax(axis=1)
            best.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
        a = np.concatenate(pooled, axis=1)
        h = np.maximum(a, 0)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        da = (d @ self.p["out"].T) * (a > 0)
        for i, w in enumerate(WIDTHS):
            dw, at = da[:, i * FILTERS : (i + 1) * FILTERS], best[i]
            k = self.p[f"k{w}"]
            g[f"b{w}"] = dw.sum(axis=0)
            dk = np.empty_like(k)
            rows = np.arange(n)[:, None]
            for j in range(w):
                ids = x[rows, at + j]
                picked = self.p["emb"][ids]
                dk[j * EMBED : (j + 1) * EMBED] = np.einsum("nfe,nf->ef", picked, dw)
                np.add.at(g["emb"], ids.ravel(), (dw[:, :, None] * k[j * EMBED : (j + 1) * EMBED].T[None]).reshape(-1, EMBED))
            g[f"k{w}"] = dk
        return g

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, langs: list[str], raw: bytes) -> ByteCNN:
        net = cls(langs)
        net.p = dict(np.load(io.BytesIO(raw)))
        return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_windows(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, per_row: int = WINDOWS_PER_ROW) -> DataFrame:
    """(lang, key, at, window) of a bounded sample of labelled rows that aren't held out: of each of the MOST_LANGS commonest
    languages, the rows whose hash falls in the fraction that gives rows_per_lang of them, and of each row per_row windows
    spread over the whole text, `at` being a window's number in it. Repeated rows count once; the windows with the smallest
    hashes stay if there are more than twice as many as meant. Rows without a letter or language give none."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    rows_per_lang = min(rows_per_lang, MOST_WINDOWS // (per_row * max(1, len(counts))))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, rows_per_lang / r["n"])).otherwise(share)
    mark = F.pmod(F.xxhash64("key", "text", F.lit(5)), F.lit(1_000_000)) / 1e6
    names = ["lang", "key", "at", "window"]

    def cut(batches):
        for batch in batches:
            out = []
            for lang, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if has_letter(text):
                    x = windows(text.encode("utf-8", "surrogatepass"))
                    for i in np.unique(np.linspace(0, max(0, len(x) - 2), per_row).astype(int)).tolist():
                        out.append((lang, key, i, x[i].tobytes()))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = labelled.where(mark < share).select("lang", "key", "text").distinct().mapInArrow(cut, "lang string, key string, at long, window binary")
    return found.orderBy(F.xxhash64(*names), *names).limit(2 * len(counts) * rows_per_lang * per_row)


def train(docs: DataFrame) -> ByteCNN | None:
    """A network fitted on training_windows(docs), of at most languages x rows x windows rows of 128 bytes; None if no row
    is labelled. The same rows give the same network."""
    small_batches(docs.sparkSession)
    rows = sorted((r["lang"], r["key"] or "", r["at"], bytes(r["window"])) for r in training_windows(docs).collect())
    langs = sorted({r[0] for r in rows})
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([langs.index(r[0]) for r in rows])
    return ByteCNN(langs).fit(x, y) if len(langs) > 1 else ByteCNN(langs)


def identify(docs: DataFrame, net: ByteCNN | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with lang_pred and lang_score, or columns of other names, which replace those of docs that have them.

    All windows of the whole text vote with their log probabilities; the score is the softmax of the votes' mean. Texts that are null or have no letter, and all texts if there is no network, give
    `und` with score 0. Rows are scored alone, so repeated rows agree; other columns stay as they are."""
    small_batches(docs.sparkSession)
    langs, raw = (net.langs, net.to_bytes()) if net else ([], b"")
    kept: dict = {}

    @F.arrow_udf("struct<lang_pred:string,lang_score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        if langs and "net" not in kept:
            kept["net"] = ByteCNN.from_bytes(langs, raw)
            kept["tables"] = kept["net"].tables()
        out = []
        for t in texts.to_pylist():
            if not langs or not has_letter(t):
                out.append({"lang_pred": UNKNOWN, "lang_score": 0.0})
                continue
            b = t.encode("utf-8", "surrogatepass")
            votes, n = np.zeros(len(langs)), 0
            for at in range(0, len(b), WINDOW << 9):  # so many bytes at once, whatever the text's length
                x = windows(b[at : at + (WINDOW << 9)])
                votes += kept["net"].log_probs(x, kept["tables"]).sum(axis=0)
                n += len(x)
            z = votes / n
            z = np.exp(z - z.max())
            k = int(z.argmax())
            out.append({"lang_pred": langs[k], "lang_score": float(z[k] / z.sum())})
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("lang_score", pa.float64())]))

    both = fresh(docs, "_lang")
    found = docs.withColumn(both, predict(F.col(text)))
    return found.withColumns({out[0]: F.col(both)["lang_pred"], out[1]: F.col(both)["lang_score"]}).drop(both)


def recognised(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """The rows of docs in whose text the network recognises a language, columns as they are. Without a network, because no
    row has a label, every text with a letter stays."""
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = fresh(docs, "_pred"), fresh(docs, "_score")
    return identify(docs, net, out=(pred, score)).where(F.col(pred) != UNKNOWN).drop(pred, score)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
