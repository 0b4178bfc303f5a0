"""Language identification by a byte convolutional network, trained here in numpy.

The network reads a window of WINDOW bytes: filters of widths 2, 3 and 4 slide over byte embeddings of their own,
each filter's largest response over the window goes through a rectifier, and a softmax layer gives the languages. A
text's probabilities are the mean over all its windows, weighted by their bytes, so every byte of every text counts;
a last window that is short is filled with spaces. Because a filter is a sum of one vector per byte and
offset, responses over two neighbouring bytes are looked up in tables of 65,536 rows.

Training takes at most `per_language` texts of each language (those whose hash of id and seed comes first), and
`windows_per_text` evenly spaced windows of each, with Adam on cross-entropy; seeds are fixed, so reruns agree. Only
text and language are learned from; source and id are never inputs. All languages
found are learned; texts shorter than a window are filled with spaces, as in prediction.

Defined cases. A text that is null or has no letter is `und` with score 0. If no labelled row may be learned from, all
texts are `und`. A null id counts as not held out, and hashes as an empty string. Repeated rows give their rows again. Ids may be of
any type. Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.chunks import bytes_of

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
UNDETERMINED = "und"
#: Windows that are predicted together.
BATCH = 2048


class Network:
    """Filters (width: [width, 256, FILTERS]), their biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.params = {f"f{w}": rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.params |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.params |= {"out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), "bias": np.zeros(len(languages), np.float32)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Probabilities, features and the places of the maxima, for windows x (uint8 [n, WINDOW])."""
        features, places = [], []
        for w in WIDTHS:
            f = self.params[f"f{w}"]
            size = x.shape[1] - w + 1
            response = sum(f[k][x[:, k : k + size]] for k in range(w))
            place = response.argmax(axis=1)
            places.append(place)
            features.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0] + self.params[f"b{w}"])
        h = np.maximum(np.concatenate(features, 1), 0)
        return _softmax(h @ self.params["out"] + self.params["bias"]), h, places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, places = self.forward(x)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        grads = {"out": h.T @ d, "bias": d.sum(0)}
        dh = (d @ self.params["out"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            mine = dh[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"b{w}"] = mine.sum(0)
            g = np.zeros_like(self.params[f"f{w}"])
            for k in range(w):
                np.add.at(g[k], (x[rows, places[i] + k], np.arange(FILTERS)[None, :]), mine)
            grads[f"f{w}"] = g
        return grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        t, (m, v) = 0, ({k: np.zeros_like(p) for k, p in self.params.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                t += 1
                for k, g in self.gradients(x[order[a : a + batch]], y[order[a : a + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to two neighbouring bytes, as rows (first byte * 256 + second): first parts, and what follows two bytes on."""
        f2, f3, f4 = (self.params[f"f{w}"] for w in WIDTHS)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(f2[0], f2[1]), pair(f3[0], f3[1]), pair(f4[0], f4[1])], 1), np.ascontiguousarray(f3[2]), pair(f4[2], f4[3])

    def predict(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Probabilities of windows, by table lookups."""
        first, third, second = tables
        n = x.shape[1]
        two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        head = first[two]
        top = [head[:, :, :FILTERS].max(1)]
        top.append((head[:, : n - 2, FILTERS : 2 * FILTERS] + third[x[:, 2:]]).max(1))
        top.append((head[:, : n - 3, 2 * FILTERS :] + second[two[:, 2:]]).max(1))
        h = np.concatenate([t + self.params[f"b{w}"] for t, w in zip(top, WIDTHS, strict=True)], 1)
        return _softmax(np.maximum(h, 0) @ self.params["out"] + self.params["bias"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, their bytes in the text, and the text of each."""
    sizes = np.diff(offs)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[text] + nth * WINDOW
    return start, np.minimum(WINDOW, offs[text + 1] - start), text


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Windows as rows, filled with spaces."""
    at = start[:, None] + np.arange(WINDOW)
    x = data[np.minimum(at, len(data) - 1)]
    x[np.arange(WINDOW) >= size[:, None]] = 32
    return x


def is_held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 300, windows_per_text: int = 6, seed: int = 11) -> Network | None:
    """A network trained on the given rows; None if none has a language and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # Rows whose hash is below a share set by the language's count: four times the bound, so that it is nearly always met.
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.xxhash64("text")), F.lit(1 << 52)) / float(1 << 52)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 4.0 * per_language / n)) for lang, n in sizes.items()], "lang string, share double")
    chosen = rows.withColumn("place", place).join(F.broadcast(shares), "lang").filter(F.col("place") <= F.col("share"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("place", "id"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(windows_per_text - 1)), lambda k: F.substring(F.col("text").cast("binary"), (k * F.greatest(F.lit(0), F.octet_length("text") - WINDOW) / max(1, windows_per_text - 1)).cast("int") + 1, F.lit(WINDOW)))
    taken = chosen.select("lang", "place", "id", F.array_distinct(spaced).alias("parts")).withColumn("nth", nth).filter(F.col("nth") <= per_language).orderBy("lang", "nth").select("lang", "parts").collect()
    languages = sorted({r["lang"] for r in taken})
    pieces = [(bytes(p), languages.index(r["lang"])) for r in taken for p in r["parts"] if len(p)]
    if not pieces:
        return None
    x = np.full((len(pieces), WINDOW), 32, np.uint8)
    for i, (p, _) in enumerate(pieces):
        x[i, : len(p)] = np.frombuffer(p, np.uint8)
    net = Network(languages)
    net.train(x, np.array([k for _, k in pieces]))
    return net


def _predictor(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            column = batch.column(2)
            offs, data = bytes_of(column)
            start, size, text = windows_of(offs, data)
            sums = np.zeros((batch.num_rows, len(net.languages)))
            for a in range(0, len(start), BATCH):
                b = slice(a, a + BATCH)
                np.add.at(sums, text[b], net.predict(cut(data, start[b], size[b]), tables) * size[b, None])
            known = batch.column(3).to_numpy(zero_copy_only=False)
            best = sums.argmax(axis=1)
            score = sums[np.arange(len(best)), best] / np.maximum(sums.sum(axis=1), 1e-300)
            names = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], names=["id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), letters.alias("known"))
    if net is None:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predictor(net), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    return predict(docs, fit(docs.filter(~is_held_out(F.col(id_col))), text_col, lang_col, id_col, **options), id_col, text_col)
