"""Language identification by a convolutional network over bytes, trained in numpy.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one, so that no position of a filter is lost; the network takes
batches of windows. Each window: an embedding of each byte, filters of several widths, max pooling over the window, a softmax layer. A text's language is that of the
highest mean log-probability over its windows, weighted by the bytes that each window adds.

For scoring, the embedding and each filter column are folded into tables: a filter of width w is a sum of w table rows, and rows of
two neighbouring bytes are summed beforehand, so a position costs half as many lookups.

Edge cases: a null text, or one without a letter, gives `und` with score 0; so does every text if there are no labelled rows to
learn from. Any length of text is scored whole. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bites, ddl, texts, with_columns

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
ROWS_A_LANGUAGE = 700
STEPS = 250
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    languages: list[str]
    embedding: np.ndarray  # 257 x EMBEDDING; row 256 pads
    filters: list[np.ndarray]  # of each width: (width, EMBEDDING, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width: (offset, 1 or 2 bytes, table of their summed contributions)."""
        out = []
        for f in self.filters:
            one = [(self.embedding @ f[j]).astype(np.float32) for j in range(len(f))]
            parts, j = [], 0
            while j < len(one):
                if j + 1 < len(one):
                    parts.append((j, 2, np.ascontiguousarray((one[j][:, None, :] + one[j + 1][None, :, :]).reshape(-1, FILTERS))))
                    j += 2
                else:
                    parts.append((j, 1, one[j]))
                    j += 1
            out.append(parts)
        return out


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW byte values (256 pads the end), and how many bytes of the text each row adds."""
    step, n = WINDOW - max(WIDTHS) + 1, len(data)
    count = max(1, -(-(n - max(WIDTHS) + 1) // step))
    padded = np.full((count - 1) * step + WINDOW, 256, np.uint16)
    padded[:n] = np.frombuffer(data, np.uint8)[: len(padded)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    return rows, np.minimum(step, np.maximum(1, n - step * np.arange(count)))


def pooled(rows: np.ndarray, tables: list, biases: list[np.ndarray]) -> np.ndarray:
    """Max-pooled filter responses of each window (rows x all filters), before the rectifier."""
    pairs = rows[:, :-1].astype(np.int32) * 257 + rows[:, 1:]
    out = []
    for parts, bias in zip(tables, biases, strict=True):
        width = parts[-1][0] + parts[-1][1]
        n = rows.shape[1] - width + 1
        total = None
        for offset, size, table in parts:
            got = table.take((pairs if size == 2 else rows)[:, offset : offset + n], axis=0)
            total = got if total is None else np.add(total, got, out=total)
        out.append(total.max(axis=1) + bias)
    return np.concatenate(out, axis=1)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], *, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteCNN:
    """Adam on cross-entropy; the gradient of max pooling flows to the position that won."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS * len(WIDTHS)
    params = {"e": rng.normal(0, 0.3, (257, EMBEDDING)), "w": rng.normal(0, 0.1, (f, k)), "b": np.zeros(k)}
    for w in WIDTHS:
        params[f"f{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS))
        params[f"c{w}"] = np.zeros(FILTERS)
    params = {n: p.astype(np.float32) for n, p in params.items()}
    moments = {n: (np.zeros_like(p), np.zeros_like(p)) for n, p in params.items()}
    step = 0
    for _ in range(max(epochs, -(-STEPS * batch // max(1, len(rows))))):  # few rows are gone through more often
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            x, y = rows[order[s : s + batch]], labels[order[s : s + batch]]
            e = params["e"][x]  # batch x WINDOW x EMBEDDING
            parts, where = [], []
            for w in WIDTHS:
                n = x.shape[1] - w + 1
                r = sum(e[:, j : j + n] @ params[f"f{w}"][j] for j in range(w))
                at = r.argmax(axis=1)
                where.append(at)
                parts.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + params[f"c{w}"])
            h = np.concatenate(parts, axis=1)
            a = np.maximum(h, 0)
            p = np.exp(log_softmax(a @ params["w"] + params["b"]))
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads = {"w": a.T @ p, "b": p.sum(axis=0), "e": np.zeros_like(params["e"])}
            dh = (p @ params["w"].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                grads[f"c{w}"] = d.sum(axis=0)
                g = np.zeros_like(params[f"f{w}"])
                for j in range(w):
                    took = x[np.arange(len(y))[:, None], where[i] + j]  # batch x FILTERS: the byte under the filter
                    g[j] = np.einsum("bf,bfe->ef", d, params["e"][took])
                    np.add.at(grads["e"], took, d[:, :, None] * params[f"f{w}"][j].T[None])
                grads[f"f{w}"] = g
            step += 1
            for n, g in grads.items():
                m, v = moments[n]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[n] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return ByteCNN(languages, params["e"], [params[f"f{w}"] for w in WIDTHS], [params[f"c{w}"] for w in WIDTHS], params["w"], params["b"])


def fit(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> ByteCNN | None:
    """A network from the text and lang of docs; None if no row has both.

    It learns from a bounded sample: of each language about rows_a_language rows, by the hash of
    doc_id, and of each row one window at a place that the hash picks. The driver gets those windows only."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("rows")), F.lit(1_000_000)) / 1_000_000
    share = F.broadcast(docs.sparkSession.createDataFrame([(lang, min(1.0, 1.3 * rows_a_language / n)) for lang, n in counts.items()], "lang string, share double"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - WINDOW))
    sample = known.join(share, "lang").where(draw < F.col("share")).select("lang", F.substring(F.col("text"), (place + 1).cast("int"), F.lit(WINDOW)).alias("piece"), F.xxhash64("doc_id", F.lit("order")).alias("o"))
    got = sample.orderBy("o", "lang").limit(2 * rows_a_language * len(counts)).collect()
    languages = sorted(counts)
    x = np.full((len(got), WINDOW), 256, np.uint16)
    for i, r in enumerate(got):
        data = r["piece"].encode()[:WINDOW]
        x[i, : len(data)] = np.frombuffer(data, np.uint8)
    y = np.array([languages.index(r["lang"]) for r in got])
    return train(x, y, languages)


def scorer(model: ByteCNN | None, block: int = 192):
    """A function from a list of texts to (languages, scores)."""
    tables = model.tables() if model else []

    def score(given: list[str]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(given), [0.0] * len(given)
        if not model:
            return names, scores
        live = [i for i, t in enumerate(given) if _LETTER.search(t)]
        if not live:
            return names, scores
        cut = [windows(given[i].encode()) for i in live]
        rows, weight = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut]).astype(np.float64)
        logs = np.concatenate([log_softmax(np.maximum(pooled(rows[s : s + block], tables, model.biases), 0) @ model.weights + model.bias) for s in range(0, len(rows), block)])
        first = np.cumsum([0] + [len(c[0]) for c in cut])[:-1]
        mean = np.add.reduceat(logs * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
        best = mean.argmax(axis=1)
        p = np.exp(log_softmax(mean))
        for j, i in enumerate(live):
            names[i], scores[i] = model.languages[best[j]], float(p[j, best[j]])
        return names, scores

    return score


def predict(docs: DataFrame, model: ByteCNN | None, chars: int = 1 << 20) -> DataFrame:
    """docs with lang_pred and score, from text alone; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in bites(batches, "text", chars):
            names, scores = score(texts(batch))
            yield with_columns(batch, {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, f"{ddl(docs)}, lang_pred string, score double")
