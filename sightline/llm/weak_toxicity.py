"""Toxicity by weak supervision.

1. Voters. Words and word beginnings that are far more frequent in toxic than in clean labelled texts become lexicon voters, each
   with the count from which it votes; pattern voters look at the text as a whole (several hits, dense hits, no hit, shouting, marks).
2. Label model. A generative model with a hidden class estimates, without labels, how often each voter fires in either class
   (expectation maximisation), then the correlations between voters given the class; votes that repeat each other are discounted.
3. Classifier. Logistic regression on the votes, trained on the label model's posteriors, gives the score.

What is learned comes from a bounded sample (SAMPLE toxic and twice as many clean rows, by the hash of doc_id); every text is scored whole.

Edge cases: a null text counts as empty and scores as any text without hits does; labels that are null are not learned from; without toxic
or without clean rows there are no voters and every score is the share of toxic rows, at most 0.49; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bites, ddl, texts, with_columns

SAMPLE = 1500
#: Texts of the sample that one task gets.
TASK_ROWS = 300
CANDIDATES = 20_000
LEXICON = 72
BEGINNINGS = (5, 6, 7)
#: A voter's least G statistic: of CANDIDATES words that tell nothing, less than one reaches it by chance.
SURPRISE = 20.0
PATTERNS = ("2 different", "3 different", "dense", "very dense", "none", "shouting", "marks")
_WORD = regex.compile(r"\p{L}+")


def _counts(text: str) -> tuple[Counter, int]:
    words = _WORD.findall(text.lower())
    c = Counter(w for w in words if len(w) > 2)
    for w, n in list(c.items()):
        for k in BEGINNINGS:
            if len(w) > k:
                c[w[:k] + "*"] += n
    return c, len(words)


def _levels(n: int, words: int) -> tuple[bool, ...]:
    return True, n > 1, n > 2, n > 1 and n * 250 >= words


@dataclass(frozen=True)
class Lexeme:
    stem: str
    beginning: bool
    level: int


@dataclass
class Toxicity:
    lexicon: list[Lexeme]
    weights: np.ndarray
    bias: float


def surprise(p: int, n: int, toxic: int, clean: int) -> float:
    """The G statistic of a word in p of the toxic and n of the clean texts."""
    share = (p + n) / (toxic + clean)
    g = 0.0
    for seen, rows in ((p, toxic), (n, clean)):
        for a, e in ((seen, rows * share), (rows - seen, rows * (1 - share))):
            if a:
                g += 2 * a * math.log(a / e)
    return g


def mine(sample: DataFrame) -> list[Lexeme]:
    """Voters from sample(text, toxic), bounded in rows: candidates are counted in the toxic texts, then in all."""
    names = [f"{c}{k}" for c in "pn" for k in range(4)]
    schema = "feature string, " + ", ".join(f"{x} long" for x in names)

    def count(wanted: frozenset | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[str, list[int]] = {}
            for frame in frames:
                for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                    c, words = _counts(text if isinstance(text, str) else "")
                    for f in c if wanted is None else wanted.intersection(c):
                        row = found.setdefault(f, [0] * 8)
                        for k, yes in enumerate(_levels(c[f], words)):
                            row[k + (0 if toxic else 4)] += yes
            yield pd.DataFrame([(f, *r) for f, r in found.items()], columns=["feature", *names])

        return run

    total = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return []
    first = sample.where("toxic = 1").mapInPandas(count(None), schema).groupBy("feature").agg(F.sum("p0").alias("p0"))
    wanted = frozenset(r["feature"] for r in first.where(F.col("p0") >= max(3, total[True] // 250)).orderBy(F.desc("p0"), "feature").limit(CANDIDATES).collect())
    rows = sample.mapInPandas(count(wanted), schema).groupBy("feature").agg(*[F.sum(x).alias(x) for x in names]).collect()
    scored = []
    for r in rows:
        for k in range(4):
            p, n = (r[f"p{k}"] + 0.5) / (total[True] + 1), (r[f"n{k}"] + 0.5) / (total[False] + 1)
            if p >= 6 * n and r[f"p{k}"] >= max(3, total[True] // 250) and surprise(r[f"p{k}"], r[f"n{k}"], total[True], total[False]) >= SURPRISE:
                scored.append((p * math.log(p / n), r["feature"], k))
    chosen: dict[str, Lexeme] = {}
    for _, f, k in sorted(scored, reverse=True):
        stem = f.rstrip("*")
        if len(chosen) < LEXICON and not any(stem.startswith(x) or x.startswith(stem) for x in chosen):
            chosen[stem] = Lexeme(stem, f.endswith("*"), k)
    return list(chosen.values())


class Voters:
    def __init__(self, lexicon: list[Lexeme]):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(lexicon):
            self.automaton.add_word(x.stem, i)
        if lexicon:
            self.automaton.make_automaton()

    def votes(self, given: list[str]) -> np.ndarray:
        """A row of 0 and 1 for each text: the lexicon, then PATTERNS."""
        out = np.zeros((len(given), len(self.lexicon) + len(PATTERNS)), np.float32)
        for t, text in enumerate(given):
            low = text.lower()
            hits = [0] * len(self.lexicon)
            if self.lexicon:
                for end, i in self.automaton.iter(low):
                    x = self.lexicon[i]
                    begin = end - len(x.stem)
                    if (begin < 0 or not low[begin].isalpha()) and (end + 1 < len(low) and low[end + 1].isalpha()) == x.beginning:
                        hits[i] += 1
            words = low.count(" ") + low.count("\n") + 1 if any(hits) else 1
            n = 0
            for i, h in enumerate(hits):
                if h and _levels(h, words)[self.lexicon[i].level]:
                    out[t, i] = 1
                    n += 1
            total = sum(hits)
            caps = text.count("!!") * 8 > len(text) / 8
            out[t, len(hits) :] = (n > 1, n > 2, n and total * 150 >= words, n and total * 50 >= words, n == 0, bool(text) and text.isupper(), caps)
        return out


def label_model(votes: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior probabilities of the toxic class for rows of votes, without labels."""
    lexical = votes[:, : -len(PATTERNS)]
    q = np.where(lexical.any(axis=1), 0.9, 0.05)
    weight = np.ones(votes.shape[1])
    for stage in range(2):
        for _ in range(rounds):
            rates = [(votes * p[:, None]).sum(axis=0) + 0.5 for p in (q, 1 - q)]
            a, b = rates[0] / (q.sum() + 1), rates[1] / ((1 - q).sum() + 1)
            a, b = np.clip(a, 1e-4, 1 - 1e-4), np.clip(b, 1e-4, 1 - 1e-4)
            prior = np.clip(q.mean(), 0.01, 0.99)
            z = math.log(prior / (1 - prior)) + votes @ (weight * np.log(a / b)) + (1 - votes) @ (weight * np.log((1 - a) / (1 - b)))
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if stage == 0:  # correlations given the class: what a vote shares with others counts less
            r = votes - (q[:, None] * a + (1 - q[:, None]) * b)
            c = r.T @ r / len(r)
            s = np.sqrt(np.diag(c)) + 1e-9
            weight = 1 / (np.clip(c / s[:, None] / s[None, :], 0, 1) ** 2).sum(axis=1).clip(1)
    return q


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Newton's method on soft labels."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """Learns from docs(doc_id, text) and labels(doc_id, toxic)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(2 * sample))
    rows = rows.select(F.col("doc_id").alias("__id"), "toxic")
    known_texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "__id").select("text", "toxic").repartition(-(-3 * sample // TASK_ROWS))
    known_texts = known_texts.persist()
    try:
        lexicon = mine(known_texts)
        if not lexicon:
            return Toxicity([], np.zeros(len(PATTERNS)), min(0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3))) - 0.04)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            voters = Voters(lexicon)
            for frame in frames:
                yield pd.DataFrame({"v": [x.tobytes() for x in voters.votes(list(frame["text"])).astype(np.uint8)]})

        votes = np.array([np.frombuffer(r["v"], np.uint8) for r in known_texts.select("text").mapInPandas(run, "v binary").limit(3 * sample + 10).collect()], float)
    finally:
        known_texts.unpersist()
    q = label_model(votes)
    weights, bias = logistic(votes, q)
    had = min(0.99, max(0.01, min(sample, total[1]) / (min(sample, total[1]) + min(2 * sample, total[0]))))
    share = min(0.99, max(0.005, share))
    return Toxicity(lexicon, weights, bias + math.log(share / (1 - share)) - math.log(had / (1 - had)))


def predict(docs: DataFrame, model: Toxicity, chars: int = 1 << 21) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int), from text alone; columns of those names are replaced."""
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model.lexicon)
        for batch in bites(batches, "text", chars):
            z = voters.votes(texts(batch)) @ model.weights + model.bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield with_columns(batch, {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32), pa.int32())})

    return docs.mapInArrow(run, f"{ddl(docs)}, score double, predicted int")
