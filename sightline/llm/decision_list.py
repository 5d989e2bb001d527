"""Quality rules: learned decision lists over text statistics, as ordered Spark conditional expressions.

Everything on the main path is a DataFrame expression. Statistics of a text need no shuffle: repeated three-word windows are found
inside the row, by sorting window hashes that carry their positions.

Edge cases: a null text counts as one without words (all statistics 0, base_failed true); labels that are null are not learned
from; a table without labels gives a list without rules, which keeps what the base rules keep; repeated rows are judged each;
extra columns of the input pass through `annotate`, except those of the names in STATISTICS, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import quoted

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_marks"]
#: What conditions may compare: a ratio of two statistics, or one of them.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "caps_share": ("n_caps", "word_chars"), "marks_per_word": ("n_marks", "n_words"), "words": ("n_words", None),
}
SAMPLE_ROWS = 20_000


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns STATISTICS (longs): counts over the whole text; its other columns stay."""
    own = [c for c in docs.columns if c not in STATISTICS]
    # Columns go by numbers, so none of docs' names meets one of those made here.
    keep = [f"c{n}" for n in range(len(own))]
    d = docs.select(*[F.col(quoted(c)).alias(k) for c, k in zip(own, keep, strict=True)], F.coalesce(F.col(quoted(text)), F.lit("")).alias("__text"))
    d = d.select(*keep, "__text", F.expr(r"regexp_extract_all(__text, '[^\\x20\\x09-\\x0D]+', 0)").alias("__words"), F.expr(r"filter(split(__text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("__lines"))
    spaces = F.length(F.regexp_replace("__text", WORD, ""))
    left = lambda chars: F.length(F.regexp_replace("__text", f"[^{chars}]+", ""))
    d = d.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        (F.length("__text") - spaces).cast("long").alias("word_chars"),
        left(r"#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        left("A-Z").cast("long").alias("n_caps"),
        left(r"!?\[\]{}=").cast("long").alias("n_marks"),
        "__words",
        # The high 36 bits of a window's hash and its position: equal windows are neighbours once sorted.
        F.expr("sort_array(slice(transform(__words, (x, i) -> (xxhash64(x, get(__words, i + 1), get(__words, i + 2)) & -268435456L) | i), 1, greatest(size(__words) - 2, 0)))").alias("__packed"),
    )
    near = lambda d: f"coalesce(shiftright(get(__packed, i {d} 1), 28) = shiftright(x, 28), false)"
    others = [c for c in d.columns if c not in ("__packed", "__words")]
    d = d.select(*others, "__words", F.expr(f"transform(filter(__packed, (x, i) -> {near('-')} or {near('+')}), x -> int(x & 268435455L))").alias("__maybe"))
    d = d.select(*others, F.expr("sort_array(transform(__maybe, i -> struct(xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)) as h, i as i)))").alias("__exact"))
    same = lambda d: f"coalesce(get(__exact, i {d} 1).h = x.h, false)"
    d = d.select(*others, F.expr(f"sort_array(transform(filter(__exact, (x, i) -> {same('-')} or {same('+')}), x -> x.i))").alias("__at"))
    repeated = F.expr("aggregate(__at, struct(-3 as last, 0L as total), (a, p) -> struct(p as last, a.total + least(3, p - a.last) as total), a -> a.total)")
    d = d.select(*others, repeated.alias("n_repeat_words"))
    # Through a generator no filter is pushed: else one on a statistic would nest all these expressions and evaluate them for each element.
    return d.select(*[F.col(k).alias(c) for c, k in zip(own, keep, strict=True)], F.inline(F.array(F.struct(*STATISTICS))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def column(self) -> Column:
        top, bottom = RATIOS[self.ratio]
        value = F.col(top).cast("double")
        if bottom:
            value = F.when(F.col(bottom) > 0, value / F.col(bottom)).otherwise(0.0)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.ratio] >= self.threshold if self.above else x[self.ratio] < self.threshold

    def __str__(self) -> str:
        return f"{self.ratio} {'>=' if self.above else '<'} {self.threshold:g}"


def ratios(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (top, bottom) in RATIOS.items():
        a = np.asarray(rows[top], float)
        out[name] = np.divide(a, rows[bottom], out=np.zeros_like(a), where=np.asarray(rows[bottom]) > 0) if bottom else a
    return out


def _holds(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, *, precision: float = 0.9, least: int = 8, cuts: int = 48, most: int = 12) -> list[list[Condition]]:
    """Sequential covering: rules (conjunctions) that pick bad rows, in order. fold: true for rows that prune and judge a rule.

    A rule grows by the condition of the highest FOIL gain on the growing rows, until it covers no good row or nothing gains; it
    loses its last conditions while that doesn't lower (p - n) / (p + n) on the pruning rows; it is kept with `precision` there and
    over all rows left, covering `least` bad ones. What it covers is taken out before the next. `most` bounds the list's length."""
    x, n = ratios(rows), len(bad)
    left, rules = np.ones(n, bool), []
    while len(rules) < most and (bad & left).sum() >= least:
        grow = left & ~fold
        rule: list[Condition] = []
        cover = grow.copy()
        while True:
            p0, n0 = (cover & bad).sum(), (cover & ~bad).sum()
            if not p0 or not n0 or len(rule) == 4:
                break
            best, gain = None, 1e-9
            for name, v in x.items():
                inside = v[cover & bad]
                for t in np.unique(np.quantile(inside, np.linspace(0, 1, cuts))):
                    for above in (True, False):
                        c = Condition(name, above, float(t))
                        h = cover & c.holds(x)
                        p1, n1 = (h & bad).sum(), (h & ~bad).sum()
                        if p1:
                            g = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain = c, g
            if best is None:
                break
            rule.append(best)
            cover &= best.holds(x)
        prune = left & fold
        worth = lambda r: (lambda h: ((h & bad).sum() - (h & ~bad).sum()) / max(1, h.sum()))(prune & _holds(r, x, n))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if not rule:
            break
        hit = left & _holds(rule, x, n)
        judged = hit & fold
        good_enough = lambda h: h.sum() and (h & bad).sum() >= precision * h.sum()
        if (hit & bad).sum() < least or not good_enough(hit) or (judged.any() and not good_enough(judged)):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """A decision list from labels(doc_id, quality: 0 is bad), over the whole texts of a sample of at most sample_rows labelled rows.

    The sample is the rows of the smallest hashes of doc_id; its statistics, a few numbers a row, are what the driver gets."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "__id")
    texts = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id")
    got = statistics(texts).where(~base_failed()).select("quality", (F.crc32(F.col("__id").cast("string")) % 3 == 0).alias("fold"), *STATISTICS).limit(2 * sample_rows).collect()
    if not got:
        return []
    rows = {c: np.array([r[c] for r in got], float) for c in STATISTICS}
    return learn(rows, np.array([r["quality"] == 0 for r in got]), np.array([r["fold"] for r in got]))


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """(kept, number of the rule that decided; 0 is the base rules, null none): ordered conditional expressions."""
    which, kept = F.when(base_failed(), F.lit(0)), F.when(base_failed(), F.lit(False))
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        which, kept = which.when(holds, F.lit(k)), kept.when(holds, F.lit(False))
    return kept.otherwise(F.lit(True)), which


def annotate(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs with STATISTICS, base_failed, kept and rule."""
    kept, which = verdict(rules)
    own = ("base_failed", "kept", "rule")
    d = statistics(docs.drop(*own))
    return d.withColumns({"base_failed": base_failed(), "kept": kept, "rule": which})
