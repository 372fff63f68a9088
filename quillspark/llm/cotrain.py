"""A quality classifier by co-training of two views.

View one sees only what a text is like (rates of symbols, repeats, lengths), view two only metadata (source, lang, size); both in
steps, so that counts of steps by class are all that a view's naive Bayes classifier needs. Each view learns from the labelled
documents; then, round after round, each labels every other document that it is sure of for the other view, and both count again. A
round is one scan of the stored steps, and only counts reach the driver. At the end each view's log odds are calibrated on labelled
documents that took no part, and add up, less the prior that both hold, to the score of every document: one SQL expression.

Labels are learned from all labelled rows outside the held-out fold, pseudo-labels come from all other documents; pseudo-labels weigh
as much as the labels in sum, at most.

Defined cases: null or empty texts and null metadata have steps of their own (0, "none"); texts of any length are read whole; a document with several
label rows is good only if all say so; a document counts in each of its rows; without both classes among the labels, or with an empty table,
every document scores 0.5; repeated rows get the same score; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.quality_rules import measures

ROUNDS, SURE = 4, 0.95
FOLDS = 5
#: Steps of a rate, and slots of hashed sources and languages.
STEPS, SOURCES, LANGS = 16, 64, 16

#: SQL over the measures of a text, each about 0 to 1.
TEXT_VIEW = {
    "symbols": "n_symbols / greatest(1, n_words)",
    "bangs": "n_bangs / greatest(1, n_words)",
    "repeats": "n_repeat_words / greatest(1, n_words)",
    "same_lines": "n_dup_lines / greatest(1, n_lines)",
    "word_length": "word_chars / greatest(1, n_words) / 20",
    "short": "1 / (1 + n_words / 10)",
    "capitals": "n_capitals / greatest(1, word_chars)",
    "stops": "n_stops / greatest(1, n_words)",
}
#: Slots of each feature of the two views.
WIDTH = {"text_view": [STEPS] * len(TEXT_VIEW), "meta_view": [SOURCES, LANGS, STEPS]}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _step(rate: Column) -> Column:
    """0 for nothing, then steps that are finer for low rates."""
    return F.when(rate <= 0, 0).otherwise(1 + F.least(F.lit(STEPS - 2), F.floor(F.sqrt(rate) * (STEPS - 1)))).cast("int")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the steps of both views: arrays ``text_view`` and ``meta_view``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    m = docs.select("doc_id", "source", "lang", "n_chars", text.alias("_t"), measures(F.col("text")).alias("_m"))
    without = lambda marks: (F.length("_t") - F.length(F.translate("_t", marks, ""))).alias
    m = m.select("doc_id", "source", "lang", "n_chars", "_m.*", without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")("n_capitals"), without(".,;:?")("n_stops"))
    slot = lambda c, n: F.pmod(F.xxhash64(F.coalesce(c, F.lit("none"))), F.lit(n)).cast("int")
    size = F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("double")) / 12
    return m.select(
        "doc_id",
        F.array(*[_step(F.expr(f"cast({sql} as double)")) for sql in TEXT_VIEW.values()]).alias("text_view"),
        F.array(slot("source", SOURCES), slot("lang", LANGS), _step(size * size)).alias("meta_view"),
    )


@dataclass(frozen=True)
class View:
    """Log odds of a naive Bayes classifier: a constant, and a row of weights for each feature, one for each step."""

    base: float
    weights: tuple[tuple[float, ...], ...]

    def odds(self, view: str) -> Column:
        rows = [F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col(view)[i] + 1) for i, w in enumerate(self.weights)]
        return sum(rows, F.lit(self.base))

    def scaled(self, slope: float, shift: float) -> View:
        return View(self.base * slope + shift, tuple(tuple(x * slope for x in w) for w in self.weights))


@dataclass(frozen=True)
class Model:
    """Both views, calibrated, and the log odds of a good document."""

    text_view: View
    meta_view: View
    prior: float


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def bayes(counts: dict[tuple[str, int, int, int, bool], int], view: str) -> View:
    """A view from counts by (view, feature, step, class, whether the label is a pseudo-label)."""
    total = lambda pseudo: sum(n for (v, i, _, _, p), n in counts.items() if v == view and i == 0 and p == pseudo)
    share = min(1.0, total(False) / max(total(True), 1))
    table = [np.zeros((2, w)) for w in WIDTH[view]]
    for (v, i, step, label, pseudo), n in counts.items():
        if v == view:
            table[i][label, step] += n * (share if pseudo else 1.0)
    size = table[0].sum(1)
    rows = []
    for t in table:
        p = (t + 1) / (size[:, None] + t.shape[1])
        rows.append(tuple(np.log(p[1] / p[0]).tolist()))
    return View(float(np.log((size[1] + 1) / (size[0] + 1))), tuple(rows))


def _counts(rows: DataFrame, labels: dict[str, tuple[Column, Column]]) -> dict[tuple[str, int, int, int, bool], int]:
    """Rows by view, feature, step and label; ``labels`` gives each view's label (null: none) and whether it is a pseudo-label."""
    def cells(view: str) -> Column:
        label, pseudo = labels[view]
        return F.transform(F.col(view), lambda s, i: F.struct(F.lit(view).alias("view"), i.alias("i"), s.alias("step"), label.alias("label"), pseudo.alias("pseudo")))

    each = [cells(v) for v in WIDTH]
    found = rows.select(F.explode(F.concat(*each)).alias("c")).select("c.*").where("label is not null").groupBy("view", "i", "step", "label", "pseudo").count()
    return {(r["view"], r["i"], r["step"], r["label"], r["pseudo"]): r["count"] for r in found.collect()}  # a row for each step and label


def platt(odds: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log odds fit the share of good documents; counts ``n`` for each value. The slope isn't negative."""
    if not len(odds) or len(set(good[n > 0].tolist())) < 2:
        return 1.0, 0.0
    x, w = np.stack([odds, np.ones(len(odds))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-3, 1e-6]), x.T @ (n * (p - good)) + np.array([1e-3, 1e-6]) * (w - [1.0, 0.0]))
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(feats: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """A model from stored `features` and labels (doc_id, quality), or None where the labels have one class only."""
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).withColumn("back", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4)
    rows = feats.join(known, "doc_id", "left")
    own = F.when(~F.col("back"), F.col("y"))
    counts = _counts(rows, {v: (own, F.lit(False)) for v in WIDTH})
    seen = [sum(n for (v, i, _, y, _), n in counts.items() if v == "text_view" and i == 0 and y == k) for k in (0, 1)]
    if not all(seen):
        return None
    views = {v: bayes(counts, v) for v in WIDTH}
    for _ in range(rounds):
        sure = lambda v: F.when(views[v].odds(v) > _logit(SURE), 1).when(views[v].odds(v) < -_logit(SURE), 0)  # noqa: E731, B023
        other = {"text_view": "meta_view", "meta_view": "text_view"}
        counts = _counts(rows, {v: (F.when(F.col("y").isNull(), sure(other[v])).otherwise(own), F.col("y").isNull()) for v in WIDTH})
        views = {v: bayes(counts, v) for v in WIDTH}
    kept = rows.where("back")
    out = {}
    for v in WIDTH:
        odds = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), views[v].odds(v))) * 8) / 8
        got = kept.select(odds.alias("z"), "y").groupBy("z", "y").count().collect()  # 481 values of two classes at most
        out[v] = views[v].scaled(*platt(*(np.array([float(r[c]) for r in got]) for c in ("z", "y", "count"))))
    return Model(out["text_view"], out["meta_view"], float(np.log(seen[1] / seen[0])))


def score(feats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score and kept for every row of `features`."""
    sig = lambda z: 1 / (1 + F.exp(-z))
    a, b, prior = (model.text_view.odds("text_view"), model.meta_view.odds("meta_view"), model.prior) if model else (F.lit(0.0), F.lit(0.0), 0.0)
    rows = feats.select("doc_id", held_out().alias("held_out"), a.alias("_a"), b.alias("_b"))
    total = sig(F.col("_a") + F.col("_b") - F.lit(prior))
    return rows.select("doc_id", "held_out", sig(F.col("_a")).alias("text_score"), sig(F.col("_b")).alias("meta_score"), total.alias("score"), (total >= 0.5).alias("kept"))
