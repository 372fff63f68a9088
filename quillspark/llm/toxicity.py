"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Voters are the words of a general lexicon in four languages, patterns of abuse, and terms found in the sample: words, and stems of
   4 to 7 letters, that occur nearly always together with a lexicon word or pattern, or nearly always in documents labelled toxic.
2. The label model knows only votes, not labels. Expectation maximisation gives each voter's accuracy and the share of toxic documents; voters whose
   votes stay correlated given the label (a stem and its longer form) form groups, and a group's members share one voice.
3. A logistic regression on the terms that tell the classes apart learns the posterior labels, so that it also weighs terms that no voter names.

Fitting uses at most `SAMPLE` labelled documents, drawn by a hash of doc_id, of copies the one of the least doc_id; scoring covers all. Terms are
counted by Spark, and only voters and features reach the driver with the sample. Labels, lang, source and doc_id are no features.

Defined cases: a null or empty text gets the score of no terms; texts of any length are read whole; a document with several label rows is
toxic if one says so; rows of labels without doc_id or verdict are ignored; without any usable label the lexicon alone votes; terms that tell equally
much go by name; repeated rows get the same score; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_batches, stored
from quillspark.llm.shingles import mix, shingles

#: Documents that the label model and the classifier are fitted on, at most.
SAMPLE = 12_000
#: Features of the classifier, at most: its size.
FEATURES = 512
#: Log likelihood ratio from which a term is no chance find, and the share of documents in which a found voter has to be right.
SURE, RIGHT = 14.0, 0.95
FOLDS = 5
#: Insults that vote in any corpus, by language, and patterns of abuse.
LEXICON = tuple(
    "clown disgusting dumb filthy fool freak garbage hate idiot idiotic imbecile jerk loser moron pathetic pig scum stupid subhuman trash ugly vermin worthless wretch "
    "abruti cretin crétin débile idiote imbécile minable ordure pourriture racaille salaud stupide vaurien "
    "abschaum arschloch blödmann depp dreckig dummkopf elend idioten schwachkopf trottel ungeziefer versager widerlich wertlos "
    "asqueroso basura desgraciado escoria estúpido imbécil inútil maldito miserable patético payaso tonto".split()
)
PATTERNS = {
    "told to go": r"\b(?:go to hell|shut up|get lost|drop dead)\b",
    "wished harm": r"\b(?:kill|hurt|hang) (?:yourself|yourselves|them all)\b",
    "hate of people": r"\b(?:i|we) (?:hate|despise) (?:you|them|those|these|all)\b",
    "you are": r"\byou(?:'re| are)? (?:all )?(?:an? |such an? |nothing but )?(?:disgrace|joke|waste|failure|animal|animals|liar|liars)\b",
    "nobody": r"\bnobody (?:likes|wants|needs) you\b",
    "shouting": r"!{3,}|[!?]{4,}",
}
#: First letters of a word that count as a term.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {f"<{name}>": re.compile(p) for name, p in PATTERNS.items()}


def terms(text: str | None) -> set[str]:
    """The distinct terms of a text; stems end in ``*``, patterns are in ``<>``."""
    low = (text or "").lower()
    words = set(_WORD.findall(low))
    return words.union((name for name, p in _PATTERNS.items() if p.search(low)), *({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        return scorer(self)(text)


def scorer(model: Model) -> Callable[[str | None], float]:
    """A function that scores texts: the sum of the weights of a text's terms, as a probability. Remembers which terms a word has."""
    weights, patterns = model.weights, [(name, p) for name, p in _PATTERNS.items() if name in model.weights]
    seen: dict[str, tuple[str, ...]] = {}

    def of(word: str) -> tuple[str, ...]:
        if len(seen) > 100_000:
            seen.clear()
        seen[word] = tuple(t for t in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if t in weights)
        return seen[word]

    def run(text: str | None) -> float:
        low = (text or "").lower()
        found = {t for w in set(_WORD.findall(low)) for t in (seen[w] if w in seen else of(w))}
        found.update(name for name, p in patterns if p.search(low))
        z = model.bias + sum(weights[t] for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return run


def label_model(votes: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of a 0/1 vote matrix (1: the voter fires), each voter's accuracy and share of a voice.

    A voter that doesn't fire abstains; a last voter, for class 0, fires where all others abstain. Accuracies are the shares of class 1
    among a voter's rows. Voters are independent given the label, but for groups: those whose votes keep a correlation above one half
    given the label share one voice. Expectation maximisation starts from the rule that any vote means class 1.
    """
    votes = np.concatenate([votes, ~votes.astype(bool).any(1, keepdims=True)], 1).astype(float)
    n, m = votes.shape
    post, voice, accuracy = np.where(votes[:, -1] > 0, 0.02, 0.9), np.ones(m), np.full(m, 0.5)
    logit = lambda p: np.log(p / (1 - p))
    for i in range(rounds):
        accuracy = np.clip((votes.T @ post + 0.5) / (votes.sum(0) + 1), 0.01, 0.995)
        share = np.clip(post.mean(), 0.001, 0.999)
        if i % 10 == 0:
            hit1, hit0 = votes.T @ post / (post.sum() + 1e-9), votes.T @ (1 - post) / ((1 - post).sum() + 1e-9)
            rest = votes - np.outer(post, hit1) - np.outer(1 - post, hit0)
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            voice = 1 / np.maximum(1, ((rest.T @ rest) / n / np.outer(spread, spread) > 0.5).sum(1))
        new = 1 / (1 + np.exp(-np.clip(votes @ (voice * (logit(accuracy) - logit(share))) + logit(share), -30, 30)))
        done, post = np.abs(new - post).max() < 1e-4, new
        if done:
            break
    return post, accuracy[:-1], voice[:-1]


def surprise(hits: Column, n: Column, share: float) -> Column:
    """How little chance explains ``hits`` of class 1 among ``n`` documents, as a log likelihood ratio."""
    p, q = F.least(F.greatest(hits / n, F.lit(1e-9)), F.lit(1 - 1e-9)), min(max(share, 1e-6), 1 - 1e-6)
    return n * (p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q)))


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton's method; both classes weigh the same in sum."""
    x = np.concatenate([x.astype(float), np.ones((len(x), 1))], 1)
    share = np.clip(target.mean(), 0.01, 0.99)
    weight = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + hold * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold), grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def _with_terms(rows: DataFrame, known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sample's rows and, for each, which of the known terms it holds."""
    place = {t: i for i, t in enumerate(known)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(place[t] for t in place.keys() & terms(x)), "<i4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["row", "terms"])

    got = in_batches(rows.select("row", "text"), step, "row long, terms binary").orderBy("row").collect()  # at most the sample's rows
    x = np.zeros((len(got), len(known)), bool)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["terms"], "<i4")] = True
    return np.array([r["row"] for r in got], np.int64), x


def _all_terms(rows: DataFrame) -> DataFrame:
    """(mark, seed, term) for every term of a text; seed says whether a lexicon word or pattern is among them."""
    seeds = frozenset([*LEXICON, *_PATTERNS])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(x)) for x in batch.column(1).to_pylist()]
            many = [len(f) for f in found]
            marks = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), many)))
            seed = np.repeat([not seeds.isdisjoint(f) for f in found], many).astype(bool)
            yield pa.RecordBatch.from_arrays([marks, pa.array(seed), pa.array([t for f in found for t in f], pa.string())], names=["mark", "seed", "term"])

    return in_batches(rows.select("mark", "text"), step, "mark double, seed boolean, term string")


def _without_copies(rows: DataFrame) -> DataFrame:
    """Of most texts that share half of their 3-word shingles the one of the least doc_id: copies would make chance words look like evidence."""
    salts = [np.uint64(1 + 2 * i) for i in range(2)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            own = [[int((mix(h * s) >> np.uint64(1)).min()) for s in salts] if len(h) else [-1 - (k or 0)] * 2 for k, h in zip(keys, shingles(texts, 3), strict=True)]
            cols = [pa.array([o[i] for o in own], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["row", "toxic", "text", "a", "b"])

    marked = in_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text"), step, "row long, toxic int, text string, a long, b long")
    for c in ("a", "b", "row"):
        one = F.min_by(F.struct("row", "toxic", "text", "a", "b"), F.struct("row", F.xxhash64("text"))).alias("_one")
        marked = marked.groupBy(F.col(c).alias("_key")).agg(one).select("_one.*")
    return marked.select("row", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    drawn = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` small rows, so the broadcast is bounded by the parameter
    rows = stored(_without_copies(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")), "toxicity-sample")
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    counts = _all_terms(rows.withColumn("mark", F.col("toxic").cast("double"))).groupBy("term").agg(F.sum("mark").alias("hits"), F.sum(F.col("seed").cast("double")).alias("seeds"), F.count("*").alias("n"))
    counts = stored(counts.where("n >= 4"), "toxicity-terms")
    share = counts.agg(F.max("seeds")).first()[0] or 0.0  # a bound on how many documents hold a seed
    found = lambda hits, s: (F.col(hits) > RIGHT * F.col("n")) & (surprise(F.col(hits), F.col("n"), s) > SURE)
    seed = F.col("term").isin([*LEXICON, *_PATTERNS])
    voters = [r["term"] for r in counts.where(seed | found("hits", (toxic or 0) / max(n, 1)) | found("seeds", share / max(n, 1))).orderBy("term").select("term").collect()]
    if not voters:
        return Model(dict.fromkeys(LEXICON, 4.0), -2.0)
    place, votes = _with_terms(rows, voters)
    post = label_model(votes)[0]
    # at most `sample` rows of two numbers
    labelled = rows.join(F.broadcast(spark.createDataFrame(list(zip(place.tolist(), post.tolist(), strict=True)), "row long, mark double")), "row")
    sums = _all_terms(labelled).groupBy("term").agg(F.sum("mark").alias("hits"), F.count("*").alias("n")).where("n >= 4").withColumn("_sure", F.round(surprise(F.col("hits"), F.col("n"), float(post.mean())), 6))
    chosen = sorted(r["term"] for r in sums.where(F.col("_sure") > SURE).orderBy(F.desc("_sure"), "term").limit(FEATURES).select("term").collect())
    _, x = _with_terms(rows, chosen)
    weights, bias = logistic(x, post)
    return Model(dict(zip(chosen, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text's score, and the held-out mark of every row. One pass; nothing is shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            scores = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return in_batches(rows, step, "doc_id long, held_out boolean, score double")


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows that score below ``most``, with all their columns."""
    place = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([of(t) < most for t in batch.column(place).to_pylist()], pa.bool_()))

    return in_batches(docs, step, docs.schema)
