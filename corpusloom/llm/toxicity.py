"""Operator 2: toxicity by weak supervision.

Voters are groups of lexicon words and of word-start patterns, found on labelled training rows and
joined by a fixed word list. A generative label model over the voters' firing patterns of all
training documents (expectation maximisation, human labels as anchors) estimates how often each
voter fires in toxic and in clean texts, and how voters go together; correlated voters count for
less. A linear classifier is then trained on its posterior labels of all training documents, with
and without a human label, and scores every text. It sees voters and three graded measures, so the
documents of one pattern are one weighted row, and all of them are at most 3 x 2**21 rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

#: Bound of the labelled rows that voters and classifier are fitted on; terms in the lexicon.
MAX_LABELLED, MAX_TERMS = 20_000, 240
WORD_GROUPS, START_GROUPS, STARTS = 5, 5, (4, 6)
VOTERS = WORD_GROUPS + START_GROUPS + 2
#: Used where labels teach nothing else.
SEED_WORDS = ("bastard", "disgusting", "dumb", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    words: dict[str, int]
    starts: dict[str, int]
    prior: float
    fires: np.ndarray  # VOTERS x 2: how often each voter fires in clean and toxic texts
    weights: np.ndarray  # of voters, less for those that go together
    linear: np.ndarray


def terms_of(text: str) -> tuple[set[str], set[str], int]:
    """Distinct lower-cased words of letters, starts of the longer ones, and the number of words."""
    found = _WORDS(text.lower())
    words = set(found)
    return words, {w[:k] for k in STARTS for w in words if len(w) > k}, len(found)


def votes(text: str, words: dict[str, int], starts: dict[str, int]) -> int:
    """A text's pattern: firing voters as bits, then grades (0 to 7) of hits, distinct hits and hits per word."""
    own, begin, n = terms_of(text)
    hit_words, hit_starts = own.intersection(words), begin.intersection(starts)
    mask = 0
    for w in hit_words:
        mask |= 1 << words[w]
    for s in hit_starts:
        mask |= 1 << WORD_GROUPS + starts[s]
    if not mask:
        return 0
    low = text.lower()
    hits = sum(low.count(w) for w in hit_words) + sum(low.count(s) for s in hit_starts)
    distinct = len(hit_words) + len(hit_starts)
    if distinct >= 2:
        mask |= 1 << VOTERS - 2
    if hits * 40 >= n:
        mask |= 1 << VOTERS - 1
    grades = min(7, int(2 * math.log2(1 + hits))), min(7, distinct), min(7, 350 * hits // n)
    return mask | sum(g << VOTERS + 3 * k for k, g in enumerate(grades))


def bits_of(patterns: np.ndarray) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)


def features(patterns: np.ndarray) -> np.ndarray:
    hits, distinct, share = ((patterns >> VOTERS + 3 * k & 7) for k in range(3))
    return np.concatenate([np.ones((len(patterns), 1)), bits_of(patterns), np.stack([hits * math.log(2) / 2, np.log1p(distinct), share / 7], 1)], 1)


def choose_terms(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> tuple[dict[str, int], dict[str, int]]:
    """(term, is a start, toxic and clean documents with it) to lexicon words and starts, each with its group.

    A term is taken if the lower bound of the share of toxic among its documents, classes weighted
    alike, is 0.75 at least. Groups go by strength, so that weak terms vote together."""
    strong: dict[bool, list[tuple[float, str]]] = {False: [], True: []}
    for term, start, t, c in counts:
        p = (t / max(toxic, 1)) / max(t / max(toxic, 1) + (c + 0.5) / max(clean, 1), 1e-12)
        low = p - 1.6 * np.sqrt(p * (1 - p) / t + 0.25 / t**2)
        if low >= 0.75:
            strong[start].append((float(low) * np.log1p(t), term))
    out = []
    for start, groups in ((False, WORD_GROUPS), (True, START_GROUPS)):
        best = sorted(strong[start], key=lambda x: (-x[0], x[1]))[: MAX_TERMS // 2]
        out.append({term: min(groups - 1, k * groups // max(1, len(best))) for k, (_, term) in enumerate(best)})
    for w in SEED_WORDS:
        out[0].setdefault(w, 0)
    return out[0], out[1]


def label_model(patterns: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior, firing rates and weights from patterns; labels: 1, 0, or -1 where unknown."""
    bits = bits_of(patterns)
    posterior = np.where(labels >= 0, labels, np.where(bits.sum(1) >= 2, 0.9, np.where(bits.sum(1) > 0, 0.3, 0.02))).astype(float)
    prior, fires, weights = 0.1, np.full((VOTERS, 2), 0.1), np.ones(VOTERS)
    for _ in range(rounds):
        w1, w0 = counts * posterior, counts * (1 - posterior)
        prior = float((w1.sum() + 1) / (counts.sum() + 10))
        fires = np.stack([(w0 @ bits + 0.5) / (w0.sum() + 5), (w1 @ bits + 0.5) / (w1.sum() + 1)], 1)
        linked = np.zeros((VOTERS, VOTERS))
        for w, k in ((w0, 0), (w1, 1)):  # correlations within each class
            centred = bits - fires[:, k]
            cov = (centred * w[:, None]).T @ centred / max(w.sum(), 1)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            linked += np.clip(cov / np.outer(spread, spread), 0, 1) / 2
        np.fill_diagonal(linked, 0)
        weights = 1 / (1 + linked.sum(1))
        new = np.where(labels >= 0, labels, _posterior(bits, prior, fires, weights))
        done, posterior = np.abs(new - posterior).max(initial=0) < 1e-6, new
        if done:
            break
    return prior, fires, weights


def _posterior(bits: np.ndarray, prior: float, fires: np.ndarray, weights: np.ndarray) -> np.ndarray:
    on, off = np.log(fires[:, 1] / fires[:, 0]), np.log((1 - fires[:, 1]) / (1 - fires[:, 0]))
    odds = np.log(prior / (1 - prior)) + bits @ (weights * on) + (1 - bits) @ (weights * off)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_linear(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels, each row standing for so many, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge, x.T @ (counts * (p - soft)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from texts and labels of the rows outside the held-out fold (crc32(doc_id) mod 3 = 1).

    The lexicon is found on ``max_labelled`` labelled rows at most, chosen by a hash of the id, which are
    also the anchors; label model and classifier see the patterns of all rows of ``docs`` outside the
    fold. Several labels of one id: the highest counts. Labels but 0 and 1, and null ids, teach nothing.
    Repeated rows count each. A null text is empty, a long one is read whole. Without labels the seed
    words vote, without documents fixed weights stand."""
    fold = common.crc_bucket("doc_id", 3) != 1
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & fold).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = [(r.doc_id, r.toxic) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()]
    chosen = docs.sparkSession.createDataFrame(sample, "_label_doc long, _toxic int")
    texts = docs.where(fold).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = texts.join(F.broadcast(chosen), texts.doc_id == chosen["_label_doc"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[Counter, Counter]] = {0: (Counter(), Counter()), 1: (Counter(), Counter())}
        total = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, starts, _ = terms_of(text)
                seen[toxic][0].update(words)
                seen[toxic][1].update(starts)
                total[toxic] += 1
        rows = [(w, s, *((n, 0) if toxic else (0, n))) for toxic, both in seen.items() for s, c in enumerate(both) for w, n in c.items()]
        rows.append(("", 2, total[1], total[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["term", "start", "t", "c"])

    found = marked.select("text", "_toxic").mapInArrow(common.tidy(terms), "term string, start int, t long, c long").groupBy("term", "start").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    toxic = sum(x for _, x in sample)
    # at least 1 % of the toxic rows have a term that is kept, and most of its rows are toxic: a few thousand terms at most
    least = max(3, toxic // 100)
    kept = found.where((F.col("start") == 2) | (F.col("t") >= least) & (F.col("t") * max(1, len(sample) - toxic) >= F.col("c") * max(1, toxic))).collect()
    total = next(((r.t, r.c) for r in kept if r.start == 2), (0, 0))
    words, starts = choose_terms([(r.term, r.start == 1, r.t, r.c) for r in kept if r.start != 2], *total)

    voted = texts.join(F.broadcast(chosen), texts.doc_id == chosen["_label_doc"], "left").select("text", F.coalesce("_toxic", F.lit(-1)).alias("label"))

    def patterns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update((votes(t, words, starts), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "label", "n"])

    found = voted.mapInArrow(common.tidy(patterns_of), "pattern int, label int, n long").groupBy("pattern", "label").agg(F.sum("n").alias("n")).orderBy("pattern", "label").collect()
    patterns, counts, label = (np.array([r[k] for r in found], np.int64) for k in ("pattern", "n", "label"))
    prior, fires, weights = label_model(patterns, counts, label)
    p = _posterior(bits_of(patterns), prior, fires, weights)
    odds = np.log(p / (1 - p)) + np.where(label < 0, 0, np.where(label == 1, 1, -1)) * np.log(19)  # a label errs once in 20
    soft = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    linear = fit_linear(features(patterns), soft, counts) if len(found) else np.concatenate(([-4.0], np.zeros(VOTERS), [1.5, 2.5, 1.0]))
    return Model(words, starts, prior, fires, weights, linear)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``docs``, then toxic_score (double, 0 to 1), for each row by itself. A null text is empty, a
    long one is read whole. A column of that name is replaced. An empty table gives an empty table."""
    kept = common.fields_without(docs, ["toxic_score"])
    out = T.StructType([*kept, T.StructField("toxic_score", T.DoubleType())])
    at = [f.name for f in kept].index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = np.array([votes(t, model.words, model.starts) for t in common.as_texts(batch.column(at))], np.int64)
            s = 1 / (1 + np.exp(-np.clip(features(patterns) @ model.linear, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=out.names)

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(common.tidy(scored), out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (common.crc_bucket("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
