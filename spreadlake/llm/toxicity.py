"""Toxic passages by maximum-scoring segments over token log-odds (op6).

Training counts in how many labelled texts a word, or one of its beginnings, stands, by label.  A token's log-odds
between the labels are smoothed by a Dirichlet prior: PRIOR texts of each label that hold the token as often as all
texts do.  A token counts as evidence when its log-likelihood ratio would be expected less than CHANCE times in such a
vocabulary by chance, and scores its log-odds less one deviation.  In a text every token scores so, or a small loss
where it is no evidence; a linear-time scan finds all maximal segments.

Extreme-value statistics say how high the best segment of a clean text of that many words climbs: lambda comes from the
scores and their rates in clean texts, K from the best segments of clean texts.  A segment's excess over log(K n) is
summed over the text and turned into a probability by a logistic curve.  K and the curve are fitted on a part of the
sample that is kept back from choosing and scoring tokens, so they know how the tokens do on texts they have not seen.

The classifier is fitted on at most ``sample`` labelled rows of different texts, the smallest by hash; every
text is scored whole.  Neither labels nor any column but the text enter a score.

Defined results: a null or empty text scores as a text without evidence; without both labels in training all
texts score the share of label 1 (0 if there are no labels); label rows that are null or without a document
are not used, repeated label rows count once, with the greatest label; repeated documents are scored each; a
null id is scored and is not held out; equal scores stay equal; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record, text_blocks, texts_of
from .shared import cut

SAMPLE = 200_000  # labelled rows that the classifier is fitted on at most
BEGINNINGS = range(4, 10)  # lengths of word beginnings that count as tokens
PRIOR = 10.0  # weight of the Dirichlet prior, in texts of each label
LOSS = 0.5  # of a token that is no evidence
CHANCE = 0.1  # evidence expected by chance in the whole vocabulary
KEPT_BACK = 4  # one text in so many calibrates and takes no part in choosing tokens
EULER = 0.5772156649015329  # mean of the extreme-value law

WORDS = re.compile(r"\w+")


@dataclass
class Model:
    tokens: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda of the extreme-value law
    height: float = 1.0  # its K
    slope: float = 1.0
    bias: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        """Of a word's tokens the best score; 0 for none."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            get = self.tokens.get
            got = self.known[w] = max(get(w, 0.0), *(get(w[:n] + "*", 0.0) for n in BEGINNINGS))
        return got

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(first word, one past the last, score) of all maximal segments, and the number of words."""
        words = WORDS.findall(text.lower())
        hits = {w: s for w in set(words) if (s := self.word(w)) > 0}
        if not hits:
            return [], len(words)
        return maximal_segments([(i, s) for i, w in enumerate(words) if (s := hits.get(w))], LOSS), len(words)

    def floor(self, n_words: int) -> float:
        """How high lambda times the best score of a clean text of that length climbs."""
        return math.log(max(self.height * n_words, 1.0))

    def excess(self, passages: list[tuple[int, int, float]], n_words: int) -> float:
        floor = self.floor(n_words)
        return sum(max(0.0, self.scale * s - floor) for _, _, s in passages)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * math.log1p(x)))))


def maximal_segments(hits: list[tuple[int, float]], loss: float) -> list[tuple[int, int, float]]:
    """All maximal segments of a sequence that scores as given at the hits' positions, in ascending order, and -loss elsewhere.

    One pass with a stack: a candidate begins at a running sum and ends at another; it joins earlier ones while
    one of them begins lower and ends lower.
    """
    stack: list[list[float]] = []  # first, past the last, sum before, sum after
    total, last = 0.0, -1
    for at, score in hits:
        total -= loss * (at - last - 1)
        new = [at, at + 1, total, total + score]
        total, last = total + score, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(int(a), int(b), after - before) for a, b, before, after in stack]


COUNTED = pa.schema([("token", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _counts(texts: DataFrame) -> DataFrame:
    """token, toxic, clean: texts by label that hold a word, or words of a beginning; partial sums of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for block in text_blocks(batch, "text"):
                for y, text in zip(block.column("y").to_pylist(), texts_of(block, "text"), strict=True):
                    of[y].update(set(WORDS.findall(text.lower())))
                if len(of[0]) + len(of[1]) > 1_000_000:
                    yield from out(of)
                    of[0].clear(), of[1].clear()
        yield from out(of)

    def out(of: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        both = []
        for counts in of:
            more = Counter(counts)
            for w, n in counts.items():
                for k in BEGINNINGS:
                    if len(w) >= k:
                        more[w[:k] + "*"] += n
            both.append(more)
        names = list(both[0].keys() | both[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield record(COUNTED, part, [both[1][w] for w in part], [both[0][w] for w in part])

    return texts.select("y", "text").mapInArrow(run, "token string, toxic long, clean long")


def training_texts(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """y, back (kept back for calibration), text of the sample: labelled, not held out, one row for each different text."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = texts.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    chosen = cut(marked.groupBy("h").agg(F.min(F.struct("doc_id", "y")).alias("x")).select("x.*", "h").orderBy("h").limit(sample).select("doc_id", "y"))  # bounded, so it can be broadcast
    back = F.pmod(F.xxhash64("doc_id"), F.lit(KEPT_BACK)) == 0
    return texts.join(F.broadcast(chosen), "doc_id").withColumn("back", back)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Only evidence, the vocabulary's sums and a histogram reach the driver."""
    texts = training_texts(docs, labels, sample, id_col, text_col, label_col)
    n1, n0, m1, m0 = texts.agg(*[F.count_if((F.col("y") == y) & (F.col("back") == back)) for back in (False, True) for y in (1, 0)]).first()
    if not n1 or not n0 or not m1 or not m0:
        ones, rows = n1 + m1, n1 + n0 + m1 + m0
        share = ones / rows if rows else 0.0
        return Model(slope=0.0, bias=math.log(share / (1 - share)) if 0 < share < 1 else (50.0 if share else -50.0))
    counts = cut(_counts(texts.where("not back")).groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    size = counts.count()
    pi = n1 / (n1 + n0)
    y1, y0 = F.col("toxic").cast("double"), F.col("clean").cast("double")
    ratio = 2 * (y1 * F.log(F.greatest(y1, F.lit(1e-9)) / ((y1 + y0) * pi)) + y0 * F.log(F.greatest(y0, F.lit(1e-9)) / ((y1 + y0) * (1 - pi))))
    prior = PRIOR * (y1 + y0) / (n1 + n0)
    with1, with0 = y1 + prior, y0 + prior
    odds = F.log(with1 / F.nullif(n1 + PRIOR - with1, F.lit(0.0))) - F.log(with0 / F.nullif(n0 + PRIOR - with0, F.lit(0.0)))
    score = odds - F.sqrt(1 / with1 + 1 / with0)
    chosen = counts.where(y1 > (y1 + y0) * pi).where(ratio > 2 * math.log(max(size, 2) / CHANCE)).select("token", "clean", score.alias("s"))
    evidence = [(r["token"], r["s"], r["clean"]) for r in chosen.where(F.col("s") > LOSS).collect()]  # what does not outweigh one other word is none
    model = Model(tokens={t: s for t, s, _ in evidence})
    # The law of a clean text: scores of evidence at the rate at which it stands there, the loss elsewhere.
    words = counts.where("not endswith(token, '*')").agg(F.sum("clean")).first()[0] or 1
    rates = [(s, max(c, 0.5) / words) for t, s, c in evidence if not t.endswith("*")] or [(s, max(c, 0.5) / words) for _, s, c in evidence]
    model.scale = extreme_value(rates, LOSS)
    spark = docs.sparkSession
    kept = cut(_segments(texts.where("back"), spark.sparkContext.broadcast(model)))
    # The best score of n clean words has the mean (log(K n) + Euler's constant) / lambda.
    level = kept.where("y = 0 and n > 0").agg(F.avg(model.scale * F.col("best") - F.log("n"))).first()[0]
    model.height = math.exp(min(0.0, level - EULER)) if level is not None else 1.0
    floor = F.log(F.greatest(model.height * F.col("n"), F.lit(1.0)))
    excess = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), model.scale * x - floor))
    bins = kept.groupBy("y", F.round(F.log1p(excess), 1).alias("b")).agg(F.count("*").alias("n")).collect()  # as many rows as steps of a tenth
    model.slope, model.bias = logistic([(r["b"], r["y"], r["n"]) for r in bins])
    return model


def extreme_value(rates: list[tuple[float, float]], loss: float) -> float:
    """lambda: the positive root of E exp(lambda s) = 1. rates: scores with their chances; all other words cost the loss."""
    if not rates:
        return 1.0
    total = min(sum(p for _, p in rates), 0.5)

    def excess(x: float) -> float:
        return sum(p * math.exp(min(x * s, 500)) for s, p in rates) + (1 - total) * math.exp(-x * loss) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 100:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and bias by Newton's method, with a weak penalty."""
    x, y, n = (np.array(v, dtype=float) for v in zip(*bins, strict=True))
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (y - p)) - 1e-3 * w
        h = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _segments(texts: DataFrame, shared) -> DataFrame:
    """y, n (words), best, scores of the segments of each text."""
    schema = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in text_blocks(batch, "text"):
                got = [model.passages(t) for t in texts_of(block, "text")]
                scores = [[s for *_, s in found] for found, _ in got]
                yield record(schema, block.column("y"), [n for _, n in got], [max(x, default=0.0) for x in scores], scores)

    return texts.select("y", "text").mapInArrow(run, "y int, n long, best double, scores array<double>")


PASSAGE = pa.list_(pa.struct([("first_word", pa.int64()), ("past_word", pa.int64()), ("score", pa.float64())]))
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", PASSAGE)])


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, passages: those that climb higher than a clean text of that length would."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in text_blocks(batch, "text"):
                scores, found = [], []
                for text in texts_of(block, "text"):
                    got, n = m.passages(text)
                    scores.append(m.probability(m.excess(got, n)))
                    floor = m.floor(n)
                    found.append([{"first_word": a, "past_word": b, "score": s} for a, b, s in got if m.scale * s > floor])
                yield record(SCORED, block.column("doc_id"), scores, pa.array(found, type=PASSAGE))

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, score double, passages array<struct<first_word: long, past_word: long, score: double>>")
