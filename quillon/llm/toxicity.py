"""Toxicity by maximum-scoring segments over token log-odds.

Learning. Every word has features: itself and its first 4, 5 and 6 characters. Each feature's
log-odds between toxic and other training documents carries an informative Dirichlet prior
proportional to its document frequency in the whole corpus (Monroe, Colaresi & Quinn, 2008);
its weight is the bound of its 95 % confidence interval that lies nearer to 0, with its sign,
and 0 if the interval holds 0. A word weighs as much as its largest positive feature, else as
its most negative one. The training sample is bounded (``SAMPLE`` labelled documents by hash
order) and holds one document of each family of near copies (documents that share their
smallest hashed word triple), so that a copied text does not make its words toxic. The lexicon
holds every feature with a weight; it grows with that sample only.

Scoring. A text is a sequence of signed word weights, those that are not positive lowered by
the drift that makes ordinary text lose score; the r-th occurrence of a word in a text counts
1/r, as repeats of one word are weaker evidence. One linear scan with back pointers (Ruzzo &
Tompa, 1999) finds all maximal scoring segments. A segment of score S in a text of n words has
the expectation ``E = K n exp(-lambda S)`` (Karlin & Altschul, 1990). Both parameters are
estimated from the non-toxic training texts: lambda as the positive root of
``sum p(s) exp(lambda s) = 1`` over the histogram of their token scores, K by maximum likelihood
from their largest segments. Segments with E below ``SIGNIFICANT`` are reported as passages; the
document's evidence adds up the -ln E of its significant passages, and a logistic curve fitted
to the training sample, together with the share of wrong labels, turns evidence into the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, draw_labels, ids_and_text, stage, trimmed

SAMPLE = 50_000
PREFIXES = (4, 5, 6)
LONGEST_WORD = 40  # longer words count by their prefixes alone
PRIOR = 0.1  # weight of the corpus prior against the training sample
GAP = 0.02  # what ordinary text loses a word at least
NOISE, NOISE_WEIGHT = 0.03, 100.0  # prior of the share of wrong labels, and the labels that it counts for
SIGNIFICANT = 0.5
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(word: str) -> list[str]:
    out = ["^" + word[:k] for k in PREFIXES if len(word) >= k]
    return [word, *out] if len(word) <= LONGEST_WORD else out


@dataclass
class Model:
    """Signed feature weights, the drift, the two parameters of the null distribution and the calibration curve."""

    weights: dict[str, float] = field(default_factory=dict)
    gap: float = GAP
    decay: float = 1.0
    k: float = 0.1
    intercept: float = -3.0
    slope: float = 1.0

    def word_weight(self, word: str) -> float:
        found = [self.weights.get(f, 0.0) for f in features(word.lower())] or [0.0]
        return max(found) if max(found) > 0 else min(found)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * evidence))))

    def expectation(self, n: int, score: float) -> float:
        """ln E of a segment."""
        return math.log(self.k * max(1, n)) - self.decay * score

    def evidence(self, n: int, scores: list[float]) -> float:
        """Of a text of n words with these segment scores: its significant passages, or how far it is from having one."""
        logs = [self.expectation(n, s) for s in scores]
        good = [-e for e in logs if e < math.log(SIGNIFICANT)]
        return sum(good) if good else min(0.0, -min([max(0.0, self.expectation(n, 0.0)), *logs]))


def segments(scores: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place, score) of signed scores (place, score), other places and losses costing gap.

    Linear time: runs between scores are single steps of the running total, and every segment
    points back to the nearest earlier one that begins lower, so no segment is passed twice.
    """
    found: list[tuple] = []  # first, last, total before, total after, index of the nearest earlier segment with a lower total before
    total, at = 0.0, None
    for place, value in scores:
        if at is not None:
            total -= gap * (place - at - 1)
        at = place
        if value <= 0:
            total += value - gap
            continue
        first, low = place, total
        total += value
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, _, low, _, back = found[j]
            del found[j:]
            j = back
        found.append((first, place, low, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


class Scorer:
    """Token scores, segments, evidence and passages of texts under a model, with a bounded memory of word weights."""

    def __init__(self, model: Model, remember: int = 300_000) -> None:
        self.model, self.known, self.remember = model, {}, remember

    def tokens(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """The number of words, and (place, score) of those with a weight, each discounted by its occurrences so far."""
        words = WORD.findall(text)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        weights = list(map(known.get, words))
        if None in weights:
            for i, w in enumerate(weights):
                if w is None:
                    weights[i] = known[words[i]] = self.model.word_weight(words[i])
        often: Counter = Counter()
        out = []
        if any(weights):
            for i, w in enumerate(weights):
                if w:
                    often[words[i]] += 1
                    out.append((i, w / often[words[i]]))
        return len(words), out

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Evidence, and passages (start, end in code points, evidence)."""
        n, scores = self.tokens(text) if self.model.weights else (0, [])
        found = segments(scores, self.model.gap)
        evidence = self.model.evidence(n, [s for *_, s in found])
        rated = [(a, b, self.model.expectation(n, s)) for a, b, s in found]
        good = [(a, b, -e) for a, b, e in rated if e < math.log(SIGNIFICANT)]
        if not good:
            return evidence, []
        ends = {i for a, b, _ in good for i in (a, b)}
        spans = {i: m.span() for i, m in enumerate(WORD.finditer(text)) if i in ends}
        return evidence, [(spans[a][0], spans[b][1], x) for a, b, x in good]


def solve_decay(rates: list[tuple[float, float]]) -> float:
    """The positive root of  sum p exp(x s) = 1  over (p, s), shares that sum to 1 and scores of negative mean."""
    total = lambda x: sum(p * math.exp(min(700.0, x * s)) for p, s in rates) - 1.0
    low, high = 1e-6, 1e-3
    while total(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 0 else (low, middle)
    return low


def fit_curve(counts: list[tuple[float, int, float]]) -> tuple[float, float, float]:
    """Intercept and slope of a logistic curve over (evidence, label, count), and the share of wrong labels.

    Expectation-maximisation over labels that are flipped with an unknown probability, which
    has the prior ``NOISE``; each round takes penalised Newton steps towards the expected true
    labels and re-estimates the share of flips.
    """
    a, b, ridge, noise = -3.0, 1.0, 0.05, NOISE
    curve = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
    for _ in range(30):
        targets, wrong = [], 0.0
        for x, label, n in counts:
            right = curve(x) if label else 1 - curve(x)
            right = (1 - noise) * right / ((1 - noise) * right + noise * (1 - right))
            wrong += n * (1 - right)
            targets.append((x, right if label else 1 - right, n))
        noise = (NOISE * NOISE_WEIGHT + wrong) / (NOISE_WEIGHT + sum(n for *_, n in counts))
        for _ in range(5):
            g0, g1, h00, h01, h11 = ridge * (a + 3), ridge * (b - 1), ridge, 0.0, ridge
            for x, t, n in targets:
                p = curve(x)
                v = n * p * (1 - p)
                g0, g1, h00, h01, h11 = g0 + n * (p - t), g1 + n * (p - t) * x, h00 + v, h01 + v * x, h11 + v * x * x
            det = h00 * h11 - h01 * h01
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
            a, b = a - step * da, max(1e-3, b - step * db)
    return a, b, noise


def _family(text: str) -> int:
    words = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def training_ids(texts: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id and toxic of at most ``sample`` labelled documents outside the held-out third, one of each family.

    Documents whose labels contradict each other are left out.
    """
    drawn = cut(draw_labels(labels.filter(~is_held_out(F.col("doc_id").cast("long"))), "toxic", sample, 5))

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_family(t or "") for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["doc_id", "toxic", "family"])

    # bounded by ``sample`` rows of 12 bytes, so the broadcast is too
    labelled = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("l_id")).select("doc_id", "toxic", "text")
    grouped = labelled.mapInArrow(trimmed(families), "doc_id long, toxic int, family long").groupBy("family", "toxic").agg(F.min("doc_id").alias("l_id"))
    return cut(grouped.select("l_id", "toxic").distinct())


def word_counts(texts: DataFrame, training: DataFrame) -> DataFrame:
    """Documents that hold each word: all of the corpus, toxic and other training ones."""
    marked = texts.join(F.broadcast(training), F.col("doc_id") == F.col("l_id"), "left").select("text", F.coalesce("toxic", F.lit(-1)).alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {-1: Counter(), 0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            rows = [(w, n, y) for y, c in counts.items() for w, n in c.items()]
            for c in counts.values():
                c.clear()
            w, n, y = zip(*rows, strict=True)
            return pa.record_batch([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(y, pa.int32())], names=["word", "n", "toxic"])

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts[toxic].update(set(WORD.findall(text.as_py().lower())))
                if sum(map(len, counts.values())) > 250_000:
                    yield out()
        if any(counts.values()):
            yield out()

    rows = marked.mapInArrow(trimmed(count), "word string, n long, toxic int")
    of = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("word").agg(F.sum("n").alias("n"), of(1).alias("y1"), of(0).alias("y0"))


def fit_null(model: Model, labelled: DataFrame) -> DataFrame:
    """Sets drift, lambda and K from the non-toxic texts of (text, toxic); returns (toxic, n, scores) of all, a row per text."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = Scorer(model), Counter()
        for b in batches:
            for t in b.column(0):
                n, scores = scorer.tokens(t.as_py())
                counts.update(round(s, 2) for _, s in scores)
                counts[0.0] += n - len(scores)
        yield pa.record_batch([pa.array(counts.keys(), pa.float64()), pa.array(counts.values(), pa.int64())], names=["s", "n"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            got = [scorer.tokens(t.as_py()) for t in b.column(0)]
            each = [[s for *_, s in segments(scores, model.gap)] for _, scores in got]
            yield pa.record_batch([b.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array(each, pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    clean = labelled.filter("toxic = 0").select("text").mapInArrow(trimmed(histogram), "s double, n long")
    bins = [(r["s"], r["n"]) for r in clean.groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").collect()]  # scores in hundredths: some thousand rows at most
    total = sum(n for _, n in bins) or 1
    model.gap = GAP + max(0.0, sum(s * n for s, n in bins) / total)
    model.decay = solve_decay([(n / total, s if s > 0 else s - model.gap) for s, n in bins])
    rows = stage(labelled.select("text", "toxic").mapInArrow(trimmed(found), "toxic int, n long, scores array<double>"), "segments")
    largest = F.coalesce(F.array_max("scores"), F.lit(0.0))
    fitted = rows.filter("toxic = 0 AND n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n") * F.exp(-F.lit(model.decay) * largest)).alias("weight")).first()
    if fitted["texts"]:
        model.k = fitted["texts"] / fitted["weight"]
    return rows


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from corpus counts over all documents and a bounded sample of labels."""
    texts = ids_and_text(docs)
    training = training_ids(texts, labels, sample)
    words = stage(word_counts(texts, training), "words")  # read twice below; counting twice would cost more
    prefixes = [F.when(F.length("word") >= k, F.concat(F.lit("^"), F.substring("word", 1, k))) for k in PREFIXES]
    whole = F.when(F.length("word") <= LONGEST_WORD, F.col("word"))
    by_feature = words.select(F.explode(F.array_compact(F.array(whole, *prefixes))).alias("feature"), "n", "y1", "y0")
    counted = by_feature.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "y1", "y0")]).filter("y1 + y0 > 0")
    # totals: one row
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "y1", "y0")]).first()
    n1, n0 = total["y1"], total["y0"]
    if not n1 or not n0:
        return Model()
    strength = PRIOR * (n1 + n0)
    prior = F.lit(strength / total["n"]) * F.col("n")
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(float(n + strength)) - F.col(y) - prior))
    rated = counted.select("feature", (odds("y1", n1) - odds("y0", n0)).alias("odds"), (1.96 * F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))).alias("spread"))
    sure = rated.filter("abs(odds) > spread").select("feature", (F.col("odds") - F.signum("odds") * F.col("spread")).alias("weight"))
    model = Model({r["feature"]: r["weight"] for r in sure.collect()})  # features of the bounded sample only
    labelled = texts.join(F.broadcast(training), F.col("doc_id") == F.col("l_id")).select("text", "toxic")
    rows = fit_null(model, stage(labelled, "labelled"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [max(-60.0, min(200.0, float(round(4 * model.evidence(n, s))))) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(bins, pa.float64())], names=["toxic", "bin"])

    bins = rows.mapInArrow(binned, "toxic int, bin double").groupBy("toxic", "bin").count().collect()  # at most 2 * 261 rows
    model.intercept, model.slope, _ = fit_curve(sorted((r["bin"] / 4, r["toxic"], float(r["count"])) for r in bins))
    return model


def evidence_of(model: Model):  # noqa: ANN201
    """A column function: text -> (evidence, score, passages)."""
    kind = "evidence double, score double, passages array<struct<start:long,end:long,evidence:double>>"

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            got = [scorer(t or "") for t in texts]
            passages = [[{"start": a, "end": b, "evidence": x} for a, b, x in p] for _, p in got]
            yield pd.DataFrame({"evidence": [e for e, _ in got], "score": [model.score(e) for e, _ in got], "passages": passages})

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (start, end in code points, evidence), one row per input row.

    Null and empty texts get the score of no evidence; very long texts take time in proportion
    to their words; repeated rows are scored alike; extra columns are ignored; an empty table
    gives an empty result.
    """
    scored = ids_and_text(docs).select("doc_id", evidence_of(model)(F.col("text")).alias("s"))
    return scored.select("doc_id", F.col("s.score").alias("score"), F.col("s.passages").alias("passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scoring below the threshold, all columns as they were; nothing is shuffled."""
    model = learn(docs, labels)
    return docs.filter(evidence_of(model)(F.col("text").cast("string"))["score"] < threshold)
