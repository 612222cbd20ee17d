"""Quality rules as a learned decision list.

Statistics of every document are DataFrame expressions. A list of rules, each a conjunction
of thresholds on statistics, is learned from labelled documents by sequential covering: a
rule for the low-quality class is grown condition by condition by information gain on two
thirds of the sample until it covers no other class or no condition gains more than it takes to state it, pruned from its end on the
remaining third, and accepted while it is precise there; the documents it covers are set aside
and the next rule is grown, until none is accepted. The list becomes one conditional expression
over the statistics. Neither the rules nor their conditions are limited in number.

The learner sees a bounded sample of labelled rows (``SAMPLE``, drawn by a hash of the id);
the statistics and the verdicts cover every document and all of its text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import draw_labels, ids_and_text, let, stage

SAMPLE = 20_000
#: A rule is accepted while this share of the pruning rows that it covers are low-quality ones, more than
#: chance explains: as many or more among as many rows drawn from the pruning part have at most this probability.
PRECISION, CHANCE = 0.9, 0.05
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"  # fixed values
FEATURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "words_per_line", "letter_share"]


def count_in(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, first ones included.

    Only texts with a repeated window sort their windows; the rest is linear.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["x"] == x["x"], F.lit(False))
        places = let(pairs, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(s, x, j - 1) | same(s, x, j + 1), x["i"])), lambda p: p.isNotNull())))
        return let(places, lambda q: F.aggregate(F.transform(q, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - p, F.lit(3)))), F.lit(0), lambda t, n: t + n))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts (long) and the learner's FEATURES (double), one row per input row."""
    texts = ids_and_text(docs)
    text = F.col("text")
    split = texts.withColumn("w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        count_in(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        count_in(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        count_in(text, "0123456789").cast("long").alias("n_digits"),
        count_in(text, ".,;:!?").cast("long").alias("n_marks"),
        count_in(text, "abcdefghijklmnopqrstuvwxyz").cast("long").alias("n_letters"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    measures = [share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_digits", "word_chars"), share("n_marks", "n_words"), share("n_distinct", "n_words"), share("n_words", "n_lines"), share("n_letters", "word_chars")]
    named = [m.alias(f"f_{n}") for n, m in zip(FEATURES[1:], measures, strict=True)]
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("n_words").cast("double").alias("f_n_words"), *named)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: int
    at_least: bool
    threshold: float

    def holds(self, row: tuple) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(f"f_{FEATURES[self.feature]}")
        return c >= F.lit(self.threshold) if self.at_least else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


def covers(rule: list[Condition], row: tuple) -> bool:
    return all(c.holds(row) for c in rule)


def best_condition(rows: list[tuple]) -> Condition | None:
    """The threshold condition of most information gain for label 1 (the last field of a row).

    None if no condition gains more bits than it takes to state one of these conditions.
    """
    p0, n0 = sum(r[-1] for r in rows), len(rows)
    if not p0 or p0 == n0:
        return None
    before, best, found = math.log2(p0 / n0), math.log2(2 * len(FEATURES) * n0), None
    for f in range(len(FEATURES)):
        order = sorted(rows, key=lambda r: r[f])
        p = 0
        for i, r in enumerate(order[:-1], 1):
            p += r[-1]
            low, high = r[f], order[i][f]
            if low == high:
                continue
            middle = (low + high) / 2
            for at_least, q, m in ((False, p, i), (True, p0 - p, n0 - i)):
                if q and (gain := q * (math.log2(q / m) - before)) > best:
                    best, found = gain, Condition(f, at_least, middle)
    return found


def chance_of(hits: int, n: int, base: float) -> float:
    """P(X >= hits) for X binomial over n draws at rate base."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log(1 - base)) for k in range(hits, n + 1)) if 0 < base < 1 else 1.0


def learn(rows: list[tuple]) -> list[list[Condition]]:
    """Rules for label 1, in order. rows: the features and the label, in a fixed random order."""
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], rows[::3], []
    while any(r[-1] for r in grow):
        rule, inside = [], grow
        while c := best_condition(inside):
            rule.append(c)
            inside = [r for r in inside if c.holds(r)]

        def on_pruning(conditions: list[Condition]) -> tuple[int, int]:
            """Low-quality and all covered rows."""
            hit = [r[-1] for r in prune if covers(conditions, r)]
            return sum(hit), len(hit)

        corrected = lambda counts: (counts[0] + 1) / (counts[1] + 2)  # noqa: E731  by Laplace
        while len(rule) > 1 and corrected(on_pruning(rule[:-1])) >= corrected(on_pruning(rule)):
            rule.pop()
        hits, n = on_pruning(rule) if rule else (0, 0)
        if not hits or hits < PRECISION * n or chance_of(hits, n, sum(r[-1] for r in prune) / len(prune)) > CHANCE:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not covers(rule, r)] for part in (grow, prune))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that rejects, else null."""
    out = None
    for i, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(i)) if out is None else out.when(condition, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def learn_rules(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules for quality 0, from at most ``sample`` labelled documents that pass the base checks.

    Labels other than 0 and 1, labels without a document and documents whose labels contradict
    each other are left out; no labels: no rules. The sample is drawn from the labels by hash of
    the id before the join, so ``sample`` bounds what the join and the driver see.
    """
    drawn = draw_labels(labels, "quality", sample, 11)
    joined = stats.filter(~base_failed()).join(F.broadcast(drawn), F.col("doc_id") == F.col("l_id"))
    once = joined.groupBy("doc_id").agg(F.min(F.struct(*[f"f_{f}" for f in FEATURES], (1 - F.col("quality")).alias("bad"))).alias("r"))  # of rows with one id, one
    rows = once.select(F.xxhash64("doc_id", F.lit(11)).alias("order"), "r.*").collect()  # at most ``sample`` small rows
    return learn([tuple(r)[1:] for r in sorted(rows, key=tuple)])


def apply_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rule (the first rule that rejects, else null).

    One row per input row; null text counts as empty and fails the base checks; repeated rows
    get the same verdict; null doc_ids are judged but never learned from; extra columns are
    ignored. With an empty label table everything that passes the base checks is kept.
    """
    stats = stage(statistics(docs), "quality")
    rules = learn_rules(stats, labels, sample)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
