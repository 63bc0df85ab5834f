"""Quality rules under weak supervision, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
EM_STEPS = 200


def _without(text: Column, chars: str) -> Column:
    """Replaced one by one: a pass that finds nothing is a scan of bytes."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and counts of every whole text; a null text counts as empty.

    Windows of three words are compared by 64-bit hashes. Hashes are sorted
    with their positions, so a text costs n log n whatever repeats in it.
    """
    text = F.col("text")
    x = docs.select("doc_id", text_or_empty().alias("text"))
    x = x.withColumn("words", F.split(F.btrim("text", F.lit(SPACE)), r"[\x20\x09-\x0D]+"))
    x = x.withColumn("n", F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words")))
    x = x.withColumn("lines", F.filter(F.split("text", "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")))
    x = x.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"\p{L}" + WORD[:-1] + "*")).cast("long").alias("n_letter_words"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])\p{L}{1,3}(?![^\x20\x09-\x0D])")).cast("long").alias("n_short_words"),
        F.rtrim("text", F.lit(SPACE)).rlike(r"[.!?\u2026\u3002\uFF01\uFF1F][\"'\u201D\u2019\u00BB)]?\z").alias("ends"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.when(F.col("n") >= 3, F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.col("n") - 2)).alias("h"),
    )
    x = x.withColumn("h", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i"))))))
    again = F.filter(F.col("h"), lambda e, k: (e.v == F.get("h", k - 1).v) | (e.v == F.get("h", k + 1).v))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e.i, e.i + 1, e.i + 2)))))
    return x.withColumn("n_repeat_words", F.when(F.col("h").isNull(), 0).otherwise(covered).cast("long")).drop("h")


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def vote(x: Column, good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    def below(x: Column, good: float, bad: float) -> Column:
        return vote(x, x <= good, x > bad)

    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    a_line = n / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": vote(n, n >= 100, n < 60),
        "repeats": below(F.col("n_repeat_words") / n, 0.1, 0.2),
        "symbols": below(F.col("n_symbols") / n, 0.02, 0.1),
        "dup_lines": F.when(F.col("n_lines") < 4, 0).otherwise(below(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.05, 0.15)),
        "word_length": vote(mean, mean.between(4, 6.5), (mean < 3) | (mean > 8)),
        "capitals": below(F.col("n_capitals") / chars, 0.06, 0.2),
        "letters": vote(n, F.col("n_letters") >= 0.93 * chars, F.col("n_letters") < 0.9 * chars),
        "letter_words": vote(n, F.col("n_letter_words") >= 0.95 * n, F.col("n_letter_words") < 0.8 * n),
        "short_words": vote(n, F.col("n_short_words") >= 0.15 * n, F.col("n_short_words") < 0.1 * n),
        "line_length": vote(n, a_line.between(8, 60), (a_line < 5) | (a_line > 100)),
        "ends": vote(n, F.col("ends"), ~F.col("ends")),
    }


def patterns_of(votes: DataFrame, names: Iterable[str]) -> list[tuple[tuple[int, ...], int]]:
    """The distinct vote patterns of columns v_<rule> and how many texts have each: at most 3 to the number of rules."""
    columns = [f"v_{k}" for k in names]
    return sorted((tuple(r[c] for c in columns), r["n"]) for r in votes.groupBy(*columns).agg(F.count("*").alias("n")).collect())


class LabelModel:
    """How often rules are right, and which texts are good, by expectation-maximisation.

    A text is good or bad; given that, rules that vote do so independently, and
    an abstention says nothing. Estimated are the share of good texts and, for
    each rule, how often its vote is bad on good and on bad texts, so a rule
    that often blames good texts weighs little and one vote does not decide.
    Priors are PRIOR made-up votes a rule and class, that say which class is
    the good one and no more.

    EM reads the table of vote patterns, whose size depends on the number of
    rules only; so one query gathers it and the steps need no further one.
    """

    #: Made-up (bad, good) votes of each rule on a good and on a bad text.
    PRIOR = ((0.1, 1.9), (1.0, 1.0))

    def __init__(self, names: Iterable[str]):
        self.names = list(names)
        self.share = 0.9
        self.bad_on_good, self.bad_on_bad = [0.05] * len(self.names), [0.5] * len(self.names)
        self.steps = 0

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """The log odds of good without votes, and what a bad and a good vote of each rule add."""
        return math.log(self.share / (1 - self.share)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in zip(self.bad_on_good, self.bad_on_bad)]

    def fit(self, patterns: list[tuple[tuple[int, ...], int]], steps: int = EM_STEPS, close: float = 1e-7) -> "LabelModel":
        """Until no estimate moves by ``close``. No patterns leave the model as it is."""
        total = sum(n for _, n in patterns)
        for self.steps in range(1, steps + 1 if total else 1):
            start, by_rule = self.weights()
            said = [[list(prior) for _ in self.names] for prior in self.PRIOR]
            good = 0.0
            for votes, n in patterns:
                odds = start + sum(w[0 if v < 0 else 1] for v, w in zip(votes, by_rule) if v)
                p = 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0
                good += p * n
                for i, v in enumerate(votes):
                    if v:
                        said[0][i][v > 0] += p * n
                        said[1][i][v > 0] += (1 - p) * n
            before = [self.share, *self.bad_on_good, *self.bad_on_bad]
            self.share = (good + 0.9) / (total + 1.0)
            self.bad_on_good, self.bad_on_bad = ([b / (b + g) for b, g in x] for x in said)
            if max(abs(x - y) for x, y in zip(before, [self.share, *self.bad_on_good, *self.bad_on_bad])) < close:
                break
        return self

    def quality(self) -> Column:
        """The probability that a text is good given its votes in columns v_<rule>."""
        start, by_rule = self.weights()
        odds = reduce(lambda a, x: a + x, (F.when(F.col(f"v_{k}") == -1, b).when(F.col(f"v_{k}") == 1, g).otherwise(0.0) for k, (b, g) in zip(self.names, by_rule)), F.lit(start))
        return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, text) -> doc_id, the counts, votes, base_failed, quality (the posterior) and kept, for every row.

    The model is fitted on all texts that pass the base rules, whose verdict is
    open. Equal rows get equal results; a null doc_id stays null; a null or
    empty text has no words and fails the base rules; a very long text costs
    time in proportion to its words, once sorted; no rows give no rows; other
    columns are not read.
    """
    votes = rules()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = materialize(text_counts(docs).withColumns({f"v_{k}": v for k, v in votes.items()} | {"base_failed": failed}), "text-counts")
    model = LabelModel(votes).fit(patterns_of(counted.where("NOT base_failed"), votes))
    out = counted.withColumn("quality", model.quality())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
