"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes for (1) or against (-1) a text, or abstains (0). A model with a latent class of each text, and one accuracy
of each rule in either class, is fitted by expectation-maximisation to the counts of vote patterns; the posterior probability
of the good class then replaces a filter that wants all rules passed. No rule is trusted beforehand: a rule that speaks against
many texts on its own gets a low accuracy and is outvoted, and one that speaks along with others gains weight. Kinds of junk
break several rules each, which is what the model learns from.

Null and empty texts have no words: every count is 0, all rules abstain, they fail the base rule and are not kept. Columns of
a table that are called like a count give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import SPACE, held, written

RULES = ("word_length", "symbols", "letters", "endings", "lines", "repeats", "variety", "lower", "capitals")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_letters", "n_capitals", "n_lower", "n_distinct", "n_lines", "n_ended", "n_dup_lines", "n_repeat_words")
_BLANK = " \t\n\x0b\x0c\r"


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts of each text, beside the columns of ``docs``: one pass, no shuffle.

    A word of a text is repeated if a window of three words that covers it is found at least twice in the text. Window
    hashes are sorted with their places; equal neighbours are repeats, so a text of n words takes n log n steps.
    """
    ink = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANK))
    words = F.when(ink == "", F.array().cast("array<string>")).otherwise(F.split(ink, SPACE))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.coalesce(F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")), F.lit(0)).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
            "n_letters": F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", "")), F.lit(0)).cast("long"),
            "n_capitals": F.coalesce(F.regexp_count(text, F.lit("[A-Z]")), F.lit(0)).cast("long"),
            "n_lower": F.coalesce(F.regexp_count(text, F.lit(r"(?:^|[\x20\x09-\x0D])\p{Ll}")), F.lit(0)).cast("long"),
            "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_ended": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": F.when(
                F.size("_words") >= 3,
                F.transform(F.slice("_words", 1, F.size("_words") - 2), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
            ),
        }
    ).drop("_words", "_lines")
    repeats = F.size("_grams") > F.size(F.array_distinct("_grams"))
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_grams")
    same = lambda x, k: x["h"].eqNullSafe(F.get("_sorted", k)["h"])
    hits = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("_at", F.sort_array(F.transform(hits, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    return held(df, *COUNTS)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.col("n_words") == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """What each rule says of a text's counts."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "word_length": _vote((2 * chars < 5 * words) | (chars > 7 * words), (chars >= 3 * words) & (chars <= 6 * words)),
        "symbols": _vote(20 * F.col("n_symbols") > words, 100 * F.col("n_symbols") <= words),
        "letters": _vote(100 * F.col("n_letters") < 90 * chars, 100 * F.col("n_letters") >= 94 * chars),
        "endings": _vote(10 * F.col("n_ended") < 9 * lines, F.col("n_ended") == lines),
        "lines": _vote(100 * F.col("n_dup_lines") > 35 * lines, (F.col("n_dup_lines") == 0) & (lines >= 3)),
        "repeats": _vote(100 * F.col("n_repeat_words") > 40 * words, 100 * F.col("n_repeat_words") <= 10 * words),
        "variety": _vote(100 * F.col("n_distinct") < 45 * words, 100 * F.col("n_distinct") >= 60 * words),
        "lower": _vote(100 * F.col("n_lower") < 70 * words, 100 * F.col("n_lower") >= 84 * words),
        "capitals": _vote(100 * F.col("n_capitals") > 20 * chars, 100 * F.col("n_capitals") <= 6 * chars),
    }


@dataclass(frozen=True)
class LabelModel:
    """prior: of the good class. right: for each rule, how often a vote on a good text, and on a bad one, is right."""

    prior: float = 0.5
    right: dict[str, tuple[float, float]] = field(default_factory=dict)
    likelihood: float = 0.0

    def odds(self, pattern: tuple[int, ...]) -> float:
        """Log odds of the good class of a vote pattern in the order of ``right``."""
        total = math.log(self.prior / (1 - self.prior))
        for v, (good, bad) in zip(pattern, self.right.values()):
            total += math.log(good / (1 - bad)) if v == 1 else math.log((1 - good) / bad) if v == -1 else 0.0
        return total

    def log_odds(self, vote: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, (good, bad) in self.right.items():
            total = total + F.when(vote[rule] == 1, F.lit(math.log(good / (1 - bad)))).when(vote[rule] == -1, F.lit(math.log((1 - good) / bad))).otherwise(F.lit(0.0))
        return total


#: Votes against a text from which a start takes it for bad; the last start takes the share of votes for it.
STARTS = (1, 2, 3, None)


def _start(pattern: tuple[int, ...], start: int | None) -> float:
    if start is None:
        return (pattern.count(1) + 0.5) / (pattern.count(1) + pattern.count(-1) + 1)
    return 0.1 if pattern.count(-1) >= start else 0.9


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[str, ...] = RULES, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, from each of ``STARTS``; the likeliest model is taken, imagined votes and texts counted too, of equal ones the first.

    One and a half imagined votes of a rule in each class, one of them right, keep rates inside (0, 1), and so does one text of each class; they
    also tell which class is the good one where all texts are alike. A rule is no worse than chance: where its vote for a text is more frequent among bad ones, it gets one rate for both and tells
    nothing. Without patterns the prior is a half and nothing is said by any vote.
    """
    total = sum(n for _, n in patterns)
    best = LabelModel(0.5, {r: (0.5, 0.5) for r in rules}, -math.inf)
    for start in STARTS if total else ():
        share = [_start(p, start) for p, _ in patterns]
        for _ in range(rounds):
            right = {}
            for j, rule in enumerate(rules):
                good, bad = {1: 1.0, -1: 0.5}, {1: 0.5, -1: 1.0}
                for (p, n), s in zip(patterns, share):
                    if p[j]:
                        good[p[j]] += n * s
                        bad[p[j]] += n * (1 - s)
                g, b = good[1] / (good[1] + good[-1]), bad[-1] / (bad[1] + bad[-1])
                if g < 1 - b:
                    g = (good[1] + bad[1]) / (good[1] + good[-1] + bad[1] + bad[-1])
                    b = 1 - g
                right[rule] = (g, b)
            model = LabelModel((sum(n * s for (_, n), s in zip(patterns, share)) + 1) / (total + 2), right)
            share, likelihood = [], math.log(model.prior * (1 - model.prior)) + sum(math.log(g * b) + 0.5 * math.log((1 - g) * (1 - b)) for g, b in right.values())
            for p, n in patterns:
                odds = model.odds(p)
                share.append(1 / (1 + math.exp(-odds)) if odds > -700 else 0.0)
                # ln P(pattern) = ln P(bad, pattern) + ln(1 + odds)
                bad = math.log(1 - model.prior) + sum(math.log(1 - b) if v == 1 else math.log(b) if v == -1 else 0.0 for v, (_, b) in zip(p, right.values()))
                likelihood += n * (bad + (odds + math.log1p(math.exp(-odds)) if odds > 0 else math.log1p(math.exp(odds))))
        if likelihood > best.likelihood + 1e-6:
            best = LabelModel(model.prior, model.right, likelihood)
    return best


def fit_docs(counted: DataFrame, rounds: int = 30) -> LabelModel:
    """The model of all texts: one row of each vote pattern comes to the driver, at most 3 to the number of rules."""
    rows = counted.select(*(v.alias(r) for r, v in votes().items())).groupBy(*RULES).count().collect()
    return fit(sorted((tuple(r[x] for x in RULES), r["count"]) for r in rows), rounds=rounds)


def judged(docs: DataFrame, text: str = "text", rounds: int = 30, columns: list[str] | None = None) -> DataFrame:
    """``docs``, or those of its columns, with its counts, base_failed, p_good and kept. Rows are written with their counts once, for the fit and for the verdicts."""
    df = counts(docs, text)
    df = written(df if columns is None else df.select(*(F.col(f"`{c}`") for c in columns), *COUNTS))
    model = fit_docs(df, rounds)
    df = df.withColumn("base_failed", base_failed())
    return df.withColumn("p_good", 1 / (1 + F.exp(-model.log_odds(votes())))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
