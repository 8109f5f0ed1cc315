"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good, bad, or abstains. How often a rule votes which way for good and for bad documents is not
given but estimated by expectation-maximisation from all documents' votes, without labels; the posterior
probability that a document is good then decides, instead of a demand that every rule be passed.

The expectation step needs only how often each combination of votes occurs, so the documents are aggregated to
at most 3 ** len(RULES) rows before anything reaches the driver, however many documents there are, and the
estimates go back as the constants of one expression: no join, no broadcast, and no shuffle but that of counts.

Words are runs of other than ASCII white space. Repeated 3-word windows are found by 64-bit hashes of their
words within one text. A null text has no words and fails the base rules; so does an empty one. doc_id may be
null; repeated rows are judged each by itself; further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm import common
from ripplework.llm.common import let

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


#: name -> its vote: 1 good, -1 bad, 0 abstains.
RULES: dict[str, Column] = {}


def rules() -> dict[str, Column]:
    """Made on first use, for columns need a session."""
    if not RULES:
        length, symbols, repeats = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words")
        distinct, capitals, shouts, duplicate = _ratio("n_distinct_words", "n_words"), _ratio("n_capitals", "word_chars"), _ratio("n_shouts", "n_words"), _ratio("n_dup_lines", "n_lines")
        fresh = distinct * F.pow(F.greatest("n_words", F.lit(1)), 0.3)  # long texts use fewer new words
        never = F.lit(False)
        RULES.update(
            prose=_vote(length.between(3, 9) & (fresh >= 1.6) & (symbols <= 0.02) & (capitals <= 0.15) & (shouts <= 0.02), never),
            word_length=_vote(never, (length < 2) | (length > 14)),
            variety=_vote(never, fresh < 0.8),
            symbols=_vote(never, symbols > 0.2),
            repetition=_vote(never, repeats > 0.45),
            capitals=_vote(never, capitals > 0.3),
            shouting=_vote(never, shouts > 0.2),
            duplicate_lines=_vote(never, duplicate > 0.6),
        )
    return RULES


def _repeated(hashes: Column) -> Column:
    """Words in windows of three that occur at least twice: sort the windows' hashes, compare neighbours, count the words that those cover."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("k"), i.alias("p")))
    count = let(
        F.sort_array(windows),
        lambda s: let(
            F.transform(F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])), lambda x: x["p"]),
            lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))),
        ),
    )
    return F.when(F.size(hashes) < 4, 0).otherwise(count)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, from whole texts (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    hashes = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, BLANK), lambda w: F.xxhash64(w)))
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = let(hashes, lambda h: F.struct(F.size(h).alias("n_words"), F.size(F.array_distinct(h)).alias("n_distinct_words"), _repeated(h).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    wide = docs.select(
        "doc_id", counts.alias("_counts"), by_line.alias("_lines"),
        without(BLANK).alias("word_chars"), (F.char_length(text) - without(f"[{SYMBOLS}]+")).alias("n_symbols"),
        (F.char_length(text) - without("\\p{Lu}+")).alias("n_capitals"), F.regexp_count(text, F.lit("!!")).alias("n_shouts"),
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return wide.select(
        "doc_id", long("_counts.n_words", "n_words"), long("word_chars", "word_chars"), long("n_symbols", "n_symbols"), long("_lines.n_dup_lines", "n_dup_lines"), long("_counts.n_repeat_words", "n_repeat_words"),
        long("_counts.n_distinct_words", "n_distinct_words"), long("n_capitals", "n_capitals"), long("n_shouts", "n_shouts"), long("_lines.n_lines", "n_lines"),
    )


#: Before any document is seen: the share of good ones, and the chance of each vote from a (good, bad) one. A bad vote, cast at an extreme only, is seldom wrong; a good vote is a hint.
SHARE, CHANCES = 0.85, {-1: (0.01, 0.3), 1: (0.6, 0.3)}


def estimate(patterns: dict[tuple[int, ...], int], weight: float = 0.1, rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of good in general, and what each rule's votes add to them, by expectation-maximisation over vote combinations and their counts.

    It starts from CHANCES, which go on counting as `weight` times all documents in each class.
    """
    total = sum(patterns.values())
    n_rules = len(next(iter(patterns), ()))
    bias, prior = math.log(SHARE / (1 - SHARE)), weight * total
    added = [{0: 0.0, **{v: math.log(g / b) for v, (g, b) in CHANCES.items()}} for _ in range(n_rules)]
    before: dict = {}
    for _ in range(rounds):
        good = {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(a[v] for a, v in zip(added, p, strict=True)))))) for p in patterns}
        if before and max(abs(good[p] - before[p]) for p in patterns) < 1e-9:
            break
        before = good
        n_good = sum(good[p] * c for p, c in patterns.items())
        bias = math.log((n_good + prior * SHARE) / (total - n_good + prior * (1 - SHARE))) if total else bias
        for j in range(n_rules):
            for v, (g, b) in CHANCES.items():
                votes = [(good[p], c) for p, c in patterns.items() if p[j] == v]
                in_good = (sum(x * c for x, c in votes) + prior * g) / (n_good + prior)
                in_bad = (sum((1 - x) * c for x, c in votes) + prior * b) / (total - n_good + prior)
                added[j][v] = math.log(in_good / in_bad)
    return bias, added


def judge(measured: DataFrame, least_words: int = 50) -> DataFrame:
    """measured with base_failed, quality (the posterior) and kept. It is read twice: stage it first if it is costly."""
    voted = measured.withColumns({f"vote_{name}": vote for name, vote in rules().items()})
    names = [f"vote_{name}" for name in rules()]
    patterns = Counter({tuple(r[n] for n in names): r["count"] for r in voted.where("n_words > 0").groupBy(*names).count().collect()})
    bias, added = estimate(patterns)
    odds = F.lit(bias)
    for name, by in zip(names, added, strict=False):
        odds = odds + F.when(F.col(name) < 0, by[-1]).when(F.col(name) > 0, by[1]).otherwise(by[0])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-odds))}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior and verdict of every document (doc_id, text); the counts are staged so that texts are read once."""
    return judge(common.staged(measure(docs), "counts"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
