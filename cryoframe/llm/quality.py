"""Quality rules by weak supervision.

Each rule looks at whole-text statistics and votes good, bad or abstains.  A text is good or has one kind of defect;
the rules of a kind vote on texts that have it with rates of their own, and all rules vote on all other texts alike, so
that a text whose only fault are its symbols is not cleared by rules that look at something else.  Expectation-maximisation
over the counts of vote patterns, of which there are at most three to the number of rules, estimates these rates and how
many texts have each kind; a text stays by its posterior probability of being good, where a list of filters that must all
pass would drop it for one vote.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut

SYMBOLS = b"#*$%&|<>"
#: Words in a window that repeats.
WINDOW = 5
#: ASCII white space, which parts words, and the second and later bytes of a character.
_SPACE, _LATER = b" \t\n\r\x0b\x0c", bytes(range(0x80, 0xC0))
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(c for c in range(128) if not chr(c).isalpha())
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_plain_words", "n_distinct", "n_marks", "n_initial")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` that are found twice or more, the first included."""
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    first = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    codes = first
    for k in range(1, WINDOW):
        # a window of k + 1 words is one of k words and the word after it
        _, codes = np.unique(codes[:-1] * len(numbers) + first[k:], return_inverse=True)
    twice = (np.bincount(codes) > 1)[codes]
    steps = np.zeros(len(words) + 1, np.int64)
    steps[: len(twice)] += twice
    steps[WINDOW : WINDOW + len(twice)] -= twice
    return int((np.cumsum(steps) > 0).sum())


def statistics_of(raw: bytes) -> tuple[int, ...]:
    """The ``STATISTICS`` of one text in UTF-8."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    less = lambda gone: len(raw) - len(raw.translate(None, gone))
    distinct = set(words)
    return (
        len(words), len(raw.translate(None, _SPACE + _LATER)), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        less(_UPPER), less(_LOWER), sum(1 for w in words if not w.translate(None, _PLAIN)), len(distinct),
        less(_MARKS), sum(1 for w in words if w[0] in _UPPER),
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the ``STATISTICS`` of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
            columns = zip(*rows) if rows else [[]] * len(STATISTICS)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *STATISTICS])

    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds (bad first), else abstains; both are SQL over the statistics.  ``kind`` is the defect it looks for."""

    name: str
    kind: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"case when {self.bad} then -1 when {self.good} then 1 else 0 end")


#: Whole numbers on both sides, so that every engine votes alike.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("marks", "symbols", "2 * n_marks > n_words", "4 * n_marks <= n_words"),
    Rule("capitals", "capitals", "2 * n_upper > n_upper + n_lower and n_upper >= 20", "5 * n_upper <= n_lower"),
    Rule("initials", "capitals", "5 * n_initial > 4 * n_words and n_words >= 20", "2 * n_initial <= n_words"),
    Rule("repeated_words", "repetition", "5 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    Rule("variety", "repetition", "n_words >= 20 and n_words <= 1000 and 5 * n_distinct < n_words", "n_words >= 20 and n_words <= 1000 and 5 * n_distinct >= 2 * n_words"),
    Rule("repeated_lines", "repetition", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines and n_lines >= 2"),
    Rule("words_without_letters", "form", "5 * n_plain_words > n_words", "20 * n_plain_words <= n_words"),
    Rule("word_length", "form", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars between 4 * n_words and 9 * n_words"),
)
#: Rounds of expectation-maximisation; the share of each kind of defect, and of bad votes among a rule's votes on texts without and with its kind, to start from.
ROUNDS, SHARE, BAD_IF_NOT, BAD_IF_SO = 50, 0.05, 0.01, 0.8
#: Votes that each rule has before any text, spread as at the start, so that no rate is 0 or 1.
SLACK = 1.0


@dataclass(frozen=True)
class LabelModel:
    """Of each kind the share of texts that have it; of each rule the share of bad votes among its votes on texts without and with its kind."""

    kinds: tuple[str, ...]
    shares: tuple[float, ...]
    bad_if_not: tuple[float, ...]
    bad_if_so: tuple[float, ...]

    def evidence(self) -> list[tuple[float, float]]:
        """Log odds for its kind that a good vote and a bad vote of each rule add."""
        return [(math.log((1 - b) / (1 - g)), math.log(b / g)) for g, b in zip(self.bad_if_not, self.bad_if_so)]

    def prior(self) -> list[float]:
        """Log odds of each kind against good."""
        return [math.log(s / (1 - sum(self.shares))) for s in self.shares]

    def posterior(self, rules: Sequence[Rule], votes: Sequence[Column]) -> Column:
        """Probability that a text is good."""
        odds = dict(zip(self.kinds, map(F.lit, self.prior())))
        for rule, vote, (good, bad) in zip(rules, votes, self.evidence()):
            odds[rule.kind] = odds[rule.kind] + F.when(vote > 0, good).when(vote < 0, bad).otherwise(0.0)
        total = F.lit(1.0)
        for o in odds.values():
            total = total + F.exp(o)
        return 1 / total


def fit_label_model(patterns: Sequence[tuple[Sequence[int], int]], rules: Sequence[Rule], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over (votes, number of texts); votes are independent given what the text is, and abstaining tells nothing.

    Where it starts says what a bad vote means: nearly all texts that get one from a rule have its kind.
    """
    kinds = tuple(dict.fromkeys(r.kind for r in rules))
    model = LabelModel(kinds, (SHARE,) * len(kinds), (BAD_IF_NOT,) * len(rules), (BAD_IF_SO,) * len(rules))
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        evidence = model.evidence()
        having: list[list[float]] = []
        for votes, n in patterns:
            odds = [math.exp(min(700.0, p + sum(evidence[i][0 if votes[i] > 0 else 1] for i, r in enumerate(rules) if votes[i] and r.kind == k))) for k, p in zip(kinds, model.prior())]
            having.append([n * o / (1 + sum(odds)) for o in odds])
        so = [[h[kinds.index(r.kind)] for h in having] for r in rules]
        rate = lambda i, weights, start: (
            (sum(w for (votes, _), w in zip(patterns, weights) if votes[i] < 0) + SLACK * start) / (sum(w for (votes, _), w in zip(patterns, weights) if votes[i]) + SLACK)
        )
        model = LabelModel(
            kinds, tuple((sum(h[k] for h in having) + SLACK * SHARE) / (total + SLACK) for k in range(len(kinds))),
            tuple(rate(i, [n - w for (_, n), w in zip(patterns, so[i])], BAD_IF_NOT) for i in range(len(rules))),
            tuple(rate(i, so[i], BAD_IF_SO) for i in range(len(rules))),
        )
    return model


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality``.

    ``quality`` is the posterior probability that the text is good, from the votes of ``rules`` on it and what their
    votes on all texts say of them; ``kept`` is False if the base fails (fewer than 10 words, or more than a fifth of them
    in repeated windows) and else whether quality reaches ``least``.

    Null and empty texts have no words and fail the base.  Texts are used whole, however long.  Rows that repeat are
    judged each, and each counts in the estimates; a null doc_id stays null.  A document without any vote
    has the share of good texts as its quality.  An empty table gives no rows; other columns are ignored.
    """
    counted = cut(text_statistics(docs).withColumns({f"vote_{i}": r.vote() for i, r in enumerate(rules)}))
    votes = [f"vote_{i}" for i in range(len(rules))]
    patterns = [(tuple(r[v] for v in votes), r["n"]) for r in counted.groupBy(*votes).agg(F.count("*").alias("n")).collect()]
    model = fit_label_model(sorted(patterns), rules, rounds)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    judged = counted.withColumns({"base_failed": failed, "quality": model.posterior(rules, [F.col(v) for v in votes])})
    return judged.select("doc_id", *STATISTICS[:5], "base_failed", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality")
