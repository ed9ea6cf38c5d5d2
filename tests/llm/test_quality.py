"""Quality votes: statistics against plain loops, the label model on planted votes, held-out labels, and the defined cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cryoframe.llm.quality import RULES, STATISTICS, Rule, fit_label_model, judge_quality, repeated_words, statistics_of

DDL = "doc_id long, text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_repeats(w: list[str]) -> int:
    seen = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len({i + j for i, s in enumerate(seen) if seen.count(s) > 1 for j in range(5)})


def slow(text: str) -> tuple:
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letter = lambda c: c.isascii() and c.isalpha()
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), slow_repeats(w), len(lines),
        sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text), sum(all(c.isascii() and not letter(c) for c in x) for x in w), len(set(w)),
        sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text), sum("A" <= x[0] <= "Z" for x in w),
    )


def test_statistics_equal_loops():
    rng = random.Random(5)
    pieces = ["a", "b", "Ab", "é", "日本", "#", "12", "|", "x.", "\n", "\t", "\x0b", "\x1c", " ", " ", "\x85", "\r\n", "end.\n", "a b a b a b"]
    for n in (0, 1, 4, 5, 6, 20, 80, 300):
        for _ in range(12):
            text = rng.choice(["", " "]).join(rng.choices(pieces, k=n)) if n else ""
            assert statistics_of(text.encode()) == slow(text), repr(text)
    assert len(slow("a")) == len(STATISTICS)


def test_repeated_words_overlap():
    split = lambda t: t.encode().split()
    assert repeated_words(split("a a a a a a")) == 6 and repeated_words(split("a a a a a")) == 0
    assert repeated_words(split("1 2 3 4 5 x 1 2 3 4 5 y")) == 10 and repeated_words([]) == 0
    assert repeated_words(split("1 2 3 4 5 6 7 1 2 3 4 5 6")) == 12


def test_label_model_finds_planted_rates():
    rng = random.Random(7)
    rules = [Rule(f"r{i}", "ab"[i // 3], "", "") for i in range(6)]
    bad_so, bad_not = [0.9, 0.8, 0.6, 0.85, 0.7, 0.9], [0.02, 0.01, 0.05, 0.02, 0.03, 0.0]
    counts, truth = {}, {}
    for _ in range(40_000):
        kind = rng.choices(["a", "b", None], [0.1, 0.05, 0.85])[0]
        votes = tuple(0 if rng.random() < 0.2 else (-1 if rng.random() < (bad_so if r.kind == kind else bad_not)[i] else 1) for i, r in enumerate(rules))
        counts[votes] = counts.get(votes, 0) + 1
        truth[votes] = truth.get(votes, 0) + (kind is None)
    model = fit_label_model(sorted(counts.items()), rules)
    assert model.shares == pytest.approx((0.1, 0.05), abs=0.01)
    assert model.bad_if_so == pytest.approx(bad_so, abs=0.05) and model.bad_if_not == pytest.approx(bad_not, abs=0.01)


def test_one_bad_vote_among_many_good_ones_can_stay(spark):
    prose = lambda i: " ".join(f"word{(i * 7 + j * j) % 997} and{j % 89}x" for j in range(60)) + ".\nsecond line here."
    junk = lambda i: " ".join(f"bit{(i + j) % 97}a$$$" for j in range(80))
    rows = [(i, prose(i)) for i in range(300)] + [(1000 + i, junk(i)) for i in range(60)]
    got = {r["doc_id"]: r for r in judge_quality(spark.createDataFrame(rows, DDL)).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[1000 + i]["kept"] for i in range(60))
    assert all(0 <= r["quality"] <= 1 for r in got.values())


def test_against_labels_that_are_never_learned(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{folder.replace('0.001', '0.1')}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = judge_quality(docs).where("not base_failed").join(labels, "doc_id").groupBy("label", "kept").count().collect()
    n = {(r["label"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, True), 0) <= 0.05 * n[(0, False)]


def test_defined_cases(spark):
    long_text = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (None, long_text), (5, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (6, "same " * 40)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as n_words", "2 as kept", "'q' as quality", "0 as vote_0")
    got = judge_quality(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows) and len(by[5]) == 2 and by[5][0] == by[5][1]
    assert all(by[i][0]["base_failed"] and not by[i][0]["kept"] for i in (1, 2, 3, 4, 6)) and by[1][0]["n_words"] == 0
    assert by[None][0]["n_words"] == 200_000 and by[None][0]["n_repeat_words"] == 0 and not by[5][0]["base_failed"] and by[6][0]["n_repeat_words"] == 40
    assert judge_quality(df.limit(0)).collect() == []
    assert len({r.name for r in RULES}) == len(RULES)
