from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cryoframe.llm.near_dedup import bits_for, drop_near_duplicates, groups_for, near_duplicate_groups
from cryoframe.llm.wordhash import shingle_hashes, text_bytes, word_hashes, word_spans

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None, width: int = 5) -> set:
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng: random.Random, words: list[str], share: float) -> str:
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = [f"g{g}x{rng.randrange(500)}" for _ in range(rng.randrange(60, 240))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((n, edited(rng, base, rng.choice([0, 0.002, 0.01, 0.02, 0.03, 0.05, 0.2]))))
            n += 1
        rows.append((n, rows[-1][1].upper() + "  \n"))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three"), (n + 6, "z " * 60_000)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in near_duplicate_groups(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    expected = brute(corpus)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["n_shingles"] == len(shingle_set(dict(corpus)[i])) and r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_one_large_group_of_copies(spark):
    rows = [(i, "a b c d e f g h") for i in range(2000)] + [(5000 + i, f"other text number {i} with its own words {i} here") for i in range(20)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 2000} == {0} and sum(r["kept"] for r in got) == 21


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", 3), (1, "a b c d e f", 4), (None, "a b c d e f", 5), (0, "a b c d e f", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, vertex int").selectExpr("*", "1 as component", "2 as key", "3 as digest")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicate_groups(df).collect()), key=str)
    assert got == sorted([(1, 0, False), (1, 0, False), (0, 0, True), (None, None, True), (None, None, True)], key=str)
    assert near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_do_not_depend_on_batches():
    texts = ["Größe a\tb", None, "", "x" * 700_000 + " tail of words here now", "a b c d e f", "A B C D E F"]
    def of(part):
        raw, at = text_bytes(pa.array(part, pa.string()))
        s, e, w = word_spans(raw, at)
        return shingle_hashes(word_hashes(raw, s, e), w)
    together, offsets = of(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(of([t])[0], together[offsets[i] : offsets[i + 1]])
    assert np.array_equal(together[offsets[4] : offsets[5]], together[offsets[5] : offsets[6]])


def test_bounds_follow_the_threshold():
    assert groups_for(85, 100) == 7 and groups_for(80, 100) == 9 and bits_for(85, 100) > 100 and bits_for(100, 100) == 0
    with pytest.raises(ValueError):
        groups_for(0, 100)


def test_rows_of_one_id_are_linked_by_their_own_texts(spark):
    x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    rows = [(3, x), (3, y), (1, x + " tail"), (2, y + " tail"), (2, y + " tail"), (7, x + " end"), (7, x + " end more"), (None, x), (9, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicate_groups(df).collect()), key=str)
    assert got == sorted([(3, 1, False), (3, 2, False), (1, 1, True), (2, 2, True), (2, 2, True), (7, 1, False), (7, 1, False), (None, None, True), (9, 9, True), (9, 9, True)], key=str)
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in drop_near_duplicates(df).fillna("none").collect())
    assert kept == [(-1, x), (1, x + " tail"), (2, y + " tail"), (9, ""), (9, "none")]
    # two linked texts of one id: one stays
    twice = drop_near_duplicates(spark.createDataFrame([(4, x), (4, x + " tail"), (5, x + " end")], "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in twice] == [4]


def test_a_bucket_of_many_similar_unlinked_texts(spark):
    """Texts of which any two share three quarters of their shingles, and linked pairs among them."""
    common = [f"c{i}" for i in range(90)]
    rows = [(i, " ".join(common + [f"u{i}_{k}" for k in range(14)])) for i in range(5000)]
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(0, 5000, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(df.repartition(4)).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_exact_run_finds_all_links(spark, corpus):
    got = near_duplicate_groups(spark.createDataFrame(corpus, "doc_id long, text string"), exact=True).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(corpus)


@pytest.mark.parametrize("numerator", [80, 70])
def test_other_thresholds_lose_no_links(spark, numerator):
    """Of pairs just above and just below the threshold those above are linked, but for a few in ten thousand."""
    above = max(t for t in range(100) if 100 * (100 - t) >= numerator * (100 + t))
    rows, linked = [], {}
    for p in range(1500):
        # 104 words each, the last t of them different: of 100 shingles 100 - t are shared.
        t = above + (p % 3 == 2)
        base = [f"p{p}w{i}" for i in range(104)]
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(base[: 104 - t] + [f"q{p}w{i}" for i in range(t)]))]
        linked[2 * p + 1] = t == above
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), numerator=numerator).collect()}
    assert sum(linked.values()) == 1000
    wrong = [i for i, near in linked.items() if (got[i] == i - 1) != near]
    assert len(wrong) <= 3 and all(linked[i] for i in wrong)
