"""WAND search against scores of all documents, and its defined cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from cryoframe.llm.lexical_search import Shard, Statistics, ranked_search, search_shard, terms_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """All scores by the formula, in plain integers."""
    texts = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, total = len(texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, w in texts:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // total
            score = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    return [(i, " ".join(rng.choices(pool, weights=[1 / (j + 1) for j in range(400)], k=rng.randint(1, 60)))) for i in range(n)], rng, pool


def test_equals_brute_force_whatever_the_shards(spark):
    docs, rng, pool = corpus(1500, 1)
    docs += [(5000 + i, docs[3][1]) for i in range(700)]  # a third are copies: ties at the heap's border
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 40)))) for i in range(25)] + [(90, docs[3][1]), (91, "w0 w0 w0 w1"), (92, "absent"), (93, None), (94, " ,. "), (95, docs[3][1])]
    d, q = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert found(ranked_search(d, q)) == want
    assert found(ranked_search(d, q, shard_postings=64)) == want
    assert found(ranked_search(d, q, block_bytes=300)) == want


def test_documents_are_skipped():
    docs, rng, pool = corpus(4000, 2)
    lists = [Counter(words(t)) for _, t in docs]
    place = {w: i for i, w in enumerate(pool)}
    owners = np.concatenate([np.full(len(c), i) for i, c in enumerate(lists)])
    df = Counter(place[w] for c in lists for w in c)
    sizes = np.array([sum(c.values()) for c in lists])
    statistics = Statistics(len(docs), int(sizes.sum()), df)
    shard = Shard([d for d, _ in docs], sizes, np.array([place[w] for c in lists for w in c]), np.array([n for c in lists for n in c.values()]), owners, statistics)
    query = [(place[w], statistics.weight(place[w])) for w in ("w0", "w1", "w2", "w150", "w300")]
    heap: list = []
    scored = search_shard(shard, query, heap, 10)
    candidates = sum(1 for c in lists if any(w in c for w in ("w0", "w1", "w2", "w150", "w300")))
    assert len(heap) == 10 and scored < candidates / 3


def test_defined_cases(spark):
    docs = [(1, "Alpha beta"), (1, "alpha BETA"), (None, "alpha beta"), (2, None), (3, ""), (4, "!?"), (5, "x " * 50_000 + "ALPHA"), (6, "ÄLPHA älpha"), (7, "alpha")]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta"), (None, "beta"), (2, "Älpha"), (3, "x" + " y" * 3000), (4, None)]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as n", "'t' as terms", "2 as query", "3 as score", "4 as rank")
    q = spark.createDataFrame(items, ITEMS).selectExpr("*", "5 as query", "6 as doc_id")
    assert found(ranked_search(d, q)) == brute(docs, items)
    assert found(ranked_search(d.limit(0), q)) == [] and found(ranked_search(d, q.limit(0))) == [] and found(ranked_search(d.where("doc_id = 2"), q)) == []


def test_terms():
    text = "Ab1_c-D É日本 x\u0000y\u007fz"
    assert [t.decode() for t in terms_of(text.encode())] == words(text)
