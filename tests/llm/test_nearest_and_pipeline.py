from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cryoframe.llm.nearest import nearest_neighbours


def exact(rows, k, asks):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 8:
            continue
        usable.setdefault((i, tuple(np.float32(x) for x in v)), None)
    usable = list(usable)
    out = {}
    for i, v in usable:
        if asks(i):
            near = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), j) for j, w in usable if j != i)
            out[i] = near[:k]
    return out


def test_small_tables_have_all_leaves_opened(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)] + [(0, rows[0][1])]
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0] * 7 + [float("nan")]), (503, [float("inf")] + [1.0] * 7), (504, []), (505, [1.0] * 5), (None, rows[3][1]), (507, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").selectExpr("*", "2 as leaf", "3 as ids")
    got: dict = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 10 == 0, k=10, leaf=16, sample=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = exact(rows, 10, lambda i: i % 10 == 0)
    assert set(got) == set(expected)
    for q, near in expected.items():
        assert [(v, n) for n, v, _ in sorted(got[q])] == [(j, n) for n, (_, j) in enumerate(near, 1)]
        assert np.allclose([s for *_, s in sorted(got[q])], [d for d, _ in near], rtol=1e-12, atol=0)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 1.0)]
    assert nearest_neighbours(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    assert nearest_neighbours(df, F.col("vec_id") < 0).collect() == []


def test_recall_of_a_bounded_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 6000)] + 0.1 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, leaf=64, search=1500, sample=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        far = ((vectors - vectors[q]).astype(float) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits / 600 >= 0.9


def gaussian(spark, folder, n, dim):
    """Vectors without near neighbours, as a table and as a matrix in the order of their ids."""
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(d).cast("float") for d in range(dim)]).alias("embedding")).write.parquet(str(folder))
    df = spark.read.parquet(str(folder))
    return df, np.array(df.orderBy("vec_id").toPandas()["embedding"].tolist())


def recall_of(got, vectors, step):
    found: dict = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in range(0, len(vectors), step):
        far = ((vectors - vectors[q]).astype(float) ** 2).sum(axis=1)
        far[q] = np.inf
        hits.append(len(found[q] & set(np.argsort(far, kind="stable")[:10].tolist())) / 10)
    return sum(hits) / len(hits)


def test_a_search_of_all_leaves_and_a_complete_one_are_exact(spark, tmp_path):
    df, vectors = gaussian(spark, tmp_path / "v", 4000, 32)
    asks = F.col("vec_id") % 40 == 0
    assert recall_of(nearest_neighbours(df, asks, search=16 * 4000, sample=1000), vectors, 40) == 1.0
    assert recall_of(nearest_neighbours(df, asks, complete=True), vectors, 40) == 1.0


def test_the_search_grows_with_the_table(spark, tmp_path, monkeypatch):
    df, vectors = gaussian(spark, tmp_path / "v", 60_000, 64)
    assert recall_of(nearest_neighbours(df, F.col("vec_id") % 200 == 0, sample=5000), vectors, 200) >= 0.9
    # Vectors in a plane have near neighbours: the forest opens as little as meets the share.
    monkeypatch.setattr("cryoframe.llm.nearest.OPENED", 10)
    df, vectors = gaussian(spark, tmp_path / "p", 20_000, 2)
    assert 0.9 <= recall_of(nearest_neighbours(df, F.col("vec_id") % 50 == 0, leaf=16, trees=2), vectors, 50) < 1.0


def test_pipeline_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()} if name != "packing" else None
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
    assert seen["personal_data"].count() == seen["decontamination"].count()
    pieces = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == seen["personal_data"].count() and all(r["n"] == r["t"] for r in pieces)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) != [] and whole.agg(F.sum("length")).first()[0] == seen["packing"].agg(F.sum("length")).first()[0]


def test_near_dedup_stage_takes_pairs_from_four_fifths(spark, folder):
    """Pairs of similarity 0.75 to 0.9, against their shingle sets."""
    rows, kept = [], set()
    for t in range(5, 15):
        for g in range(20):
            base = [f"t{t}g{g}w{i}" for i in range(104)]
            texts = [base, base[: 104 - t] + [f"t{t}g{g}x{i}" for i in range(t)]]
            a, b = ({tuple(w[i : i + 5]) for i in range(100)} for w in texts)
            first = len(rows)
            rows += [(first + n, " ".join(w)) for n, w in enumerate(texts)]
            kept |= {first} if 100 * len(a & b) >= 80 * len(a | b) else {first, first + 1}
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()} == kept


def test_stages_take_odd_rows(spark, folder):
    rows = [(1, None, "en", "s", 0), (None, "a b c d e f", None, None, 3), (2, "", "en", "s", 0), (3, "the same five words here", "en", "s", 9), (3, "the same five words here", "en", "s", 9), (4, "The same five words here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as vertex", "3 as x", "4 as spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and stage(spark, docs.where("false"), folder).count() == 0
        if name == "near_dedup":
            assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 3, None]
        else:
            assert out.count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(rows)
