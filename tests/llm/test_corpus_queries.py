"""The corpus queries over the smallest driver tables: SQL where there is some, contracts elsewhere."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from cryoframe.llm import queries

COLUMNS = {
    "op1_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_forest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op3_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_license_windows": {"doc_id": "bigint", "license": "string", "containment": "double"},
    "op5_nnpu_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_string_tiling": {"doc_id": "bigint", "item_id": "bigint", "coverage": "double"},
    "op7_vector_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_spectrum_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_entropy_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op11_tiled_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_wand_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_quality_votes": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    "op10_url_digests": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}
PER_DOCUMENT = ("op1_", "op3_", "op5_", "op8_", "op9_", "op13_")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    n = df.count()
    if name.startswith(PER_DOCUMENT):
        assert n == spark.read.parquet(f"{folder}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    expected = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    rows = sorted((tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()), key=str) == rows


def test_only_the_corpus_modules_import_each_other():
    root = os.path.dirname(os.path.dirname(os.path.abspath(queries.__file__)))
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "llm" not in f.read(), path
