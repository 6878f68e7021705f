"""The stages against plain versions of themselves, and the registered queries."""

from __future__ import annotations

import glob
import os
import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from lumenfold.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A small corpus: good, bad, doubled and near-copied documents, one with extra columns' names."""
    good = [" ".join(f"w{k}x{j}" for j in range(40)) + f"\nowner line {k} 4041894974608795" for k in range(30)]
    bad = [" ".join(f"w{k}x{j}###" for j in range(40)) for k in range(30)]
    near = [good[3].replace("w3x39", "changed")]
    texts = [*good, *bad, *near, None, "", "shared line of many\n" + good[5].replace("w5", "v5"), "shared line of many\n" + good[6].replace("w6", "u6")]
    rows = [(k, t, "en", "s", None if t is None else len(t), "clash") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 30)) for k in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), texts


def test_stages(spark, folder):
    sf_dir, texts = folder
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        rows = docs.collect()
        seen[name] = {r.doc_id: r.text for r in rows}
        assert all(r.n_lines == "clash" and r.lang == "en" for r in rows)
    kept = set(range(30)) | {60, 63, 64}
    assert set(seen["quality_rules"]) == kept
    assert all(seen["quality_rules"][k] == texts[k] for k in kept)
    lines = seen["line_dedup"]
    assert lines[63] == texts[63].rsplit("\n", 1)[0] and lines[64] == texts[64].split("\n")[1]
    assert set(seen["minhash_near_dedup"]) == kept - {60}
    private = seen["pii_pseudonyms"]
    assert all("4041894974608795" not in t for t in private.values())
    assert len({m[1] for t in private.values() if (m := re.search(r" (\d{16})$", t))}) == 1
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = defaultdict(int)
    for r in packed:
        tokens[r.doc_id] += r.length
    assert set(tokens) == kept - {60} and all(tokens[r.doc_id] == r.doc_tokens for r in packed)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_quality_rules", "op2_byte_bpe", "op3_toxicity", "op5_line_dedup", "op6_pii_pseudonyms", "op8_packing", "op9_secret_scan", "op10_minhash_near_dedup"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    df, expected = queries.queries()[name](spark, SF), c.sql(sql.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(expected.columns) == order
    rows = lambda got, cols: sorted(tuple(str(r[cols.index(x)]) for x in order) for r in got)
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)


def test_all_are_registered(spark):
    names = set(driver.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert {int(m[1]) for n in queries.queries() if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_one_row_per_input_row(spark, name):
    table = {"op4": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    n = corpus_pipeline.table(spark, SF, table).count()
    got = queries.queries()[name](spark, SF).select(key)
    assert got.distinct().count() == n
    if not name.startswith("op8_"):
        assert got.count() == n
