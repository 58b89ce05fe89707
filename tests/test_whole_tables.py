"""Queries over whole tables against brute force."""

import os
import re

import pyarrow.parquet as pq
import pytest

from corvane.plans import registry, screening

DATA = "/root/testdata/sf0.001"


def count(pattern, description, text):
    return sum(1 for _ in re.finditer(pattern, text, re.S | (re.I if "context" in description.lower() else 0)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pii_counts_cover_every_language(spark, tmp_path):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    said = "Zoë: jane@roe.org, 10.2.3.4, 98765 43210, Âge: 31 ans, age: 31 years, IBAN DE89370400440532013000, ١٢٣٤٥"
    rows += [(-1, said, None), (-2, said, "fr"), (-3, said, "en"), (-4, "", "de"), (-5, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["pii_raw_counts"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {lang for *_, lang in rows} >= {"fr", "de", None}
    for i, text, _ in rows:
        assert [got[i][k] for k, _, _ in screening._PLAIN_PII] == [None if text is None else count(p, d, text) for _, p, d in screening._PLAIN_PII], i


def test_pii_far_into_a_text_is_found(spark, tmp_path):
    rows = [(1, "word " * 25_000 + "mail jane@roe.org and 10.2.3.4"), (2, "word " * 25_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.found, r.evidence) for r in registry.QUERIES["pii_matches"](spark, str(tmp_path)).collect()}
    assert got == {1: ("email,ipv4", "jane@roe.org,10.2.3.4"), 2: ("", "")}


def test_value_metrics_read_whole_texts(spark, tmp_path):
    rows = [(1, "word " * 40 + "7 42 42 NASA"), (2, "none here"), (3, "word " * 40 + "5")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in registry.QUERIES["value_metrics"](spark, str(tmp_path)).collect()] == [(1, 1, 2)]


def test_all_rows_outside_a_cache_are_looked_up(spark, tmp_path):
    rows = [(k, [1.0, k / 1000]) for k in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    looked_up = lambda name: {r.vec_id for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert looked_up("threat_cache") == set(range(50, 80))
    assert looked_up("allowlist_cache") == {*range(50), *range(70, 80)}
