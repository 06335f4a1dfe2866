"""Mixing against its targets, and the pipeline's stages."""

import os
import shutil

import corpus_pipeline
import numpy as np
import pytest
from leaguestats.llm import mixing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def expected(rates):
    rows = rates.collect()
    return sum((np.array(r.p) * r.rate * r.tokens for r in rows), np.zeros(len(rows[0].p))), rows


def test_rates_meet_targets(documents):
    labelled = documents.select("text", F.col("lang").alias("label"))
    totals, rows = expected(mixing.fit_rates(documents, labelled, targets={"en": 2, "de": 1, "es": 1, "fr": 1}))
    goal = np.array([1, 2, 1, 1]) / 5 * sum(r.tokens for r in rows)
    assert np.abs(totals / goal - 1).max() < 0.01 and min(r.rate for r in rows) >= 0
    assert abs(sum(r.copies * r.tokens for r in rows) / goal.sum() - 1) < 0.15


def test_no_document_goes_with_a_least_rate(documents):
    labelled = documents.select("text", F.col("lang").alias("label"))
    _, rows = expected(mixing.fit_rates(documents, labelled, least_rate=1.0, keep_largest=True))
    assert min(r.copies for r in rows) >= 1 and max(r.rate for r in rows) > 1.05


def test_odd_rows_and_missing_labels(spark, documents):
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "le la de"), (2, "le la de")], "doc_id bigint, text string")
    labelled = documents.select("text", F.col("lang").alias("label"))
    rows = mixing.fit_rates(odd, labelled).collect()
    assert len(rows) == 4 and all(np.isfinite(r.rate) and r.rate >= 0 for r in rows)
    assert [r.rate for r in mixing.fit_rates(odd, labelled.limit(0)).collect()] == [1.0] * 4
    assert mixing.fit_rates(odd.limit(0), labelled).collect() == []


def test_stages_in_order_and_columns(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_copies", "mixing", "packing"]
    docs, counts = documents, [documents.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] >= counts[3]
    last = corpus_pipeline.run(spark, SF)
    assert last.select("doc_id").distinct().count() == counts[3]


def test_the_rest_works_without_the_text_part(tmp_path):
    """A copy of the repository less the text part imports and lists its other queries."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    n, text = said.stdout.split()
    assert int(n) >= 60 and text == "False"
