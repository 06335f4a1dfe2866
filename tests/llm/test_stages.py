"""Each pipeline stage on odd rows: nulls, empty texts, ties, repeated rows, clashing columns, no rows."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
EXTRA = ("kept", "KEY", "component_id", "copies", "_k_id", "label", "rank", "row", "n", "p")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Sound documents with odd ones among them, and columns named like those the operators use."""
    sound = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) between 400 and 4000").limit(40)
    sound = sound.select("doc_id", "text", "lang", "source", "n_chars")
    some = sound.limit(3)
    long = sound.limit(1).select(F.lit(90_001).cast("bigint").alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 300).alias("text"), "lang", "source", "n_chars")
    odd = spark.createDataFrame(
        [(90_002, None, "en", "s", 0), (90_003, "", None, "s", 0), (90_004, " \n ", "en", "s", 3), (None, "two words", "en", None, None), (None, None, None, None, None)],
        sound.schema,
    )
    tied = some.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    whole = sound.unionByName(some).unionByName(tied).unionByName(long).unionByName(odd)
    return whole.withColumns({c: F.lit(i).cast("bigint") for i, c in enumerate(EXTRA)}).cache()


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_keeps_its_contract_on_odd_rows(spark, docs, name):
    before = rows_of(docs)
    made = STAGES[name](spark, docs, SF_DIR)
    if name == "packing":
        pieces = made.collect()
        assert sum(p.length for p in pieces if p.start == 0 or True) == sum(p.doc_tokens for p in pieces if p.start == 0)
        assert sum(p.start == 0 for p in pieces) == sum(before.values())
        return
    assert made.columns == docs.columns
    after = rows_of(made)
    assert set(after) <= set(before)
    assert made.select(*[F.col(f"`{c}`") for c in EXTRA]).distinct().count() == 1
    texts = Counter()
    for (_, text), n in before.items():
        texts[text or ""] += n
    if name == "quality_rules":
        assert all(text for _, text in after) and (None, "two words") not in after
        sound = [k for k in before if k[0] is not None and 400 <= len(k[1] or "") <= 4000]
        assert sum(k in after for k in sound) >= 0.8 * len(sound) and all(after[k] == before[k] for k in after)
    if name == "exact_dedup":
        assert Counter(text or "" for _, text in after.elements()) == Counter(list(texts))
        best = {t: max((i for i, x in before if (x or "") == t and i is not None), default=None) for t in texts}
        assert all(i == best[t or ""] for i, t in after)
    if name == "near_copies":
        assert all(n == 1 or not (t or "").split() for (_, t), n in after.items())
        wordless = {k: n for k, n in before.items() if not (k[1] or "").split()}
        assert all(after[k] == n for k, n in wordless.items())
        worded = {t for _, t in before if (t or "").split()}
        assert {t for _, t in after if (t or "").split()} <= worded and len(after) >= 30
        assert all(i < 1_000_000 for i, t in after if i is not None)  # of equal texts the smallest id
    if name == "mixing":
        assert all(after[k] >= before[k] for k in before)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, docs, name):
    made = STAGES[name](spark, docs.limit(0), SF_DIR)
    assert made.count() == 0 and (name == "packing" or made.columns == docs.columns)
