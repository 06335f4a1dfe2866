"""The language model against a plain one in Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from leaguestats.checkpoints import Scratch
from leaguestats.llm import kneser
from leaguestats.llm.queries import QUERIES
from leaguestats.llm.wordarrays import Words, mix, unmix
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def brute(training):
    """Probability of a word after another, from the definition, with dictionaries."""
    pairs, count = Counter(), Counter()
    for text in training:
        words = tokens_of(text)
        count.update(words)
        pairs.update(zip([None, *words[:-1]], words))
    left, total, after = Counter(), Counter(), defaultdict(list)
    for (v, w), n in pairs.items():
        left[w] += 1
        total[v] += n
        after[v].append(n)

    def cut(counts):
        kinds = tuple(sum(1 for n in counts if n == k) for k in (1, 2, 3, 4))
        d = kneser.discounts(kinds)
        return lambda n: d[min(n, 3)]

    upper, lower = cut(list(pairs.values())), cut(list(left.values()))

    def single(w):
        spare = sum(lower(n) for n in left.values()) / len(pairs) / (len(left) + 1)
        return (left[w] - lower(left[w])) / len(pairs) + spare if w in left else spare

    def p(v, w):
        if total[v] == 0:
            return single(w)
        seen = pairs[v, w]
        return ((seen - upper(seen)) + sum(upper(n) for n in after[v]) * single(w)) / total[v]

    return p, count


TRAIN = ["the cat sat on the mat", "The CAT sat", "the dog sat on the log the end", None, "", " a\tb\x0bc ", "É é É", "x " * 40, "the cat sat"]
TEXTS = [*TRAIN, "a bird sat on the cat", "zzz yyy", "the cat sat the cat sat", "\x00    x", "x " * 5000]


def test_scores_match_a_plain_model(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, Score int")
    training = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(5)
    p, count = brute(TRAIN)
    size = sum(count.values())
    found = {r.doc_id: r for r in kneser.score_texts(docs, training).collect()}
    assert set(found[0].asDict()) == {"doc_id", *kneser.ADDED}
    for i, text in enumerate(TEXTS):
        words = tokens_of(text)
        row = found[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(w in count for w in words), size)
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (size + len(count) + 1)) for w in words))
        assert row.score == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip([None, *words[:-1]], words)), rel=1e-9)


def test_probabilities_add_up_to_one(spark):
    training = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    with Scratch(spark) as scratch:
        model = kneser.fit(training, scratch, part_rows=2)  # many parts
        assert len(model.word_sizes) > 4 and len(model.pair_sizes) > 4
        names = sorted({w for t in TRAIN for w in tokens_of(t)} - {"\n"})
        for before in ["the", "x", "c", "nowhere", ""]:
            words, codes, ends = kneser._tokens(pa.array([f"{before} {w}" for w in [*names, "unseen", ""]]))
            chances, _ = kneser.log_probabilities(model, words, codes, ends)
            of = chances[ends - 2] if not before else chances[np.concatenate(([0], ends[:-1])) + 1]
            if not before:
                of = np.concatenate((of[:-1], [chances[-1]]))  # the empty text is its end at once
            assert of.sum() == pytest.approx(1.0)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    empty = docs.limit(0)
    assert kneser.score_texts(empty, docs).collect() == []
    rows = kneser.score_texts(docs, empty).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.0} and {r.train_tokens for r in rows} == {0}
    rows = kneser.score_texts(docs, docs).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.n_tokens == 3}) == 1


def test_scrambling_is_one_to_one():
    numbers = np.array([0, 1, 2**32, 2**64 - 1, 123456789], np.uint64)
    assert (unmix(mix(numbers)) == numbers).all()
    words = Words(pa.array([" a  B", None, "", "b\x0ba"]))
    assert [words.names[c].as_py() for c in words.codes] == ["a", "b", "b", "a"] and list(words.starts) == [0, 2, 2, 2, 4]


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op13_kneser_ney"](spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    assert set(rows) == set(texts) and {i for i, r in rows.items() if r.held_out} == held
    p, count = brute([t for i, t in texts.items() if i not in held])
    for i, text in texts.items():
        words = tokens_of(text)
        assert rows[i].n_tokens == len(words) and rows[i].n_known == sum(w in count for w in words)
        assert rows[i].train_tokens == sum(count.values())
        if i % 20 == 0:
            p_text = sum(math.log10(p(v, w)) for v, w in zip([None, *words[:200]], words[:200])) if len(words) < 200 else None
            assert p_text is None or rows[i].score == pytest.approx(p_text, rel=1e-9)
    # Held-out texts are likelier under the model than under single words.
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)
