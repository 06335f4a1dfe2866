"""Spelling variants against plain definitions."""

import random
import re
import zlib
from collections import Counter

import pytest
from leaguestats.checkpoints import Scratch
from leaguestats.llm import spelling
from leaguestats.llm.queries import QUERIES
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def pairs_of(words):
    """All near pairs, found through words with a letter taken out."""
    held = {}
    for w in words:
        for d in deletions(w) | {w}:
            held.setdefault(d, set()).add(w)
    return {(a, b) for group in held.values() for a in group for b in group if a < b and one_edit(a, b)}


def brute(rows, every, least_letters=5, least=3, times=2):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc if doc is not None else ''}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least_letters and c >= least}
    near = {w: [] for w in n}
    for a, b in pairs_of(n):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def as_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in df.collect())


def varied(draw, word, alphabet):
    i = draw.randrange(len(word) + 1)
    kind = draw.randrange(3)
    return word[:i] + (draw.choice(alphabet) if kind else "") + word[i + (kind != 1) :]


@pytest.mark.parametrize("most_words", [2, 30, 20_000])
@pytest.mark.parametrize("alphabet", ["ab", "abcdeéÿ", "abcdefghijklmnopqrstuvwxyz"])
def test_near_pairs_match_brute_force(spark, alphabet, most_words):
    draw = random.Random(len(alphabet))
    words = {"".join(draw.choice(alphabet) for _ in range(draw.randrange(5, 12))) for _ in range(150)}
    words |= {varied(draw, draw.choice(sorted(words)), alphabet) for _ in range(300)}
    words = {w for w in words if len(w) >= 5} | {"a" * k for k in range(5, 40)} | {"b" * 300, "b" * 150 + "a" + "b" * 149, "b" * 301}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(5)
    with Scratch(spark) as scratch:
        found = [(r.a, r.b) for r in spelling.near_pairs(frame, scratch, most_words).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs_of(words) and len(found) > 100


def test_groups_match_brute_force(spark):
    draw = random.Random(3)
    base = ["colour", "color", "colours", "straße", "strasse", "Élan", "élans", "élan", "naïves", "naives", "x" * 200, "x" * 201, "STRONG", "strong", "strung"]
    base += ["".join(draw.choice("abc") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join(draw.choice(base) + draw.choice(["", "1", "×", "÷ö", "ß"]) for _ in range(60))) for i in range(80)]
    rows += [(None, "colour colour"), (1, None), (1, ""), (2, "123 -- 日本語"), (2, "colour"), (2, "colour")]
    rows += [(7, "chaina " * 4 + "chainab " * 9 + "chainabc " * 20)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, WORD int").repartition(6)
    for every in (None, 3):
        expected = brute(rows, every)
        assert as_rows(spelling.spelling_groups(docs, every=every)) == expected
        assert any(r[1] for r in expected) and any(r[2] != r[1] and r[1] for r in expected)
    assert spelling.spelling_groups(docs.limit(0)).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_rows(QUERIES["op12_sorted_spelling"](spark, sf_dir)) == brute(rows, 97)
