"""Collocations against a plain count."""

import random
import re
from collections import Counter

import duckdb
import pytest
from leaguestats.llm import phrases
from leaguestats.llm.oracles import ORACLES
from leaguestats.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest=5, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    made = {}
    for (lang, words), a in count.items():
        if len(words) > 1 and a >= least:
            cuts = [(1000 * a * total[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            made[lang, words] = (a, count[lang, words[:k]], count[lang, words[k:]], total[lang], score)

    def within(lang, words, a):
        return any(
            o[0] == lang and len(o[1]) > len(words) and v[0] >= a and any(o[1][i : i + len(words)] == words for i in range(len(o[1])))
            for o, v in made.items()
        )

    out = []
    for lang in total:
        kept = [(-v[4], -v[0], " ".join(w).encode(), v) for (g, w), v in made.items() if g == lang and not within(g, w, v[0])]
        out += [(lang, i + 1, p.decode(), *v) for i, (_, _, p, v) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(seed, rows=150):
    draw = random.Random(seed)
    common = [f"w{i}" for i in range(6)] + ["en", "de"] + ["É", "x²", "A\x00b", "'", "…"]
    made = []
    for i in range(rows):
        words = [draw.choice(common) if draw.random() < 0.8 else f"rare{draw.randrange(400)}" for _ in range(draw.randrange(120))]
        text = "".join(w + draw.choice([" ", "  ", "\t", " ", " ", ", ", "\n", "\x0b", "! ?", " ", " "]) for w in words)
        made.append((draw.choice(["en", "de", None]), text + "The quick Brown fox jumps over the lazy dog" * (i % 3 == 0)))
    return made + [("en", None), ("en", ""), (None, " \t\n.,"), ("fr", "one two"), ("en", "A " * 3000)]


@pytest.mark.parametrize("modulus", [1, 3, 24])
def test_counts_match_brute_force(spark, modulus):
    rows = texts(modulus)
    docs = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, Phrase int").repartition(7)
    found = phrases.collocations(docs, least=8, modulus=modulus)
    assert found.columns == COLUMNS
    expected = brute(rows, 8)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 200
    cut = phrases.collocations(docs, least=8, longest=3, top=5, modulus=modulus)
    assert sorted(map(tuple, cut.collect())) == brute(rows, 8, 3, 5)


def test_chunks_repeat_with_the_passage(spark):
    draw = random.Random(5)
    passage = " ".join(f"p{draw.randrange(1000)}" for _ in range(400))
    docs = spark.createDataFrame([("en", f"a{i} b{i} {passage} c{i}") for i in range(20)], "lang string, text string")
    chunks = phrases.parsed(docs, 4, 8).collect()
    # The passage's chunks are the same in all texts; only those at its ends differ.
    assert sum(c.n == 20 for c in chunks) > 20 and sum(c.n < 20 for c in chunks) <= 20 * 6


def test_edges(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    big = 10**9  # products beyond 64 bits
    table = spark.createDataFrame([("en", "a", 1, big * 9), ("en", "b", 1, big * 8), ("en", "a b", 2, big * 7)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, total long")
    (row,) = phrases._scored(table, totals).collect()
    assert row.score == 1000 * 7 * big * 10**13 // (72 * big * big)


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = duck.execute(ORACLES["op11_phrase_parsing"])
    names = [c[0] for c in result.description]
    expected = sorted(tuple(row[names.index(c)] for c in COLUMNS) for row in result.fetchall())
    found = QUERIES["op11_phrase_parsing"](spark, sf_dir)
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == expected and len(expected) > 50
