"""Quality rules, languages, toxicity, packing, sharding and formatting on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from leaguestats.llm import chat, common, language, packing, quality, sharding, toxicity
from leaguestats.llm.queries import fertility, packed
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\n", "a  b\n \nc", "it's  we'll x²'s", "<|endoftext|> ok", "a <|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext|", "<|ENDOFTEXT|>", "é" * 300, "word " * 3000, "日本語 текст", "퟿€\t!", "same", "same"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, ("en", None)[i % 2], "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_packing_round_trip(spark):
    docs = docs_of(spark, ODD)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in ODD]
    pieces = packed(docs).collect()
    for doc, own in enumerate(ids):
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(own)) and p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
            at += p.length
        assert at == len(own)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 1024 and sorted(sequences) == list(range(len(sequences)))
    assert packed(docs.limit(0)).collect() == []


def test_hilbert_key_steps_to_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_base_counts_match_brute_force(documents):
    for text in [t or "" for t in ODD] + [r.text for r in documents.limit(60).collect()]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert quality.base_counts(text) == expected


def test_fallback_share_is_that_of_the_tokenizer():
    made = quality.fallback(public_tokenizers.path("piece_bpe_32k.model"))
    wide = "".join(chr(0xFF21 + i % 26) for i in range(60))
    for text in [*ODD, wide, "plain words\n", "mixed ퟿ and 🜁 words", "ᚠᚢᚦ " * 50_000]:
        text = text or ""
        ids = made.pieces.encode(re.sub("[\t-\r]", " ", text))
        expected = np.mean([made.pieces.is_byte(i) for i in ids]) if ids else 0.0
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        assert made.share(text, codes) == pytest.approx(expected, abs=1e-4)
    assert made.share(wide, np.frombuffer(wide.encode("utf-32-le"), "<u4")) > 0.5


def test_quality_rules(spark, documents):
    found = fertility(docs_of(spark, ODD)).collect()
    assert len(found) == len(ODD) and not any(r.kept for r in found)  # all are too short or repeat themselves
    whole = fertility(documents)
    assert whole.count() == documents.count()
    draw = random.Random(1)
    base = [r.text for r in documents.where("lang = 'en'").limit(150).collect()]
    junk = " ".join("".join(draw.choice("#~^=+") for _ in range(9)) for _ in range(200))
    rows = {r.doc_id: r for r in fertility(docs_of(spark, [*base, junk])).collect()}
    assert not rows[len(base)].base_failed and not rows[len(base)].kept
    passed = [r for r in rows.values() if not r.base_failed and r.doc_id < len(base)]
    assert sum(r.kept for r in passed) >= 0.9 * len(passed)
    assert fertility(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("lang, first, last", [("ko", 0xAC00, 0xB3FF), ("th", 0xE01, 0xE2E), ("ru", 0x430, 0x44F), (None, 0x995, 0x9A8)])
def test_few_clean_rows_of_another_script_stay(spark, documents, lang, first, last):
    draw = random.Random(2)
    base = [(i, r.text, "en") for i, r in enumerate(documents.where("lang = 'en' and length(text) > 300").limit(120).collect())]
    lexicon = ["".join(chr(draw.randint(first, last)) for _ in range(draw.randint(2, 6))) for _ in range(600)]
    few = [(1000 + i, " ".join(draw.choice(lexicon) for _ in range(draw.randint(120, 300))), lang) for i in range(12)]
    junk = [(2000, " ".join("".join(draw.choice("#~^=+") for _ in range(9)) for _ in range(200)), None)]
    junk += [(2001, " ".join("".join(draw.choice("#~^=+") for _ in range(9)) for _ in range(200)), lang)] if lang else []
    docs = spark.createDataFrame(base + few + junk, "doc_id bigint, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility(docs).collect()}
    assert all(kept[i] for i, _, _ in few) and not any(kept[i] for i, _, _ in junk)


def test_automaton_matches_all_substrings_and_no_others():
    text = np.array([random.Random(2).randrange(3) for _ in range(40)])
    following = language.suffix_automaton(text)

    def known(word):
        state = 0
        for symbol in word:
            state = following[state].get(int(symbol))
            if state is None:
                return False
        return True

    joined = "".join(map(str, text))
    draw = random.Random(3)
    for _ in range(500):
        word = [draw.randrange(3) for _ in range(draw.randrange(1, 8))]
        assert known(word) == ("".join(map(str, word)) in joined)


def test_phrases_match_a_greedy_parse():
    parser = language.Parser((("x", "the cat sat on the mat"), ("y", "ein hund lief im wald")))
    text = "the hund sat im wald and ran off"
    counts, lengths = parser.phrases([text, "", "zzz"])
    for k, (_, sample) in enumerate((("x", "the cat sat on the mat"), ("y", "ein hund lief im wald"))):
        normal = parser.normal(text).tolist()
        sampled = parser.normal(sample).tolist()
        occurs = lambda part: any(sampled[i : i + len(part)] == part for i in range(len(sampled)))
        at = phrases = 0
        while at < len(normal):
            end = at + 1
            while end < len(normal) and occurs(normal[at : end + 1]):
                end += 1
            at, phrases = end, phrases + 1
        assert counts[k, 0] == phrases
    assert counts[:, 1].tolist() == [0, 0] and lengths.tolist() == [len(parser.normal(text)), 0, 3]


def test_a_list_of_edges_parses_as_the_whole_table_does(monkeypatch):
    samples = (("x", "the cat sat on the mat "), ("y", "ein hund lief im wald "), ("z", "한국어 문장 한국 사람"))
    texts = ["the hund sat im wald", "", "한국어 사람 the cat", "q" * 700, "日本"]
    whole, lengths = language.Parser(samples).phrases(texts)
    monkeypatch.setattr(language, "DENSE", 0)
    edges = language.Parser(samples)
    assert edges.automata[0].table is None and (edges.phrases(texts)[0] == whole).all()


def test_languages_of_seven_scripts(spark):
    draw = random.Random(12)
    alphabets = {
        "de": "abcdefghijklmnopqrstuvwxyzäöüß", "fr": "abcdefghijklmnopqrstuvwxyzéèçà", "el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
        "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 900))), "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 1200))), "ja": "".join(map(chr, range(0x3041, 0x3090))),
    }
    vocabulary = {lang: ["".join(draw.choice(a) for _ in range(draw.randrange(1, 7))) for _ in range(300)] for lang, a in alphabets.items()}
    said = lambda lang, n: " ".join(draw.choice(vocabulary[lang]) for _ in range(n))
    labelled = spark.createDataFrame([(lang, said(lang, 300)) for lang in alphabets for _ in range(6)], "lang string, text string")
    asked = [(lang, said(lang, 20)) for lang in alphabets for _ in range(5)]
    found = {r.doc_id: r.lang_pred for r in language.identify_languages(docs_of(spark, [t for _, t in asked]), labelled).collect()}
    assert [found[i] for i in range(len(asked))] == [lang for lang, _ in asked]


def test_samples_come_from_anywhere_in_a_text(spark):
    head = "this header stands before every text " * 400
    tail = {"aa": "grzegorz brzmi w trzcinie ", "bb": "el perro come la carne "}
    rows = [(lang, head + text * 600) for lang, text in tail.items()]
    samples = dict(language.training_samples(spark.createDataFrame(rows, "lang string, text string"), 24_000, 64))
    assert all("header" not in samples[lang] or any(w in samples[lang] for w in text.split()) for lang, text in tail.items() if lang in samples)
    stretches = spark.createDataFrame([(f"{i} " + "x" * 50 + "y" * 50,) for i in range(40)], "text string")
    found = {r.s for r in stretches.select(common.hashed_stretch("text", 10).alias("s")).collect()}
    assert all(len(x) == 10 for x in found) and len(found) >= 4 and any("y" in x for x in found)
    assert spark.createDataFrame([("ab",), ("",), (None,)], "text string").select(common.hashed_stretch("text", 10).alias("s")).collect() == [("ab",), ("",), (None,)]


def test_languages_of_held_out_rows(spark, documents):
    found = language.identify_languages(documents, documents.where("doc_id % 3 <> 0").select("lang", "text"))
    held_out = found.join(documents.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 0")
    assert held_out.where("lang = lang_pred").count() >= 0.95 * held_out.count()
    odd = {r.doc_id: r for r in language.identify_languages(docs_of(spark, ODD), documents.select("lang", "text")).collect()}
    assert [odd[i].lang_pred for i in range(4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in odd.values())
    none = language.identify_languages(docs_of(spark, ["text"]), documents.select("lang", "text").limit(0)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_a_language_of_one_short_row_or_of_near_copies(spark, documents):
    rows = documents.where("lang is not null").select("lang", "text")
    english = documents.where("lang = 'en' and length(text) > 400").limit(40)
    short = spark.createDataFrame([("aa", "ok "), ("ab", "Grzegorz brzmi w trzcinie")], "lang string, text string")
    found = language.identify_languages(english, rows.union(short)).collect()
    assert sum(r.lang_pred == "en" for r in found) >= 38
    own = language.identify_languages(docs_of(spark, ["Grzegorz brzmi w trzcinie"]), rows.union(short)).first()
    assert own.lang_pred == "ab"
    draw = random.Random(8)
    syllables = [a + b for a in "bdgkz" for b in ("uu", "oo", "ii", "ww")]
    page = ["".join(draw.choice(syllables) for _ in range(4)) for _ in range(200)]
    copies = []
    for i in range(100):
        words = list(page)
        words[draw.randrange(200)] = f"zuubii{'uoi'[i % 3]}{'bdgkz'[i % 5]}"
        copies.append(("zz", " ".join(words)))
    copied = spark.createDataFrame(copies, "lang string, text string")
    samples = dict(language.training_samples(rows.union(copied), 24_000, 64))
    assert all(w in samples["zz"] for w in page[20:180:20])
    own = language.identify_languages(docs_of(spark, [" ".join(page[20:60])]), rows.union(copied)).first()
    assert own.lang_pred == "zz"


def test_samples_are_filled_further_down_the_order(spark):
    draw = random.Random(9)
    lone = lambda n: " ".join(f"w{draw.randrange(10**6)}x" for _ in range(n))
    page = lone(60)
    rows = [("a", f"{lone(6)} {page}") for _ in range(150)] + [("b", lone(100)) for _ in range(5)] + [("b", page), ("c", page), ("a", None), (None, page)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    samples = dict(language.training_samples(labelled, 4_000, 8))
    assert len(samples["a"]) == 4_000
    assert page.split()[20] not in samples["a"] + samples["b"] and "c" not in samples
    alone = dict(language.training_samples(labelled.where("lang = 'a'"), 4_000, 8))
    assert alone["a"].count(page.split()[20]) == 1


def test_toxicity_learns_marked_words(spark):
    draw = random.Random(6)
    texts, labels = [], []
    for i in range(400):
        words = [f"wo{draw.randrange(10**4)}" for _ in range(60)]
        if i % 4 == 0:
            words[draw.randrange(60)] = draw.choice(["awfulness", "nastyfied"])
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    docs = docs_of(spark, texts + ODD)
    marked = spark.createDataFrame(labels, "doc_id bigint, label int")
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, marked.where("doc_id < 300")).collect()}
    assert len(found) == docs.count() and all(0 <= s <= 1 for s in found.values())
    right = [(found[i] >= 0.7) == bool(y) for i, y in labels[300:]]
    assert np.mean(right) >= 0.97
    assert all(s < 0.7 for s in [found[len(texts)], found[len(texts) + 1]])
    assert all(r.score < 0.1 for r in toxicity.score_toxicity(docs, marked.limit(0)).collect())


def test_shards_are_even_and_slots_gapless(spark, documents):
    found = sharding.kd_shards(documents, sharding.document_dims(), shards=7).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in found)
    sizes, heaviest = Counter(), max(r["size"] for r in found)
    for r in found:
        sizes[r.shard] += r["size"]
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 2 * heaviest
    for shard in sizes:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))


def test_hot_text_is_split_and_odd_rows_are_placed(spark):
    hot = sharding.kd_shards(docs_of(spark, ["x" * 100] * 900 + ["y" * 100] * 100), sharding.document_dims(), shards=10)
    sizes = [r["n"] for r in hot.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) <= 1.5 * min(sizes)
    odd = sharding.kd_shards(docs_of(spark, ODD), sharding.document_dims(), shards=4).collect()
    assert sorted(r.doc_id for r in odd) == list(range(len(ODD))) and {r.text_crc32 for r in odd if r.doc_id < 2} == {0}
    assert sharding.kd_shards(docs_of(spark, []), sharding.document_dims(), shards=4).collect() == []


def test_conversations_come_back(spark):
    said = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\l\\b<s>a\n"), (1, 1, "assistant", "\\l\\b<s>a\n"), (2, 5, None, None), (None, 1, "tool\nx", "[")]
    rows = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat.chat_digests(chat.format_reply_trees(chat.conversations_as_trees(rows))).collect()}
    for conv in (1, 2, None):
        turns = [(r or "", t or "") for c, _, r, t in said if c == conv]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == digest("".join(f"{role}\n{text}\n" for role, text in turns)) and r.loss_sha256 == digest(loss)
    assert chat.format_reply_trees(chat.conversations_as_trees(rows.limit(0))).collect() == []


def test_reply_trees_rank_branches(spark):
    nodes = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "good", 2.0), ("t", "c", "a", "assistant", "bad", None)]
    nodes += [("t", f"b{i}", "b" if i == 0 else f"b{i - 1}", "user", str(i), 1.0) for i in range(9)]
    nodes += [("u", "x", "y", "user", "circle", 1.0), ("u", "y", "x", "user", "circle", 1.0), ("v", "o", "gone", "user", "orphan", 1.0)]
    trees = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    found = {(r.tree, r.branch_rank): r for r in chat.format_reply_trees(trees, best=2).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert set(found) == {("t", 1), ("t", 2), ("v", 1)}
    assert [t.text for t in found["t", 1].turns] == ["q", "good", *map(str, range(9))] and [t.text for t in found["t", 2].turns] == ["q", "bad"]


def test_all_branches_are_ranked_without_best(spark):
    nodes = [("t", "a", None, "user", "q", 0.0), *[("t", f"b{i}", "a", "assistant", str(i), float(i % 4)) for i in range(8)]]
    trees = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    found = {r.leaf: r.branch_rank for r in chat.format_reply_trees(trees).collect()}
    assert found == {leaf: i + 1 for i, leaf in enumerate(["b3", "b7", "b2", "b6", "b1", "b5", "b0", "b4"])}
    assert chat.format_reply_trees(trees, best=0).collect() == []
