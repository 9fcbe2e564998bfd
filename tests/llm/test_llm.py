"""The operators of the training-data pipeline against plain versions on small tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import bpe, chat, encoding, idstore, licenses, merkle, neardup, packing, quality, shipping, texts, toxicity, warc
from tallyflow.runtime import Scratch

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    shipping.ship(spark)


def make_docs(spark, texts_, ids=None):
    """documents with an extra column whose names clash with what the operators add."""
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids or range(len(texts_)), texts_)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    return [
        None, "", " \n\t ", "a", "the MIT License and the mit license", base, base, base + " tail", prose(rng, 60_000),
        "Élan ÅÅ Σς ＭＩＴ ’s don't 日本語 é<|endoftext|>x <|ENDOFTEXT|>", "line\n" * 40, "\x1c\x1d x\x85y　z", "😀 \x00 ﻿",
    ]


def test_words_are_the_contract_words(odd_texts):
    for t in odd_texts:
        assert texts.words_of(t or "") == re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- encoding, packing, id store -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(texts.tokenizer_file())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def test_prefix_programming_gives_the_library_ids(odd_texts, library):
    rng = random.Random(9)
    letters = "abcdeèÀİßΣσςſKÅ' \t\n\x1c\x85　̧日한12٣½!#$|…😀\x00"
    many = odd_texts + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    encode, decode = library
    for encoder in (bpe.prefix_encoder(), encoding.library_encoder()):
        ids, offsets = encoder.encode(pa.array(many))
        decoded = encoder.decode(ids, offsets).to_pylist()
        for k, t in enumerate(many):
            expected = encode(t)
            assert ids[offsets[k] : offsets[k + 1]].tolist() == expected
            assert decoded[k] == decode(expected)


def test_compatible_pairs_are_those_the_library_keeps_apart():
    words = bpe.PrefixWords(texts.tokenizer_file())
    library_words = encoding.LibraryWords(texts.tokenizer_file())
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("aabcenrst") for _ in range(rng.randrange(1, 14)))
        assert words.ids(w) == library_words.ids(w)


def test_encode_documents(spark, odd_texts, library):
    rows = bpe.encode_documents(make_docs(spark, odd_texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, odd_texts, strict=True):
        expected = library[0](t)
        assert bytes(r.ids) == struct.pack(f"<{len(expected)}I", *expected) and r.decoded == library[1](expected)
    assert bpe.encode_documents(make_docs(spark, [])).count() == 0


def test_packing_cuts_every_id_once(spark, odd_texts, library):
    docs = make_docs(spark, odd_texts)
    rows = packing.pack_documents(docs.withColumn("length", F.lit("clash"))).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for k, t in enumerate(odd_texts):
        ids = [*library[0](t), 2]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.doc_tokens == len(ids) and r.offset == 0 for r in mine)
        assert sum(r.length < 4096 for r in mine) == bin(len(ids) % 4096).count("1")
    assert packing.pack_documents(make_docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, max_tokens=1000)


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 50, 5000):
        rng = np.random.default_rng(n)
        keys = rng.integers(-(1 << 62), 1 << 62, n)
        occurrences = np.zeros(n, np.int64)
        seeds, slots = idstore.build_hash(keys, occurrences)
        assert sorted(slots.tolist()) == list(range(n))
        assert (idstore.look_up(keys, occurrences, seeds, n) == slots).all()


def test_id_store_round_trip(spark, odd_texts, library):
    ids = [50, None, 7, 8, 9, 9, 11, 12, 13, 14, 15, 16, 17]
    at = Scratch(spark, "idstore").path
    manifest = idstore.write_shards(make_docs(spark, odd_texts, ids), at)
    index, buckets = idstore.build_index(manifest, at)
    wanted = manifest.select("key", "occurrence").unionByName(spark.createDataFrame([(999, 0), (9, 5)], "key long, occurrence long"))
    found = idstore.fetch(idstore.locate(wanted, index, buckets), at).collect()
    assert len(found) == len(ids)  # absent keys are told by their fingerprint
    expected = sorted((struct.pack(f"<{len(x)}I", *x) for x in ([*library[0](t), 2] for t in odd_texts)))
    assert sorted(bytes(r.ids) for r in found) == expected
    starts = {r.file: r.before for r in idstore.shard_starts(manifest).collect()}
    order = sorted(found, key=lambda r: starts[r.file] + r.first)
    assert [r.key for r in order] == sorted(ids, key=lambda k: (k is not None, k))
    ends = np.cumsum([0, *(r.n_ids for r in order)])
    assert [starts[r.file] + r.first for r in order] == ends[:-1].tolist()


def test_id_store_of_an_empty_table(spark):
    at = Scratch(spark, "idstore").path
    manifest = idstore.write_shards(make_docs(spark, []), at)
    index, buckets = idstore.build_index(manifest, at)
    assert idstore.fetch(idstore.locate(manifest, index, buckets), at).count() == 0


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long, breaks = "x" * 300, ("a\r\n\r\nWARC/1.1\r\n\r\n" * 20)
    html = [long, None, "", "short", "short", long, breaks, long, breaks, "ü" * 60, long, None]
    ids = [5, 1, 2, 3, 4, 0, 6, None, 7, 8, 0, 9]
    urls = ["http://a/", None, "http://b/ c\r\nX: y", "", "ü"] + ["http://d/"] * 7
    pages = spark.createDataFrame(list(zip(ids, urls, html)), "page_id long, url string, html string").withColumn("digest", F.lit(1))
    at = Scratch(spark, "warc").path
    warc.write_archives(pages, at, records_per_file=3)
    index = warc.build_index(spark, at)
    got = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.read_records(index, at).collect()
    )
    expected = Counter()
    for i, h in zip(ids, html, strict=True):
        data = (h or "").encode()
        same = [j for j, g in zip(ids, html, strict=True) if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        revisit = len(data) >= 100 and first is not None and first != i
        expected[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, True] += 1
    assert got == expected
    some = warc.read_records(index.filter("page_id = 6"), at).collect()
    assert [bytes(r.payload).decode() for r in some] == [breaks]


def test_warc_of_an_empty_table(spark):
    at = Scratch(spark, "warc").path
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), at)
    assert warc.read_records(warc.build_index(spark, at), at).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    n, terms = 300, 40
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(terms, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(list(range(n)), vectors, [k % 2 for k in range(n)], terms, block=16)
    dense = np.zeros((n, terms))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for q in range(60):
        places, similarities = index.nearest(*vectors[q], k=7, without=q)
        every = dense @ dense[q]
        every[q] = 0
        assert np.allclose(similarities, np.sort(every)[::-1][:7])
        assert np.allclose(every[index.ids[places]], similarities) and q not in index.ids[places]


def toxic_tables(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if bad:
            for stem in rng.sample(["scumbag", "vilething", "rotter"], 2):
                words.insert(rng.randrange(60), stem + rng.choice(["", "s", "ly"]))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    docs += [(1000, None), (1001, ""), (None, docs[0][1]), (5, docs[5][1])]
    labels += [(3, None, None), (None, 1, 1), (7, 1, 0)]
    extra = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(0))
    return extra, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_toxicity(spark):
    docs, labels, raw = toxic_tables(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(raw)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 5 == 0)
    assert {r.predicted for r in rows if r.doc_id in (1000, 1001)} == {0}
    assert [r.predicted for r in rows if r.doc_id is None] == [1]  # judged by its text
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if not r.predicted)


def test_toxicity_without_labels_or_rows(spark):
    docs, labels, raw = toxic_tables(spark)
    assert {r.score for r in toxicity.score_documents(docs, labels.filter("false")).collect()} == {0.0}
    assert toxicity.score_documents(docs.filter("false"), labels).count() == 0
    assert toxicity.keep_clean(docs.filter("false"), labels).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(grams)
    marked = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_rule_counts(odd_texts):
    rng = random.Random(4)
    many = odd_texts + [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(200)]
    many += ["\n".join(rng.choice(["x y", "", " ", "z", "\x1c", "\x85"]) for _ in range(8)) for _ in range(50)]
    for t in many:
        n, chars, symbols, _, dup, repeated = quality.rule_counts(t)
        assert (n, chars, symbols, dup, repeated) == plain_counts(t)


def test_isolation_forest_paths():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    forest = quality.IsolationForest(rows, trees=20, sample=64)
    scores = forest.scores(rows)
    assert scores.argmax() == 500

    def walk(nodes, x, at=0):
        column, value, left, right, path = nodes[at]
        return path if column < 0 else walk(nodes, x, int(left if x[int(column)] <= value else right))

    for k in (0, 7, 500):
        mean = sum(walk(t, rows[k]) for t in forest.trees) / len(forest.trees)
        assert math.isclose(scores[k], 2 ** -(mean / forest.norm))


def test_quality(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(f"word{rng.randrange(900)}" + ("###" if k % 20 == 0 else "") for _ in range(120))) for k in range(600)]
    docs += [(900, None), (901, ""), (902, "few words"), (903, "a b c d e " * 20), (None, docs[1][1]), (2, docs[2][1])]
    labels = spark.createDataFrame([(k, int(k % 20 != 0), 0) for k in range(300)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    rows = quality.judge(frame, labels).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    for k, t in docs:
        r, (n, chars, symbols, dup, repeated) = by_id[k], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)
    held = [by_id[k] for k in range(600)]
    assert all(not r.kept for r in held if r.doc_id % 20 == 0)
    assert sum(r.kept for r in held if r.doc_id % 20) >= 0.99 * 570
    good = quality.keep_good(frame, labels)
    assert good.columns == frame.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality.judge(frame.filter("false"), labels).count() == 0
    assert quality.judge(frame, labels.filter("false")).filter("kept = base_failed").count() == 0


# --- licenses --------------------------------------------------------------------------------------------------------


def test_license_places(spark):
    many = [
        None, "", "The MIT license, the mit License and MIT\nLICENSE", "mit licenses smit license", "GNU General-Public license; CC BY",
        "licensed under the Apache Licence", "Permision is hereby granted, free of charg", "mozila public license ü", "Éc cc by", "cc by cc by",
    ]
    rows = licenses.scan_documents(make_docs(spark, many)).withColumn("labels", licenses.label_list("exact", "fuzzy")).collect()
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (many[r.doc_id] or "").translate(ASCII_LOWER))
        places = sorted(
            (k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()
        )
        assert r.n_words == len(words) and [(x.first_word, x.label) for x in r.exact] == places
        assert all(x.errors > 0 for x in r.fuzzy) and 0 <= r.score <= 1 and (r.score == 1) == bool(places)
    found = {r.doc_id: r.labels for r in rows}
    assert (found[5], found[6], found[7]) == ("apache", "mit", "mpl") and found[0] == found[1] == "" and found[9] == "cc-by"


def test_verbatim_notices_count(spark):
    """Every notice without an error gives its label and a score of 1, once: as a phrase or as a notice."""
    notices = list(licenses.NOTICES.items())
    texts_ = [f"Some words, {p.title()}: and after" for p, _ in notices] + ["GNU Lesser General Public Licence", "mozilla public"]
    rows = licenses.scan_documents(make_docs(spark, texts_)).withColumn("labels", licenses.label_list("exact", "fuzzy")).collect()
    got = {r.doc_id: r for r in rows}
    for k, (p, label) in enumerate(notices):
        r = got[k]
        assert (r.labels, r.score) == (label, 1.0)
        assert bool(r.exact) == any(f" {x} " in f" {p} " for x in licenses.PHRASES)
        assert [tuple(x) for x in r.fuzzy] == ([] if p in licenses.PHRASES else [(label, 2, len(p.split()), 0)])
    near, none = got[len(notices)], got[len(notices) + 1]
    assert near.labels == "lgpl" and 0 < near.score < 1 and (none.labels, none.score) == ("", 0.0)


def test_words_near_short_notices_are_no_notices(spark):
    """One error makes other words of a short notice; a wrong letter inside a long word is still the notice."""
    plain = [
        "please omit license text", "grant it license to use", "a kit license fee", "a bit license", "apache licensee", "the mitt license", "mi license",
        "met license", "permit license", "apaches license", "an apache licensees", "mit licensee", "commit licensed work", "mit a license", "mitlicense",
    ]
    hurt = {"mit licence": "mit", "mit lisense": "mit", "apache lisense": "apache", "apoche license": "apache", "MIT-licensed": "mit", "Apache licensed": "apache", "mit liceense": "mit"}
    long = {"gnu genral public license": "gpl", "mozilla publics license": "mpl", "creative comons attribution": "cc-by"}
    texts_ = [*plain, *hurt, *long]
    rows = licenses.scan_documents(make_docs(spark, texts_)).withColumn("labels", licenses.label_list("exact", "fuzzy")).collect()
    assert {texts_[r.doc_id]: r.labels for r in rows} == {**dict.fromkeys(plain, ""), **hurt, **long}


def test_word_numbers_of_many_places(spark):
    text = " ".join(["cc by and", "mit lisense"] * 3_000)
    row = licenses.scan_documents(make_docs(spark, [text])).first()
    assert [x.first_word for x in row.exact] == [5 * k for k in range(3_000)] and [x.first_word for x in row.fuzzy] == [5 * k + 3 for k in range(3_000)]
    assert licenses.word_numbers(b"a b  c", [5, 0, 2]) == {0: 0, 2: 1, 5: 3}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_fuzzy_notices_lose_nothing():
    """Every window of whole words within the bound is met by some span, and every span is within it."""
    rng = random.Random(6)
    notice = licenses.Notice("apache license", "apache", letters_an_error=6)
    for _ in range(300):
        hurt = list("apache license")
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(hurt))
            hurt[at : at + 1] = rng.choice([[], ["x"], [hurt[at], "y"]])
        text = " ".join(f"some words before {''.join(hurt)} and after".split()).encode()
        spans = list(notice.find(text))
        assert all(edit_distance(text[a:b], notice.text) == e <= notice.errors for a, b, e in spans)
        words = [0, *(k + 1 for k, c in enumerate(text) if c == 32)]
        ends = [*(k for k, c in enumerate(text) if c == 32), len(text)]
        near = [(a, b) for a in words for b in ends if b > a and 0 < edit_distance(text[a:b], notice.text) <= notice.errors]
        exact = b" apache license " in b" " + text + b" "
        assert exact or not near or any(a < d and c < b for a, b in near for c, d, _ in spans)


# --- chat ------------------------------------------------------------------------------------------------------------


def plain_render(messages):
    text, spans = "", []
    for role, body in messages:
        text += f"<|{role}|>\n"
        if role == "assistant":
            spans.append((len(text), len(text) + len(body) + 7))
        text += f"{body}<|end|>\n"
    return text, spans


def test_preferences(spark):
    pairs = [
        (0, [("user", "hi"), ("assistant", "yes 😀")], [("user", "hi"), ("assistant", "no"), ("user", "why")]),
        (1, [("user", "a")], [("user", "a")]),
        (2, None, [("assistant", "")]),
        (3, [("system", "s"), ("user", "u")], [("user", "u")]),
        (4, [("user", "u")], [("user", "u"), ("assistant", "more")]),
    ]
    frame = spark.createDataFrame(pairs, f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}").withColumn("source", F.lit(1))
    for r in chat.format_preferences(frame).collect():
        _, yes, no = pairs[r.pair_id]
        yes, no = yes or [], no or []
        k = 0
        while k < min(len(yes), len(no)) and yes[k] == no[k]:
            k += 1
        assert r.n_prompt_turns == k and r.prompt == plain_render(yes[:k])[0]
        for name, rest in (("chosen", yes[k:]), ("rejected", no[k:])):
            text, spans = plain_render(rest)
            assert r[f"{name}_text"] == text and [tuple(s) for s in r[f"{name}_mask"]] == spans


def test_sibling_pairs(spark):
    turns = [
        (0, 1, "assistant", "A"), (0, 0, "user", "q"), (0, 2, "user", "bye"), (1, 0, "user", None), (1, 1, "assistant", "B"),
        (2, 0, "user", "x"), (3, 0, "assistant", "C"), (3, 0, "assistant", "C"), (None, 0, "user", "lost"), (4, 0, None, "r"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: ([m.text for m in r.chosen], [m.text for m in r.rejected]) for r in chat.sibling_pairs(frame).collect()}
    assert got == {
        0: (["q", "A"], ["q", "B"]), 1: (["", "B"], ["", "A"]), 2: (["x"], ["x"]), 3: (["C", "C"], ["C"]), 4: (["r"], ["r"]),
    }
    assert chat.format_preferences(chat.sibling_pairs(frame.filter("false"))).count() == 0


def test_sibling_pairs_keep_the_tail(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "A"), (0, 2, "user", "bye"), (0, 3, "user", "so"), (1, 0, "assistant", "B"), (2, 0, "user", "x")]
    rows = chat.format_preferences(chat.sibling_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.conv_id: [m.text for m in r.tail] for r in rows} == {0: ["bye", "so"], 1: [], 2: []}


# --- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BYTES", 100_000)
    many = [*odd_texts, *(prose(random.Random(k), 900) for k in range(60))]
    ids = [None if k == 3 else k * 7 - 50 for k in range(len(many))]
    docs = make_docs(spark, many, ids)
    rows = merkle.with_edit(merkle.with_next(docs))
    for text, name in (("text", "own"), ("edited", "after"), ("next_text", "next")):
        rows = merkle.with_tree(rows, text, name)
    rows = rows.select(
        "doc_id", "text", "next_text", "edited", "n_chars", merkle.fingerprint("own").alias("fingerprint"), merkle.likeness("own", "after").alias("near"),
        merkle.edits("own", "after").alias("edits"), F.col("own.paragraphs").alias("left"), F.col("after.paragraphs").alias("right"),
    ).collect()
    order = sorted(zip(ids, many, strict=True), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    follows = {i: (t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)}
    assert len(rows) == len(many)
    prints = {}
    for r in rows:
        text, after = follows[r.doc_id]
        k = len(text) // 3
        assert (r.text, r.next_text, r.n_chars) == (text, after, len(text))
        assert r.edited == text[: len(text) - k] + after[:k] and 0 <= r.near <= 1
        assert (r.near == 1) == (r.edited == text) or r.near < 1
        hashes = [hashlib.sha256(p.encode()).hexdigest() for p in text.split("\n")]
        assert r.left == hashes
        assert r.edits.left == [i for i, h in enumerate(hashes) if h not in r.right]
        assert prints.setdefault(r.fingerprint, text) == text
    assert len(prints) == len({t or "" for t in many})


def plain_leaves(text):
    return Counter(x for p in (text or "").split("\n") for x in re.findall(merkle.PIECE, p))


def test_likeness_walks_the_trees(spark, odd_texts):
    """Leaves in common, counted with their repeats, beside a plain count over all leaves of both texts."""
    rng = random.Random(8)
    lines = ["one line", "another, longer line of text.", "", "x", prose(rng, 60), prose(rng, 90), "one line"]
    pairs = [("a", "a\na"), ("a\na\na", "a\na"), ("b\na", "a\nb"), ("\n", "\n\n"), ("", ""), (None, ""), ("x", ""), ("a, a, a, b.", "a, a, c."), ("1#2", "1#2\n1#2|,")]
    for _ in range(80):
        text = [rng.choice(lines) for _ in range(rng.randrange(1, 40))]
        other = [*text]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(3)] = rng.choices(lines, k=rng.randrange(3))
        pairs.append(("\n".join(text), "\n".join(other)))
    pairs += [(t, u) for t, u in zip(odd_texts, odd_texts[1:])]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "doc_id long, text string, other string")
    df = merkle.with_tree(merkle.with_tree(df, "text", "own"), "other", "next")
    got = {r.doc_id: r for r in df.select("doc_id", merkle.likeness("own", "next").alias("near"), "own.n_leaves", F.col("own.root").alias("a"), F.col("next.root").alias("b")).collect()}
    for k, (a, b) in enumerate(pairs):
        left, right = plain_leaves(a), plain_leaves(b)
        both, same = left.total() + right.total(), (left & right).total()
        want = 1.0 if (a or "") == (b or "") else min(2 * same / both, both / (both + 1)) if both else 0.0
        assert got[k].n_leaves == left.total() and got[k].near == pytest.approx(want), pairs[k]
        assert (got[k].near == 1) == (got[k].a == got[k].b) == ((a or "") == (b or ""))


def test_fingerprints_with_ties(spark):
    docs = make_docs(spark, ["b", "a", "c", "a"], [1, 1, 0, 1])
    rows = merkle.with_next(docs).collect()
    assert sorted((r.doc_id, r.text, r.next_text) for r in rows) == [(0, "c", "a"), (1, "a", "a"), (1, "a", "b"), (1, "b", "c")]
    assert merkle.with_next(make_docs(spark, ["x"])).collect()[0].next_text == "x"
    assert merkle.with_next(make_docs(spark, [])).count() == 0


def test_fingerprints_run_no_python(spark, odd_texts):
    rows = merkle.with_tree(merkle.with_edit(merkle.with_next(make_docs(spark, odd_texts))), "edited", "tree")
    assert not re.search("Python|Arrow|Pandas", rows._jdf.queryExecution().executedPlan().toString())


# --- near-duplicates -------------------------------------------------------------------------------------------------


def plain_sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def plain_components(texts_, width, threshold):
    sets = [plain_sets(t, width) for t in texts_]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, [root(k) for k in range(len(sets))]


def near_texts():
    rng = random.Random(12)
    many = [None, "", "one", "ONE", "one two", "one two", "Ünique É"]
    for group in range(12):
        words = prose(rng, 160, 5000).split()
        many.append(" ".join(words))
        for copy in range(rng.randrange(2, 14)):
            changed = list(words)
            for _ in range(rng.randrange(0, 8)):
                changed[rng.randrange(len(changed))] = f"c{rng.randrange(9999)}"
            many.append(" ".join(changed) if copy % 3 else " ".join(changed).upper())
    rng.shuffle(many)
    return many


@pytest.mark.parametrize(("width", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates_agree_with_all_pairs(spark, width, threshold):
    many = near_texts()
    sets, expected = plain_components(many, width, threshold)
    rows = {r.doc_id: r for r in neardup.near_duplicates(make_docs(spark, many).withColumn("digest", F.lit(1)), width, threshold).collect()}
    assert {k: (rows[k].n_shingles, rows[k].component_id, rows[k].kept) for k in rows} == {
        k: (len(sets[k]), expected[k], expected[k] == k) for k in range(len(many))
    }


def test_parts_of_a_split_region_meet_again(spark):
    """Two near signatures between which 200 others stand in every order, in a region that is walked whole and in one that is split."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (202, neardup.TREES, neardup.DEPTH), np.uint8)
    rows[:, :, :4], rows[:, :, 4] = 7, 128
    rows[1] = rows[0]
    rows[0, :, 4], rows[1, :, 4] = 0, 255
    frame = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(rows)], "doc_id long, signature binary")
    pairs, crowd = neardup.forest_pairs(frame, 0.85)
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)] and crowd is None
    pairs, crowd = neardup.forest_pairs(frame, 0.85, region=50)
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    assert crowd.select("doc_id").distinct().count() == 202


def test_depth_adapts_to_the_region(spark):
    """Labels that share 4, 6 and 64 bytes: a region's prefix grows until it has few rows, and no further."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (90, 128), np.uint8)
    rows[:30, :4], rows[30:60, :6], rows[60:, :64] = 1, 2, 3
    rows[:, 127] = np.arange(90)
    frame = spark.createDataFrame([(k, 0, bytearray(r.tobytes())) for k, r in enumerate(rows)], "doc_id long, tree byte, label binary")
    splits, inside = neardup.split_prefixes(frame, Scratch(spark, "t"), 10)
    depths = {r.doc_id: r.d for r in neardup.with_regions(inside, splits).select("doc_id", F.length("region").alias("d")).collect()}
    assert {depths[k] for k in range(30)} == {5} and {depths[k] for k in range(30, 60)} == {8} and {depths[k] for k in range(60, 90)} == {128}


def test_only_rows_with_company_are_moved(spark):
    """Of 3 000 signatures two pairs are near: the filter keeps their rows, and few others go through the sort and the walk."""
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 256, (3_000, neardup.TREES * neardup.DEPTH), np.uint8)
    rows[5], rows[70] = rows[4], rows[2_999]
    frame = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(rows)], "doc_id long, signature binary")
    moved, counts = neardup.shared_rows(neardup.forest_rows(frame), Scratch(spark, "t"))
    found = moved.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in found if r["count"] == neardup.TREES} == {4, 5, 70, 2_999} and len(found) < 100
    assert {(r.tree, r.n) for r in counts.collect()} == {(t, 2) for t in range(neardup.TREES)}
    assert sorted(map(tuple, neardup.forest_pairs(frame, 0.85)[0].collect())) == [(4, 5), (70, 2_999)]


def test_key_filter_refuses_no_key(spark):
    keys = spark.range(0, 40_000, 4).select(F.col("id").alias("a"), F.md5(F.col("id").cast("string")).alias("b"))
    keys = keys.unionByName(spark.createDataFrame([(None, "x"), (1, None)], "a long, b string"))
    asked = neardup.key_filter(keys, "a", "b")
    rows = spark.range(40_000).select(F.col("id").alias("a"), F.md5(F.col("id").cast("string")).alias("b"))
    passed = {r.a for r in rows.filter(asked("a", "b")).collect()}
    assert passed >= set(range(0, 40_000, 4)) and len(passed) < 10_000 + 1_000
    assert keys.filter(~asked("a", "b")).count() == 0
    assert rows.filter(neardup.key_filter(keys.limit(0), "a", "b")("a", "b")).count() == 0


def test_a_worker_keeps_the_cache_of_one_operator():
    counter = toxicity.worker_counter(["a", "b"])
    assert toxicity.worker_counter(["a", "b"]) is counter and toxicity.worker_counter(["a"]) is not counter
    encoder = encoding.library_encoder()
    assert encoding.library_encoder() is encoder and list(texts._kept.values()) == [encoder]
    texts.let_go()
    assert not texts._kept


def test_a_common_template_costs_as_much_as_its_rows(spark):
    """Signatures of a similarity of 0.6, all of one template: what is walked and what is near grows with the rows, not with their pairs."""

    def work(n):
        rng = np.random.default_rng(1)
        rows = np.where(rng.random((n, 128)) < 0.775, np.uint8(9), rng.integers(0, 256, (n, 128), np.uint8))
        frame = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "signature": [r.tobytes() for r in rows]}))
        pairs, crowd = neardup.forest_pairs(frame, 0.85)
        return pairs.count(), crowd.count()

    (pairs, crowded), (more_pairs, more_crowded) = work(10_000), work(20_000)
    assert more_pairs <= 2.2 * pairs and more_crowded <= 2.2 * crowded and more_pairs < 20_000 * 16


def template_texts(rng):
    common = prose(rng, 60, 5000).split()
    many = []
    for k in range(150):
        own = [f"own{k}x{j}" for j in range(40)]
        many.append(" ".join(common + own))
        if k % 10 == 0:  # a near copy: one word of its own is another
            many.append(" ".join([*common, *own[:-1], "changed"]))
    rng.shuffle(many)
    return many


@pytest.mark.parametrize("region", [256, 8])
def test_links_inside_a_template_are_found_by_rare_shingles(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "WHOLE", region // 8)
    many = template_texts(random.Random(12))
    _, expected = plain_components(many, 3, 85)
    rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(make_docs(spark, many), 3, 85).collect()}
    assert rows == dict(enumerate(expected[k] for k in range(len(many)))) and len(set(rows.values())) == 150


def test_groups_are_united_by_links_only(spark, monkeypatch):
    """0-1 is a candidate and no link, 1-2 is a link, 0-2 is a link that no candidate names; 3 is alone, 4-5 are one already."""
    words = [f"w{k}" for k in range(100)]
    many = [" ".join(x) for x in (words[:90], words[10:], words[5:95], ["x", *words[50:]], ["y"] * 4, ["y"] * 5)]
    docs = make_docs(spark, many)
    sets = neardup.shingle_sets(docs, 1)
    nodes = neardup.signatures(docs.withColumn("text_key", F.md5("text")), 1).select(F.col("doc_id").alias("node"), "signature")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    own = {0: 0, 1: 1, 2: 1, 3: 3}
    rows = spark.createDataFrame([(k, 0, c, 4) for k, c in own.items()], "doc_id long, group long, apart long, n long")
    for group in (None, 1, 2):
        assert [tuple(r) for r in neardup.group_pairs(rows, sets, 85, group).collect()] == [(0, 2)]
    rest, postings = rows.select("doc_id", "apart"), neardup.rare_postings(sets, 85)
    for most in (9, 1, 2):
        more = neardup.confirmed(neardup.missing_pairs(postings, rest, nodes, 85, most), sets, 85).collect()
        assert [tuple(r) for r in more] == [(0, 2)]
    for whole in (neardup.WHOLE, 1):
        monkeypatch.setattr(neardup, "WHOLE", whole)
        assert {tuple(r) for r in neardup.all_links(pairs, None, sets, nodes, 85).collect()} == {(0, 2), (1, 2), (4, 5)}
    rng = random.Random(4)
    plain = [set(rng.sample(range(60), 40)) for _ in range(9)]
    counts = neardup.shared_counts([np.array(sorted(x), np.uint64) for x in plain])
    assert all(counts[a, b] == len(plain[a] & plain[b]) for a in range(9) for b in range(9) if a != b)


def test_near_duplicates_with_ties(spark):
    text = prose(random.Random(1), 50)
    docs = make_docs(spark, [text, text, text, "other words here now"], [4, 4, None, 9])
    rows = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert rows == [(-1, None, True), (4, 4, True), (4, 4, True), (9, 9, True)]
    assert neardup.near_duplicates(make_docs(spark, [])).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns and neardup.keep_one(docs).count() == 4


def test_texts_under_one_id_are_judged_alone(spark):
    a, b, c = (prose(random.Random(k), 60, 5000) for k in range(3))
    docs = make_docs(spark, [a, a, b, c, c + " end", b + " end"], [1, 7, 7, 9, 9, 12])
    assert sorted((r.doc_id, r.text in (c, c + " end") or r.text) for r in neardup.keep_one(docs).collect()) == [(1, a), (7, b), (9, True)]


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


# --- queries and pipeline --------------------------------------------------------------------------------------------

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", ["op1_warc", "op6_preferences", "op10_near_duplicates"])
def test_queries_agree_with_sql(spark, name):
    import __spark_entry__ as entry
    from compare import check, connect

    assert check(spark, connect(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])[2] == "ok"


def test_pipeline_stages(spark):
    """Each stage on all its predecessor kept, against the operators' verdicts and a plain near-duplicate search."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SMALL}/labels.parquet")
    scratch = Scratch(spark, "stages")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(scratch.save(stage(spark, seen[-1], SMALL), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    assert all(d.columns == columns for d in seen[:-1])
    ids = [sorted(r.doc_id for r in d.select("doc_id").distinct().collect()) for d in seen]
    toxic = {r.doc_id for r in toxicity.score_documents(docs, labels).filter("predicted = 1").collect()}
    assert ids[1] == [i for i in ids[0] if i not in toxic]
    bad = {r.doc_id for r in quality.judge(seen[1], labels).filter("NOT kept").collect()}
    assert bad and ids[2] == [i for i in ids[1] if i not in bad]
    rows = sorted(seen[2].select("doc_id", "text").collect())
    _, first = plain_components([r.text for r in rows], 5, 80)
    assert ids[3] == [r.doc_id for k, r in enumerate(rows) if first[k] == k]
    packed = seen[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert sorted(r.doc_id for r in packed) == ids[3] and all(r.n == r.all for r in packed)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "length").collect())) == Counter(
        map(tuple, seen[4].select("doc_id", "start", "length").collect())
    )
