"""Document operators against brute force, round trips and held-out accuracy."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from tallyloom.llm import decontaminate, hilbert_shards, jpeg, language_id, licenses, minhash_join, mixing, queries, ranks, textbatch

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# --- words ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB1é .,\n\x00日", max_size=20), max_size=8))
def test_word_hashes_agree_with_words(rows):
    data = [r.encode() for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    hashes, owners, begins = textbatch.hashed_words(memoryview(b"".join(data)), offsets)
    want = [(i, w) for i, r in enumerate(rows) for w in words(r)]
    assert [[w.decode() for w in textbatch.words_of(d)] for d in data] == [words(r) for r in rows]
    assert owners.tolist() == [i for i, _ in want]
    seen = {}
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# --- decontamination ---


def plain_leaks(doc, items, window):
    hit, names = set(), set()
    grams = defaultdict(set)
    for name, item in items:
        n = min(window, len(item)) if item else 0
        for i in range(len(item) - n + 1 if n else 0):
            grams[tuple(item[i : i + n])].add(name)
    for n in {len(g) for g in grams}:
        for i in range(len(doc) - n + 1):
            if (owners := grams.get(tuple(doc[i : i + n]))) is not None:
                hit |= set(range(i, i + n))
                names |= owners
    return hit, names


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 5))
def test_automaton_against_windows(items, doc, window):
    named = [(str(i), [w.encode() for w in item]) for i, item in enumerate(items)]
    spans, names = decontaminate.ItemAutomaton([x for x in named if x[1]], window).scan([w.encode() for w in doc])
    hit, owners = plain_leaks([w.encode() for w in doc], named, window)
    assert {i for a, b in spans for i in range(a, b)} == hit
    assert names == owners
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_cut_drop_blocks_and_edges(spark, monkeypatch):
    item = "One two, three four five six seven eight nine TEN eleven"
    rows = [(1, f"before words here {item}. after words", "en", "s", 5), (1, f"before words here {item}. after words", "en", "s", 5), (2, item, "en", "s", 5), (3, "clean text", None, None, None), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "x Short item y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _spans", "2 as score")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "short ITEM"), (9, None), (10, ""), (None, "clean nothing")], "item_id BIGINT, text STRING")
    dropped = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert dropped == {3, 4, 5}
    for size in (decontaminate.BLOCK_BYTES, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        kept = decontaminate.decontaminate(docs, bench, max_coverage=0.75)
        got = {r["doc_id"]: r for r in kept.collect()}
        assert set(got) == {1, 3, 4, 5, 6} and kept.columns == docs.columns
        assert got[1]["text"] == "before words here . after words" and got[1]["n_chars"] == 31 and got[1]["_spans"] == 1
        assert got[6]["text"] == "x  y z" and got[3]["n_chars"] is None
        found = {r["doc_id"]: r for r in decontaminate.op3_decontaminate(docs, bench).collect()}
        assert (found[6]["n_hit"], found[6]["n_items"], found[4]["n_words"]) == (2, 1, 0)
        assert found[2]["items_sha256"] == hashlib.sha256(b"7").hexdigest()
    assert decontaminate.op3_decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.op3_decontaminate(docs.limit(0), bench).count() == 0


# --- n-gram join ---


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(docs):
    """(class, links, text links) of each doc by comparing all pairs."""
    sets = {i: shingle_set(t or "") for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (find(i), links[i]) for i in docs}


@pytest.mark.parametrize("block", [minhash_join.BLOCK, 7])
def test_join_against_all_pairs(spark, texts, block):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = dict(list(texts.items())[:60])
    for g in range(4):
        base = rng.choice(vocabulary, 60).tolist()
        for c in range(25):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            docs[10_000 + 100 * g + c] = " ".join(copy)
    docs |= {20_000: "a b", 20_001: "A, b!", 20_002: "a b c", 20_003: None, 20_004: "", 20_005: "...", 20_006: "a b c d e", 20_007: "long " * 50_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash_join.similarity_classes(df, block=block).collect()}
    assert got == plain_classes(docs)


def test_join_edges(spark):
    same = "one two three four five six"
    rows = [(5, same, "x"), (5, same, "x"), (3, same.upper(), "x"), (None, same, "x"), (9, None, None), (9, None, None), (7, "other words", "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, class_id STRING")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in minhash_join.similarity_classes(df).collect())
    assert got == [("3", "3", 3), ("5", "3", 3), ("5", "3", 3), ("7", "7", 0), ("9", "9", 0), ("9", "9", 0), ("None", "3", 3)]
    kept = sorted(str(r["doc_id"]) for r in minhash_join.drop_near_duplicates(df).collect())
    assert kept == ["3", "7", "9"]
    twice = df.where("doc_id = 5")
    assert minhash_join.drop_near_duplicates(twice).count() == 1
    assert minhash_join.similarity_classes(df.limit(0)).count() == 0 == minhash_join.drop_near_duplicates(df.limit(0)).count()
    no_ids = spark.createDataFrame([(None, same), (None, same), (None, same + " seven"), (None, "quite another text")], "doc_id BIGINT, text STRING")
    assert sorted(r["text"] for r in minhash_join.drop_near_duplicates(no_ids).collect())[-1] == "quite another text"
    assert sorted(r["n_links"] for r in minhash_join.similarity_classes(no_ids).collect()) == [0, 0, 1, 1]


def test_two_texts_under_one_id(spark):
    a, b = "the first text of seven words here", "a second text that is not like it"
    rows = [(1, a), (5, a), (5, b), (6, b + " at all"), (5, "third one")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["text"]) for r in minhash_join.drop_near_duplicates(df).collect()}
    assert got == {(1, a), (5, b), (6, b + " at all"), (5, "third one")}
    everything = spark.createDataFrame([(1, t) for _, t in rows], "doc_id BIGINT, text STRING")
    assert sorted(r["text"] for r in minhash_join.drop_near_duplicates(everything).collect()) == sorted({t for _, t in rows})


def test_large_group_of_near_copies(spark):
    """3,000 near copies in one group: links as all pairs give them, and members go to as many tasks as there are blocks."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(3000):
        copy = list(base)
        for _ in range(int(rng.integers(0, 5))):
            copy[int(rng.integers(200))] = f"x{int(rng.integers(5000))}"
        docs.append((i, " ".join(copy)))
    sets = [{" ".join(t[k : k + 5]) for k in range(196)} for t in (d[1].split() for d in docs)]
    known = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    matrix = np.zeros((3000, len(known)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [known[g] for g in s]] = 1
    common = matrix @ matrix.T
    linked = common >= 0.8 * (matrix.sum(1)[:, None] + matrix.sum(1)[None, :] - common) - 1e-6
    want = linked.sum(1) - 1
    got = {r["doc_id"]: r for r in minhash_join.similarity_classes(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), block=1024).collect()}
    assert [got[i]["n_links"] for i in range(3000)] == want.tolist()
    assert {r["class_id"] for r in got.values()} == {0}


def test_recall_of_every_fiftieth_against_all(spark):
    """Links of the rows whose id is divisible by 50 against all rows of a table, by comparing sets."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sets = {i: shingle_set(t or "") for i, t in docs.items()}
    got = {r["doc_id"]: r["n_links"] for r in queries.QUERIES["op2_ngram_join"](spark, "/root/testdata/sf0.01").collect()}
    for i in (i for i in docs if i % 50 == 0):
        want = 0
        for j, other in sets.items():
            if i != j and sets[i] and 0.8 * len(sets[i]) <= len(other) + 1e-9 and len(other) * 0.8 <= len(sets[i]) + 1e-9:
                common = len(sets[i] & other)
                want += common >= 0.8 * (len(sets[i]) + len(other) - common) - 1e-9
        assert got[i] == want, i


def test_pruning_keeps_pairs_at_the_threshold():
    from math import comb

    least, step = minhash_join.least_matches(minhash_join.THRESHOLD, minhash_join.TOLERANCE), minhash_join.STEP
    alive, lost, p = {0: 1.0}, 0.0, minhash_join.THRESHOLD
    for n in range(step, minhash_join.HASHES + 1, step):
        after = Counter()
        for k, chance in alive.items():
            for more in range(step + 1):
                after[k + more] += chance * comb(step, more) * p**more * (1 - p) ** (step - more)
        lost += sum(c for k, c in after.items() if k < least[n])
        alive = {k: c for k, c in after.items() if k >= least[n]}
    assert lost < 1e-8
    assert lost + (1 - p**minhash_join.BAND_ROWS) ** minhash_join.BANDS < 1e-7


def test_pruning_keeps_what_reaches_the_threshold():
    least = minhash_join.least_matches(0.8, 1e-4)
    rng = np.random.default_rng(1)
    for n, m in least.items():
        assert (rng.binomial(n, 0.8, 200_000) < m).mean() < 1e-3
        assert m > 0.4 * n


# --- language ---


def plain_cost(data, counts, order):
    """Bits of PPM by walking down the contexts of one language."""
    bits = 0.0
    for i, b in enumerate(data):
        for n in range(min(order, i), -1, -1):
            seen = counts.get(bytes(data[i - n : i]))
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if b in seen:
                bits += np.log2((total + kinds) / seen[b])
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_costs_are_exact_ppm(spark):
    lines = {"x": ["abab abba", "bab aba"], "y": ["çaça zaz", "zaça"]}
    rows = [(i, t, k) for k, ts in lines.items() for i, t in enumerate(ts)]
    (trees,) = language_id.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), fit_rows=100)
    samples = ["abba zaz", "ç", "qqq", "", "aba" * 50]
    data = [s.encode() for s in samples]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    got = trees.costs(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, language in enumerate(trees.languages):
        counts = defaultdict(Counter)
        for t in lines[language]:
            raw = t.encode()
            for i, b in enumerate(raw):
                for n in range(min(3, i) + 1):
                    counts[bytes(raw[i - n : i])][b] += 1
        for i, d in enumerate(data):
            assert got[i, k] == pytest.approx(plain_cost(d, counts, 3), abs=1e-3)
    whole = np.frombuffer(("aba zaz " * 50).encode(), np.uint8)
    old, language_id.PIECE_BYTES = language_id.PIECE_BYTES, 37
    assert language_id._costs(trees, whole, np.array([0, len(whole)])) == pytest.approx(trees.costs(whole, np.array([0, len(whole)])), abs=0.05)
    language_id.PIECE_BYTES = old


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == labels[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 !?", "en", "s"), (4, "the cat", "en", "s"), (4, "the cat", "en", "s"), (5, "日本", None, "s"), (None, "das ist", "de", "s")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, score STRING")
    got = {r["doc_id"]: r for r in language_id.op6_language_id(df).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[5]["lang_pred"] in ("en", "und")
    none = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "score")
    assert {r["lang_pred"] for r in language_id.op6_language_id(none).collect()} == {"und"}
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r["score"] for r in kept.collect()} == {"s"}
    assert language_id.op6_language_id(df.limit(0)).count() == 0
    assert language_id.keep_identified(none).count() == 4


@pytest.mark.parametrize("text", ["² ½ ①", "Ⅷ 12", "_ - 3", "\u0301\u0301"])
def test_what_is_no_letter(spark, text):
    assert not language_id.has_letter(text.encode())
    df = spark.createDataFrame([(1, text, "en"), (2, "ab", "en")], "doc_id BIGINT, text STRING, lang STRING")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, language_id.fit(df, fit_rows=100)).collect()} == {1: "und", 2: "en"}


def test_two_hundred_languages(spark, monkeypatch):
    """Each of its own words; one with very few rows keeps its contexts; passes of 8 and of 200 languages agree."""
    rng = np.random.default_rng(8)
    rows, told = [], []
    for k in range(200):
        letters = [chr(0x4E00 + 5 * k + i) for i in range(5)]
        say = lambda letters=letters: " ".join("".join(rng.choice(letters, 5)) for _ in range(12))
        rows += [(1000 * k + i, say(), f"l{k:03d}") for i in range(2 if k == 7 else 4)]
        told.append((k, say()))
    trees = language_id.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    assert len(trees) == 50
    df = spark.createDataFrame(told, "doc_id BIGINT, text STRING")
    monkeypatch.setattr(language_id, "PASS_LANGUAGES", 100)
    two = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df, trees).collect()}
    assert all(two[k][0] == f"l{k:03d}" for k in range(200))
    monkeypatch.setattr(language_id, "PASS_LANGUAGES", 200)
    assert two == {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df, trees).collect()}


def test_unlearned_languages_and_data_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(6)
    blob = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 3000))
    foreign = [(-1, "これは学習されていない言語の文章です。" * 20), (-2, "это предложение на незнакомом языке " * 20), (-3, blob)]
    more = spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in foreign], docs.schema)
    kept = {r["doc_id"] for r in language_id.keep_identified(docs.unionByName(more)).select("doc_id").collect()}
    assert not kept & {-1, -2, -3}
    assert kept == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}


@pytest.mark.parametrize("order, keep", [(1, 8), (3, 8), (4, 8), (3, 1000)])
def test_grams_of_all_bytes_are_counted(monkeypatch, order, keep):
    """Pieces, merges and counts passed on early, against counting byte by byte."""
    import pyarrow as pa

    for name, value in (("PIECE_BYTES", 7), ("MERGE_COUNTS", 10), ("KEEP_COUNTS", keep)):
        monkeypatch.setattr(language_id, name, value)
    rows = [("x", 0, "abab abba"), ("y", 1, ""), ("y", 1, "çaça zaz\0\0"), ("x", 1, "a"), ("y", 1, "zaça"), ("x", 0, "bab"), ("x", 0, "ÿ" * 9)]
    batches = [pa.RecordBatch.from_pylist([{"lang": k, "half": h, "text": t} for k, h, t in rows[a : a + 3]]) for a in range(0, len(rows), 3)]
    want, got = Counter(), Counter()
    for k, h, t in rows:
        raw = t.encode()
        for i in range(len(raw)):
            for n in range(min(order, i) + 1):
                want[k, h, n, int.from_bytes(raw[i - n : i + 1])] += 1
    out = list(language_id._grams(order)(iter(batches)))
    for r in pa.Table.from_batches(out).to_pylist():
        got[r["lang"], r["half"], r["n"], r["gram"]] += r["times"]
    assert got == want and (len(out) > order + 1) == (keep == 8)


def test_all_labelled_rows_are_learned(spark):
    """More rows than a sample took: the first byte's costs tell all counts."""
    rows = [(i, f"{'q' if i % 3 else 'z'}{i}", "en") for i in range(3000)]
    (trees,) = language_id.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    seen = Counter(b for _, t, _ in rows for b in t.encode())
    total, kinds = sum(seen.values()), len(seen)
    for letter, n in seen.items():
        assert trees.bits[0, trees.classes[letter], 0] == pytest.approx(np.log2((total + kinds) / n), abs=1e-5)


def test_the_limit_comes_from_all_labelled_rows(spark):
    """One labelled row among thousands is coded worst; the limit follows it, by a model that has not learned from it."""
    odd, like = "щука жевала чужой плащ у ручья ", "пчела жужжала у чаши "
    rows = [(i, f"the house and garden number {i} of the town", "en") for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(4001, odd * 20, "en"), (7001, "ein einziger Satz", "de")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i in (4001, 7001)} == {False}
    halves = dict(df.select("doc_id", language_id._half()).collect())
    parts = [language_id.fit(df.where(language_id._half() == k)) for k in (0, 1)]
    trees = language_id.fit(df)
    want = 0.0
    for i, text, lang in rows:
        raw = text.encode()
        models = trees if lang == "de" else parts[1 - halves[i]]
        bits = min(m.costs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).min() for m in models)
        want = max(want, (bits - language_id.FREE_BITS) / len(raw))
    worst = language_id.worst_rate(df, trees, parts)
    assert worst == pytest.approx(want, rel=1e-5) and worst > language_id.NO_MODEL
    more = df.unionByName(spark.createDataFrame([(9001, like * 20, None)], df.schema))
    assert language_id.keep_identified(more).count() == len(rows) + 1


# --- licences ---


def test_licences(spark):
    notices = [("mit", "Released under the MIT License."), ("apache", "Licensed under the Apache License, Version 2.0."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("proprietary", "All rights reserved.")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(docs)
    rows = [(i, f"Éa bla bla.\n{n}\n\nmore of it", f) for i, (f, n) in enumerate(notices)]
    rows += [(100, None, "none"), (101, "", "none"), (102, "the cat sat\non the mat", "none"), (103, "word " * 100_000, "none"), (104, "This font is under a custom copyleft license with special permission rights", "unknown")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, family STRING").drop("family").selectExpr("*", "1 as score"), model).collect()}
    for i, text, family in rows:
        assert got[i]["family"] == family, i
        for m in got[i]["matches"]:
            assert text[m["start"] : m["end"]] in text.split("\n")
    assert (got[100]["n_paragraphs"], got[0]["n_paragraphs"]) == (0, 3)
    assert licenses.op4_licenses(docs.limit(0)).count() == 0


def test_licence_recall_and_precision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pattern = re.compile(r"^(This work is licensed under the GNU General Public License, version \d\.|All rights reserved\.|Licensed under CC BY-NC \d\.\d\.|Released under the MIT License\.|Licensed under the Apache License, Version \d\.\d\.)$", re.M)
    want = {r["doc_id"] for r in docs.collect() if pattern.search(r["text"] or "")}
    got = {r["doc_id"] for r in licenses.op4_licenses(docs).where("n_license > 0 and family <> 'unknown'").collect()}
    assert want and got == want


def test_licences_wrapped_and_straddling(spark):
    import random
    import textwrap

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rng, known = random.Random(5), sorted({w for r in docs.limit(50).collect() for w in (r["text"] or "").split()})
    rows = []
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            rows.append((family, notice, "intro\n\n" + textwrap.fill(notice, 40) + "\n\nafter"))
            rows.append((family, notice, "\n".join("# " + x for x in textwrap.wrap(notice, 50))))
            for before in (0, 50, 61, 63, 100):
                around = rng.choices(known, k=before + 150)
                rows.append((family, notice, " ".join([*around[:before], notice, *around[before:]])))
                rows.append((family, notice, textwrap.fill(rows[-1][2], 70)))
    df = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "doc_id BIGINT, text STRING")
    for r in licenses.scan_licenses(df, licenses.fit(docs)).collect():
        family, notice, text = rows[r["doc_id"]]
        assert r["family"] == family, text
        spans = [text[m["start"] : m["end"]] for m in r["matches"] if m["family"] == family]
        assert any(len(set(words(notice)) & set(words(s))) >= 0.6 * len(set(words(notice))) for s in spans), text


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_windows_are_scored_like_each_alone(spark, license_model, texts):
    """All windows of a text at once, by differences of running sums, against each window by itself."""
    for text in [*list(texts.values())[:5], "a b", "Released under the MIT License. " * 40]:
        data = text.encode()
        words, n_words = licenses._hashes([textbatch.words_of(data)])
        if not len(words):
            continue
        first, last = licenses._windows(n_words)
        got = license_model.of_windows(words, first, last)
        for k in range(len(first)):
            assert got[k] == pytest.approx(license_model.probabilities(words[first[k] : last[k]], np.array([last[k] - first[k]]))[0], abs=1e-4)
        covered = {i for a, b in zip(first, last, strict=True) for i in range(a, b)}
        assert covered == set(range(len(words)))


@pytest.mark.parametrize("family", ["mit", "gpl", "bsd"])
def test_a_notice_at_every_word_offset(spark, license_model, family):
    rng, known = np.random.default_rng(3), sorted({w for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(50).collect() for w in (r["text"] or "").split() if w.isalpha()})
    notice = licenses.NOTICES[family][0]
    around = rng.choice(known, 300).tolist()
    rows = [(n, " ".join([*around[:n], notice, *around[n : n + 40]])) for n in range(131)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), license_model).collect()
    assert [r["doc_id"] for r in got if r["family"] != family] == []


def test_unknown_class_is_calibrated(spark, license_model):
    quality = license_model.quality
    assert quality["calibration_error"] < 0.05 and quality["accuracy"] > 0.95 and quality["false_alarms"] < 0.01
    assert quality["further_told"] > 0.6 and quality["further_as_family"] < 0.1
    rows = [(i, f"some words before\n{t}\nand words after") for i, t in enumerate(licenses.HELD_OUT_LICENSES)]
    got = {r["doc_id"]: r["family"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), license_model).collect()}
    assert sum(f == "unknown" for f in got.values()) >= len(rows) - 1 and set(got.values()) <= {"unknown", "none"}


# --- mixing ---


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def check_mix(rows, docs):
    sizes, longest = Counter(), Counter()
    for _, text, _, source, _ in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    target, taken = plain_targets(sizes), Counter()
    source_of = {d[0]: d[3] for d in docs}
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], rel=1e-9, abs=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["shards"]) * r["size"] == r["taken"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)


def test_mixing_targets(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    run = lambda: sorted(map(tuple, queries.QUERIES["op7_mixing"](spark, "/root/testdata/sf0.01").collect()))
    check_mix(queries.QUERIES["op7_mixing"](spark, "/root/testdata/sf0.01").collect(), docs)
    assert run() == run()


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 7), "en", [None, "b", "a", "é"][i % 4], 1) for i in range(400)] + [(1000, None, "en", "empty", 0), (1001, "x", None, "b", None), (1001, "x", None, "b", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.op7_mixing(df).collect()
    assert len(got) == len(rows)
    check_mix(got, rows)
    mixed = mixing.mix(df.withColumnRenamed("n_chars", "shards")).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: v for k, v in Counter(x for r in got for x in [r["doc_id"]] * len(r["shards"])).items() if v})
    assert mixing.op7_mixing(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [r["taken"] for r in mixing.op7_mixing(nothing).collect()] == [0]


def test_mixing_shards_are_runs_of_permuted_blocks(spark):
    """Which rows a source's last pass takes, and that blocks go to shards whole, in runs, about as many to each."""
    rows = [(i, "w " * (1 + i * 7 % 23), "en", ["a", "b", "c", "d"][min(3, i % 7)], 1) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.op7_mixing(df).collect()
    hashed = df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", mixing.word_count(), F.lit(0).cast("long")).alias("h")).collect()
    order, source_of = {r["doc_id"]: r["h"] for r in hashed}, {r[0]: r[3] for r in rows}
    per_shard, n_sources = Counter(), set(source_of.values())
    for source in n_sources:
        mine = [r for r in got if source_of[r["doc_id"]] == source]
        n_blocks, size, target = -(-len(mine) // mixing.ROWS_PER_BLOCK), mine[0]["source_size"], mine[0]["target"]
        mine.sort(key=lambda r: (order[r["doc_id"]] % n_blocks, order[r["doc_id"]], r["doc_id"]))
        places = sorted({order[r["doc_id"]] % n_blocks for r in mine})
        epochs, start, shard_at = int(target // size), 0, {}
        for r in mine:
            again = start + r["size"] / 2 <= target - epochs * size and target > epochs * size
            assert len(r["shards"]) == epochs + again
            start += r["size"]
            for p, shard in enumerate(r["shards"]):
                shard_at.setdefault(p * len(places) + places.index(order[r["doc_id"]] % n_blocks), set()).add(shard)
        runs = [shard_at[k] for k in sorted(shard_at)]
        assert all(len(x) == 1 for x in runs)
        assert [min(x) for x in runs] == sorted(min(x) for x in runs)
        per_shard.update(min(x) for x in runs)
    counts = [per_shard[k] for k in range(8)]
    assert max(counts) - min(counts) <= 4 + len(n_sources)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 5))
def test_splitting_tree_meets_quotas(blocks, shards, seed):
    out = mixing.splitting_tree(np.array(blocks), shards, seed)
    assert out.sum(axis=1).tolist() == blocks and (out >= 0).all()
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= np.ceil(np.log2(shards)) + 1


def test_write_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = mixing.mix(docs)
    mixing.write_mix(mixed, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixed.count()


# --- media ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
def test_payload_round_trip(rows):
    padded = [r + bytes(max(64, -(-len(r) // 64) * 64) - len(r)) for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in padded])))
    images = jpeg.encode_payloads(np.frombuffer(b"".join(padded), np.uint8), offsets)
    for p, image, frames in zip(padded, images, jpeg.decode_dc(images), strict=True):
        assert image[:2] == b"\xff\xd8" and image[-2:] == b"\xff\xd9"
        assert frames[0][0].width == 512 and frames[0][0].height == len(p) // 8
        assert b"".join(x.tobytes() for _, x in frames) == p


def test_long_payload_takes_several_images(monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_ROWS", 3)
    payload = bytes(range(256)) * 2
    image = jpeg.encode_payloads(np.frombuffer(payload, np.uint8), np.array([0, 512]))
    frames = jpeg.decode_dc(image)[0]
    assert len(frames) == 3 and b"".join(x.tobytes() for _, x in frames) == payload


def colour_jpeg(interval, mcus=2):
    """An image 16 high and 16 wide for each of ``mcus``, of 4:2:0 with AC coefficients, written bit by bit."""
    rng = np.random.default_rng(3)
    bits, parts = "", []
    dc_codes = {s: f"{s:04b}" for s in range(12)}
    ac_codes = {0x00: "00", 0x01: "01", 0x12: "100", 0xF0: "101"}
    luma, last = np.zeros((2, 2 * mcus), int), [0, 0, 0]
    for mcu in range(mcus):
        if interval and mcu:
            parts.append(bits)
            bits, last = "", [0, 0, 0]
        for unit, c in enumerate([0, 0, 0, 0, 1, 2]):
            level = int(rng.integers(-60, 60))
            if c == 0:
                luma[unit // 2, mcu * 2 + unit % 2] = level
            diff, last[c] = level - last[c], level
            size = abs(diff).bit_length()
            bits += dc_codes[size] + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
            bits += ac_codes[0x01] + "1" + ac_codes[0xF0] + ac_codes[0x12] + "10" + ac_codes[0x00]
    parts.append(bits)
    scan = b""
    for k, part in enumerate(parts):
        part += "1" * (-len(part) % 8)
        scan += int(part, 2).to_bytes(len(part) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k]) if k + 1 < len(parts) else b"")
    table = lambda kind, codes: jpeg._segment(0xC4, bytes([kind]) + bytes(sum(len(v) == n for v in codes.values()) for n in range(1, 17)) + bytes(codes))
    frame = jpeg._segment(0xC0, bytes([8, 0, 16, *(16 * mcus).to_bytes(2, "big"), 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, bytes([0, 16] + [1] * 63)) + frame + table(0, dc_codes) + table(0x10, ac_codes)
    if interval:
        head += jpeg._segment(0xDD, bytes([0, 1]))
    return head + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", luma


@pytest.mark.parametrize("interval", [0, 1])
def test_colour_subsampled_image(interval):
    data, luma = colour_jpeg(interval)
    frame, image = jpeg.decode_dc([data])[0][0]
    assert (frame.width, frame.height) == (32, 16)
    assert image.tolist() == np.clip(luma * 2 + 128, 0, 255).tolist()


def test_lanes_one_by_one_and_side_by_side(monkeypatch):
    """Many payloads and a colour image, decoded either way; also where they break."""
    rng = np.random.default_rng(12)
    payload = rng.integers(0, 256, 64 * 200, dtype=np.uint8)
    images = jpeg.encode_payloads(payload, np.arange(0, 64 * 201, 64 * 4))
    images += [colour_jpeg(0)[0], colour_jpeg(1)[0]]
    images += [bytes([*i[:-9], *rng.integers(0, 255, 7, dtype=np.uint8), *i[-2:]]) for i in images]
    found = []
    for few in (0, 1 << 30):
        monkeypatch.setattr(jpeg, "FEW_LANES", few)
        found.append([None if f is None else [x.tolist() for _, x in f] for f in jpeg.decode_dc(images)])
    assert found[0] == found[1] and sum(f is not None for f in found[0]) >= 52


def test_an_image_without_restarts_is_quick():
    """A megapixel in one lane."""
    import time

    data, luma = colour_jpeg(0, mcus=4000)
    start = time.monotonic()
    frame, image = jpeg.decode_dc([data])[0][0]
    assert (frame.width, frame.height) == (64_000, 16)
    assert image.tolist() == np.clip(luma * 2 + 128, 0, 255).tolist()
    assert time.monotonic() - start < 10


def test_broken_images():
    good = jpeg.encode_payloads(np.arange(128, dtype=np.uint8), np.array([0, 128]))[0]
    cases = [b"", b"\xff\xd8", good[:40], good[:-8], good[1:], b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2")]
    assert jpeg.decode_dc(cases) == [None] * len(cases)
    assert jpeg.decode_dc([good, b"x", good])[2] is not None


def test_media_query(spark):
    rows = [(1, None), (2, ""), (3, "é" * 33), (4, "x" * 64), (5, "x" * 64), (None, "a" * 65), (7, "long text " * 60_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id BIGINT, text STRING, media STRING")
    got = {r["doc_id"]: r for r in jpeg.op8_jpeg(df).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[4]["media_sha256"] == got[5]["media_sha256"] and got[1]["feature"] == got[2]["feature"]
    assert jpeg.op8_jpeg(df.limit(0)).count() == 0
    back = jpeg.describe_media(jpeg.store_as_media(df), with_payload=True).where("doc_id = 3").first()
    assert bytes(back["payload"]) == ("é" * 33).encode() + bytes(62)


# --- shards ---


def test_hilbert_curve_is_continuous():
    for bits in (1, 2, 3):
        side = range(1 << bits)
        at = {hilbert_shards.hilbert_index((a, b, c), bits): (a, b, c) for a in side for b in side for c in side}
        assert sorted(at) == list(range(8**bits))
        assert all(sum(abs(x - y) for x, y in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(8**bits - 1))


def check_shards(rows, sizes):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8))
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    loads = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(loads) - min(loads) <= 2 * max(sizes)


def test_shard_query(spark, texts):
    rows = queries.QUERIES["op9_hilbert_shards"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check_shards(rows, [r["size"] for r in rows])


def test_shard_edges(spark):
    rows = [(i, None if i % 3 else "t" * i, [None, "en", "de"][i % 3], f"s{i % 40}" if i % 5 else None, None) for i in range(300)] + [(1, "same", "en", "hot", 4)] * 200
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "cell").selectExpr("*", "1 as size", "2 as shard")
    check_shards(hilbert_shards.shard_documents(df).collect(), [300])
    out = hilbert_shards.attach_shards(df)
    assert out.columns == [*[c for c in df.columns if c != "shard"], "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    assert hilbert_shards.attach_shards(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 14, 15, 16, 100, 10_000])
def test_values_are_cut_at_quantiles(spark, n):
    """Also with a long common beginning, and alike at every number of values."""
    df = spark.range(n).selectExpr("concat('https://a.very.long.host/', lpad(id, 6, '0')) as source").union(spark.createDataFrame([(None,)], "source STRING"))
    steps = {r["source"]: r["s"] for r in df.select("source", hilbert_shards.text_steps(df, "source").alias("s")).collect()}
    assert steps.pop(None) == 0
    assert [steps[k] for k in sorted(steps)] == [1 + i * 15 // n for i in range(n)]


def test_shards_against_a_plain_placement(spark, texts):
    """Order by curve, sub-bin and id, cut by bytes: shard and slot recomputed from rows alone."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = {r["doc_id"]: r for r in hilbert_shards.op9_hilbert_shards(docs).collect()}
    step = {}
    for c in ("lang", "source"):
        values = sorted({r[c] for r in rows.values() if r[c] is not None}, key=str.encode)
        step[c] = {v: 1 + i * 15 // len(values) for i, v in enumerate(values)} | {None: 0}
    bins = {r["doc_id"]: r["bin"] for r in hilbert_shards.slim_columns(docs).selectExpr("doc_id", "pmod(xxhash64(doc_id, size, text_crc32, 0L), 32) as bin").collect()}

    def key(i):
        size = len((rows[i]["text"] or "").encode()) + 1
        point = (step["lang"][rows[i]["lang"]], step["source"][rows[i]["source"]], max(0, min(15, size.bit_length() - 1 - 4)))
        return hilbert_shards.hilbert_index(point, 4), bins[i], i

    total, at, seen = sum(r["size"] for r in got.values()), 0, Counter()
    for i in sorted(rows, key=key):
        shard = min(7, at * 8 // total)
        assert (got[i]["shard"], got[i]["slot"]) == (shard, seen[shard])
        seen[shard] += 1
        at += got[i]["size"]


@pytest.mark.parametrize("doc_id", [None, 1])
def test_one_id_for_all_rows(spark, doc_id):
    """Shards stay even and the mixture meets its target though ids tell nothing apart."""
    rows = [(doc_id, "ten words are in this text as you can see", "en", "s", 1)] * 100
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    check_shards(hilbert_shards.shard_documents(df).collect(), [50])
    assert len({(r["shard"], r["slot"]) for r in hilbert_shards.attach_shards(df).collect()}) == 100
    got = mixing.op7_mixing(df).collect()
    assert sum(r["taken"] for r in got) == 1500 == got[0]["target"]
    assert max(r["taken"] for r in got) == 20
    assert mixing.mix(df).count() == 150


def test_peers_and_running_totals(spark):
    df = ranks.cut_lineage(spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 7) as a", "id").repartition(6))
    by = defaultdict(list)
    for r in ranks.number_peers(df, ["a"]).collect():
        by[r["a"]].append(r["peer"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    total = 0
    for r in sorted(ranks.running_totals(df, [df["id"]], {"before": df["id"]}).collect(), key=lambda r: r["id"]):
        assert r["before"] == total
        total += r["id"]


def test_ten_thousand_sources(spark):
    rows = [(i, "w " * (1 + i % 5), "en", f"s{i % 10_000:05d}", 1) for i in range(30_000)]
    got = mixing.op7_mixing(spark.createDataFrame(rows, DOCS)).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    target = plain_targets(sizes)
    assert all(r["target"] == pytest.approx(target[f"s{r['doc_id'] % 10_000:05d}"]) for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(target.values()), rel=0.1)


@pytest.mark.parametrize("doc_id", [0, 1, 3, 7, 9])
def test_every_language_is_learned_whatever_its_ids(spark, doc_id):
    rows = [(doc_id, f"the house and garden number {k} of the town", "en") for k in range(2000)] + [(k, f"la maison numero {k} du village", "fr") for k in range(300)] + [(doc_id, "ein einziger Satz", "de")] * 900
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    models = language_id.fit(df, fit_rows=100)
    assert sorted(x for m in models for x in m.languages) == ["de", "en", "fr"]
    none = language_id.fit(df.selectExpr("cast(null as bigint) doc_id", "text", "lang"), fit_rows=100)
    assert sorted(x for m in none for x in m.languages) == ["de", "en", "fr"]


def test_items_without_id_as_in_the_sql(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "one two three four five"), (4, None)], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(None, "one two three"), ("b", "four five"), (None, "two"), ("c", None)], "item_id STRING, text STRING")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    items.coalesce(1).write.parquet(str(tmp_path / "b"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/b/*.parquet'")
    got = decontaminate.op3_decontaminate(docs, items)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op3_decontaminate']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r["doc_id"]: (r["n_items"], r["contaminated"]) for r in got.collect()} == {1: (0, True), 2: (1, True), 3: (1, True), 4: (0, False)}
