"""Prefix token counts against the library itself."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import token_counts as tc

PARTS = [
    "a", "b", "e", "th", "ing", "'", "'re", "'ll", "'s", "!", "...", "1", "2026", " ", "\n", "é", "é", "日本", "ß", "Σ", "İ", "<|endoftext|>", "<|endof",
    "<|startoftext|>", "<|", "한", "한", "aaaa", "A", "THE", "😀", "́", "Å", "क्षि", "\x85", "\x1c", "ﬁ", " ", "\x00", "\t",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tc.vocabulary_path(tc.VOCABULARY))


def plain(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_every_prefix_agrees_with_the_library(library, text):
    got = tc.counter(tc.VOCABULARY).table(text)
    inside = tc._backward_composing()
    for k in range(len(text) + 1):
        # a prefix ends between characters
        if k < len(text) and (unicodedata.combining(text[k]) or text[k] in inside):
            continue
        assert got[k] == plain(library, text[:k]), text[:k]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aeinrstho'.1", min_size=1, max_size=90), min_size=1, max_size=30))
def test_many_words_as_one_by_one(words):
    counter = tc.counter(tc.VOCABULARY)
    words = [w for w in words if len(w) <= tc.LONG_WORD]
    counts, begin = counter.words(words)
    for w, b in zip(words, begin.tolist(), strict=True):
        assert counts[b : b + len(w) + 1].tolist() == counter.word(w).tolist()


def test_query_with_edges(spark, library, monkeypatch):
    monkeypatch.setattr(tc, "PIECE_BYTES", 50)  # runs in the driver only; workers keep theirs
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "house", "x9", "naïve", "don't", "<|endoftext|>"]) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (4, long), (None, "one two"), (5, "q" * 30000), (6, "é" * 3000), (7, long.replace(" ", ""))]
    df = spark.createDataFrame([(*r, "other") for r in rows], "doc_id BIGINT, text STRING, n_tokens STRING")
    got = sorted(map(tuple, tc.op12_token_counts(df).collect()), key=repr)
    want = []
    for i, t in rows:
        n = plain(library, t or "")
        kept = len(t or "")
        if n > 2048:
            table = tc.counter(tc.VOCABULARY).table(t)
            kept = max(k for k in range(len(t) + 1) if table[k] <= 2048)
            assert plain(library, t[:kept]) <= 2048 < plain(library, t[: kept + 1])
        want.append((i, len((t or "").encode()), n, n > 2048, kept))
    assert got == sorted(want, key=repr)
    more = tc.count_tokens(df.withColumn("kept_chars", F.lit("old")))
    assert more.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit", "kept_chars"]
    assert tc.op12_token_counts(df.limit(0)).count() == 0


def test_pieces_end_at_rows_and_spaces(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tc, "PIECE_BYTES", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "bé", "", "c" * 70, "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None]
    _, tokens, kept = tc._batch_counts(pa.array(texts), tc.RunTotals(tc.counter(tc.VOCABULARY)), 7)
    for t, n, k in zip(texts, tokens.tolist(), kept.tolist(), strict=True):
        table = tc.counter(tc.VOCABULARY).table(t or "")
        assert n == plain(library, t or "")
        assert k == max(i for i in range(len(table)) if table[i] <= 7)


def test_stored_prefixes_answer_questions(spark, library):
    rows = [(1, "The quick brown fox, don't you think?"), (2, ""), (3, None), (4, "日本語 text <|endoftext|> end")]
    stored = tc.with_prefix_counts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    asked = stored.select("doc_id", "text", *(tc.tokens_of_prefix(F.col("prefix_steps"), k).alias(f"t{k}") for k in (-1, 0, 7, 99)), *(tc.chars_within(F.col("prefix_steps"), k).alias(f"c{k}") for k in (-1, 0, 3, 99)))
    for r in asked.collect():
        text = r["text"] or ""
        assert [r[f"t{k}"] for k in (-1, 0, 7, 99)] == [0, 0, plain(library, text[:7]), plain(library, text)]
        assert r["c-1"] is None and r["c99"] == len(text)
        for k in (0, 3):
            assert r[f"c{k}"] == max(i for i in range(len(text) + 1) if plain(library, text[:i]) <= k)


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tc.PrefixCounter(tc.vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("unit", ["q", "the", "x1!", "日本"])
def test_a_long_word_in_bounded_memory(library, unit):
    import tracemalloc

    text = (unit * 200_000)[:200_000]
    counter = tc.counter(tc.VOCABULARY)
    tracemalloc.start()
    total = int(counter.run(text)[-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == plain(library, text)
    assert peak < 200 * len(text.encode())
