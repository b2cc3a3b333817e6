import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqframe.llm import bpe, tokencount

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXT = st.lists(st.sampled_from([*" \n\t,.'’12aeéßσΣİﷺ一²", " ", "　", "\x1c", "\x85", "'s", "the", "<|endoftext|>"]), max_size=20).map("".join)


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(RANKS)
    return bpe.Encoder(ranks, P.PATTERN), bpe.Decoder(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return tokencount.PrefixCounter(WORDS), Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_same_ids_and_round_trip(codec, text):
    ids, n = codec[0].encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == codec[2].encode_ordinary(text) and n * 4 == len(ids)
    assert codec[1].decode(ids) == text.encode()


def test_every_character_class(codec):
    for at in range(0x20, 0x3100):
        text = f"a{chr(at)}b {chr(at)}1"
        assert np.frombuffer(codec[0].encode(text)[0], "<u4").tolist() == codec[2].encode_ordinary(text), hex(at)


def test_long_pre_tokens(codec):
    rng = random.Random(0)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5_000 + "x"):
        assert np.frombuffer(codec[0].encode(text)[0], "<u4").tolist() == codec[2].encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_same_counts(words, text):
    assert words[0].count(text, 9)[0] == len(words[1].encode(text, add_special_tokens=False).ids)


def test_every_prefix(words):
    counter, library = words
    for word in ("internationalization", "thereofonwhble", "a", "zzzzqqq"):
        assert counter.prefix_counts(counter.spelled(word)) == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]


TEXTS = ["the quick brown fox jumps over the lazy internationalization of it", "a", "", "  x ", "l\u2019été d'Élise they're 'rx we'll 12 345", "e\u0301te\u0301 1e\u0301 \u03a3\u03a3 end", "x<|endoftext|>y !!<|startoftext|>", "漢字かな交じり文をつなげて書く" * 3, "thereofonwhble" * 4]


@pytest.mark.parametrize("text", TEXTS)
def test_what_fits(words, text):
    count = lambda t: len(words[1].encode(t, add_special_tokens=False).ids)
    each = [count(text[:i]) for i in range(len(text) + 1)]
    assert words[0].every(text, *words[0].stretches([text])[0]).tolist() == each
    for budget in range(max(each) + 2):
        assert words[0].count(text, budget) == (each[-1], max(i for i, n in enumerate(each) if n <= budget))


def test_prefix_table(spark, words):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r for r in tokencount.prefix_table(docs, WORDS, budgets=(0, 3, 7), every=True).collect()}
    for i, text in enumerate(TEXTS):
        each = np.frombuffer(got[i].counts, "<u4").tolist()
        assert len(each) == len(text) + 1 and each[-1] == got[i].n_tokens == words[0].count(text, 0)[0]
        assert got[i].fits == [words[0].count(text, b)[1] for b in (0, 3, 7)]


def test_odd_rows(spark, odd, nothing):
    got = tokencount.count_tokens(odd, WORDS, budget=2048).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert [r.over_limit for r in got if r.doc_id in (5, 6)] == [True, True]
    assert tokencount.count_tokens(nothing, WORDS, budget=1).count() == 0
    coded = bpe.encode(odd, RANKS, P.PATTERN, decoded=True)
    texts = sorted(bytes(r.decoded).decode() for r in coded.collect())
    assert texts == sorted(r.text or "" for r in odd.collect())
    assert sorted(bytes(r.decoded).decode() for r in bpe.decode(coded, RANKS, P.PATTERN).collect()) == texts
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


ODD = st.lists(st.sampled_from([*"\n,.'<|>aesrx19ßσΣİǰ²漢が̸̣́̈ো한한", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "é", "ve"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(ODD)
def test_prefixes_of_any_form(words, text):
    """Decomposed letters, lengths that change in lower case, special strings: each prefix as the library counts it."""
    counter, library = words
    want = [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
    assert counter.inside(text) == want


@pytest.mark.parametrize("unit", ["がぎ", "İxİ", "漢字かな交じり文", "éẍ", "漢字<|endoftext|>かな", "한", "ab'll9"])
def test_long_unspaced_texts_take_their_length(words, unit):
    text = unit * (20_000 // len(unit))
    began = time.process_time()
    counts = words[0].inside(text)
    assert time.process_time() - began < 4 and len(counts) == len(text) + 1
    at = [0, 1, 2, 3, 777, len(text) // 2, len(text) - 1, len(text)]
    assert [counts[i] for i in at] == [len(words[1].encode(text[:i], add_special_tokens=False).ids) for i in at]
