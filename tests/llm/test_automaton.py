import itertools

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefixory.llm import automaton

from .conftest import HARD

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def merged(word, merges):
    """Byte-pair encoding as it is defined: the merge of least rank, from left to right, until none applies."""
    word = list(word)
    for u, v, made in merges:
        out = []
        for t in word:
            if out and out[-1] == u and t == v:
                out[-1] = made
            else:
                out.append(t)
        word = out
    return word


def encode(own, words):
    n = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(n + 1)))
    symbol = np.zeros(start[-1], np.int64)
    for a, w in zip(start, words, strict=False):
        symbol[a : a + len(w)] = w
    token = own.encode(symbol, start[:-1], start[1:] - 1)
    return [[t for t in token[a:b].tolist() if t >= 0] for a, b in zip(start[:-1], start[1:], strict=True)]


@st.composite
def dictionaries(draw):
    """Merges of parts that exist, each made once."""
    symbols, merges, size = 3, [], 3
    word = [(t,) for t in range(symbols)]
    for _ in range(draw(st.integers(0, 9))):
        u, v = draw(st.integers(0, size - 1)), draw(st.integers(0, size - 1))
        if word[u] + word[v] not in word:
            word.append(word[u] + word[v])
            merges.append((u, v, size))
            size += 1
    return merges


@given(dictionaries(), st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_small_automata_encode_as_defined(merges, words):
    assert encode(automaton.Automaton(3, merges), words) == [merged(w, merges) for w in words]


@given(dictionaries())
@settings(max_examples=40, deadline=None)
def test_accepts_the_encodings_alone(merges):
    """Of all ways to write a word in tokens the automaton has a path for just one."""
    own = automaton.Automaton(3, merges)
    word = {t: (t,) for t in range(3)}
    for u, v, made in merges:
        word[made] = word[u] + word[v]

    def paths(state, rest):
        if not rest:
            return [[]]
        return [[t, *p] for t, w in word.items() if own.live[t] and rest[: len(w)] == w and own.allows(state, t) for p in paths(own.goes[t], rest[len(w) :])]

    for w in itertools.product(range(3), repeat=5):
        assert paths(0, w) == [merged(w, merges)]


ODD = ["", " ", "\n", "a", "'s 's", "It's WE'LL can't", "<|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "ΣΑΣ İ ﬁ é é ́x", "12345 a1b2", "日本語 😀 \x00\x1f\x85\xa0", "a\tb\r\nc", "x" * 5000, "é" * 300, "a  b", "ͅ ß ẞ", "don't!?...", "<|"]


@pytest.mark.parametrize("text", ODD)
def test_equals_the_library(library, text):
    own = automaton.codec(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(own.encode([text])[0], np.int32)
    assert got.tolist() == want
    assert " ".join(automaton.arc_labels(PATH)[got]) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(st.sampled_from("abehinorst'XÉé😀日1 \n<|>́"), max_size=30), max_size=20))
@settings(max_examples=150, deadline=None)
def test_any_texts(texts):
    library, own = LIBRARY, automaton.codec(PATH)
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_entry_of_the_vocabulary(library):
    own = automaton.codec(PATH)
    words = [w.replace("</w>", "") for w in library.get_vocab()] + ["zz", "q"]
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_known_words_are_bounded(library):
    own = automaton.Codec(PATH, 50)
    for k in range(5):
        texts = [f"word{k}x{i} the end" for i in range(30)]
        assert [np.frombuffer(x, np.int32).tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(own.known) <= 50


def test_hard_rows(make, library):
    docs = make([*HARD, *((i, t) for i, t in enumerate(ODD, 100))], extra=True).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    ids = automaton.encoded(docs, PATH)
    out = automaton.decoded(ids, PATH).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        e = library.encode(texts[r.doc_id], add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == library.decode(e.ids, skip_special_tokens=False)
    assert automaton.decoded(automaton.encoded(make([]), PATH), PATH).count() == 0
    nothing = docs.sparkSession.createDataFrame([(1, None), (None, [0])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.decoded) for r in automaton.decoded(nothing, PATH).collect()} == {(1, ""), (None, "!")}


def test_query_equals_the_library(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = automaton.op13_word_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r, e in zip(got, library.encode_batch([texts[r.doc_id] for r in got], add_special_tokens=False), strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))
