import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefixory.llm import packing
from prefixory.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs):
    """Pieces are those of the whole texts; sequences are gapless and within their size. Returns the number of sequences."""
    tok = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected.append((str(doc_id), k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_hard_rows(make, hard):
    from .conftest import HARD

    rows = packing.pack(packing.tokenised(hard, PATH), bucket_rows=2).collect()
    check(rows, HARD)
    assert packing.pack(packing.tokenised(make([]), PATH)).collect() == []


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = packing.op1_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 4, 10_000), (100, 7, 3_000)])
def test_counts_equal_single_pieces(rule, caps):
    """Placement on counts opens as many sequences as best-fit piece by piece, under every constraint."""
    r = random.Random(3)
    lengths = sorted((r.choice([1, 3, 7, 20, 20, 33, 50]) for _ in range(400)), reverse=True)
    bins = []
    w = (1.0, 1.0, 1.0)
    for n in lengths:
        need = (n, 1, n * n)
        best = None
        for i, b in enumerate(bins):
            if all(x >= y for x, y in zip(b, need, strict=True)):
                if rule == "norm":
                    s = sum(v * ((x - y) / c) ** 2 for v, x, y, c in zip(w, b, need, caps, strict=True))
                else:
                    s = sum(v * x * y / c / c for v, x, y, c in zip(w, b, need, caps, strict=True))
                if best is None or s < best[0] - 1e-12:
                    best = (s, i)
        if best is None:
            bins.append(list(caps))
            best = (0, len(bins) - 1)
        for k in range(3):
            bins[best[1]][k] -= need[k]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows, opened = packing.place(counts, *caps, rule=rule)
    assert opened == len(bins)
    used = defaultdict(lambda: np.zeros(3, int))
    placed = defaultdict(int)
    for length, rank, k, n, first, _ in rows.tolist():
        assert rank == placed[length]
        placed[length] += k * n
        for s in range(first, first + n):
            used[s] += (k * length, k, k * length * length)
    assert dict(placed) == counts
    assert all((u <= caps).all() for u in used.values())


def test_impossible_piece():
    with pytest.raises(ValueError):
        packing.place({20: 1}, 100, 10, 300)


def test_words_equal_the_tokenizer():
    tok, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    for t in ["it's we'll 'S x'T", "<|endoftext|> a<|endoftext|>b <|", "ÀÉ×÷ßſŉĲ İi ΑΣ Σ", "x y\u0085z\x1cq", "é ́a", "日本語 123 4a5b c_d__e", "a\tb\r\nc", "ǅ ﬁ ½ ²", "\x00\x01"]:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
