import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from prefixory.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "\n", "\n\n", " a", "a ", "a  b", "  a\n  b \n", "\na", "a\n b", "▁", "a▁b ▁ c", "x▁", "日本語 テキスト", "😀 á", "\t\x00\x01", "<s> </s> <unk> <0x0A>", "a" * 500, " \n \n", "é̀‍"]


def equal(model, library, text):
    ids, starts, ends = model.encode(text)
    assert ids.tolist() == library.encode(text)
    whole_text = model._aligned(*model.normalised(text))  # in one go, without chunks
    assert [list(map(int, x)) for x in (ids, starts, ends)] == [list(x) for x in whole_text]
    whole = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces if not p.piece.startswith("<0x")]
    assert [(int(a), int(b)) for i, a, b in zip(ids.tolist(), starts, ends, strict=True) if not library.is_byte(i)] == whole
    if len(ends):
        assert ends[-1] == len(text.encode())
        assert (starts[1:] <= ends[1:]).all()


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    equal(*pieces.load(PATH), text)


@given(st.lists(st.text(st.sampled_from("▁thernigaoblsé日😀0"), min_size=1, max_size=24), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_both_ways_to_merge_are_one(segments):
    model, _ = pieces.load(PATH)
    chars = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
    parts, lengths, n = model._merged_all(chars, np.array([len(t) for t in segments]))
    for t, w, k in zip(segments, lengths.tolist(), n.tolist(), strict=True):
        assert [len(p) for p in model.merged(t)] == w[:k]


def test_keys_with_spaces_are_seen():
    assert not pieces.CharMap(double_array({"ﬁ": "fi", "AB": "x y"})).has_space()
    assert pieces.CharMap(double_array({"ﬁ": "fi", "A B": "x"})).has_space()
    assert pieces.CharMap(double_array({"▁": " "})).has_space()
    assert not pieces.CharMap(b"").has_space()


@given(st.text(st.sampled_from("ab ▁\né😀 "), max_size=30))
@settings(max_examples=150, deadline=None)
def test_any_text(text):
    equal(*pieces.load(PATH), text)


def double_array(entries):
    """A compiled character map of (source, replacement) pairs, laid out unit by unit."""
    blob, at = b"", {}
    for source, target in sorted(entries.items()):
        at[source.encode()] = len(blob)
        blob += target.encode() + b"\0"
    units, used, bases = [0] * 65536, {0}, set()

    def build(prefix, node):
        keys = sorted({k[len(prefix)] for k in at if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in at
        need = [0] * leaf + keys
        base = next(b for b in range(256, 65000, 256) if all((b ^ c) not in used for c in need) and node ^ b not in used and b not in bases)
        bases.add(base)  # each node has its own, so no transition leads to another's child
        offset = base ^ node
        units[node] |= offset << 10 | leaf << 8
        for c in need:
            used.add(node ^ offset ^ c)
        if leaf:
            units[node ^ offset] = at[prefix] | 1 << 31
        for c in keys:
            child = node ^ offset ^ c
            units[child] |= c
            build(prefix + bytes([c]), child)

    build(b"", 0)
    raw = struct.pack("<65536I", *units)
    return struct.pack("<I", len(raw)) + raw + blob


def test_longest_prefixes_of_a_map():
    m = pieces.CharMap(double_array({"ﬁ": "fi", "A": "a", "AB": "xy", "Ⅷ": "VIII"}))
    assert m.longest("ABC".encode(), 0) == (2, "xy")
    assert m.longest("AC".encode(), 0) == (1, "a")
    assert m.longest("zﬁ".encode(), 1) == (3, "fi")
    assert m.longest(b"q", 0) is None


def field(n, value):
    head = bytes([n << 3 | 2])
    size = len(value)
    while size > 127:
        head += bytes([size & 127 | 128])
        size >>= 7
    return head + bytes([size]) + value


@pytest.mark.parametrize("collapse", [0, 1])
def test_model_with_a_map_equals_the_library(collapse):
    """The public model with a character map put in: ids as the library's, spans over all of the source."""
    raw = open(PATH, "rb").read()
    base = b"".join(field(f, v) for f, v in pieces._fields(raw) if f in (1, 2))
    spec = field(1, b"own") + field(2, double_array({"ﬁ": "fi", "A": "a", "AB": "xy zz", "Ⅷ": "VIII", "\t": " "})) + bytes([0x18, 1, 0x20, collapse, 0x28, 1])
    model = pieces.PieceModel(base + field(3, spec))
    library = sentencepiece.SentencePieceProcessor(model_proto=base + field(3, spec))
    for t in ["ﬁne ABBA", "Ⅷ\t\tﬁA AB", " x  y ", "", "the quick ABﬁ fox\nA"]:
        ids, starts, ends = model.encode(t)
        assert ids.tolist() == library.encode(t)
        # A piece covers the whole source of each of its characters.
        assert ((starts <= ends) & (ends <= len(t.encode()))).all()
        assert (np.diff(starts) >= 0).all() and (np.diff(ends) >= 0).all()
        covered = {k for x, y in zip(starts, ends, strict=True) for k in range(x, y)}
        assert collapse or covered == set(range(len(t.encode())))


def test_rows(make, hard):
    from .conftest import HARD

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = pieces.encode_digest(hard, PATH).collect()
    expected = []
    for i, t in HARD:
        ids = [1, *library.encode(t or ""), 2]
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(expected)
    assert pieces.encode_digest(make([]), PATH).count() == 0
    span = pieces.encode_spans(make([(1, "a b")]), PATH).first()
    assert (span.starts, span.ends) == ([0, 1], [1, 3])
