import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefixory.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


@given(st.text(st.sampled_from("a@.b-+ 0129()%é"), max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.c@d.e f@g.h", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (555) 555-0100.", "x@y", "@a.b", "a@@b.c", "00000255.0.0.1", "é@b.cc", "+1-2 +49 170 1234567", "1" * 20])
def test_base_examples(text):
    assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "+1" + " " * 200_000, "+1(" * 50_000, "a-" * 100_000 + "1"):
        pii.candidates(text, pii.base_spans(text))


DOCS = [(i, t) for i, t in enumerate(
    [f"reach me at joe{i}@mail.example.com or +1 (415) 555-01{i:02d} today" for i in range(10, 30)]
    + [f'token = "{"%040x" % (7**55 + i * 10**35)}" in use' for i in range(20)]
    + ["card 4111 1111 1111 1111 paid", "from 10.0.0.7 we saw", "call (415) 555-0134 now", "plain words without any", "version 10.2 and page 12 of 300"]
)]


def test_added_spans(make):
    rows = {r.doc_id: r for r in pii.spans(make(DOCS)).collect()}
    for i, text in DOCS:
        base = brute(text)
        own = rows[i].spans.split(",") if rows[i].spans else []
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(own)
        assert rows[i].n_email == sum(k == "email" for _, k, _ in base)
        assert (rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(s[1] == k for s in base) for k in ("ip", "card", "phone"))
    assert all("secret:9:49" in rows[i].spans for i in range(20, 40))
    assert rows[43].spans == "" and rows[44].spans == ""


ALONE = ["joe (at) mail (dot) com", "ask joe [at] mail [dot] example [dot] org", "joe(at)mail.com", "(joe [at) mail.net", "host dead:beef:cafe:babe:dead:beef:cafe:babe up"]


@pytest.mark.parametrize("text", ALONE)
def test_candidates_without_digits(text):
    """A digit elsewhere in the text makes no difference to what is found."""
    assert pii.candidates(text, pii.base_spans(text)) == pii.candidates(text + " , 7", []) != []


@given(st.lists(st.sampled_from(["a", "f", ":", "a:", "f:" * 7, "(at)", "[at]", " (dot) ", ".", " ", "-", "(", "]", "é"]), max_size=30).map("".join))
@settings(max_examples=500, deadline=None)
def test_filter_leaves_no_wide_match_out(text):
    assert pii._ANY.search(text) or not any(w.search(text) for k, w in pii._WIDE.items() if k != "secret")


def test_address_alone_reaches_the_classifier(make):
    docs = [(2 * i + k, text + " , 7" * k) for i, text in enumerate(ALONE) for k in range(2)]
    found = {r.doc_id: r.found for r in pii.found_in(make(docs)).collect()}
    assert all(found[2 * i] == found[2 * i + 1] and found[2 * i] for i in range(len(ALONE)))


SPANS = st.lists(st.tuples(st.integers(0, 60), st.sampled_from(pii.KINDS), st.integers(1, 9)), max_size=14)


@given(SPANS, SPANS)
@settings(max_examples=400, deadline=None)
def test_added_equals_the_plain_rule(base, found):
    """Accepted candidates that overlap neither base spans nor each other, leftmost and longest first; against all pairs."""
    base = [(a, k, a + n) for a, k, n in base]
    found = [(a, k, a + n, 0) for a, k, n in found]
    classifier = pii.SpanClassifier({})
    classifier.accepted = {k: {0} for k in pii.KINDS[1:]}
    taken, out = [(a, b) for a, _, b in base], list(base)
    for a, k, b, _ in sorted(found, key=lambda s: (s[0], -s[2], pii.KINDS.index(s[1]))):
        if k != "email" and not any(x < b and a < y for x, y in taken):
            out.append((a, k, b))
            taken.append((a, b))
    assert classifier.added(base, found) == sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_many_spans_take_linear_time():
    text = "a@b.cc x@y 1.2.3.4 (at) q (at) z " * 20_000
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    classifier = pii.SpanClassifier({})
    classifier.accepted = {k: {p for _, _, _, p in found} for k in pii.KINDS}
    assert len(classifier.added(base, found)) >= 60_000


def test_redaction(make):
    out = {r.doc_id: r for r in pii.redacted(make([*DOCS, (100, None), (101, ""), (102, "a@b.cc c@d.ee")], extra=True)).collect()}
    assert out[0].text == "reach me at <EMAIL> or <PHONE> today"
    assert out[20].text == 'token = "<SECRET>" in use'
    assert out[40].text == "card <CARD> paid"
    assert (out[43].text, out[100].text, out[101].text, out[102].text) == (DOCS[43][1], None, "", "<EMAIL> <EMAIL>")
    assert out[0].h1 == "x"


def test_hard_rows(make, hard):
    assert pii.spans(hard).count() == hard.count()
    assert pii.redacted(hard).columns == hard.columns
    assert sorted(map(str, (r.text for r in pii.redacted(hard).collect()))) == sorted(map(str, (r.text for r in hard.collect())))
    assert pii.spans(make([])).count() == 0
    assert pii.redacted(make([])).count() == 0


def test_unreliable_labelers_are_found_out():
    """A labeler that votes at random gets no say against three that agree."""
    import itertools
    import random

    r = random.Random(0)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.5
        votes = [2 if (r.random() < 0.9) == y else 0 for _ in range(3)] + [r.choice([0, 2]), 1]
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[code * 8] = counts.get(code * 8, 0) + 1
    c = pii.SpanClassifier({"secret": counts})
    for votes in itertools.product([0, 2], repeat=4):
        code = 0
        for v in (*votes, 1):
            code = code * 3 + v
        assert (code * 8 in c.accepted["secret"]) == (sum(votes[:3]) >= 4)
