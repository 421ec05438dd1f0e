"""Operator 13: byte-pair encoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that accepts just the sequences that byte-pair encoding
yields. It begins with one state that loops on every symbol. The gadget of a merge (u, v): the state that u leads to is
copied without its transition on v, u then leads to the copy, and wherever u could go on with v there is a transition on uv
to where v led. Since all transitions on a token lead to one state, a state is its parent, the merge that made it and the
token removed, and a gadget takes constant time.

The removed transitions of a state are ranges: with tokens in the order of a walk through the tree of left parts, latest
child first, the tokens that a removal forbids (v and all tokens begun with v from then on) lie side by side. A state's row
of the table is the sorted ends of these ranges, made when the state is first met; a transition is one search in it.

The new words of an Arrow batch are encoded together, in numpy: from the place that each has reached the longest token with
a transition is taken, and a place from which the end can't be reached is left for good. As each beginning of a word has one
encoding, a place is met in one state, and work is linear in a word's length, whatever it is. Decoding emits the label of
each arc. Rows are mapped one by one without a shuffle; workers keep words met before, up to a fixed number.

Defined results: a null or empty text has no ids and decodes to an empty text; texts of any length are encoded whole;
special tokens' strings in a text are special tokens; repeated rows are encoded each; null doc_ids are kept; an empty table
gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, table, texts
from .packing import _PLAIN, _byte_characters

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = pa.schema([*_IDS, ("decoded", pa.string())])


#: Of each byte in plain lower-case words: letter 0, digit 1, other mark 2, line end 3.
_KINDS = np.array([3 if b == 10 else 1 if 48 <= b < 58 else 0 if 97 <= b < 123 or b > 127 else 2 for b in range(256)], np.int8)


class Automaton:
    """symbols: number of base tokens, which are 0 to symbols - 1. merges: (left, right, made) in order of rank; `made` is
    made by one merge only and both parts exist before."""

    def __init__(self, symbols: int, merges: list[tuple[int, int, int]]):
        size = symbols + len(merges)
        self.symbols, goes = symbols, [0] * size  # the state that all transitions on a token lead to
        self.parent, self.removed = [-1], [-1]
        left = [-1] * size
        for u, v, made in merges:
            self.parent.append(goes[u])
            self.removed.append(v)
            goes[made], goes[u] = goes[v], len(self.parent) - 1
            left[made] = u
        self._order(merges, size)
        self._live(merges, size)
        self._rows(goes)
        self._trie(merges, size)

    def _order(self, merges: list[tuple[int, int, int]], tokens: int) -> None:
        """Places of tokens, and the range of places that each state's own removal forbids."""
        size, place, start = [1] * tokens, [0] * tokens, 0
        for u, _, made in reversed(merges):
            size[u] += size[made]
        for t in range(self.symbols):
            place[t], start = start, start + size[t]
        # In reverse order of rank a token's children come latest first; those so far are the ones made from then on.
        end, child_at, spans = [1] * tokens, [0] * tokens, []  # end: of a token and its children so far
        for u, v, made in reversed(merges):
            child_at[made] = end[u]
            end[u] += size[made]
            spans.append((v, end[v]))
        for u, _, made in merges:  # parts before what is made of them
            place[made] = place[u] + child_at[made]
        self.place = np.array(place, np.int64)
        self.spans = [(0, 0), *((place[v], place[v] + n) for v, n in reversed(spans))]

    def _live(self, merges: list[tuple[int, int, int]], tokens: int) -> None:
        """Tokens that some encoding holds: a merge whose right part has no transition after its left part, when its turn comes,
        is a gadget without a place."""
        low, high = np.array(self.spans).T
        parent, v = np.array(self.parent), self.place[self.removed]
        at, todo, barred = parent.copy(), np.arange(1, len(parent)), np.zeros(len(parent), bool)
        while len(todo := todo[at[todo] > 0]):
            s = at[todo]
            barred[todo] |= (low[s] <= v[todo]) & (v[todo] < high[s])
            at[todo] = parent[s]
        self.live = np.ones(tokens, bool)
        for (u, v, made), no in zip(merges, barred[1:].tolist(), strict=True):
            self.live[made] = not no and self.live[u] and self.live[v]

    def _rows(self, goes: list[int]) -> None:
        """The table: for each state that some token leads to, the ends of its forbidden ranges of places. All rows are one
        sorted array, a row's number in the upper bits; an odd number of ends before a place forbids it."""
        number, ends = {0: 0}, []
        for s in goes:
            if s not in number:
                number[s] = row = len(number)
                spans = []
                while s > 0:
                    spans.append(self.spans[s])
                    s = self.parent[s]
                last, base = -1, row << 32
                for a, b in sorted(spans):
                    if a > last:
                        ends += (base + a, base + b)
                        last = b
                    elif b > last:
                        ends[-1] = base + b
                        last = b
        self.ends = np.array(ends, np.int64)
        self.goes = np.array([number[s] for s in goes], np.int64)

    def _trie(self, merges: list[tuple[int, int, int]], size: int) -> None:
        """Tokens by their symbols: the next node for each node with children, and a node's token. Node 0 is none, 1 the root."""
        word = [(t,) for t in range(self.symbols)] + [()] * (size - self.symbols)
        for u, v, made in merges:
            word[made] = word[u] + word[v]
        inner = {(): 1}
        for w in word:
            for k in range(len(w) - 1, 0, -1):
                if w[:k] in inner:
                    break
                inner[w[:k]] = 0
        for k, w in enumerate(inner, 1):
            inner[w] = k
        node = dict(inner)
        for w in word:
            node.setdefault(w, len(node) + 1)
        self.inner = len(inner) + 1
        self.next = np.zeros((self.inner, self.symbols), np.int32)
        self.token = np.full(len(node) + 1, -1, np.int64)
        for w, k in node.items():
            if w:
                self.next[inner[w[:-1]], w[-1]] = k
        for t, w in enumerate(word):
            if self.live[t]:
                self.token[node[w]] = t
        self.deepest = max(map(len, word), default=0)

    def allows(self, state, token):
        return np.searchsorted(self.ends, (state << 32) + self.place[token], "right") & 1 == 0

    def encode(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The token that ends at each place, -1 where none does. Word k has its symbols at the places from start[k] to before
        end[k], which is a place of its own. All words step together: from each place the longest token with a transition
        is taken. A place from which the end can't be reached is left for good: there is one encoding up to it, so each
        place of a word is met in one state, and entered again only to try a shorter token."""
        size = len(symbol)
        below = np.full(size, size + 1)  # a place's tokens that end from there on are tried; 0: the place is left for good
        came, token, state = (np.zeros(size, np.int64) for _ in range(3))  # of the way to a place: from where, by what, in which state
        active = np.flatnonzero(end > start)
        at = start[active]
        while len(active) > 24:
            stop = end[active]
            best, by = np.full(len(at), -1), np.zeros(len(at), np.int64)
            row, node, walk, to = state[at], np.ones(len(at), np.int32), np.arange(len(at)), at
            for _ in range(self.deepest):
                node = self.next[node, symbol[to]]
                hit = np.flatnonzero(node)
                node, walk, to = node[hit], walk[hit], to[hit] + 1
                t = self.token[node]
                can = np.flatnonzero((t >= 0) & (to < below[at[walk]]) & (below[to] > 0))
                can = can[self.allows(row[walk[can]], t[can])]
                best[walk[can]], by[walk[can]] = to[can], t[can]
                on = np.flatnonzero((node < self.inner) & (to < stop[walk]))
                if not len(on):
                    break
                node, walk, to = node[on], walk[on], to[on]
            found = best >= 0
            new, old, lost = best[found], at[found], at[~found]
            came[new], token[new], state[new], below[old] = old, by[found], self.goes[by[found]], new
            below[lost] = 0
            best[~found] = came[lost]
            on = best < stop
            at, active = best[on], active[on]
        for i, stop in zip(at.tolist(), end[active].tolist(), strict=True):  # the few that are left, such as very long words
            while i < stop:
                node, to, todo = 1, i, []
                while to < stop and node < self.inner and (node := int(self.next[node, symbol[to]])):
                    to += 1
                    if (t := int(self.token[node])) >= 0 and to < below[i] and below[to]:
                        todo.append((t, to))
                for t, to in reversed(todo):
                    if self.allows(state[i], t):
                        came[to], token[to], state[to], below[i] = i, t, self.goes[t], to
                        i = to
                        break
                else:
                    below[i], i = 0, int(came[i])
        out, at, first = np.full(size, -1), end[end > start], start[end > start]
        while len(at):
            out[at] = token[at]
            at = came[at]
            on = at > first
            at, first = at[on], first[on]
        return out


class Codec:
    """Whole texts to ids, by the vocabulary file of a byte-level tokenizer whose words end with a mark."""

    def __init__(self, path: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        names = [*(chars := _byte_characters()), *(c + self.end for c in chars), *(a + b for a, b in merges)]
        number = {name: k for k, name in enumerate(names)}
        self.automaton = Automaton(512, [(number[a], number[b], number[a + b]) for a, b in merges])
        self.id = np.array([vocab[name] for name in names], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.bytes = {c: b for b, c in enumerate(chars)}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.most = most

    def _ends(self, joined: np.ndarray) -> np.ndarray:
        """Of normalised plain words in bytes, each followed by a line end: where pre-split words end. Letters stay together,
        other marks too, a digit stands alone; all bytes outside ASCII are letters' here."""
        kind = _KINDS[joined]
        return (kind[:-1] != kind[1:]) | (kind[:-1] == 1)

    def _flat(self, joined: np.ndarray, last: np.ndarray, word: np.ndarray) -> list[bytes]:
        """Ids of each word: joined bytes of pre-split words, whether a byte is the last of one, and the word of each byte."""
        part = np.cumsum(last) - last  # the number of the pre-split word
        places = np.arange(len(joined)) + part
        symbol = np.zeros(len(joined) + int(last.sum()), np.int64)
        symbol[places] = joined.astype(np.int64) + 256 * last
        end = places[last] + 1
        start = np.concatenate(([0], end[:-1] + 1))[: len(end)]
        token = self.automaton.encode(symbol, start, end)
        ids = self.id[token[token >= 0]].tobytes()
        n = np.zeros(len(token) + 1, np.int64)
        np.cumsum(token >= 0, out=n[1:])
        edge = np.flatnonzero(np.diff(word, append=-1))  # last byte of each word
        to = (n[places[edge] + 2] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Adds words (what lies between spaces and line ends; no token reaches over these) to those known; all go through the
        automaton together."""
        plain = [w for w in words if _PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            joined = np.frombuffer(("\n".join(plain).lower() + "\n").encode(), np.uint8)
            own = joined != 10
            last = np.append(self._ends(joined), False)[own]
            self.known.update(zip(plain, self._flat(joined[own], last, np.cumsum(~own)[own]), strict=True))
        for w in set(words) - self.known.keys():
            self.known[w] = b"".join(np.int32(self.special[x]).tobytes() if x in self.special else self._split(x) for x in (self.specials.split(w) if self.specials else [w]))

    def _split(self, word: str) -> bytes:
        """Ids of a word that holds no special token, normalised and pre-split by the library's own rules."""
        parts = [bytes(self.bytes[c] for c in p) for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word)) if p]
        if not parts:
            return b""
        last = np.zeros(sum(map(len, parts)), bool)
        last[np.cumsum([len(p) for p in parts]) - 1] = True
        return self._flat(np.frombuffer(b"".join(parts), np.uint8), last, np.zeros(len(last), np.int64))[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers. Words not met before are learned a bounded number at a time; those of before
        go if they are too many."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        met = set().union(*split)
        new = met - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, met
        todo, size = [], 0
        for w in new:
            todo.append(w)
            size += len(w) + 1
            if size > 400_000:
                self._learn(todo)
                todo, size = [], 0
        self._learn(todo)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def arc_labels(path: str) -> np.ndarray:
    """The label of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    labels = {i: name for name, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return np.array([labels.get(i, "") for i in range(max(labels) + 1)], object)


@prepared
def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of each whole text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            raw = own.encode(texts(batch))
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], schema=_IDS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


@prepared
def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids) with the decoded text; null ids decode to an empty text."""

    def run(batches):
        labels = arc_labels(path)
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = np.asarray(lists.flatten()), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) if len(lists) else []
            out, at = [], 0
            for end in ends:
                out.append(" ".join(labels[flat[at:end]]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(_IDS.field("ids").type), pa.array(out, pa.string())], schema=_DECODED)

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op13_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
