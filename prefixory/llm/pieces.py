"""Operator 5: SentencePiece encoding and decoding with offsets.

A text is normalised by longest-prefix matches in the model's compiled character map, each normalised character keeping
the bytes of the source it came from; the pieces of the BPE segmentation are then projected to byte spans of the
original text. Both work word by word where the model allows it (no key of the map holds a space, and no piece holds one
after other characters), and a word's ids and spans, relative to its first byte, are kept in a cache; else the text is one
word. Everything is this module's own; the library's part is to decode, and to be compared with in the tests.

Defined results: a null or empty text has no pieces, only the begin and end ids; texts of any length are encoded whole;
repeated rows and null doc_ids give one row each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepared, record, table, texts
from .hashtable import HashTable

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = float("-inf")
#: Chunks that a worker remembers.
KNOWN = 300_000
#: Segments of a normalised text; and the chunks of a text that begin at its spaces, or at its spaces and line ends.
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CHUNKS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")
_LINE_CHUNKS = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|\n|[^ {SPACE}\n]+")


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message; length-delimited values as bytes."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            value, at = raw[at : at + 4], at + 4
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.targets = blob[4 + size :]

    def has_space(self) -> bool:
        """Whether a key holds a space or its escape (followed from the root)."""
        if not self.units:
            return False
        units, spaces = self.units, (b" ", SPACE.encode())
        todo = [((units[0] >> 10) << ((units[0] & 512) >> 6), b"")]
        met = set()
        while todo:
            node, key = todo.pop()
            if node in met:
                continue
            met.add(node)
            for c in range(1, 256):
                child = node ^ c
                if child < len(units) and units[child] & 0x800000FF == c:
                    longer = key + bytes([c])
                    if any(x in longer for x in spaces):
                        return True
                    todo.append((child ^ ((units[child] >> 10) << ((units[child] & 512) >> 6)), longer))
        return False

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest key that raw has at this place, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.targets[start : self.targets.index(b"\0", start)].decode()
        return found


class PieceModel:
    def __init__(self, raw: bytes):
        self.raw = raw
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids = [0] * 256
        self.unknown = 0
        self.bos, self.eos = 1, 2
        kinds, names = [], []
        self.dummy = self.collapse = self.escape = True
        blob, model_type, fallback = b"", 1, False
        for field, value in _fields(raw):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                names.append(piece)
                kinds.append(kind)
                self.scores.append(score)
            elif field == 2:
                spec = dict(_fields(value))
                model_type, fallback = spec.get(3, 1), bool(spec.get(35, 0))
                self.bos, self.eos = spec.get(41, 1), spec.get(42, 2)
            elif field == 3:
                spec = dict(_fields(value))
                blob = spec.get(2, b"")
                self.dummy, self.collapse, self.escape = (bool(spec.get(f, 1)) for f in (3, 4, 5))
        if model_type != 2 or USER in kinds or UNUSED in kinds or not self.escape:
            raise ValueError("only BPE models with escaped spaces and without user-defined or unused pieces")
        for i, (piece, kind) in enumerate(zip(names, kinds, strict=True)):
            if kind == NORMAL:
                self.ids[piece] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind == BYTE and fallback:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.fallback, self.map = fallback, CharMap(blob)
        #: Cuts that no match and no merge can cross, read off the map and the vocabulary.
        self.cut_words = not self.collapse and not any(SPACE in p.lstrip(SPACE) for p in self.ids) and not self.map.has_space()
        self.cut_lines = self.cut_words and not self.map.units and not any("\n" in p and len(p) > 1 for p in self.ids)
        self._forget()
        # Characters and what two neighbours make, by number: a piece's id, or one from n_ids on for a character that is none.
        self.n_ids = len(names)
        singles = {c: self.n_ids + k for k, c in enumerate(sorted({c for p in self.ids for c in p} - self.ids.keys()))}
        self.char_ids = np.full(0x110000, self.n_ids + len(singles), np.int64)
        for c, i in (*((p, i) for p, i in self.ids.items() if len(p) == 1), *singles.items()):
            self.char_ids[ord(c)] = i
        made = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = (self.ids.get(x, singles.get(x)) for x in (p[:k], p[k:]))
                if left is not None and right is not None:
                    made[left << 32 | right] = i
        self.pairs = HashTable(np.array(list(made), np.int64))
        self.made = np.array([*made.values()], np.int64)
        self.worth = np.array([self.scores[i] for i in made.values()], float)

    # --- normalisation with alignment

    def mapped(self, text: str) -> tuple[str, list[int], list[int]]:
        """The text after the longest-prefix replacements, and for each of its characters the span of source bytes that it
        stands for. Spaces are escaped, all of them kept."""
        raw = text.encode()
        chars: list[str] = []
        start: list[int] = []
        end: list[int] = []
        at = 0
        while at < len(raw):
            if hit := self.map.longest(raw, at):
                n, to = hit
            else:
                lead = raw[at]
                n = 1 if lead < 128 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                to = raw[at : at + n].decode()
            for c in to:
                chars.append(SPACE if c == " " else c)
                start.append(at)
                end.append(at + n)
            at += n
        return "".join(chars), start, end

    def normalised(self, text: str) -> tuple[str, list[int], list[int]]:
        """mapped() with spaces collapsed and the dummy added, where the model has that."""
        normal, start, end = self.mapped(text)
        chars = list(normal)
        if self.collapse:
            keep, last = [], SPACE
            for i, c in enumerate(chars):
                if c != SPACE or last != SPACE:
                    keep.append(i)
                last = c
            while keep and chars[keep[-1]] == SPACE:
                keep.pop()
            chars, start, end = [chars[i] for i in keep], [start[i] for i in keep], [end[i] for i in keep]
        if chars and self.dummy:
            chars.insert(0, SPACE)
            start.insert(0, start[0])
            end.insert(0, start[0])
        return "".join(chars), start, end

    # --- segmentation

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of neighbours makes (-1: nothing) and its score."""
        at = self.pairs.find((left.ravel() << 32 | right.ravel()).astype(np.int64)).astype(np.int64)
        at[(left.ravel() < 0) | (right.ravel() < 0)] = -1
        made = np.where(at >= 0, self.made[at], -1)
        return made.reshape(left.shape), np.where(at >= 0, self.worth[at], NEVER).reshape(left.shape)

    def _merged_all(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """BPE of many segments at once: in each round every segment joins the neighbours that form its best piece, the
        leftmost first, until none has any. chars: their characters one after the other. Returns pieces and their numbers of
        characters in rows padded with -1 and 0, and the numbers of pieces."""
        n, width = len(sizes), int(sizes.max())
        col = np.arange(width)
        inside = col < sizes[:, None]
        parts, lengths = np.full((n, width), -1, np.int64), inside.astype(np.int64)
        parts[inside] = self.char_ids[chars]
        if width == 1:
            return parts, lengths, sizes.copy()
        made, score = self._pairs(parts[:, :-1], parts[:, 1:])
        live = np.arange(n)
        while len(live):
            k = score[live].argmax(1)
            more = score[live, k] > NEVER
            live, k = live[more], k[more]
            at = np.arange(len(live))
            p, w, m, s = parts[live], lengths[live], made[live], score[live]
            p[at, k] = m[at, k]
            w[at, k] += w[at, k + 1]
            on = np.minimum(col + (col > k[:, None]), width - 1)
            p, w = np.take_along_axis(p, on, 1), np.take_along_axis(w, on, 1)
            p[:, -1], w[:, -1] = -1, 0
            on = np.minimum(col[:-1] + (col[:-1] >= k[:, None]), width - 2)
            m, s = np.take_along_axis(m, on, 1), np.take_along_axis(s, on, 1)
            m[:, -1], s[:, -1] = -1, NEVER
            for j in (k - 1, k):  # the pairs of the new piece
                fits = np.flatnonzero((j >= 0) & (j < width - 1))
                m[fits, j[fits]], s[fits, j[fits]] = self._pairs(p[fits, j[fits]], p[fits, j[fits] + 1])
            parts[live], lengths[live], made[live], score[live] = p, w, m, s
        return parts, lengths, (lengths > 0).sum(1)

    def merged(self, segment: str) -> list[str]:
        """BPE of one segment, by a heap of pairs."""
        parts: list[str | None] = list(segment)
        n = len(parts)
        ids, scores = self.ids, self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            joined = parts[left] + parts[right]  # type: ignore[operator]
            if (i := ids.get(joined)) is not None:
                heapq.heappush(heap, (-scores[i], left, right, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if parts[left] is None or right >= n or parts[right] is None or after[left] != right:
                continue
            if len(parts[left]) + len(parts[right]) != len(joined):  # type: ignore[arg-type]
                continue
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p is not None]

    def _segments(self, text: str) -> list[str]:
        return _SEGMENTS.findall(text) if self.cut_words else [text] * bool(text)

    def _aligned(self, normal: str, start: list[int], end: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Ids of a normalised text, each with the source span of its piece."""
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for segment in self._segments(normal):
            for p in self.merged(segment):
                to = at + len(p)
                if (i := self.ids.get(p)) is not None:
                    ids.append(i)
                    starts.append(start[at])
                    ends.append(end[to - 1])
                else:
                    own = [self.byte_ids[b] for b in p.encode()] if self.fallback else [self.unknown]
                    ids += own
                    starts += [start[at]] * len(own)
                    ends += [end[to - 1]] * len(own)
                at = to
        return ids, starts, ends

    def _learn(self, chunks: list) -> None:
        """Ids and spans of chunks that aren't known. A tuple holds the first chunk of a text, which has the dummy in front:
        a space that no byte of the source stands for."""
        plain = [c[0] if type(c) is tuple else c for c in chunks]
        first = np.array([type(c) is tuple and self.dummy for c in chunks])
        if self.map.units:
            mapped = [self.mapped(c) for c in plain]
            normal = [SPACE * f + x for f, (x, _, _) in zip(first.tolist(), mapped, strict=True)]
            start = np.array([x for f, (_, y, _) in zip(first.tolist(), mapped, strict=True) for x in ([0] * f + y)], np.int64)
            end = np.array([x for f, (_, _, y) in zip(first.tolist(), mapped, strict=True) for x in ([0] * f + y)], np.int64)
            sizes = np.array([len(x) for x in normal])
            chars = np.frombuffer("".join(normal).encode("utf-32-le"), "<u4")
        else:  # no prefix has a replacement: each character stands for itself
            sizes = np.array([len(c) for c in plain]) + first
            chars = np.frombuffer("".join([SPACE * f + c for f, c in zip(first.tolist(), plain, strict=True)]).encode("utf-32-le"), "<u4").copy()
            wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            heads = np.cumsum(sizes) - sizes
            wide[heads[first]] = 0
            total = np.cumsum(wide)
            end = total - np.repeat(total[heads] - wide[heads], sizes)
            start = end - wide
            chars[chars == 32] = ord(SPACE)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        bytes_ = np.array([len(c.encode()) for c in plain])
        # One segment each that is short and made of known pieces; others take the plain way, one by one.
        odd = (sizes > 24) | (sizes == 0)
        if self.map.units:
            odd |= np.array([len(self._segments(x)) != 1 for x in normal])
        todo = np.flatnonzero(~odd)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(todo):
            mine = np.repeat(~odd, sizes)
            parts, lengths, n = self._merged_all(chars[mine], sizes[todo])
            inside = np.arange(parts.shape[1]) < n[:, None]
            ids, to = parts[inside], np.cumsum(lengths[inside])
            starts, ends = start[mine][to - lengths[inside]], end[mine][to - 1]
            cut = np.cumsum(n)
            odd[todo[np.add.reduceat(ids >= self.n_ids, cut - n) > 0]] = True
            fine = ~odd[todo]
            keep = np.repeat(fine, n)
            self._keep([chunks[i] for i in todo[fine]], n[fine], bytes_[todo[fine]], ids[keep], starts[keep], ends[keep])
        for i in np.flatnonzero(odd).tolist():
            a, b = offsets[i], offsets[i + 1]
            text = chars[a:b].tobytes().decode("utf-32-le")
            found.append(tuple(np.array(x, np.int64) for x in self._aligned(text, start[a:b].tolist(), end[a:b].tolist())))
        if found:
            self._keep([chunks[i] for i in np.flatnonzero(odd)], np.array([len(x) for x, _, _ in found]), bytes_[odd], *(np.concatenate(c) for c in zip(*found, strict=True)))

    def _keep(self, chunks: list, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        base = self.held["ids"].n
        self.held["from"].extend(base + np.cumsum(n) - n)
        self.held["n"].extend(n)
        self.held["size"].extend(sizes)
        for name, values in (("ids", ids), ("starts", starts), ("ends", ends)):
            self.held[name].extend(values)

    def _forget(self) -> None:
        self.known: dict = {}
        self.held = {name: Column() for name in ("from", "n", "size", "ids", "starts", "ends")}

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids without begin and end, and for each id the start and end of its span in the UTF-8 bytes."""
        if not self.cut_words:
            whole = [self._aligned(*self.normalised(t)) for t in texts]
            return [(np.array(i, "<u4"), np.array(a, np.int64), np.array(b, np.int64)) for i, a, b in whole]
        if len(self.known) > KNOWN or self.held["ids"].n > 16 * KNOWN:
            self._forget()
        cut = (_LINE_CHUNKS if self.cut_lines else _CHUNKS).findall
        chunks: list = []
        sizes = []
        for text in texts:
            own = cut(text)
            if own:
                own[0] = (own[0],)
            chunks += own
            sizes.append(len(own))
        if new := list(set(chunks).difference(self.known)):
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        n, size = self.held["n"].take(at), self.held["size"].take(at)
        total, reach = np.cumsum(np.append(0, n)), np.cumsum(np.append(0, size))
        bounds = np.cumsum([0, *sizes])  # of the texts, in chunks
        row = np.arange(total[-1]) + np.repeat(self.held["from"].take(at) - total[:-1], n)
        offset = np.repeat(reach[:-1] - np.repeat(reach[bounds[:-1]], sizes), n)
        ids, starts, ends = self.held["ids"].take(row).astype("<u4"), self.held["starts"].take(row) + offset, self.held["ends"].take(row) + offset
        cuts = total[bounds].tolist()
        return [(ids[a:b], starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]


class Column:
    """A growing array of integers."""

    def __init__(self):
        self.values, self.n = np.empty(1024, np.int64), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            grown = np.empty(2 * (self.n + len(more)), np.int64)
            grown[: self.n] = self.values[: self.n]
            self.values = grown
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.values.take(at)


@lru_cache(maxsize=2)
def load(path: str):
    """The model and the library's processor, once a worker. The path is the same on each machine (an installed package)."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    return PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


SPANS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


@prepared
def encode_spans(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (without begin and end), starts and ends (spans in the text's UTF-8 bytes) of each document."""

    def run(batches):
        model, _ = load(model_path)
        for batch in batches:
            found = model.encode_all(texts(batch))
            yield record(SPANS, doc_id=batch.column("doc_id"), ids=[x[0].tolist() for x in found], starts=[x[1].tolist() for x in found], ends=[x[2].tolist() for x in found])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>, starts array<long>, ends array<long>")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("spans_sha256", pa.string())])


@prepared
def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Digests of each document's ids (with begin and end), of its decoded text and of its spans."""

    def run(batches):
        model, library = load(model_path)
        head, tail = (np.array([x], "<u4").tobytes() for x in (model.bos, model.eos))
        for batch in batches:
            n, shas, decoded, sizes, spans = [], [], [], [], []
            for ids, starts, ends in model.encode_all(texts(batch)):
                n.append(len(ids) + 2)
                shas.append(hashlib.sha256(head + ids.tobytes() + tail).hexdigest())
                decoded.append(hashlib.sha256(library.decode([model.bos, *ids.tolist(), model.eos]).encode()).hexdigest())
                sizes.append(int(ends[-1]) if len(ends) else 0)
                spans.append(hashlib.sha256(starts.tobytes() + ends.tobytes()).hexdigest())
            yield record(DIGEST, doc_id=batch.column("doc_id"), n_tokens=n, ids_sha256=shas, decoded_sha256=decoded, n_bytes=sizes, spans_sha256=spans)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public 32k piece model; n_bytes is where its last span ends."""
    import public_tokenizers

    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
