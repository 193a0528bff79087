"""SentencePiece-style encoding: the best segmentation into pieces with log scores, and decoding.

A double-array trie holds the pieces; the path with the greatest sum of scores is
found by Viterbi. Characters without a piece become byte pieces. White space is
written as a marker before each word.

No piece of the vocabularies used here has the marker after another character, so
no path spans the start of a word, and the best path of a text is that of its words
one after the other. Each distinct word of a stretch of documents is therefore
solved once; all of them go through trie and Viterbi together, as numpy vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import column_of

#: What stands for a space in pieces (fixed value).
MARK = "▁"
#: Below the least score, for characters without a piece (fixed value).
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
STEP = 200


class DoubleArray:
    """A trie in two arrays: from node s, byte c leads to `base[s] + c` if `check` there is s. `value` is a key's number or -1."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for number, key in enumerate(keys):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][c]
            values[node] = number
        base, check, value = [0], [-2], [values[0]]
        used = bytearray(b"\1")
        low, queue = 1, [(0, 0)]
        for node, state in queue:
            codes = sorted(children[node])
            if not codes:
                base[state] = -1
                continue
            at, tried = low, 0  # place of the first child
            while True:
                at = used.find(0, max(at, codes[0] + 1))
                if at < 0 or at + 256 > len(used):
                    grown = len(used)
                    for x, f in ((base, 0), (check, -1), (value, -1)):
                        x.extend([f] * grown)
                    used.extend(bytes(grown))
                    at = max(0, at)
                    continue
                if not any(used[at + c - codes[0]] for c in codes):
                    break
                at, tried = at + 1, tried + 1
            if tried > 50:  # hardly a gap is left below
                low = at
            first = at - codes[0]
            base[state] = first
            for c in codes:
                child = children[node][c]
                used[first + c], check[first + c], value[first + c] = 1, state, values[child]
                queue.append((child, first + c))
        size = len(base)
        # Nodes without children lead to the padding, which no node checks.
        self.base = np.array([size if x < 0 else x for x in base], np.int64)
        self.check = np.array(check + [-1] * 256, np.int64)
        self.value = np.array(value + [-1] * 256, np.int64)

    def matches(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys found at each start and ending by its stop: starts, ends and key numbers."""
        found = []
        at, node, origin = starts.copy(), np.zeros(len(starts), np.int64), starts
        while len(at):
            inside = at < stops
            at, node, origin, stops = at[inside], node[inside], origin[inside], stops[inside]
            nxt = self.base[node] + data[at]
            on = self.check[nxt] == node
            at, node, origin, stops = at[on] + 1, nxt[on], origin[on], stops[on]
            number = self.value[node]
            hit = number >= 0
            found.append((origin[hit], at[hit], number[hit]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))


class Pieces:
    """A vocabulary: `texts` and `scores` by id, which ids stand for single bytes, and the id of unknown."""

    def __init__(self, texts: list[str], scores: list[float], bytes_: dict[int, int], ordinary: list[int], unknown: int):
        self.scores, self.unknown = np.array(scores, np.float32), unknown
        self.ordinary = np.array(ordinary, np.int64)
        self.trie = DoubleArray([texts[i].encode() for i in ordinary])
        self.least = np.float32(self.scores[self.ordinary].min() - UNKNOWN_PENALTY)
        self.byte_ids = np.full(256, unknown, np.int64)
        for id_, byte in bytes_.items():
            self.byte_ids[byte] = id_
        usual = set(ordinary)
        self.written = [bytes([bytes_[i]]) if i in bytes_ else texts[i].replace(MARK, " ").encode() if i in usual else b"" for i in range(len(texts))]
        self.by_word = not any(MARK in texts[i].lstrip(MARK) for i in ordinary)
        self.known = _Known()

    def solve(self, words: list[str]) -> list[bytes]:
        """The ids of the best path of each word, as little-endian 32-bit numbers."""
        if not words:
            return []
        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        stops = np.cumsum([len(c) for c in coded])
        begins = np.concatenate(([0], stops[:-1]))
        n = len(data)
        word = np.repeat(np.arange(len(words)), stops - begins)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        tails = np.append(heads[1:], n)
        start, end, number = self.trie.matches(data, heads, stops[word[heads]])
        id_ = self.ordinary[number]
        score = self.scores[id_]
        single = np.zeros(n + 1, bool)  # starts with a piece of one character
        width = np.zeros(n + 1, np.int64)
        width[heads] = tails - heads
        single[start[end - start == width[start]]] = True
        bare = ~single[heads]
        start, end = np.concatenate((start, heads[bare])), np.concatenate((end, tails[bare]))
        id_ = np.concatenate((id_, np.full(bare.sum(), -1)))
        score = np.concatenate((score, np.full(bare.sum(), self.least, np.float32)))
        # Steps from the n-th byte of all words at once: they end at different places. Places are shifted by one a word.
        begin_at, stop_at = begins + np.arange(len(words)), stops + np.arange(len(words))
        offset = start - begins[word[start]]
        start, end = start + word[start], end + word[end - 1]
        order = np.lexsort((end, offset))
        start, end, id_, score, offset = start[order], end[order], id_[order], score[order], offset[order]
        total = n + len(words)
        best, back, by = np.full(total, -np.inf, np.float32), np.zeros(total, np.int64), np.zeros(total, np.int64)
        best[begin_at] = 0
        cuts = np.flatnonzero(np.diff(offset)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(offset)), strict=True):
            s, e = start[a:b], end[a:b]
            reach = best[s] + score[a:b]
            up = reach > best[e]
            best[e[up]], back[e[up]], by[e[up]] = reach[up], s[up], id_[a:b][up]
        # Back from the ends, all words at once.
        at, which, steps = stop_at.copy(), np.arange(len(words)), []
        while len(at):
            on = at > begin_at[which]
            at, which = at[on], which[on]
            steps.append((which, back[at], at, by[at]))
            at = back[at]
        which, s, e, id_ = (np.concatenate(c) for c in zip(*steps, strict=True))
        order = np.argsort(e, kind="stable")
        which, s, e, id_ = which[order], s[order] - which[order], e[order] - which[order], id_[order]
        size = np.where(id_ < 0, e - s, 1)  # an unknown character gives a piece for each byte
        place = np.repeat(np.arange(len(id_)), size)
        within = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
        flat = np.where(id_[place] < 0, self.byte_ids[data[np.minimum(s[place] + within, n - 1)]], id_[place]).astype("<u4")
        ends = np.cumsum(np.bincount(which, weights=size, minlength=len(words))).astype(np.int64) * 4
        out = flat.tobytes()
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def segments(self, text: str) -> list[str]:
        """The text's words with their markers. Further spaces are markers of the word that follows."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return [marked]
        parts, out, marks = marked.split(MARK)[1:], [], MARK
        if "" not in parts:
            return [MARK + p for p in parts]
        for p in parts[:-1]:
            if p:
                out.append(marks + p)
                marks = MARK
            else:
                marks += MARK
        return [*out, marks + parts[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.segments(t) for t in texts]
        known = self.known
        new = list({w for ws in words for w in ws if w not in known})
        known.now = dict(zip(new, self.solve(new), strict=True))
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(known) >= CACHED_WORDS:
                break
            if len(w) <= 40:
                known[w] = known.now[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: markers become spaces, byte pieces join to characters (U+FFFD where they do not), one leading space goes."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Known(dict):
    now: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.now[word]


@lru_cache(4)
def load(path: str, by_rank: bool = True) -> Pieces:
    """A vocabulary file. With `by_rank`, scores that are merge ranks become log scores by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
    scores = np.array([model.get_score(i) for i in ids])
    if by_rank:
        scores = -np.log1p(-np.minimum(scores, 0)) - np.log(np.log(len(scores)))
    bytes_ = {i: int(model.id_to_piece(i)[1:-1], 16) for i in ids if model.is_byte(i)}
    return Pieces([model.id_to_piece(i) for i in ids], scores.tolist(), bytes_, [i for i in ids if i not in special], model.unk_id())


def encode_decode(docs: DataFrame, path: str, text: str = "text", by_rank: bool = True) -> DataFrame:
    """`docs` with `piece_ids`, `n_byte_pieces` and `decoded`; existing columns of these names are replaced.

    Null text counts as empty and has no pieces. A marker in the text itself reads
    back as a space. Whole texts are encoded, each by itself, so repeated rows give
    equal ids; a very long text costs in proportion to its length, and an empty table
    gives no row. `path` is a vocabulary file that every machine has.
    """
    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_byte_pieces", T.LongType()), T.StructField("decoded", T.StringType())]
    rows = docs.drop(*[f.name for f in added])
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, by_rank)
        is_byte = np.zeros(len(pieces.written), bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids = [np.frombuffer(x, "<u4") for x in pieces.encode([x or "" for x in column_of(part, text).to_pylist()])]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([pieces.decode(x) for x in ids], pa.string()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_crc32(rows: DataFrame) -> DataFrame:
    """`rows` with `ids_crc32` of `piece_ids` as little-endian 32-bit numbers."""
    schema = T.StructType([*rows.schema.fields, T.StructField("ids_crc32", T.LongType())])
    at = rows.columns.index("piece_ids")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=schema.names)

    return rows.mapInArrow(check, schema)
