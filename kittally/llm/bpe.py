"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

A merge list is proper if every part of a rule is a byte or made by an earlier rule. Merging then equals
applying the rules one after the other, each from left to right. Two inputs that differ only after byte p
can differ further left only through a chain of rules, in rising order, in which each rule joins the last
token they share to a token that begins where they part: the next rule's right side begins with this
rule's left side. The longest such chain, counted in bytes of the left sides, is the lookahead. A token
that ends at least that far before the end of what has been read is final, and merging can go on from its
end as from a fresh start. So one window of fixed length is enough for a piece of any length.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kittally.llm.common import id_text, values

#: Fixed value: the split pattern of byte-level BPE files with use_regex.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SLICE, WINDOW, SHORT, REMEMBERED, FLUSH = 1 << 16, 1 << 12, 64, 1 << 19, 8 << 20
NO_RULE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file: itself, or 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes of right context that settle a token under these rules; ValueError if they are not proper."""
    made: set[bytes] = set()
    chain: dict[bytes, int] = {}
    for left, right in rules:
        if any(len(x) > 1 and x not in made for x in (left, right)):
            raise ValueError(f"rule {left!r} {right!r} comes before a part of it is made")
        made.add(left + right)
        before = max(chain.get(right[:k], 0) for k in range(1, len(right) + 1))
        chain[left] = max(chain.get(left, 0), len(left) + before)
    return max(chain.values(), default=0)


class Vocabulary:
    """Merge ranks, ids and bytes of one tokenizer file; small and of fixed size, so it is broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"]:
            raise ValueError("not a byte-level BPE file without a normalizer")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        rules = [tuple(map(raw, r.split(" ") if isinstance(r, str) else r)) for r in model["merges"]]
        self.ranks = {(ids[a], ids[b]): (k, ids[a + b]) for k, (a, b) in reversed([*enumerate(rules)])}
        self.codes = {pair: (rank << 32) + whole for pair, (rank, whole) in self.ranks.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.lookahead = lookahead(rules)
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take blanks or whole words are not read")
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}


class Encoder:
    """Text to ids, slice by slice; keeps no more than a slice, a window and a bounded memory of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PIECES)
        self.marks = re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one stretch: the pair of lowest rank first, the leftmost of equals."""
        ranks = self.vocabulary.ranks
        ids: list[int | None] = [self.vocabulary.single[b] for b in data]
        after, before = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        heap = [(*ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, whole, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = whole, None, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in ranks:
                    heapq.heappush(heap, (*ranks[p], k, p))
        return [i for i in ids if i is not None]

    def merge_short(self, data: bytes) -> list[int]:
        """The same for a few bytes: looks for the lowest rank again after each merge."""
        get, ids = self.vocabulary.codes.get, [*map(self.vocabulary.single.__getitem__, data)]
        codes = [get(p, NO_RULE) for p in zip(ids, ids[1:])]
        while codes and (code := min(codes)) != NO_RULE:
            i = codes.index(code)
            ids[i : i + 2] = [code & 0xFFFFFFFF]
            del codes[i]
            if i:
                codes[i - 1] = get((ids[i - 1], ids[i]), NO_RULE)
            if i < len(codes):
                codes[i] = get((ids[i], ids[i + 1]), NO_RULE)
        return ids

    def stream(self, parts: Iterator[bytes]) -> Iterator[bytes]:
        """The transducer: bytes of one piece in, packed ids out as soon as they are settled."""
        held, sizes = b"", self.vocabulary.bytes_of
        for part in parts:
            held += part
            while len(held) >= WINDOW + self.vocabulary.lookahead:
                view = held[: WINDOW + self.vocabulary.lookahead]
                final, end = [], 0
                for i in self.merge(view):
                    if end + len(sizes[i]) > WINDOW:
                        break
                    final.append(i)
                    end += len(sizes[i])
                yield np.array(final, "<u4").tobytes()
                held = held[end:]
        yield np.array(self.merge(held), "<u4").tobytes()

    def short(self, piece: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        packed = self.known[piece] = array("I", self.merge_short(piece.encode())).tobytes()
        return packed

    def plain(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        """Packed ids of text[start:stop], which holds no added token."""
        while start < stop:
            end = min(start + SLICE, stop)
            pieces = self.pattern.findall(text, start, end)
            if end < stop:  # the last piece may go on behind the slice
                last = pieces.pop()
                if pieces and pieces[-1] == "'":  # a begun 're, 've or 'll
                    last = pieces.pop() + last
                if not pieces:
                    end = self.pattern.match(text, start, stop).end()
                    yield from self.stream(text[i : min(i + WINDOW, end)].encode() for i in range(start, end, WINDOW))
                    start = end
                    continue
                end -= len(last)
            packed = [*map(self.known.get, pieces)]
            if None in packed:
                for i, p in enumerate(packed):
                    if p is None:
                        piece = pieces[i]
                        packed[i] = self.short(piece) if len(piece) <= SHORT else b"".join(self.stream(iter([piece.encode()])))
            yield b"".join(packed)
            start = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids (little-endian, 32 bits) of a whole text, in parts."""
        start = 0
        for mark in self.marks.finditer(text):
            yield from self.plain(text, start, mark.start())
            yield np.array([self.vocabulary.added[mark[0]]], "<u4").tobytes()
            start = mark.end()
        yield from self.plain(text, start, len(text))


class Decoder:
    """Ids to text: the state is the begun character, at most three bytes; ill-formed bytes give U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids.tolist())), last)


def decoded(vocabulary: Vocabulary, packed: bytes | None) -> str:
    decoder, ids = Decoder(vocabulary), np.frombuffer(packed or b"", "<u4")
    return "".join(decoder.feed(ids[i : i + SLICE]) for i in range(0, len(ids), SLICE)) + decoder.feed(ids[:0], True)


def _batches(rows: Iterator[tuple[int, str | bytes]], name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, value) as batches of a few MB."""
    ids, found, size = [], [], 0
    for key, value in rows:
        ids.append(key)
        found.append(value)
        size += len(value)
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", name])
            ids, found, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", name])


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text as little-endian 32-bit integers in one binary.

    A null text counts as empty and gives no ids. ``tokenizer`` is the path of a byte-level BPE file that
    the driver can read. Added tokens found in a text become their own ids. One output row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        rows = ((k, b"".join(encoder.encode(t or ""))) for b in batches for k, t in values(b, "doc_id", "text"))
        return _batches(rows, "ids", pa.binary())

    return id_text(docs, key, text).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from the packed ids that ``encode`` gives; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((k, decoded(shared.value, p)) for b in batches for k, p in values(b, "doc_id", "ids")), "text", pa.string())

    return encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encoded and decoded again, one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in _batches(((k, b"".join(encoder.encode(t or ""))) for k, t in values(batch, "doc_id", "text")), "ids", pa.binary()):
                texts = [decoded(shared.value, packed) for (packed,) in values(part, "ids")]
                yield part.append_column("decoded", pa.array(texts, pa.string()))

    return id_text(docs, key, text).mapInArrow(run, "doc_id long, ids binary, decoded string")
