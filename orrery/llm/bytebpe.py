"""Byte-level BPE encoding and decoding by a monoid's tree reduction: halves are encoded by themselves and joined at their border.

Two joins make the tree, each with a proof of what stays as it is:

* Tokens within one match of the split pattern (`join`). Merging takes the pair of least rank, leftmost first. If all adjacent
  pairs (x, y) of a row of tokens encode to themselves, x + y to [x, y], then the row is the encoding of its bytes: a first merge
  across a border would also be made when x + y is encoded alone, as the merges inside x + y come in the same order there. So
  where the window around the border, encoded anew, begins with the old first token and ends with the old last one, every pair
  of the joined row is a pair of an encoding, and the tokens outside the window are right. Else the window grows to twice as many tokens.
* Matches of the pattern (`Codec.join_texts`). Where a match ends depends on the text from its start to at most LOOK
  characters past its end. So matches of the left half that end LOOK characters before the border stay. From there the text is
  matched anew in a growing window until a match ends where one of the right half starts; from there the right half's stay.

A match begins wherever white space follows another character, whatever comes before and after. So a text that is
one leaf is encoded run by run, each of white space and the characters up to the next one; short runs' tokens are remembered.

Decoding concatenates the bytes of halves.

Hard rows: a null or empty text has no tokens (n_tokens 0, digests of nothing), also if doc_id is null; equal rows give equal
rows, each of them; an empty table gives an empty one; other columns are not read, whatever their names. A very long text, or a
very long match in it (no spaces, one letter repeated), is halved down to leaves of 32,768 characters and 32 bytes; its task
holds it with its tokens, about 20 bytes a character.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, small_batches

#: Characters past a match's end that decide it: two for a quotation mark that may begin a contraction.
LOOK = 2
#: Characters of a text, and bytes of a match, that are not halved.
LEAF, LEAF_BYTES = 1 << 15, 32
#: Strings up to so many characters are remembered, so many of them, before the memory begins anew.
KEPT_CHARS, KEPT = 64, 1 << 19
#: What the split pattern takes for white space.
SPACE = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))


def ranks_of(path: str) -> dict[bytes, int]:
    """Token's bytes to its rank, which is its id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of data: the adjacent pair of least rank, leftmost first, becomes one token until no pair is a token."""
    n = len(data)
    if n <= LEAF_BYTES:
        return merge_few(data, ranks)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := data[i : i + 2]) in ranks]
    heapify(heap)
    while heap:
        _, i, whole = heappop(heap)
        if parts[i] is None or (j := after[i]) == n or parts[i] + parts[j] != whole:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = whole, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (p := whole + parts[k]) in ranks:
                heappush(heap, (ranks[p], i, p))
        if (h := before[i]) >= 0 and (p := parts[h] + whole) in ranks:
            heappush(heap, (ranks[p], h, p))
    return [p for p in parts if p is not None]


def merge_few(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same by looking at all pairs each time, which is quicker for few bytes. Parts are known by their bounds in data."""
    none, rank = len(ranks) + 256, ranks.get
    bounds = list(range(len(data) + 1))
    pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del pairs[i], bounds[i + 1]
        if i < len(pairs):
            pairs[i] = rank(data[bounds[i] : bounds[i + 2]], none)
        if i:
            pairs[i - 1] = rank(data[bounds[i - 1] : bounds[i + 1]], none)
    return [data[i:j] for i, j in zip(bounds, bounds[1:])]


def join(left: list[bytes], right: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of the bytes of left and right together, each the encoding of its own bytes."""
    i = j = 1
    while left and right:
        i, j = min(i, len(left)), min(j, len(right))
        new = merge(b"".join(left[-i:] + right[:j]), ranks)
        left_stays, right_stays = i == len(left) or new[0] == left[-i], j == len(right) or new[-1] == right[j - 1]
        if left_stays and right_stays:
            return left[:-i] + new + right[j:]
        i, j = i if left_stays else 2 * i, j if right_stays else 2 * j
    return left or right


def encode_match(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of one match's bytes, without the short way for those that are a token themselves."""
    if len(data) <= LEAF_BYTES:
        return merge(data, ranks)
    half = LEAF_BYTES
    while half * 2 < len(data):
        half *= 2
    return join(encode_match(data[:half], ranks), encode_match(data[half:], ranks), ranks)


class Part(NamedTuple):
    """A stretch of a text: its characters, where its matches end (from its start), each match's tokens, all ids."""

    size: int
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


class Kept(dict):
    """A string's ids, four bytes each, of all its matches."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, text: str) -> bytes:
        matches = self.codec.match(text)
        found = self.codec.code(text) if len(matches) == 1 else b"".join(map(self.__getitem__, matches))
        if len(text) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[text] = found
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.match = regex.compile(pattern).findall
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.four = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.kept = Kept(self)

    def code(self, match: str) -> bytes:
        """Ids of one match, four bytes each."""
        data = match.encode()
        return self.four[data] if data in self.four else b"".join(map(self.four.__getitem__, encode_match(data, self.ranks)))

    def leaf(self, text: str) -> Part:
        codes = list(map(self.kept.__getitem__, matches := self.match(text)))
        lengths = lambda x: np.fromiter(map(len, x), np.int64, len(x))
        return Part(len(text), np.cumsum(lengths(matches)), lengths(codes) // 4, np.frombuffer(b"".join(codes), "<i4"))

    def part(self, text: str, start: int, stop: int) -> Part:
        if stop - start <= LEAF:
            return self.leaf(text[start:stop])
        middle = start + (stop - start) // 2
        return self.join_texts(text, start, self.part(text, start, middle), self.part(text, middle, stop))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if len(text) <= LEAF:
            return np.frombuffer(b"".join(map(self.kept.__getitem__, self.runs(text))), "<i4")
        return self.part(text, 0, len(text)).ids

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])

    def join_texts(self, text: str, start: int, a: Part, b: Part) -> Part:
        """The part of text from start that a and b make up."""
        stay = int(np.searchsorted(a.ends, a.size - LOOK, side="right"))  # matches of a that no text after it changes
        begin = int(a.ends[stay - 1]) if stay else 0
        border, take = a.size - begin, 1  # the border within the window; matches of b in it
        while True:
            take = min(take, len(b.ends))
            stop = int(b.ends[take - 1])
            window = text[start + begin : start + a.size + stop]
            matches = self.match(window)
            ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
            last = take == len(b.ends)
            meet = np.isin(ends - border, np.append(0, b.ends[:take])) & ((ends <= len(window) - LOOK) | last)
            if meet.any():
                break
            take *= 2
        new = int(np.argmax(meet)) + 1
        goes = int(np.searchsorted(b.ends, ends[new - 1] - border, side="right"))  # matches of b that the new ones replace
        codes, at = [], 0
        for m, end in zip(matches[:new], ends[:new].tolist(), strict=True):
            codes.append(self.kept[m] if len(m) <= LEAF_BYTES else self.across(m, at, end, border, a, stay, b, begin))
            at = end
        counts = np.array([len(c) // 4 for c in codes], np.int64)
        ids = np.concatenate([a.ids[: a.counts[:stay].sum()], np.frombuffer(b"".join(codes), "<i4"), b.ids[b.counts[:goes].sum() :]])
        return Part(a.size + b.size, np.concatenate([a.ends[:stay], begin + ends[:new], a.size + b.ends[goes:]]), np.concatenate([a.counts[:stay], counts, b.counts[goes:]]), ids)

    def across(self, match: str, at: int, end: int, border: int, a: Part, stay: int, b: Part, begin: int) -> bytes:
        """Ids of a long match in the window from `at` to `end`: the tokens of the matches that it is made of, joined; where
        it isn't made of whole ones, encoded from its bytes."""
        data = match.encode()
        own, theirs = np.append(begin, a.ends[stay:]) - begin, np.append(0, b.ends) + border
        if data in self.ranks or not (at < border < end and at in own and end in theirs):
            return self.code(match)
        found: list[bytes] = []
        for part, first, stop in ((a, stay + int(np.searchsorted(own, at)), len(a.ends)), (b, 0, int(np.searchsorted(theirs, end)))):
            where = np.concatenate([[0], np.cumsum(part.counts)])
            for k in range(first, stop):
                tokens = [self.tokens[i] for i in part.ids[where[k] : where[k + 1]].tolist()]
                # A match that is a token itself was not merged.
                found = join(found, merge(tokens[0], self.ranks) if len(tokens) == 1 else tokens, self.ranks)
        return np.array([self.ranks[t] for t in found], "<i4").tobytes()


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """One codec a worker process, so that its next task finds the strings that are remembered."""
    return Codec(ranks_of(path), pattern)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256 (bytes of the decoded ids)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for piece in pieces(batch, 1):
                rows: list[list] = [[], [], []]
                for text in piece.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    said = " ".join(map(codec.decimal.__getitem__, ids.tolist()))
                    for to, x in zip(rows, (len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()), strict=True):
                        to.append(x)
                yield pa.record_batch([piece.column(0).cast(pa.int64()), pa.array(rows[0], pa.int64()), *(pa.array(x, pa.string()) for x in rows[1:])], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, ids (array of int)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for batch in batches:
            for piece in pieces(batch, 1):
                ids = [codec.encode(text or "") for text in piece.column(1).to_pylist()]
                yield pa.record_batch([piece.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
