"""Alignment of two tokenizers' tokens over the same texts.

Every byte of a text (with a space before it) gets a label: none, an A token's last byte, a B token's, or both. A regular
expression scans the labels for spans up to each "both"; the labels in a span tell how many tokens of A and of B the group has.
The last tokens of a group are linked: they end together.

Both tokenizers end a token wherever white space follows another character and where a run of spaces begins, whatever stands
around: A splits there, and no piece of B holds its space mark after another character (checked when the vocabulary is read; such
a merge can't be made, so the sides are encoded apart). So labels, groups and links of a run (white space and the characters up to
the next) do not depend on the text, and those of short runs are remembered. Runs that begin with other white space than a
space stay with the run before them for B's sake.

Links counted over the corpus: linked tokens end together, so one's bytes end the other's. The pairs of ids that can be linked
are thus at most the sum of the lengths of all tokens of both vocabularies (under 700,000 for the two of the query), whatever the
corpus. That bounds the table of pair counts, which is broadcast.

Hard rows: null and empty texts and those that a tokenizer doesn't give back byte by byte have zeros and an empty digest; equal
rows give equal rows, each of them, and count each time; a null doc_id stays; an empty table gives an empty one; other columns are
not read. A text's task holds it with its tokens; a long run without white space is tokenized whole by the two libraries.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytebpe import SPACE
from .common import Scratch, pieces, small_batches

#: Runs up to so many characters are remembered, about so many of them; then those stay that the texts at hand have.
KEPT_CHARS, KEPT = 64, 1 << 19
#: A byte's label, and a span up to a byte where both end.
NONE, A_END, B_END, BOTH = b".abx"
SPAN = re.compile(rb"[^x]*x")
OTHER = SPACE.replace(" ", "")
#: White space that begins with a space, the characters up to the next such, and other white space between them.
RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{OTHER}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the
    other bytes in order for the characters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers: A of byte-level BPE (a tokenizers file), B of pieces with byte fallback (a sentencepiece model)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = byte_of_char()
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = {i: bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t, i in vocabulary}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if any("▁" in x.lstrip("▁") for i, x in enumerate(names) if not (self.b.is_control(i) or self.b.is_unknown(i))):
            raise ValueError("a piece of the vocabulary goes on after a space")
        self.kept: dict[str, tuple] = {}

    def aligned(self, runs: list[str]) -> list[tuple]:
        """Of runs that begin with a space: whether both give a run's bytes back, numbers of A's and B's tokens, text of the
        groups, links (two ids each, four bytes an id)."""
        of_a = self.a.encode_batch(runs, add_special_tokens=False)
        of_b = self.b.encode([run[1:] for run in runs], num_threads=1)  # B puts a space before each, but not before nothing
        space = [self.b.piece_to_id("▁")]
        return [self.grouped(run.encode(), a.ids, b if run != " " else space) for run, a, b in zip(runs, of_a, of_b, strict=True)]

    def grouped(self, data: bytes, a: list[int], b: list[int]) -> tuple:
        labels = bytearray([NONE]) * len(data)
        for ids, table, label in ((a, self.a_bytes, A_END), (b, self.b_bytes, B_END)):
            tokens = [table[i] for i in ids]
            if b"".join(tokens) != data:
                return False, 0, 0, "", b""
            for end in accumulate(map(len, tokens)):
                labels[end - 1] = label if labels[end - 1] == NONE else BOTH
        groups, links, i, j = [], [], 0, 0
        for span in SPAN.findall(labels):
            to, upto = i + span.count(A_END) + 1, j + span.count(B_END) + 1
            groups.append(f"{','.join(map(str, a[i:to]))}|{','.join(map(str, b[j:upto]))}")
            links += (a[to - 1], b[upto - 1])
            i, j = to, upto
        return True, len(a), len(b), ";".join(groups), array("i", links).tobytes()

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """Of each text: numbers of A's and B's tokens, text of the groups, links (a row of two ids each)."""
        each = [RUN.findall(" " + text) if text else [] for text in texts]
        asked = dict.fromkeys(chain.from_iterable(each))
        new = [run for run in asked if run not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept = {run: found for run, found in self.kept.items() if run in asked}
        self.kept.update(zip(new, self.aligned(new), strict=True))
        for runs in each:
            found = list(map(self.kept.__getitem__, runs))
            if not found or not all([x[0] for x in found]):
                yield 0, 0, "", np.zeros((0, 2), np.int32)
            else:
                links = np.frombuffer(b"".join([x[4] for x in found]), np.int32).reshape(-1, 2)
                yield sum([x[1] for x in found]), sum([x[2] for x in found]), ";".join([x[3] for x in found]), links
        for run in new:
            if len(run) > KEPT_CHARS:
                del self.kept[run]


@lru_cache(maxsize=1)
def pair_of(a_path: str, b_path: str) -> Pair:
    """One pair a worker process, so that its next task finds the vocabularies and the runs that are remembered."""
    return Pair(a_path, b_path)


def tokenized(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a, b, and how often the row links them)."""
    small_batches(docs.sparkSession)
    pair = "struct<a:int,b:int,n:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = pair_of(a_path, b_path)
        for batch in batches:
            for piece in pieces(batch, 1):
                n_a, n_b, n, digest, rows, links = [], [], [], [], [], []
                for k, (a, b, groups, found) in enumerate(both.texts([x or "" for x in piece.column(1).to_pylist()])):
                    n_a.append(a), n_b.append(b), n.append(len(found)), links.append(found), rows.append(np.full(len(found), k))
                    digest.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                at, ids = np.concatenate(rows), np.concatenate(links)
                # a row's equal links together: row, a, b in one number (20 and 17 bits for ids)
                keys, times = np.unique(at.astype(np.int64) << 37 | ids[:, 0].astype(np.int64) << 20 | ids[:, 1], return_counts=True)
                columns = [pa.array(x.astype(np.int32)) for x in (keys >> 20 & (1 << 17) - 1, keys & (1 << 20) - 1, times)]
                bounds = np.searchsorted(keys >> 37, np.arange(len(n) + 1)).astype(np.int32)
                pairs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, ["a", "b", "n"]))
                longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)]
                yield pa.record_batch([piece.column(0).cast(pa.int64()), *longs, pa.array(digest, pa.string()), pairs], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair}>")


def links(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): how often the whole corpus links the two ids, and whether no other a is linked to b more often."""
    each = rows.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are read and tokenized once; the counted pairs of each row are stored in the shared folder and read twice, for the
    counts of the corpus and for what the rows get of them."""
    scratch = Scratch(docs.sparkSession, "align")
    rows = scratch.table(tokenized(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "rows")
    each = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.n")
    counted = each.join(F.broadcast(links(rows)), ["a", "b"])  # bounded by the vocabularies
    sums = counted.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
