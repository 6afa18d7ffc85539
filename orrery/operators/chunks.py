"""Chunkers: functions of Go, blocks of Python, definitions of JavaScript, runs of lines; parents of chunks.

A file is a row, and chunks of one file need only that file. The scan runs line by line, which no built-in operator can
express, so it is a mapInArrow over whole files; memory is one batch of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, chunk long, start long, end long, kind string, text string"
JS_START = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b|class\s+\w|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\()")

Piece = tuple[int, int, str]


def braces(lines: list[str], starts: re.Pattern) -> Iterator[Piece]:
    """(first, last, kind), lines from 0: from a starting line to where its braces are even again, or to the next start."""
    open_at, depth, opened = -1, 0, False
    for i, line in enumerate(lines):
        if starts.match(line) and (open_at < 0 or depth <= 1 and line[:1].strip()):
            if open_at >= 0:
                yield open_at, i - 1, "function"
            open_at, depth, opened = i, 0, False
        if open_at >= 0:
            depth += line.count("{") - line.count("}")
            opened = opened or "{" in line
            if opened and depth <= 0:
                yield open_at, i, "class" if re.search(r"\bclass\b", lines[open_at]) else "function"
                open_at = -1
    if open_at >= 0:
        yield open_at, len(lines) - 1, "function"


def indented(lines: list[str]) -> Iterator[Piece]:
    """Blocks of Python: a def or class to the line before the next one, or before a line that is indented no deeper."""
    open_at, indent = -1, 0
    kind = lambda i: "class" if lines[i].lstrip().startswith("class") else "function"
    for i, line in enumerate(lines):
        bare = line.strip()
        if re.match(r"(?:async\s+def|def|class)\s+\w+", bare):
            if open_at >= 0:
                yield open_at, i - 1, kind(open_at)
            open_at, indent = i, len(line) - len(line.lstrip())
        elif open_at >= 0 and bare and not bare.startswith("#") and len(line) - len(line.lstrip()) <= indent and bare[0] not in ")]}":
            yield open_at, i - 1, kind(open_at)
            open_at = -1
    if open_at >= 0:
        yield open_at, len(lines) - 1, kind(open_at)


def packed(lines: list[str], most: int, overlap: int = 0) -> Iterator[Piece]:
    """Runs of lines of at most `most` characters (a longer line is a run of its own), each with the last `overlap` lines of the run before.

    Every run ends later than the one before, so the scan always ends."""
    at, n = 0, len(lines)
    while at < n:
        end, size = at, len(lines[at])
        while end + 1 < n and size + 1 + len(lines[end + 1]) <= most:
            end += 1
            size += 1 + len(lines[end])
        yield at, end, "lines"
        at = end + 1 if end + 1 >= n else max(end + 1 - overlap, at + 1)


def cut(text: str, language: str, least: int, most: int) -> list[Piece]:
    """The pieces of a text whose size is in [least, most]; runs of lines where the language has no scan, or it finds nothing."""
    lines = text.split("\n")
    size = lambda p: sum(map(len, lines[p[0] : p[1] + 1])) + p[1] - p[0]
    found: Iterator[Piece] = iter(())
    if language == "go":
        found = braces(lines, re.compile(r"^func\b"))
    elif language in ("javascript", "typescript"):
        found = braces(lines, JS_START)
    elif language == "python":
        found = indented(lines)
    kept = [p for p in found if least <= size(p) <= most]
    return kept or [p for p in packed(lines, most) if size(p) >= least]


def chunk(files: DataFrame, least: int = 100, most: int = 1000) -> DataFrame:
    """(file, chunk, start, end, kind, text) of files (file, language, content); lines count from 1. Null or empty content has no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["content"] or ""
                lines = text.split("\n")
                for i, (a, b, kind) in enumerate(cut(text, row["language"] or "", least, most) if text.strip() else []):
                    out.append({"file": row["file"], "chunk": i, "start": a + 1, "end": b + 1, "kind": kind, "text": "\n".join(lines[a : b + 1])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("text", pa.string())]))

    return files.select("file", "language", "content").mapInArrow(run, SCHEMA)


def parents(chunks: DataFrame, files: DataFrame, around: int = 10, head: int = 50) -> DataFrame:
    """(file, chunk, parent): import lines of the file's first `head` lines, then the chunk's lines with `around` lines before and after."""
    lines = F.split("content", "\n")
    first = F.filter(F.slice(lines, 1, head), lambda x: F.trim(x).rlike(r"^(import|from|package|require|const .*require)\b"))
    start = F.greatest(F.col("start") - around, F.lit(1)).cast("int")
    part = F.slice(lines, start, (F.least(F.col("end") + around, F.size(lines)) - start + 1).cast("int"))
    rows = chunks.join(files.select(F.col("file").alias("f"), "content"), F.col("file") == F.col("f"))
    return rows.select("file", "chunk", F.concat_ws("\n", F.nullif(F.array_join(first, "\n"), F.lit("")), F.array_join(part, "\n")).alias("parent"))


def stripped(content: str, language: str) -> str:
    """Code without line comments, blank lines and lines of block comments; a line that opens a block goes whole."""
    line, opening, closing = (r"#.*$", r'"""|' + "'''", r'"""|' + "'''") if language == "python" else (r"//.*$", r"/\*", r"\*/")
    kept, inside = [], False
    for x in content.split("\n"):
        if inside:
            inside = not re.search(closing, x)
        elif found := re.search(opening, x):
            inside = not re.search(closing, x[: found.start()] + x[found.end() :])
        elif (x := re.sub(line, "", x)).strip():
            kept.append(x)
    return "\n".join(kept)


def strip_comments(files: DataFrame) -> DataFrame:
    """(file, code) of files (file, language, content); a language without known comments stays as it is."""
    known = ("python", "go", "javascript", "typescript", "java", "rust")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["file"], stripped(r["content"] or "", r["language"]) if r["language"] in known else r["content"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], ["file", "code"])

    return files.select("file", "language", "content").mapInArrow(run, "file string, code string")
