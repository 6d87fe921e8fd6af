"""Chunkers: plain text, Markdown and source files, and their choice by file ending.

A document becomes its chunks in one Arrow pass where it lies. Sizes are in UTF-16 units, as the stored limits mean them.
All chunkers cut with ``spans``: the pieces of a text are laid end to end, and a chunk is a stretch of that text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopegrain.operators import structure

#: Endings of Markdown.
MARKDOWN = (".md", ".mdx", ".markdown")
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
#: Imports that head every chunk of a source file, at most.
IMPORTS = 5


@dataclass(frozen=True)
class Chunk:
    content: str
    heading: str
    start_line: int
    end_line: int


def width(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


@dataclass(frozen=True)
class Span:
    """A stretch of the joined pieces: its text, what of it the stretch before had too, and the new pieces [first, after)."""

    text: str
    again: str
    first: int
    after: int


def spans(pieces: list[str], joint: str, limit: int, overlap: int) -> list[Span]:
    """Stretches of ``pieces`` joined by ``joint``, each ending with a whole piece and as long as ``limit`` allows.

    A stretch begins ``overlap`` units before the end of the one before, though not before that one's begin, and takes at least
    one new piece, however long. Empty pieces at the very start are no part of any stretch.
    """
    raw = joint.join(pieces).encode("utf-16-le", "surrogatepass")
    ends = [e - width(joint) for e in accumulate(width(p) + width(joint) for p in pieces)]
    text_of = lambda a, b: raw[2 * a : 2 * b].decode("utf-16-le", "surrogatepass")
    first = next((i for i, p in enumerate(pieces) if p), len(pieces))
    begin = ends[first] - width(pieces[first]) if first < len(pieces) else 0
    shared, out = begin, []
    while first < len(pieces):
        after = max(first + 1, bisect_right(ends, begin + limit))
        out.append(Span(text_of(begin, ends[after - 1]), text_of(begin, shared), first, after))
        shared = ends[after - 1]
        begin = max(begin, shared - overlap)
        # No stretch begins with half a character.
        begin += begin < shared and 0xDC <= raw[2 * begin + 1] <= 0xDF
        first = after
    return out


def chunk_text(content: str, limit: int = 512, overlap: int = 64) -> list[Chunk]:
    """Whole lines packed up to ``limit``; each further chunk begins with the last ``overlap`` of the one before.

    A single longer line stays whole. Blank content gives no chunk. A chunk's end line is the line after its last, but for
    the final chunk; its start line counts back by the line ends that it repeats.
    """
    lines = content.split("\n")
    found = spans(lines, "\n", limit, overlap) if content.strip() else []
    start = [1, *(max(1, s.first - s.again.count("\n")) for s in found[1:])]
    made = [Chunk(s.text.strip(), "", at, s.after + 1) for s, at in zip(found, start, strict=False)]
    if made and made[-1].content:
        return [*made[:-1], Chunk(made[-1].content, "", made[-1].start_line, len(lines))]
    return made[:-1]


def section(text: str, heading: str, start: int, end: int, limit: int, overlap: int) -> list[Chunk]:
    """A section whole if it fits, else its paragraphs packed with overlap; line numbers do not count blank lines."""
    if width(text) <= limit:
        return [Chunk(text, heading, start, end)]
    paragraphs = re.split(r"\n\n+", text)
    line = [start, *accumulate((p.count("\n") + 1 for p in paragraphs), initial=start)][1:]
    found = spans(paragraphs, "\n\n", limit, overlap)
    made = [Chunk(s.text.strip(), heading, line[s.first], end if s.after == len(paragraphs) else line[s.after]) for s in found]
    return made if made[-1].content else made[:-1]


def chunk_markdown(content: str, limit: int = 512, overlap: int = 64) -> list[Chunk]:
    """Sections between headings, each under the path of its headings; long ones split by paragraph.

    A heading inside a code fence counts as one. Text before the first heading has an empty heading.
    """
    lines, out = content.split("\n"), []
    path: list[tuple[int, str]] = []
    opened = 0

    def close(end: int) -> None:
        text = "\n".join(lines[opened:end]).strip()
        if text:
            out.extend(section(text, " > ".join(name for _, name in path), opened + 1, end, limit, overlap))

    for number, line in enumerate(lines):
        found = HEADING.match(line)
        if found:
            close(number)
            level = len(found[1])
            path = [(depth, name) for depth, name in path if depth < level] + [(level, found[2].strip())]
            opened = number
    close(len(lines))
    return out


def chunk_source(content: str, ending: str, limit: int = 512, overlap: int = 64, name: str | None = None) -> list[Chunk]:
    """The structures of a source file, each below the file's imports, and what lies between them, by start line.

    A structure that is too long is packed line by line, the imports in its first chunk only. A structure inside another
    statement is a chunk too, and that statement counts as lying between. A chunk of what lies between ends, as far as its line
    number says, with the statement that did not fit any more. A text that does not parse gives no chunk.
    """
    found = structure.parts(content, ending)
    starts = [0, *(m.end() for m in re.finditer("\n", content))]
    line_of = lambda at: bisect_right(starts, at)
    imports = [content[p.start : p.end].strip() for p in found if p.imports]
    head = "\n".join(imports[:IMPORTS]) + ("\n// ..." if len(imports) > IMPORTS else "")
    front, out = [f"[{name}]"] if name else [], []
    for p in (p for p in found if p.split):
        heading, text = " > ".join([*front, p.name or p.kind.replace("_", " ")]), content[p.start : p.end]
        begin, end = line_of(p.start), line_of(max(p.start, p.end - 1))
        if width(text) <= limit:
            out.append(Chunk(f"{head}\n\n{text}" if head else text, heading, begin, end))
            continue
        opening = [f"{head}\n\n"] if head else []
        pieces = [*opening, *text.split("\n")]
        for s in spans(pieces, "\n", limit, overlap):
            at = begin + max(0, s.first - len(opening))
            out.append(Chunk(s.text.strip(), heading, at, end if s.after == len(pieces) else begin + s.after - len(opening) - 1))
    between = [p for p in found if p.top and not p.split and not p.imports and content[p.start : p.end].strip()]
    for s in spans([content[p.start : p.end].strip() for p in between], "\n", limit, overlap):
        last = between[min(s.after, len(between) - 1)]
        out.append(Chunk(s.text.strip(), " ".join([*front, "top-level"]), line_of(between[s.first].start), line_of(last.end - 1)))
    return sorted((c for c in out if c.content), key=lambda c: c.start_line)


def chunk_file(content: str, path: str, limit: int = 512, overlap: int = 64) -> list[Chunk]:
    """Chunks by file ending: Markdown, source files, and plain text for all else and for what yields nothing."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    ending = f".{base.rsplit('.', 1)[-1].lower()}" if "." in base else ""
    if ending in MARKDOWN:
        return chunk_markdown(content, limit, overlap)
    return (ending in structure.LANGUAGES and chunk_source(content, ending, limit, overlap, path)) or chunk_text(content, limit, overlap)


def chunk_documents(df: DataFrame, id_col: str, path_col: str, text_col: str, limit: int = 512, overlap: int = 64, kind: str = "auto") -> DataFrame:
    """(id, path, chunk_index, content, heading, start_line, end_line): the chunks of every document.

    ``kind`` is auto (by path), text or markdown. A null text has no chunk, a null path counts as plain text; repeated rows are
    chunked once each; other columns are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for one, path, text in zip(ids, paths, texts, strict=True):
                if text is None:
                    continue
                made = chunk_text(text, limit, overlap) if kind == "text" else chunk_markdown(text, limit, overlap) if kind == "markdown" else chunk_file(text, path or "", limit, overlap)
                rows.extend((one, path, i, c.content, c.heading, c.start_line, c.end_line) for i, c in enumerate(made))
            names = ["id", "path", "chunk_index", "content", "heading", "start_line", "end_line"]
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    own = df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {id_type}, path string, chunk_index int, content string, heading string, start_line int, end_line int")
