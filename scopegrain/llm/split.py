"""Splitting oversized items at natural boundaries, by a recursive hierarchy of separators with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest piece, characters of a piece before which no cut is sought, and overlap of consecutive pieces.
LIMIT, LEAST, OVERLAP = 512, 256, 64

#: Where a cut may stand by kind of separator: the position at which the next piece begins. Any character is the last resort.
SEPARATORS: dict[str, str] = {
    "heading": r"(?m)(?<![^\n])(?=#{1,6} )",
    "paragraph": r"(?m)(?:\A|(?<=\n))[ \t\r]*\n",
    "line": r"\n",
    "sentence": r"[.!?…][\"'”’»)\]]*[ \t]+|[。！？]",
    "word": r"[ \t]",
}
#: The hierarchy from the coarsest to the finest; ``sentence`` may be put before ``word`` where no definition forbids it.
HIERARCHY = ("heading", "paragraph", "line", "word")
LINE = re.compile(r"\n")


class Boundaries:
    """Sorted positions of each kind of boundary in one text, found once."""

    def __init__(self, text: str, hierarchy: tuple[str, ...] = HIERARCHY) -> None:
        self.levels = [np.array([m.end() for m in re.finditer(SEPARATORS[kind], text)], np.int64) for kind in hierarchy]

    def cut(self, low: int, high: int) -> int:
        """The largest boundary in [low, high] of the coarsest kind that has one, else ``high``."""
        for level in self.levels:
            i = int(np.searchsorted(level, high, side="right"))
            if i and level[i - 1] >= low:
                return int(level[i - 1])
        return high


def pieces(text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, hierarchy: tuple[str, ...] = HIERARCHY) -> list[tuple[int, int]]:
    """[start, end) of the pieces of ``text``: packed up to ``limit``, each beginning ``overlap`` before the last one's end."""
    if not least > overlap:
        raise ValueError("a piece must be longer than the overlap")
    marks, out, start = Boundaries(text, hierarchy), [], 0
    while len(text) - start > limit:
        end = marks.cut(start + least, start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def split_oversized(chunks: DataFrame, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, hierarchy: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """One row for each piece of each chunk with more than ``limit`` characters (code points).

    Columns: chunk_id, piece_no (from 1), char_start, char_end (0-based, end exclusive), line_start, line_end, heading.
    Null, empty and shorter contents give no rows; a null start_line counts as 1; a null id drops out; repeated rows count
    once (the pieces are compared, which are smaller than the texts); other columns are ignored. Each row is split on its own,
    so no text is ever gathered with others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lines, heads = (batch.column(i).to_pylist() for i in range(4))
            rows: list[tuple] = []
            for one, text, line, head in zip(ids, texts, lines, heads, strict=True):
                ends = np.array([m.start() for m in LINE.finditer(text)], np.int64)
                cuts = pieces(text, limit, least, overlap, hierarchy)
                begin = np.searchsorted(ends, [s for s, _ in cuts], side="left").tolist()
                close = np.searchsorted(ends, [e - 1 for _, e in cuts], side="left").tolist()
                rows += [(one, n + 1, s, e, line + b, line + c, head) for n, ((s, e), b, c) in enumerate(zip(cuts, begin, close, strict=True))]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())], ["chunk_id", "piece_no", "char_start", "char_end", "line_start", "line_end", "heading"])

    own = chunks.filter(F.col("id").isNotNull() & (F.length("content") > limit))
    own = own.select(F.col("id").cast("bigint").alias("id"), "content", F.coalesce("start_line", F.lit(1)).cast("bigint").alias("line"), F.col("heading").cast("string"))
    schema = "chunk_id bigint, piece_no bigint, char_start bigint, char_end bigint, line_start bigint, line_end bigint, heading string"
    return own.mapInArrow(run, schema).dropDuplicates(["chunk_id", "piece_no"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{sf_dir}/chunks.parquet")).drop("heading")
