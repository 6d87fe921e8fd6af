"""Byte-level BPE over a whole corpus by an index of pair occurrences.

All words that a batch brings anew lie end to end in one array of tokens. Every mergeable pair of neighbours is indexed with
all its positions; the pairs' ranks are applied in ascending order, each at all its positions at once, and only the lists of
the pairs that a merge creates are updated. A merge can create pairs of later ranks only, so one pass suffices. A word's ids
are kept for later batches of the same task.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.llm.common import slices

#: Where the public vocabularies lie; a parameter of every function here.
FOLDER = "/opt/tokenizers"
#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task keeps the ids of, at most; others are encoded again.
KEEP = 400_000


@dataclass(frozen=True)
class Merges:
    """Ids of the 256 bytes, and the merges sorted by pair: (left << 32 | right), rank, resulting id."""

    singles: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_merges(path: str) -> Merges:
    """Read a byte-level BPE vocabulary in JSON (``model.vocab`` and ``model.merges``)."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, letters = model["vocab"], byte_letters()
    rows = []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        rows.append((vocab[left] << 32 | vocab[right], rank, vocab[left + right]))
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Merges(np.array([vocab[letters[b]] for b in range(256)], np.int32), table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32))


def encode_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and how many each has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    token = merges.singles[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    n = len(token)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    right[ends[lengths > 0] - 1] = -1
    left[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    of_rank = np.argsort(merges.ranks)

    def add(at: np.ndarray) -> None:
        """Index the mergeable pairs that begin at the positions ``at``, each of which has a right neighbour."""
        key = token[at] << 32 | token[right[at]]
        found = np.minimum(np.searchsorted(merges.pairs, key), len(merges.pairs) - 1)
        hit = merges.pairs[found] == key
        at, rank = at[hit], merges.ranks[found[hit]]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edge = np.flatnonzero(np.diff(rank)) + 1
        for one, places in zip(rank[np.concatenate([[0], edge])].tolist(), np.split(at, edge), strict=True):
            if one not in index:
                index[one] = []
                heapq.heappush(heap, one)
            index[one].append(places)

    if len(merges.pairs):
        add(np.flatnonzero(right >= 0))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        row = of_rank[rank]
        a, b = merges.pairs[row] >> 32, merges.pairs[row] & 0xFFFFFFFF
        at = at[alive[at] & (token[at] == a) & (right[at] >= 0)]
        at = at[token[right[at]] == b]
        if a == b and len(at) > 1:
            at = np.sort(at)
            follows = np.concatenate([[False], right[at[:-1]] == at[1:]])
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            continue
        gone = right[at]
        token[at] = merges.results[row]
        alive[gone] = False
        after = right[gone]
        right[at] = after
        left[after[after >= 0]] = at[after >= 0]
        add(np.unique(np.concatenate([left[at][left[at] >= 0], at[after >= 0]])))
    return token[alive].astype(np.int32), np.bincount(owner[alive], minlength=len(words))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str = f"{FOLDER}/byte_bpe_50k.json", pattern: str = PATTERN) -> DataFrame:
    """(id column, ids): the token ids of every text, without special tokens, whose strings count as ordinary text.

    Null and empty texts give an empty list. Rows are encoded where they lie, without a shuffle; a repeated row keeps its own
    row and a null id stays null. Other columns are ignored. Memory depends on a batch's distinct words only.
    """
    merges = df.sparkSession.sparkContext.broadcast(vars(load_merges(path)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        table = Merges(**merges.value)
        number: dict[str, int] = {}
        flat, starts, counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts):
                if len(number) > KEEP:
                    number = {}
                    flat, starts, counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
                known = len(number)
                split = [find(t) if t else [] for t in texts[begin:end]]
                used = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64)
                fresh = [w.encode("utf-8", "replace") for w in list(number)[known:]]
                if fresh:
                    ids, n = encode_words(fresh, table)
                    starts = np.concatenate([starts, len(flat) + np.cumsum(n) - n])
                    flat, counts = np.concatenate([flat, ids]), np.concatenate([counts, n])
                size = counts[used]
                total = int(size.sum())
                out = flat[np.repeat(starts[used] - (np.cumsum(size) - size), size) + np.arange(total)] if total else np.empty(0, np.int32)
                edges = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, split)])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out))], [id_col, "ids"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
