"""Evaluation texts leaking into training text: Wu-Manber search for many word sequences at once.

The patterns are all runs of ``run`` words of the test items. A shift table over hashed blocks of ``WIDTH`` words says how far
a window may move without missing a pattern; where it says 0, the block's bucket gives the patterns that end in it, a prefix
hash selects among them, a comparison of the whole run's hashes follows, and the words themselves confirm the occurrence. The
windows of all texts of a slice move together, one vectorised step each, and only blocks at which a window stands are hashed
and looked up. Long texts are cut into overlapping stretches, so that no text delays the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.llm.common import mix64, slices, token_hashes

#: Words of a block, words of a stretch of a long text, and pattern words that one pass over the corpus searches at most.
WIDTH, STRETCH, PATTERN_WORDS = 2, 512, 2_000_000


WORD = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Searcher:
    """Shift and bucket tables for patterns of ``run`` words; ``words`` holds the test items' words end to end."""

    run: int
    words: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    prefix: np.ndarray
    blocks: np.ndarray
    shifts: np.ndarray
    suffixes: np.ndarray
    order: np.ndarray
    plain: list[str]


def block_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the ``WIDTH`` words from each of the positions on."""
    out = words[at]
    for i in range(1, WIDTH):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    return out


def build(words: np.ndarray, owner: np.ndarray, items: np.ndarray, run: int, plain: list[str]) -> Searcher:
    """Tables for all runs of ``run`` words within one item; ``owner`` is each word's item, as an index of
    ``items``, ``plain`` the words themselves."""
    n = len(words) - run + 1
    begin = np.flatnonzero(owner[:n] == owner[run - 1 :]) if n > 0 else np.empty(0, np.int64)
    hashed = block_at(words, np.arange(len(words) - WIDTH + 1)) if len(words) >= WIDTH else np.empty(0, np.uint64)
    keys, shifts = [], []
    for end in range(WIDTH, run + 1):
        keys.append(hashed[begin + end - WIDTH] if len(begin) else np.empty(0, np.uint64))
        shifts.append(np.full(len(begin), run - end, np.int64))
    key, shift = np.concatenate(keys), np.concatenate(shifts)
    order = np.lexsort((shift, key))
    blocks, first = np.unique(key[order], return_index=True)
    suffix = keys[-1]
    by = np.argsort(suffix, kind="stable")
    return Searcher(run, words, begin, items[owner[begin]] if len(begin) else np.empty(0, np.int64), hashed[begin] if len(begin) else suffix, blocks, shift[order][first], suffix[by], by, plain)


def search(s: Searcher, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, pattern, position) of every occurrence, by hashes, in the stretches words[first:last]."""
    at, who = first.copy(), np.arange(len(first))
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(s.blocks):
        live = at + s.run <= last
        at, who, last = at[live], who[live], last[live]
        if not len(at):
            break
        key = block_at(words, at + s.run - WIDTH)
        found = np.minimum(np.searchsorted(s.blocks, key), len(s.blocks) - 1)
        shift = np.where(s.blocks[found] == key, s.shifts[found], s.run - WIDTH + 1)
        stop = np.flatnonzero(shift == 0)
        if len(stop):
            low, high = np.searchsorted(s.suffixes, key[stop], "left"), np.searchsorted(s.suffixes, key[stop], "right")
            times = high - low
            place = np.repeat(stop, times)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            pattern = s.order[np.repeat(low, times) + nth]
            same = s.prefix[pattern] == block_at(words, at[stop])[np.repeat(np.arange(len(stop)), times)]
            place, pattern = place[same], pattern[same]
            whole = np.arange(s.run)
            equal = (words[at[place][:, None] + whole] == s.words[s.begin[pattern][:, None] + whole]).all(axis=1)
            if equal.any():
                hits.append((who[place[equal]], pattern[equal], at[place[equal]]))
        at = at + np.maximum(shift, 1)
    if not hits:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(h) for h in zip(*hits, strict=True))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def confirmed(s: Searcher, texts: list[str], text: np.ndarray, pattern: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which occurrences hold word for word: ``place`` is a word's number in the text ``text``."""
    out, now, own = np.zeros(len(text), bool), -1, []
    for i in np.argsort(text, kind="stable"):
        if text[i] != now:
            now, own = int(text[i]), words_of(texts[int(text[i])])
        begin = int(s.begin[pattern[i]])
        out[i] = own[place[i] : place[i] + s.run] == s.plain[begin : begin + s.run]
    return out


def leaked(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """(doc_id, item_id): documents and test items that share at least ``run`` consecutive words.

    Words are maximal runs of ASCII letters and digits in the lower-cased text. Null and empty texts, and texts with fewer
    words, take no part; null ids drop out; repeated rows count once; other columns are ignored. The items' words are searched
    in passes of at most ``PATTERN_WORDS``, each broadcast, over all documents.
    """
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = asked.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    passes = max(1, -(-size // (PATTERN_WORDS * 4)))
    corpus = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    out = None
    for block in range(passes if size else 0):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == block).orderBy("item_id").collect()
        words, owner = token_hashes([r.text for r in rows], underscore=False)
        plain = [w for r in rows for w in words_of(r.text)]
        tables = spark.sparkContext.broadcast(vars(build(words, owner, np.array([r.item_id for r in rows], np.int64), run, plain)))

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            s = Searcher(**tables.value)
            for batch in batches:
                texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
                for begin, end in slices(texts):
                    words, owner = token_hashes(texts[begin:end], underscore=False)
                    count = np.bincount(owner, minlength=end - begin)
                    start = np.cumsum(count) - count
                    parts = np.maximum(1, -(-np.maximum(count - s.run + 1, 0) // STRETCH))
                    who = np.repeat(np.arange(end - begin), parts)
                    nth = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
                    first = start[who] + nth * STRETCH
                    last = np.minimum(first + STRETCH + s.run - 1, (start + count)[who])
                    stretch, pattern, at = search(s, words, first, last)
                    if len(stretch):
                        text = who[stretch]
                        real = confirmed(s, texts[begin:end], text, pattern, at - start[text])
                        pair = np.unique(np.stack([ids[begin:end][text[real]], s.item[pattern[real]]]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["doc_id", "item_id"])

        found = corpus.mapInArrow(scan, "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
