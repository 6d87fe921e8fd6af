"""Near-duplicate records by T-occurrence search over inverted lists of word shingles (DivideSkip).

Two records are near-duplicates if they share T shingles, where T follows from their numbers of shingles and the least
similarity. A record's shingles stand in one global order, rare ones first. The L most frequent ones of a record, one less
than any partner must share with it, are its long lists, the others its short ones: every partner stands in one of the short
lists at least. These are merged in sorted runs, which gives the candidates; two exact bounds (what can still follow on either
side, and bit maps of the whole shingle sets) drop most of them at once. For the rest, the occurrences in the short lists are
counted, those with fewer than T - L leave, and only for what is left the long lists are probed by binary search; a pair stays
if its occurrences reach T.

Records with equal shingle sets are one row, so that copies cost no more than one record. The order needs only an upper
estimate of each shingle's frequency: a count-min table of fixed size over all records, the only thing that is broadcast.
A list expected to be longer than ``BLOCK`` is cut into blocks whose pairs go to different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.llm.common import fixed_binary, from_binary, mix64, ragged_binary, slices, token_hashes
from scopegrain.llm.vectors import near_pairs, usable_vectors, vector_groups
from scopegrain.shared import materialise

#: Counters in each of the count-min table's two rows, counters shipped in one row, and the longest uncut inverted list.
SLOTS, PIECE, BLOCK = 1 << 20, 4_096, 4_096
#: Members of a class that one cell of its pairs takes from either side, and parts into which members are spread to be placed.
COPIES, SALTS = 2_048, 32
#: Bits of a shingle's hash; pairs of records are compared by these.
BITS = 48


def shingle_sets(texts: list[str | None], size: int, least_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the texts with enough tokens, their numbers of distinct shingles, and those shingles, sorted by text."""
    token, owner = token_hashes(texts, underscore=True)
    count = np.bincount(owner, minlength=len(texts))
    n = len(token) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashed = np.zeros(n, np.uint64)
    for i in range(size):
        hashed = mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + token[i : i + n])
    whole = (owner[:n] == owner[size - 1 :]) & (count[owner[:n]] >= least_tokens)
    key = np.sort((owner[:n][whole].astype(np.uint64) << np.uint64(BITS)) | (hashed[whole] >> np.uint64(64 - BITS)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    at, number = np.unique(key >> np.uint64(BITS), return_counts=True)
    return at.astype(np.int64), number, key & np.uint64((1 << BITS) - 1)


def bit_maps(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each set; each shingle sets one of the 128 bits."""
    bit = mix64(shingles) >> np.uint64(57)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    out = np.zeros((len(counts), 2), np.uint64)
    for word in range(2):
        own = np.where((bit >> np.uint64(6)) == word, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        out[:, word] = np.bitwise_or.reduceat(own, starts) if len(counts) else 0
    return out


def _sets(size: int, least_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts):
                at, number, flat = shingle_sets(texts[begin:end], size, least_tokens)
                if not len(at):
                    continue
                starts = np.concatenate([[0], np.cumsum(number)[:-1]])
                key = mix64(np.add.reduceat(mix64(flat), starts) + number.astype(np.uint64))
                ids = batch.column(0).slice(begin, end - begin).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.view(np.int64)), ragged_binary(_pack(flat), number * 6)], ["id", "skey", "shingles"])

    return run


def _pack(flat: np.ndarray) -> np.ndarray:
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, counts = from_binary(column, np.uint8)
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.view(np.uint64).ravel(), counts // 6


def _slots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(shingles + np.uint64(0x51ED270B))
    return (mixed & np.uint64(SLOTS - 1)).astype(np.int64), ((mixed >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64) + SLOTS


def frequencies(sets: DataFrame) -> np.ndarray:
    """The count-min table (2 * SLOTS counters, a fixed size) over all shingle sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS, np.int64)
        for batch in batches:
            flat, _ = _unpack(batch.column(0))
            for slot in _slots(flat):
                total += np.bincount(slot, minlength=2 * SLOTS)
        pieces = total.reshape(-1, PIECE)
        at = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), fixed_binary(np.minimum(pieces[at], 2**31 - 1).astype(np.int32))], ["piece", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = from_binary(batch.column(1), np.int32)[0].reshape(-1, PIECE).astype(np.int64)
            for piece, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                total[piece] = total[piece] + row if piece in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), fixed_binary(np.minimum(np.stack(list(total.values())), 2**31 - 1).astype(np.int32))], ["piece", "n"])

    schema = "piece bigint, n binary"
    summed = sets.select("shingles").mapInArrow(count, schema).repartition(16, "piece").mapInArrow(add, schema).toArrow()
    out = np.zeros((2 * SLOTS // PIECE, PIECE), np.int32)
    if summed.num_rows:
        out[summed.column("piece").to_numpy()] = from_binary(summed.column("n"), np.int32)[0].reshape(-1, PIECE)
    return out.ravel()


def _postings(table, least: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["shingle", "cell", "block", "skey", "n", "pos", "b0", "b1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = table.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 4_096):
                part = batch.slice(begin, 4_096)
                key = part.column(0).to_numpy()
                flat, number = _unpack(part.column(1))
                maps = bit_maps(flat, number)
                order, place, owner, often = in_order(flat, number, seen)
                short = place < (number - long_lists(number, least))[owner]
                order, place, owner = order[short], place[short], owner[short]
                flat, often = flat[order], often[order]
                parts = np.maximum(1, -(-often.astype(np.int64) // BLOCK))
                mine = (mix64(key.view(np.uint64)[owner]) % parts.astype(np.uint64)).astype(np.int64)
                who = np.repeat(np.arange(len(flat)), parts)
                other = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
                low, high = np.minimum(mine[who], other), np.maximum(mine[who], other)
                o = owner[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (flat[who].view(np.int64), low * (1 << 31) + high, mine[who].astype(np.int32), key[o], number[o].astype(np.int32), place[who].astype(np.int32), maps[o, 0].view(np.int64), maps[o, 1].view(np.int64))], names
                )

    return run


def required(n: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    """T: the shingles that sets of ``n`` and ``m`` must share for a Jaccard similarity of ``least``."""
    p, q = least.numerator, least.denominator
    return -(-(p * (n.astype(np.int64) + m)) // (p + q))


def _merged(least: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(columns: list[np.ndarray]) -> np.ndarray:
        shingle, cell, block, key, n, pos, b0, b1 = columns
        same = np.zeros(len(shingle), bool)
        same[1:] = (shingle[1:] == shingle[:-1]) & (cell[1:] == cell[:-1])
        alone = ~same
        alone[:-1] &= ~same[1:]
        keep = np.flatnonzero(~alone)
        shingle, cell, block, key, n, pos, b0, b1 = (c[keep] for c in (shingle, cell, block, key, n, pos, b0, b1))
        out = []
        at, step = np.arange(len(shingle)), 1
        while True:
            at = at[at + step < len(shingle)]
            with_ = at + step
            at = at[(shingle[at] == shingle[with_]) & (cell[at] == cell[with_])]
            if not len(at):
                break
            i, j = at, at + step
            across = (cell[i] >> 31) != (cell[i] & ((1 << 31) - 1))
            need = required(n[i], n[j], least)
            good = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
            good &= np.minimum(n[i], n[j]) >= need
            good &= ~across | (block[i] != block[j])
            i, j, need = i[good], j[good], need[good]
            left = n[i] - np.bitwise_count(b0[i] & ~b0[j]) - np.bitwise_count(b1[i] & ~b1[j]).astype(np.int64)
            right = n[j] - np.bitwise_count(b0[j] & ~b0[i]) - np.bitwise_count(b1[j] & ~b1[i]).astype(np.int64)
            good = (np.minimum(left, right) >= need) & (key[i] != key[j])
            a, b = key[i[good]], key[j[good]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            step += 1
        return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(8)]
            columns[6:] = [c.view(np.uint64) for c in columns[6:]]
            if carry is not None:
                columns = [np.concatenate(x) for x in zip(carry, columns, strict=True)]
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            carry = [c[cut:] for c in columns]
            found = pairs([c[:cut] for c in columns])
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
        if carry is not None:
            found = pairs(carry)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return run


def long_lists(number: np.ndarray, least: Fraction) -> np.ndarray:
    """L: how many of a record's lists are long; any partner shares at least one more shingle with it."""
    return -(-number.astype(np.int64) * least.numerator // least.denominator) - 1


def in_order(flat: np.ndarray, number: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The global order: positions of the shingles by record, rare ones first; each one's place in its record, its record, and
    its frequency before ordering."""
    one, two = _slots(flat)
    often = np.minimum(table[one], table[two])
    owner = np.repeat(np.arange(len(number)), number)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(number) - number, number)
    return np.lexsort((flat, often, owner)), place, owner, often


def _probed(table, least: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = table.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 4_096):
                part = batch.slice(begin, 4_096)
                (one, n), (two, m) = _unpack(part.column(2)), _unpack(part.column(3))
                # Sorted by pair and shingle, so that one binary search probes all pairs.
                lists = (np.repeat(np.arange(len(m)), m).astype(np.uint64) << np.uint64(BITS)) | two
                order, place, owner, _ = in_order(one, n, seen)
                asked = ((owner.astype(np.uint64) << np.uint64(BITS)) | one)[order]

                def occurrences(which: np.ndarray, asked=asked, owner=owner, lists=lists, pairs=len(n)) -> np.ndarray:  # noqa: ANN001
                    keys = asked[which]
                    at = np.minimum(np.searchsorted(lists, keys), max(0, len(lists) - 1))
                    hit = lists[at] == keys if len(lists) else np.zeros(len(keys), bool)
                    return np.bincount(owner[which][hit], minlength=pairs)

                long_ = long_lists(n, least)
                short = place < (n - long_)[owner]
                shared = occurrences(np.flatnonzero(short))
                able = shared >= required(n, m, least) - long_
                shared = shared + occurrences(np.flatnonzero(~short & able[owner]))
                union = n + m - shared
                keep = able & (shared * q >= union * p)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(c).to_numpy()[keep]) for c in range(2)] + [pa.array(shared[keep] / np.maximum(union[keep], 1))], ["a", "b", "similarity"])

    return run


def text_members(df: DataFrame, id_col: str, text_col: str, size: int, least_tokens: int) -> DataFrame:
    """(id, skey, shingles): the distinct shingles of each record with enough tokens; ``skey`` is equal for equal sets."""
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null and t is not null")
    return own.mapInArrow(_sets(size, least_tokens), "id bigint, skey bigint, shingles binary")


def similar_sets(sets: DataFrame, least: Fraction) -> DataFrame:
    """(a, b, similarity), a < b: pairs of distinct shingle sets (skey, shingles; a written table) that reach ``least``."""
    spark = sets.sparkSession
    table = spark.sparkContext.broadcast(frequencies(sets))
    schema = "shingle bigint, cell bigint, block int, skey bigint, n int, pos int, b0 bigint, b1 bigint"
    posted = sets.select("skey", "shingles").mapInArrow(_postings(table, least), schema)
    pairs = posted.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell", "n").mapInArrow(_merged(least), "a bigint, b bigint").distinct()
    one = sets.select(F.col("skey").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("skey").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_probed(table, least), "a bigint, b bigint, similarity double")


def near_duplicate_texts(df: DataFrame, id_col: str, text_col: str, least: float = 0.8, size: int = 5, least_tokens: int = 1) -> tuple[DataFrame, DataFrame]:
    """Membership (id, skey) and pairs (a, b, similarity) between the representatives' keys.

    Tokens are runs of ASCII letters, digits and underscore in the lower-cased text; a record's shingles are its distinct
    runs of ``size`` tokens. Null and empty texts, and those with fewer than ``least_tokens`` tokens or ``size``, belong to
    no class. Repeated rows count once, ties need no order, extra columns are ignored, and an empty table gives no rows.
    """
    members = text_members(df, id_col, text_col, size, least_tokens)
    sets = materialise(members.groupBy("skey").agg(F.first("shingles").alias("shingles")), "shingles")
    return members.select("id", "skey").distinct(), similar_sets(sets, Fraction(str(least)))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(one, two), one < two: pairs of ids from pairs (a, b) of classes and their membership (id, key), own class included.

    A class of more than ``COPIES`` members is cut into parts, and each pair of parts is a cell of its own, so that the pairs
    of a large class go to as many tasks. Members learn their part through salted keys, so that none of them gather before.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.filter("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))
    large = sizes.filter(F.col("n") > COPIES).select("key", F.ceil(F.col("n") / COPIES).alias("parts"))
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = members.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(salted, ["key", "salt"], "left")
    placed = placed.select("id", "key", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part"))
    cells = pairs.select("a", "b").unionByName(own)
    for side in ("a", "b"):
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)).alias(f"part_{side}")
        cells = cells.join(large.withColumnRenamed("key", side), side, "left").select(*cells.columns, part)
    left = placed.select(F.col("key").alias("a"), F.col("part").alias("part_a"), F.col("id").alias("x"))
    right = placed.select(F.col("key").alias("b"), F.col("part").alias("part_b"), F.col("id").alias("y"))
    joined = cells.join(left, ["a", "part_a"]).join(right, ["b", "part_b"]).filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return joined.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")).filter("one < two")


def near_duplicates(chunks: DataFrame, least: float = 0.6, size: int = 3, least_tokens: int = 30, least_cosine: float = 0.985) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: chunks with almost the same ``content``, or with almost the same ``vector``.

    A repeated row is one chunk. Direct pairs only. A null, empty or short content can be found by its vector only, an
    unusable vector by its content only; an empty table gives no pairs. Other columns are ignored.
    """
    members, pairs = near_duplicate_texts(chunks, "id", "content", least, size, least_tokens)
    by_text = expand(materialise(pairs.select("a", "b"), "text-pairs"), members.withColumnRenamed("skey", "key"))
    vectors = usable_vectors(chunks, "id", "vector")
    groups = materialise(vector_groups(vectors, 1), "vectors")
    close = materialise(near_pairs(groups, least_cosine).select("a", "b"), "vector-pairs")
    by_vector = expand(close, vectors.select("id", F.col("vkey").alias("key")).distinct())
    return by_text.unionByName(by_vector).distinct().select(F.col("one").alias("chunk_a"), F.col("two").alias("chunk_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/chunks.parquet"))


def document_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (id, skey, whole) of every document and pairs (a, b, similarity) between the classes' keys, over (doc_id, text).

    Documents with equal shingle sets are one class. One without shingles is classed by its whole text (``whole``); without
    a text it is a class of its own. Rows with a null id drop out.
    """
    members, pairs = near_duplicate_texts(docs, "doc_id", "text")
    shingled = members.select("id", F.col("skey").cast("string").alias("skey"), F.lit(False).alias("whole"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    key = F.coalesce(F.sha2("text", 256), F.concat(F.lit("id "), F.col("id").cast("string")))
    rest = texts.select("id", key.alias("skey"), F.lit(True).alias("whole")).distinct().join(members.select("id").distinct(), "id", "left_anti")
    return shingled.unionByName(rest), pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "similarity")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the smallest id of its class, the class's size, and its links to other classes."""
    members, pairs = document_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("skey")).groupBy("skey").agg(F.count(F.lit(1)).alias("links"))
    first = members.groupBy("skey").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    named = first.join(links, "skey", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))
    return members.join(named, "skey").select(F.col("id").alias("doc_id"), "class_id", "members", "links")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_a, class_b, similarity), class_a < class_b: the near-duplicates among the classes of p3_classes."""
    members, pairs = document_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = members.filter("not whole").groupBy("skey").agg(F.min("id").alias("class_id"))
    one, two = first.select(F.col("skey").alias("a"), F.col("class_id").alias("x")), first.select(F.col("skey").alias("b"), F.col("class_id").alias("y"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def chunk_classes(chunks: DataFrame, least: float = 0.6, size: int = 3, least_tokens: int = 30, least_cosine: float = 0.985) -> tuple[DataFrame, DataFrame]:
    """Membership (kind, id, key) of chunks in classes of equal shingle sets (text) and of equal vectors (vector), and the pairs
    (kind, a, b) of classes that are near-duplicates: p3_found without its expansion. A chunk may be in a class of either kind,
    or in none."""
    members, pairs = near_duplicate_texts(chunks, "id", "content", least, size, least_tokens)
    vectors = usable_vectors(chunks, "id", "vector")
    groups = materialise(vector_groups(vectors, 1), "vectors")
    close = near_pairs(groups, least_cosine).select(F.lit("vector").alias("kind"), "a", "b")
    held = members.select(F.lit("text").alias("kind"), "id", F.col("skey").alias("key")).unionByName(vectors.select(F.lit("vector").alias("kind"), "id", F.col("vkey").alias("key")).distinct())
    return held, materialise(pairs.select(F.lit("text").alias("kind"), "a", "b").unionByName(close), "class-pairs")


def p3_chunk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, chunk_id, class_id, members, links): each chunk's classes, named by the smallest id, their sizes and links."""
    members, pairs = chunk_classes(spark.read.parquet(f"{sf_dir}/chunks.parquet"))
    links = pairs.select("kind", F.explode(F.array("a", "b")).alias("key")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("links"))
    first = members.groupBy("kind", "key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")).join(links, ["kind", "key"], "left")
    named = members.join(first, ["kind", "key"])
    return named.select("kind", F.col("id").alias("chunk_id"), "class_id", "members", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def p3_chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, class_a, class_b), class_a < class_b: the near-duplicates among the classes of p3_chunk_classes."""
    members, pairs = chunk_classes(spark.read.parquet(f"{sf_dir}/chunks.parquet"))
    first = materialise(members.groupBy("kind", "key").agg(F.min("id").alias("class_id")), "classes")
    one, two = (first.select("kind", F.col("key").alias(k), F.col("class_id").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    joined = pairs.join(one, ["kind", "a"]).join(two, ["kind", "b"])
    return joined.select("kind", F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"))
