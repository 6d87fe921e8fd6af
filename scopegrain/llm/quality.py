"""Per-document text statistics, and the label of every line by a hidden Markov model over line statistics.

A document's text is read line by line; a line longer than ``UNIT`` characters is read as several units, cut at white space.
Each unit gives discrete statistics (words, short words, frequent words, digits, symbols, line end, opening mark, separators,
repetition and so on), computed over a batch's characters at once. A four-state hidden Markov model, the statistics
independent given the state, labels the units prose, list, table or junk (machine output counts as junk).

Nothing in the model is set by hand. Its emissions start from the evident units of the corpus itself (a full sentence, a short
line behind a bullet, a row of columns, a line that was there before), whose states ``evident`` names; Baum-Welch then fits
emissions and transitions to all units of all documents, evident ones held to their states. Frequent words are those that most
documents have. For labelling no unit is held: the best path of the whole document (Viterbi) decides, so that a doubtful line
is read as its neighbours are. The labels' shares of the text are summed over the whole document.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopegrain.llm.common import fixed_binary, from_binary, mix64, ragged_binary, slices
from scopegrain.shared import materialise

#: Characters of a unit, rounds of Baum-Welch, and words that count as frequent.
UNIT, ROUNDS, FREQUENT = 240, 3, 64
#: The statistics overlap, so their joint likelihood is taken to this power; 1 would drown the chain.
EVIDENCE = 0.5
STATES = ("prose", "list", "table", "junk")
#: Share of prose in the text's characters under which a document is no prose.
PROSE_LEAST = 0.6

#: The statistics of a unit and how many values each takes.
SIZES = {"words": 5, "short": 4, "frequent": 4, "digits": 4, "symbols": 4, "end": 2, "opening": 3, "separators": 4, "pair": 2, "repeat": 4, "length": 4, "crumbs": 3, "stamp": 2, "clean": 5}
#: Where each statistic's values begin in a row of counts.
EDGES = np.concatenate([[0], np.cumsum(list(SIZES.values()))])

SPACE, LINE, LOWER, UPPER, WIDE, DIGIT, INNER, STOP, SIGN = range(9)
#: Characters that may stand at or in a word of prose, those that end a line of it, bullets, and column signs.
INNER_MARKS, END_MARKS, BULLETS, CRUMBS = "([{<\"'“‘„«¿¡`*_#-’–/,;:)\\]}>”»…。，、！？；：.!?", ".!?。！？…:;\"”»'’)]", "-*+•–‣◦▪", "|»·/>›•→"


@lru_cache(maxsize=1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower case of every character up to U+FFFF; those beyond are signs, or wide letters."""
    kind, low = np.full(65_537, SIGN, np.uint8), np.arange(65_537, dtype=np.uint32)
    for code in range(65_536):
        c = chr(code)
        group = unicodedata.category(c)
        if c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
            kind[code] = LINE
        elif c.isspace():
            kind[code] = SPACE
        elif 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x4DBF or 0x4E00 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7AF:
            kind[code] = WIDE
        elif group[0] in "LM":
            kind[code] = UPPER if group in ("Lu", "Lt") else LOWER
        elif group[0] == "N":
            kind[code] = DIGIT
        elif c in END_MARKS:
            kind[code] = STOP
        elif c in INNER_MARKS:
            kind[code] = INNER
        small = c.lower()
        if len(small) == 1:
            low[code] = ord(small)
    return kind, low


def steps(value: np.ndarray, *bounds: float) -> np.ndarray:
    return sum((value >= b).astype(np.uint8) for b in bounds)


def word_keys(words: list[str]) -> np.ndarray:
    """The hashes that ``observe`` gives these words (runs of letters)."""
    text = "\n".join(words)
    _, _, _, key, _ = _words(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)) if text else (0, 0, 0, np.empty(0, np.uint64), 0)
    return np.unique(key)


def _words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of characters; and beginnings, lengths and hashes of the runs of letters that are not wide."""
    table, low = kinds()
    small = np.minimum(code, 65_536)
    kind = table[small]
    kind[(code >= 0x20000) & (code < 0x40000)] = WIDE
    letter = (kind == LOWER) | (kind == UPPER)
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(letter)
    if not len(at):
        return kind, begin, end - begin, np.empty(0, np.uint64), at
    offset = at - np.repeat(begin, end - begin)
    mixed = mix64(low[small[at]].astype(np.uint64) + np.uint64(1)) * _powers(int(offset.max()) + 1)[offset]
    return kind, begin, end - begin, mix64(np.add.reduceat(mixed, np.cumsum(end - begin) - (end - begin))), at


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def observe(texts: list[str | None], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of each text, statistics of every unit in the order of ``SIZES``, characters of every unit without white space)."""
    own = [t or "" for t in texts]
    code = np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in own])
    kind, w_begin, w_length, w_key, _ = _words(code)
    solid = kind > LINE
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(len(own), np.int64), np.empty((0, len(SIZES)), np.uint8), np.empty(0, np.int32)
    # Tokens are runs between white space; a unit ends with a line, or with the token that passes a multiple of UNIT.
    fresh = np.concatenate([[True], np.diff(at) > 1])
    line_begin = np.concatenate([[-1], np.flatnonzero(kind == LINE)])
    line = np.searchsorted(line_begin, at, side="left") - 1
    token = np.flatnonzero(fresh)
    width = np.diff(np.append(token, len(at)))
    column = at - line_begin[line] - 1
    part = np.repeat(column[token] // UNIT, width) + (np.arange(len(at)) - np.repeat(token, width)) // UNIT
    cut = np.concatenate([[True], (np.diff(line) > 0) | (np.diff(part) > 0)])
    unit = np.flatnonzero(cut)
    token = np.flatnonzero(fresh | cut)
    of_char = np.cumsum(cut) - 1
    of_token = of_char[token]
    n = len(unit)
    document = np.searchsorted(ends, at[unit], side="right")
    sign, here = code[at], kind[at]

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, unit, dtype=np.int32)

    def per_token(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, token, dtype=np.int32)

    def has(*marks: str) -> np.ndarray:
        return np.isin(sign, np.array([ord(c) for c in "".join(marks)], np.uint32))

    size = np.diff(np.append(unit, len(at)))
    upper, letter, wide, digit = here == UPPER, (here == LOWER) | (here == UPPER), here == WIDE, here == DIGIT
    letters, cjk, digits = total(letter), total(wide), total(digit)
    symbols = np.maximum(0, size - letters - cjk - digits) / np.maximum(1, size)
    rich = (cjk >= (letters + cjk) / 2) & (cjk > 0)
    # Words.
    w_unit = of_char[np.searchsorted(at, w_begin)]
    words = np.bincount(w_unit, minlength=n)
    each = np.maximum(1, words)
    count = np.where(rich, cjk // 2, words)
    short = np.bincount(w_unit, (w_length >= 2) & (w_length <= 3), n) / each
    single = np.bincount(w_unit, w_length == 1, n) / each
    common = np.bincount(w_unit, np.isin(w_key, frequent) & (w_length > 1), n) / each
    distinct = np.unique(mix64(w_key ^ mix64(w_unit.astype(np.uint64))), return_index=True)[1]
    varied = np.bincount(w_unit[distinct], minlength=n) / each
    # Units that stood in the document before.
    offset = np.arange(len(at)) - np.repeat(unit, size)
    text_key = mix64(np.add.reduceat(mix64(sign.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[offset], unit))
    first = np.unique(mix64(text_key ^ mix64(document.astype(np.uint64))), return_index=True)[1]
    again = np.ones(n, bool)
    again[first] = False
    wordy = (words >= 8) & ~rich
    repeat = np.where(again, 3, np.where(wordy & (varied < 0.3), 2, (wordy & (varied < 0.5)).astype(np.int64)))
    # Tokens.
    length = np.diff(np.append(token, len(at)))
    t_letters, t_upper, t_digits = per_token(letter | wide), per_token(upper), per_token(digit)
    odd = per_token(here == SIGN)
    # A capital may open a token, also behind a bracket or quotation mark.
    initial = (here[token] == UPPER) | (here[np.minimum(token + 1, len(at) - 1)] == UPPER)
    clean = (t_letters > 0) & (t_digits == 0) & (odd == 0) & ((t_upper == 0) | (t_upper == t_letters) | ((t_upper == 1) & initial))
    tokens = np.bincount(of_token, minlength=n)
    cleaned = np.bincount(of_token, clean, n) / np.maximum(1, tokens)
    longest = np.maximum.reduceat(length, np.flatnonzero(np.diff(np.concatenate([[-1], of_token])) > 0))
    alone = np.bincount(of_token, (length == 1) & has(CRUMBS)[token], n)
    lead = np.flatnonzero(np.diff(np.concatenate([[-1], of_token])) > 0)
    last_of_lead = token[lead] + length[lead] - 1
    closing = has(".)")[last_of_lead]
    number = closing & (t_digits[lead] >= 1) & (t_digits[lead] <= 4) & (length[lead] - t_digits[lead] <= 2) & (t_letters[lead] == 0)
    lettered = closing & (t_letters[lead] == 1) & (length[lead] <= 3) & (t_digits[lead] == 0)
    box = has("[")[token[lead]] & (length[lead] <= 3)
    marked = (tokens > 1) & (part[unit] == 0) & ((has(BULLETS)[token[lead]] & (length[lead] == 1)) | number | lettered | box)
    # Columns and signs.
    tree = total((sign >= 0x2500) & (sign <= 0x257F)) > 0
    bars, semis, commas = total(has("|")), total(has(";")), total(has(","))
    gap = np.concatenate([[0], np.diff(at)])
    gap[unit] = 0
    tabs = np.concatenate([[0], np.cumsum(code == 9)])
    tabbed = total(np.concatenate([[0], tabs[at[1:]] - tabs[at[:-1]]]) * ~cut) > 0
    wide_gap = total(gap > 3) > 0
    columns = (bars >= 2) | (semis >= 2) | wide_gap | tabbed | ((commas >= 2) & (digits > 2) & (tokens == 1))
    separators = np.where(tree, 3, np.where(columns, 2, (bars > 0).astype(np.int64)))
    crumbs = alone + commas * (commas > 0.25 * count)
    assign = has("=:")
    assign[unit + size - 1] = False
    pair = (total(assign) >= 1) & (tokens <= 3) & (words <= 6) & ~rich
    between = np.concatenate([[False], (here[1:-1] >= INNER) & has(":-")[1:-1] & (here[:-2] == DIGIT) & (here[2:] == DIGIT), [False]]) if len(at) > 2 else np.zeros(len(at), bool)
    stamp = (total(between) >= 2) & (total(between) >= 0.2 * count)
    mean = letters / each
    out = np.stack(
        [
            steps(count, 1, 3, 5, 9),
            np.where(rich, 3, steps(short, 0.08, 0.2)),
            np.where(rich, 3, steps(common, 0.08, 0.2)),
            steps(digits / np.maximum(1, size), 0.02, 0.12, 0.3),
            steps(symbols, 0.06, 0.15, 0.4),
            has(END_MARKS)[unit + size - 1],
            np.where(tree, 2, marked),
            separators,
            pair,
            repeat,
            np.where(rich, 3, np.where((single > 0.6) & (words > 3), 0, np.where((mean > 14) | (longest > 45), 2, 1))),
            steps(crumbs / np.maximum(1, count), 0.12, 0.3),
            stamp,
            np.where(rich, 4, steps(cleaned, 0.35, 0.6, 0.8)),
        ],
        axis=1,
    ).astype(np.uint8)
    return np.bincount(document, minlength=len(own)), out, size.astype(np.int32)


def evident(observed: np.ndarray) -> np.ndarray:
    """The state of the units that can be no other: 0 to 3, or -1 for all that are not evident."""
    v = dict(zip(SIZES, observed.T, strict=True))
    out = np.full(len(observed), -1, np.int8)
    plain = (v["repeat"] == 0) & (v["separators"] == 0) & (v["opening"] == 0) & (v["stamp"] == 0) & (v["pair"] == 0) & (v["crumbs"] == 0)
    sentence = (v["words"] == 4) & (v["length"] != 0) & (((v["clean"] >= 3) & (v["end"] == 1)) | ((v["frequent"] == 3) & (v["clean"] >= 2)))
    out[plain & (v["frequent"] >= 2) & sentence] = 0
    out[(v["opening"] == 1) & (v["words"] >= 1) & (v["words"] <= 2) & (v["separators"] == 0) & (v["repeat"] == 0) & (v["frequent"] <= 1)] = 1
    out[(v["separators"] == 2) & (v["repeat"] == 0) & (v["stamp"] == 0) & (v["frequent"] <= 1)] = 2
    machine = (v["repeat"] >= 2) | (v["opening"] == 2) | (v["length"] == 0) | (v["length"] == 2) | (v["stamp"] == 1) | ((v["pair"] == 1) & (v["words"] <= 2))
    out[machine & (v["separators"] != 2) & (v["opening"] != 1)] = 3
    return out


@dataclass(frozen=True)
class Model:
    """Logarithms of the start, transition and emission probabilities; emissions of all statistics end to end, by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def model_of(counts: np.ndarray, there: np.ndarray | None = None) -> Model:
    """The model of a row of counts: starts, transitions, emissions; each distribution with one unit added.

    States that are not ``there``, since no unit of the corpus is evidently of them, are never entered.
    """
    there = np.ones(4) if there is None else np.maximum(there, 1e-12)
    start, move, emit = (counts[:4] + 1) * there, (counts[4:20].reshape(4, 4) + 1) * there, counts[20:].reshape(4, -1) + 1
    emit = np.concatenate([e / e.sum(axis=1, keepdims=True) for e in np.split(emit, EDGES[1:-1], axis=1)], axis=1)
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit))


def likelihoods(model: Model, observed: np.ndarray) -> np.ndarray:
    """Log-likelihood of each unit in each state, to the power ``EVIDENCE``."""
    return EVIDENCE * sum(model.emit[:, EDGES[i] + observed[:, i]].T for i in range(len(SIZES)))


def _waves(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Documents by falling length, and how many of them reach each position."""
    order = np.argsort(-lengths, kind="stable")
    reach = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    return order, reach.tolist()


def posterior(model: Model, observed: np.ndarray, lengths: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of each unit given its document, and expected transitions; all documents move together.

    ``held`` fixes the state of units where it is not -1.
    """
    ll = likelihoods(model, observed)
    if held is not None:
        at = np.flatnonzero(held >= 0)
        fixed = np.full((len(at), 4), -60.0)
        fixed[np.arange(len(at)), held[at]] = 0
        ll[at] += fixed
    weight = np.exp(ll - ll.max(axis=1, keepdims=True))
    move, begin = np.exp(model.move), np.cumsum(lengths) - lengths
    order, reach = _waves(lengths)
    ahead, back, pairs = np.empty_like(weight), np.ones_like(weight), np.zeros((4, 4))
    begin = begin[order]
    for i, n in enumerate(reach):
        at = begin[:n] + i
        value = (np.exp(model.start) if i == 0 else ahead[at - 1] @ move) * weight[at]
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    for i in range(len(reach) - 2, -1, -1):
        at = begin[: reach[i + 1]] + i
        follow = weight[at + 1] * back[at + 1]
        value = follow @ move.T
        back[at] = value / value.sum(axis=1, keepdims=True)
        each = np.einsum("ni,nj->nij", ahead[at], follow) * move
        pairs += (each / each.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    gamma = ahead * back
    return gamma / gamma.sum(axis=1, keepdims=True), pairs


def best_path(model: Model, observed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The state of each unit on its document's most likely path (Viterbi); all documents move together."""
    score = likelihoods(model, observed)
    came = np.zeros(score.shape, np.int8)
    begin = np.cumsum(lengths) - lengths
    order, reach = _waves(lengths)
    begin = begin[order]
    for i, n in enumerate(reach):
        at = begin[:n] + i
        if i == 0:
            score[at] += model.start
            continue
        through = score[at - 1][:, :, None] + model.move
        came[at] = through.argmax(axis=1)
        score[at] += through.max(axis=1)
    path = np.zeros(len(score), np.int8)
    for i in range(len(reach) - 1, -1, -1):
        n, longer = reach[i], reach[i + 1] if i + 1 < len(reach) else 0
        at = begin[:n] + i
        path[at[longer:]] = score[at[longer:]].argmax(axis=1)
        path[at[:longer]] = came[at[:longer] + 1, path[at[:longer] + 1]]
    return path


def expected_counts(model: Model | None, observed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Expected counts of starts, transitions and emissions; without a model those of the evident units alone."""
    held = evident(observed)
    if model is None:
        gamma, pairs = (held[:, None] == np.arange(4)).astype(float), np.zeros((4, 4))
        follow = np.flatnonzero((held[:-1] >= 0) & (held[1:] >= 0))
        follow = follow[~np.isin(follow + 1, np.cumsum(lengths))]
        np.add.at(pairs, (held[follow], held[follow + 1]), 1)
    else:
        gamma, pairs = posterior(model, observed, lengths, held)
    emit = np.stack([np.concatenate([np.bincount(observed[:, i], gamma[:, s], k) for i, k in enumerate(SIZES.values())]) for s in range(4)])
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    return np.concatenate([gamma[first].sum(axis=0), pairs.ravel(), emit.ravel()])


def frequent_words(documents: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The ``most`` words of two letters or more that most documents have, over all documents; equally frequent ones by name."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(\p{L}{2,})"), 1))
    counted = documents.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def observations(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, units, stats, sizes): every text's statistics, one byte each, unit after unit; a written table."""
    own = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    keys = word_keys(frequent_words(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts, 1 << 20):
                count, stats, size = observe(texts[begin:end], keys)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(count), ragged_binary(stats.ravel(), count * len(SIZES)), ragged_binary(size, count)], ["doc_id", "units", "stats", "sizes"])

    return materialise(own.mapInArrow(run, "doc_id bigint, units bigint, stats binary, sizes binary"), "lines")


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return from_binary(batch.column("stats"), np.uint8)[0].reshape(-1, len(SIZES)), batch.column("units").to_numpy(), from_binary(batch.column("sizes"), np.int32)[0]


def fit(lines: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all ``observations``: counts of the evident units, then ``rounds`` of Baum-Welch, summed on each task's side.

    A round sends one row of counts (a fixed number) from each task.
    """
    spark = lines.sparkSession
    width = 20 + 4 * int(EDGES[-1])
    model = there = None
    for _ in range(rounds + 1):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            sums = np.zeros(width)
            for batch in batches:
                for begin in range(0, batch.num_rows, 4_096):
                    observed, lengths, _ = _read(batch.slice(begin, 4_096))
                    if len(observed):
                        sums += expected_counts(sent.value, observed, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(sums)], ["at", "n"])

        summed = lines.select("units", "stats", "sizes").mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n"))
        counts = np.zeros(width)
        for r in summed.collect():
            counts[r["at"]] = r.n
        there = counts[20:].reshape(4, -1).sum(axis=1) > 0 if there is None else there
        model = model_of(counts, there if there.any() else None)
    return model


def label_shares(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, units, prose, list, table, junk, labels): a text's number of units, each label's share of its characters, and
    the units' labels in order, one letter each (p, l, t, j).

    A null, empty or blank text has 0 units, null shares and no labels. Repeated rows keep a row each, null ids drop out, other
    columns are ignored. Texts are read where they lie and in full; only counts of words and of statistics are shuffled. An
    empty table gives no rows.
    """
    lines = observations(documents, id_col, text_col)
    sent = lines.sparkSession.sparkContext.broadcast(fit(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4_096):
                part = batch.slice(begin, 4_096)
                observed, lengths, size = _read(part)
                path = best_path(sent.value, observed, lengths)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                chars = np.bincount(owner * 4 + path, size, 4 * len(lengths)).reshape(-1, 4)
                with np.errstate(invalid="ignore"):
                    shares = chars / chars.sum(axis=1, keepdims=True)
                letters = np.frombuffer(b"pltj", np.uint8)[path]
                text = ragged_binary(letters, lengths).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths), *(pa.array(shares[:, i], from_pandas=True) for i in range(4)), text], ["doc_id", "units", *STATES, "labels"])

    return lines.mapInArrow(run, "doc_id bigint, units bigint, prose double, list double, table double, junk double, labels string")


def text_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, mean_word_length, symbol_ratio, end_punctuation_share and common_word_share, all in the JVM.

    Words are runs of letters; common words are the ``frequent_words`` of the table; symbols are characters that are neither
    letters, digits nor white space; shares are of non-blank lines and of words. A null, empty or blank text has 0 words and
    null shares. Repeated rows keep a row each and other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")
    known = frequent_words(documents, text_col)
    base = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), words.alias("w"), lines.alias("l"))
    solid = F.length(F.regexp_replace("text", r"\s", ""))
    size = F.size("w").cast("bigint")
    return base.select(
        "doc_id",
        size.alias("words"),
        F.when(size > 0, F.round(F.length(F.array_join("w", "")) / size, 6)).alias("mean_word_length"),
        F.when(solid > 0, F.round(F.length(F.regexp_replace("text", r"[\s\p{L}\p{N}]", "")) / solid, 6)).alias("symbol_ratio"),
        F.when(F.size("l") > 0, F.round(F.size(F.filter("l", lambda x: x.rlike(r"[.!?。！？]\s*$"))) / F.size("l"), 6)).alias("end_punctuation_share"),
        F.when(size > 0, F.round(F.size(F.filter("w", lambda x: x.isin(*known))) / size, 6)).alias("common_word_share"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = label_shares(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shares.filter((F.col("units") > 0) & (F.col("prose") < PROSE_LEAST)).select("doc_id").distinct()


def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every document's lines and their shares."""
    return label_shares(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
