"""Text functions as column expressions: terms, query cleaning, digests, token estimates, paths and sizes.

Null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms; English, code and Chinese.
STOP_WORDS = tuple(
    dict.fromkeys(
        """
the a an is are was were be been being have has had do does did will would could should may might shall can need must ought
and but or nor not so yet both either neither each every all any few more most other some such no only own same than
too very just because as until while of at by for with about against between through during before after above below to from up
down in out on off over under again further then once here there when where why how what which who whom this that these those
it its i me my we our you your he him his she her they them their
const let var function return import export class interface type string number boolean null undefined true false new if else
switch case break continue try catch throw async await void public private protected static
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们
""".split()
    )
)
#: Fixed patterns: Latin terms, Chinese runs, a declaration's first line.
LATIN = "[a-zA-Z_][a-zA-Z0-9_]{1,}"
HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]{2,}"
SIGNATURE = r"(?m)^[ \t]*(export\s+)?(default\s+)?(async\s+)?(function|class|interface|type|const|enum)\s+\w+[^{;]*"
#: White space as a script engine trims it, which is more than ``\s`` matches here.
SPACE = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside lambdas nothing else keeps it from being computed at every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def latin_terms(text: Column | str) -> Column:
    """Lower-cased identifiers without stop words, split at underscores; parts of one letter and stop words drop out."""
    words = F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(LATIN), F.lit(0)), F.lower), lambda w: ~is_stop(w))
    parts = F.flatten(F.transform(words, lambda w: F.split(w, "_+")))
    return F.filter(parts, lambda p: (F.length(p) >= 2) & ~is_stop(p))


def han_terms(text: Column | str) -> Column:
    """All pairs of neighbours in runs of Chinese characters, and runs of up to four as a whole (a pair counts twice)."""
    runs = F.regexp_extract_all(col(text), F.lit(HAN), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    whole = F.filter(runs, lambda r: F.length(r) <= 4)
    return F.filter(F.concat(pairs, whole), lambda t: ~is_stop(t))


def terms(text: Column | str) -> Column:
    """All terms of a text, repeated ones kept."""
    return F.concat(latin_terms(text), han_terms(text))


def trim(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def clean_query(text: Column | str) -> Column:
    """A query without fenced code, inline code marks and Markdown signs, white space collapsed; the query itself if empty."""
    plain = F.regexp_replace(col(text), r"(?s)```.*?```", "")
    plain = F.regexp_replace(plain, "`([^`]+)`", "$1")
    plain = F.regexp_replace(plain, r"[#*_~>|]", "")
    plain = trim(F.regexp_replace(plain, f"{SPACE}+", " "))
    return F.when(plain == "", col(text)).otherwise(plain)


def utf16_length(text: Column | str) -> Column:
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("bigint")


def estimate_tokens(text: Column | str) -> Column:
    """1.5 tokens for each Chinese character and a quarter for each other UTF-16 unit, rounded up."""
    han = F.regexp_count(col(text), F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.ceil(han * 1.5 + (utf16_length(text) - han) / 4).cast("bigint")


def round3(value: Column | str) -> Column:
    """Three decimals, halves up."""
    return F.floor(col(value) * 1000 + 0.5) / 1000


def content_hash(content: Column | str) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(col(content).cast("binary"), 256), 1, 16)


def code_signature(content: Column | str) -> Column:
    """The first declaration, trimmed and cut to 100 characters; null if there is none."""
    return let(F.regexp_extract(col(content), SIGNATURE, 0), lambda x: F.when(x != "", F.substring(trim(x), 1, 100)))


def key_terms(content: Column | str, n: int = 5) -> Column:
    """The ``n`` most frequent terms, equally frequent ones by first place."""

    def ranked(own: Column) -> Column:
        each = F.transform(F.array_distinct(own), lambda t, i: F.struct((-F.size(F.filter(own, lambda x: x == t))).alias("n"), i.alias("i"), t.alias("t")))
        return F.transform(F.slice(F.array_sort(each), 1, n), lambda s: s["t"])

    return let(terms(content), ranked)


def first_line(content: Column | str) -> Column:
    """The first line with more than ten characters, cut to 80; null if there is none."""
    line = trim(F.try_element_at(F.filter(F.split(col(content), "\n", -1), lambda x: F.length(trim(x)) > 10), F.lit(1)))
    return let(line, lambda x: F.when(F.length(x) > 80, F.concat(F.substring(x, 1, 80), F.lit("..."))).otherwise(x))


def structural_digest(content: Column | str, heading: Column, tags: Column, residual: Column) -> Column:
    """Heading, declaration, up to five tags and the weak-signal note, else key terms, else the first line.

    ``tags`` is a list or null, ``residual`` a boolean or null.
    """
    tagged = F.coalesce(F.size(tags) > 0, F.lit(False))

    def parts(signature: Column) -> Column:
        fingerprint = F.when(signature.isNull() & ~tagged, F.array_join(key_terms(content), " · "))
        return F.concat_ws(
            "\n    ",
            F.when(heading != "", F.concat(F.lit("📂 "), heading)),
            F.concat(F.lit("⚡ "), signature),
            F.when(tagged, F.concat(F.lit("🏷️ "), F.array_join(F.slice(tags, 1, 5), ", "))),
            F.when(residual, F.lit("🔍 弱信号发现")),
            let(fingerprint, lambda x: F.when(x != "", F.concat(F.lit("📝 "), x))),
        )

    return let(let(code_signature(content), parts), lambda p: F.when(p != "", p).otherwise(F.coalesce(first_line(content), F.lit(""))))


def key_lines(content: Column | str) -> Column:
    """The first four lines with more than five characters, cut to 150; dots if the content is longer than that."""
    lines = F.slice(F.filter(F.split(col(content), "\n", -1), lambda x: F.length(trim(x)) > 5), 1, 4)
    return F.concat(F.substring(F.array_join(lines, "\n"), 1, 150), F.when(utf16_length(content) > 150, F.lit("...")).otherwise(F.lit("")))


def header(index: Column, path: Column, start: Column, end: Column, similarity: Column) -> Column:
    """``[1] path (L1-L9) [0.5]``; the score as a script prints it, without trailing zeros; a question mark for a null line or path."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    score = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", similarity), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), known(path), F.lit(" (L"), known(start), F.lit("-L"), known(end), F.lit(") ["), score, F.lit("]"))


def format_level(level: Column, head: Column, digest: Column, lines: Column, content: Column) -> Column:
    """A hit at a level of detail: 0 header, 1 digest, 2 key lines, 3 and 4 the whole content; others as 0."""
    rule = "\n    ───\n    "
    return (
        F.when(level == 1, F.concat(head, F.lit("\n    "), digest))
        .when(level == 2, F.concat(head, F.lit("\n    "), digest, F.lit(rule), lines))
        .when(level.isin(3, 4), F.concat(head, F.lit("\n    "), digest, F.lit(rule), content))
        .otherwise(head)
    )


def extension(path: Column | str) -> Column:
    """The lower-cased ending of a path's last component, with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(col(path), r"[^/\\](\.[^./\\]*)$", 1))


def wanted_path(path: Column | str, extensions: list[str], ignore: list[str]) -> Column:
    """Whether a path has a wanted ending and no component that equals an ignored name."""
    parts = F.split(F.regexp_replace(col(path), r"\\", "/"), "/")
    return extension(path).isin(*extensions) & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignore)))


def format_size(size: Column | str) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    n = col(size)
    return F.when(n.isNull(), None).when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024), F.lit("KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576), F.lit("MB")))


def safe_relative(path: Column | str) -> Column:
    """Whether a path is accepted from a user: a relative one must not have two dots in a row anywhere."""
    return ~col(path).contains("..") | col(path).startswith("/")


def infer_provider(model: Column | str, base_url: Column | None = None) -> Column:
    """The embedding provider that a model's name or address belongs to."""
    name = col(model)
    by_name = F.when(name.startswith("text-embedding"), "openai").when(name.startswith("models/"), "google").otherwise("ollama")
    if base_url is None:
        return by_name
    by_url = F.when(base_url.contains("openai.com"), "openai").when(base_url.contains("localhost:11434") | base_url.contains("ollama"), "ollama").when(base_url.contains("googleapis.com"), "google").otherwise("custom")
    return F.when(base_url.isNull() | (base_url == ""), by_name).otherwise(by_url)


def migration_action(matches: Column, dimensions_changed: Column, strategy: Column) -> Column:
    """What a changed model asks for: none, rebuild or warn."""
    return F.when(matches, "none").when(dimensions_changed | (strategy == "rebuild"), "rebuild").otherwise("warn")
