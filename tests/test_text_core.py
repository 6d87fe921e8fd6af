import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scopegrain.functions import text as T
from scopegrain.operators import chunkers, fold, structure


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


def slow_terms(text):
    stop, out = set(T.STOP_WORDS), []
    for word in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]{1,}", text):
        if word.lower() not in stop:
            out += [p for p in re.split("_+", word.lower()) if len(p) >= 2 and p not in stop]
    for run in re.findall("[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]{2,}", text):
        out += [run[i : i + 2] for i in range(len(run) - 1) if run[i : i + 2] not in stop]
        if len(run) <= 4 and run not in stop:
            out.append(run)
    return out


@pytest.mark.parametrize("text", ["getUserName get_user_name _x 2abc the theory", "索引 向量索引 一个 混合text向量检索系统", "", "a _ __ x_", "日本 x 索引树"])
def test_terms(spark, text):
    assert Counter(value(spark, T.terms("t"), text)) == Counter(slow_terms(text))


def test_query_cleaning(spark):
    assert value(spark, T.clean_query("t"), "# find ```x\ny``` the `code` \u00a0 *now*") == "find the code now"
    assert value(spark, T.clean_query("t"), "###") == "###"
    assert value(spark, T.clean_query("t"), None) is None


def test_token_estimate_counts_utf16(spark):
    assert value(spark, T.estimate_tokens("t"), "😀😀") == 1
    assert value(spark, T.estimate_tokens("t"), "索引abcd") == 4
    assert value(spark, T.estimate_tokens("t"), "") == 0


def test_signature_terms_and_first_line(spark):
    assert value(spark, T.code_signature("t"), "x\n  export async function run(a) {\n}") == "export async function run(a)"
    assert value(spark, T.code_signature("t"), "plain") is None
    assert value(spark, T.key_terms("t", 2), "beta alpha beta gamma alpha") == ["beta", "alpha"]
    assert value(spark, T.first_line("t"), "short\n" + "long line " * 20).endswith("...")


def test_paths_and_sizes(spark):
    wanted = T.wanted_path("t", [".py"], ["dist"])
    assert [value(spark, wanted, p) for p in ("a/b.PY", "a\\dist\\b.py", "a/b.md", "dist.py")] == [True, False, False, True]
    assert [value(spark, T.safe_relative("t"), p) for p in ("a/../b", "../b", "/a/../b", "./a", "a..b")] == [False, False, True, True, False]
    assert [value(spark, T.format_size(F.length("t") * 1024), x) for x in ("", "a", "a" * 1536)] == ["0B", "1.0KB", "1.5MB"]


def test_plain_chunks():
    assert chunkers.chunk_text("") == [] and chunkers.chunk_text(" \n ") == []
    assert [len(c.content) for c in chunkers.chunk_text("x" * 2000)] == [2000]
    lines = "\n".join(f"line {i} with words" for i in range(100))
    made = chunkers.chunk_text(lines)
    assert made[-1].end_line == 100 and all(len(c.content) <= 512 for c in made)
    assert made[1].content.split("\n")[0] in made[0].content
    assert all(b.start_line < a.end_line + 1 for a, b in zip(made, made[1:], strict=False))
    assert chunkers.chunk_text("a" * 300 + "\n" + "b" * 300, overlap=0)[1].content == "b" * 300


def test_markdown_sections():
    made = chunkers.chunk_markdown("intro\n# A\ntext\n### B\nmore\n```\n# C\n```\n## D\nend")
    assert [(c.heading, c.start_line) for c in made] == [("", 1), ("A", 2), ("A > B", 4), ("C", 7), ("C > D", 9)]
    long = "# T\n\n" + "\n\n".join("word " * 60 for _ in range(5))
    parts = chunkers.chunk_markdown(long)
    assert len(parts) > 1 and {c.heading for c in parts} == {"T"}


def test_python_chunks():
    code = "import a\nimport b\n\nX = 1\n\n@deco\ndef f():\n    return 1\n\nif X:\n    def g():\n        pass\nelse:\n    def h():\n        pass\n\nclass K:\n" + "\n".join(f"    def m{i}(self):\n        return {i}" for i in range(40))
    made = chunkers.chunk_source(code, ".py", name="m.py")
    assert [c.start_line for c in made] == sorted(c.start_line for c in made)
    assert made[0].heading == "[m.py] top-level" and made[1].content.startswith("import a\nimport b\n\n@deco")
    assert [c.heading.removeprefix("[m.py] > ") for c in made[1:4]] == ["decorated definition", "g", "K"] and made[0].end_line == 15
    assert len([c for c in made if c.heading.endswith("> K")]) > 2 and made[-1].end_line == len(code.split("\n"))
    assert chunkers.chunk_source("def (", ".py") == [] and chunkers.chunk_file("def (", "x.py")
    assert chunkers.chunk_source("def f(): pass", ".xyz") == [] and chunkers.chunk_source("", ".rs") == []


SOURCES = {
    ".ts": ('import a from "a";\nexport function f(x) {\n  return `}${x}`; // }\n}\nclass B { m() {} }\nconst g = async (x) => {\n  return x\n}\ninterface Q { a: string }\ntype T = { a: 1 };\nenum E { A }\ncall("{")\n', ["export statement", "B", "arrow function", "Q", "T", "E"], 1),
    ".rs": ("use a::b;\n#[derive(Debug)]\npub struct S { a: i32 }\nimpl S { fn x(&self) -> char { '}' } }\nmod inner { pub fn deep() {} }\npub async fn go<'a>(x: &'a str) -> i32 { let s = \"}\"; 1 }\ntrait R {}\n", ["S", "impl item", "deep", "go", "R"], 1),
    ".go": ('package main\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) M(x int) error {\n\treturn nil\n}\n\nfunc main() {\n\tfmt.Println("}")\n}\n', ["M", "main"], 1),
    ".java": ("package a.b;\nimport java.util.*;\n/** doc { */\n@Ann(1)\npublic final class Foo extends Bar { void m() { } }\ninterface I { }\nenum E { A }\n", ["Foo", "I", "E"], 2),
    ".c": ('#include <x.h>\n#define A {\nstatic int *add(int a, int b) {\n  return a;\n}\nstruct P { int x; };\nint main(void) { puts("}"); }\n', ["*add(int a, int b)", "main(void)"], 0),
    ".cs": ("using A;\nnamespace N {\n  [Attr]\n  public class C { void M() {} }\n  interface I { }\n}\n", ["C", "I"], 0),
    ".kt": ("import a.b\n\nfun f(x: Int): Int {\n  return x\n}\n\ndata class D(val a: Int)\n", ["f", "D"], 0),
    ".lua": ("-- function no()\nlocal function f(x)\n  return x\nend\n", ["f"], 0),
}


@pytest.mark.parametrize("ending", sorted(SOURCES))
def test_structures_of_a_language(ending):
    code, names, imports = SOURCES[ending]
    found = structure.parts(code, ending)
    assert [p.name or p.kind.replace("_", " ") for p in sorted(found, key=lambda p: p.start) if p.split] == names
    assert sum(p.imports for p in found) == imports
    made = chunkers.chunk_source(code, ending, name=f"m{ending}")
    assert [c.heading for c in made if "top-level" not in c.heading] == [f"[m{ending}] > {n}" for n in names]
    for text in (code[:-9], code[: len(code) // 2], code.replace("}", "")):
        assert chunkers.chunk_file(text, f"x{ending}")


def test_stretches_of_pieces():
    made = chunkers.spans(["", "aa", "b" * 9, "c", "😀😀"], "\n", 6, 3)
    assert [(s.text, s.again, s.first, s.after) for s in made] == [("aa", "", 1, 2), ("aa\n" + "b" * 9, "aa", 2, 3), ("bbb\nc", "bbb", 3, 4), ("b\nc\n😀😀", "b\nc", 4, 5)]
    assert chunkers.spans([], "\n", 6, 3) == [] and chunkers.spans(["", ""], "\n", 6, 3) == []
    # Half of a character is never repeated.
    assert [s.text for s in chunkers.spans(["x😀", "y"], "\n", 3, 1)] == ["x😀", "\ny"]

def test_chunk_table_handles_nulls(spark):
    df = spark.createDataFrame([(1, "a.md", "# H\nx"), (2, None, "y"), (3, "b.py", None), (4, "c.py", "")], "doc bigint, p string, t string")
    got = chunkers.chunk_documents(df, "doc", "p", "t").collect()
    assert sorted((r.id, r.heading) for r in got) == [(1, "H"), (2, "")]


def page(spark):
    rows = [(1, i + 1, "p.md", 1, 9, s, 0.5, ("word " * 30 * (i + 1)).strip(), "H", None, False) for i, s in enumerate((0.9, 0.6, 0.5, 0.3))]
    return spark.createDataFrame(rows, "query_id bigint, rank int, path string, start_line int, end_line int, similarity double, logic_depth double, content string, heading string, matched array<string>, is_secondary boolean")


def test_levels_and_formats(spark):
    levels = {r["rank"]: r.level for r in fold.fold(page(spark)).collect()}
    assert levels[1] == 3 and levels[4] == 0
    row = fold.fold_forced(page(spark), 0).orderBy("rank").first()
    assert row.formatted == "[1] p.md (L1-L9) [0.9]"
    assert "───" in fold.fold_forced(page(spark), 2).first().formatted


def slow_budget(hits, budget, full):
    costs = {h["rank"]: (h["t0"], h["t1"], h["t3"], h["s"]) for h in hits}
    if sum(c[0] for c in costs.values()) > budget:
        out, used = {}, 0
        for r in sorted(costs):
            if used + costs[r][0] > budget:
                break
            out[r], used = 0, used + costs[r][0]
        return out
    levels, used = dict.fromkeys(costs, 0), sum(c[0] for c in costs.values())
    for target, at in ((1, 1), (3, 2)):
        for r in sorted(costs, key=lambda r: (-costs[r][3], r)):
            more = costs[r][at] - costs[r][{0: 0, 1: 1}[levels[r]]]
            if used + more <= budget and (target == 1 or costs[r][3] >= full):
                levels[r], used = target, used + more
    return levels


@pytest.mark.parametrize("budget", [10, 30, 60, 100, 200, 1000])
def test_budget_against_a_plain_reading(spark, budget):
    hits = page(spark)
    tokens = {lv: {r["rank"]: r.tokens for r in fold.fold_forced(hits, lv).collect()} for lv in (0, 1, 3)}
    full = fold.thresholds(hits).first().full_threshold
    rows = [{"rank": r["rank"], "t0": tokens[0][r["rank"]], "t1": tokens[1][r["rank"]], "t3": tokens[3][r["rank"]], "s": r.similarity} for r in hits.collect()]
    got = fold.fold_budget(hits, budget).collect()
    assert {r["rank"]: r.level for r in got} == slow_budget(rows, budget, full)
    assert sum(r.tokens for r in got) <= budget
