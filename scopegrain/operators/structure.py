"""The structures of source files: which spans are functions, classes and the like, which are imports, and what lies between.

Python is parsed. For the other languages a scanner blanks comments and strings, then cuts the text into top-level statements
by brackets, semicolons and line ends, and tells a statement's kind by its first words. Spans are offsets into the text.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Part:
    """A statement of a file: ``kind`` names a structure, or is empty; ``split`` says whether it is one to be cut out, and
    ``top`` whether it is a statement of the file itself rather than one inside another."""

    start: int
    end: int
    kind: str = ""
    name: str = ""
    imports: bool = False
    split: bool = False
    top: bool = True


#: Endings and their languages.
LANGUAGES = {
    ".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".mjs": "ts", ".py": "python", ".rs": "rust", ".go": "go", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "cs", ".swift": "swift",
    ".kt": "kotlin", ".lua": "lua", ".zig": "zig",
}

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|open|override|async|declare|default|readonly|virtual|inline|data|suspend|fileprivate)\s+)*"
#: Structures by their first words; the group is the name, where the kind has one.
KINDS: dict[str, list[tuple[str, str]]] = {
    "ts": [
        ("export_statement", r"export\b()"),
        ("function_declaration", r"(?:async\s+)?function\b\s*\*?\s*([\w$]*)"),
        ("class_declaration", r"class\s+([\w$]+)"),
        ("interface_declaration", r"interface\s+([\w$]+)"),
        ("type_alias_declaration", r"type\s+([\w$]+)[^=\n]*="),
        ("enum_declaration", r"(?:const\s+)?enum\s+([\w$]+)"),
    ],
    "rust": [
        ("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"),
        ("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
        ("enum_item", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
        ("impl_item", r"(?:unsafe\s+)?impl\b()"),
        ("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
    ],
    "go": [("method_declaration", r"func\s*\([^)]*\)\s*(\w+)"), ("function_declaration", r"func\s+(\w+)")],
    "java": [("class_declaration", rf"(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}class\s+(\w+)"), ("interface_declaration", rf"(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}interface\s+(\w+)"), ("enum_declaration", rf"(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}enum\s+(\w+)")],
    "c": [("function_definition", r"(?!typedef\b|struct\b[^(]*\{|union\b[^(]*\{|enum\b|#)[\w\s]*?[\s*]((?:\*\s*)*\w+\s*\([^;{}]*\))\s*\{")],
    "cpp": [("function_definition", r"(?!typedef\b|struct\b[^(]*\{|class\b[^(]*\{|union\b[^(]*\{|enum\b|namespace\b|#)[\w\s:<>,&~]*?[\s*&]((?:[*&]\s*)*[\w:~]+\s*\([^;{}]*\)[^;{}]*?)\s*\{")],
    "cs": [("class_declaration", rf"(?:\[[^\]]*\]\s*)*{_MODIFIERS}class\s+(\w+)"), ("interface_declaration", rf"(?:\[[^\]]*\]\s*)*{_MODIFIERS}interface\s+(\w+)"), ("enum_declaration", rf"(?:\[[^\]]*\]\s*)*{_MODIFIERS}enum\s+(\w+)")],
    "php": [("function_definition", r"function\s+(\w+)"), ("class_declaration", rf"{_MODIFIERS}class\s+(\w+)"), ("interface_declaration", r"interface\s+(\w+)"), ("enum_declaration", r"enum\s+(\w+)")],
    "swift": [("function_declaration", rf"(?:@\w+\s+)*{_MODIFIERS}func\s+(\w+)"), ("class_declaration", rf"(?:@\w+\s+)*{_MODIFIERS}(?:class|struct|enum|actor|extension)\s+(\w+)")],
    "kotlin": [("function_declaration", rf"(?:@\w+\s+)*{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class_declaration", rf"(?:@\w+\s+)*{_MODIFIERS}(?:enum\s+)?(?:class|interface)\s+(\w+)")],
    "ruby": [],
    "lua": [("function_declaration", r"(?:local\s+)?function\s+([\w.:]+)")],
    "zig": [("function_declaration", r"(?:pub\s+)?fn\s+(\w+)")],
}
IMPORTS = {"ts": r"import\b(?!\s*\()", "rust": r"(?:pub\s+)?use\b|extern\s+crate\b", "go": r"import\b", "java": r"(?:import|package)\b", "swift": r"import\b"}
#: Blocks that are looked into for structures, two levels down.
CONTAINERS = {"rust": r"(?:pub\s+)?mod\s+\w+\s*\{", "cs": r"namespace\b[^{;]*\{", "cpp": r"(?:namespace\b[^{;]*|extern\s+\"[^\"]*\"\s*)\{", "php": r"namespace\b[^{;]*\{", "ts": r"(?:declare\s+)?(?:namespace|module)\b[^{;]*\{"}
ARROW = re.compile(r"(?:const|let|var)\s+[\w$]+(?:\s*:[^=]+)?\s*=\s*((?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)(?:\s*:[^={]+)?\s*=>)")

_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_BLANK_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.DOTALL)
_BLANK_HASH = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_BLANK_DASH = re.compile(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
#: A line that ends so goes on in the next, and one that begins so belongs to the last.
_OPEN_END, _OPEN_START = re.compile(r"[,=+\-*/%&|^<>?:.(\[{]\s*$"), re.compile(r"\s*(?:[.,=+*/%&|^<>?:)\]{]|else\b|catch\b|finally\b)")
#: A line that is a statement whatever follows, and annotations, which belong to what follows.
_DIRECTIVE, _ANNOTATION = re.compile(r"\s*#\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error|region|endregion)\b[^\n]*\n"), re.compile(r"\s*(?:@[\w.]+(?:\([^;{}]*\))?\s*|\[[\w.(), =]*\]\s*)+")


def masked(text: str, language: str) -> str:
    """``text`` at the same length with comments and strings blanked, and brackets in directives."""
    pattern = {"rust": _BLANK_RUST, "ruby": _BLANK_HASH, "lua": _BLANK_DASH}.get(language, _BLANK)
    plain = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return re.sub(r"(?m)^[ \t]*#.*", lambda m: re.sub(r"[()\[\]{};]", " ", m[0]), plain) if language in ("c", "cpp", "cs") else plain


def statements(plain: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Spans of the statements between two offsets of a masked text, without white space at their ends.

    A statement ends with a semicolon or the brace that closes its block, outside of all brackets, or with its line where
    neither that line nor the next one goes on.
    """
    cuts, depth = [begin], 0
    for found in re.compile(r"[(\[{]|[)\]}]|;|\n|\Z").finditer(plain, begin, end):
        sign, at = found[0], found.end()
        if sign and sign in "([{":
            depth += 1
        elif sign and sign in ")]}":
            depth = max(0, depth - 1)
            if sign == "}" and not depth and not re.compile(r"[ \t]*(?:[;,.)(=]|else\b|catch\b|finally\b|while\b|as\b|from\b)").match(plain, at, end):
                cuts.append(at)
        elif depth:
            continue
        elif sign == ";":
            cuts.append(at)
        elif sign == "\n" and _DIRECTIVE.match(plain, cuts[-1], at):
            cuts.append(at)
        elif sign == "\n" and not _ANNOTATION.fullmatch(plain, cuts[-1], at) and not _OPEN_END.search(plain, cuts[-1], found.start()) and not _OPEN_START.match(plain, at, end):
            cuts.append(at)
    spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True) if plain[a:b].strip(" \t\r\n;")]
    return [(a + len(plain[a:b]) - len(plain[a:b].lstrip()), a + len(plain[a:b].rstrip())) for a, b in spans]


def scanned(text: str, language: str) -> list[Part]:
    """The statements of a file in a language with brackets, and the structures inside its containers."""
    plain = masked(text, language)
    kinds = [(kind, re.compile(pattern)) for kind, pattern in KINDS[language]]
    imports, container = re.compile(IMPORTS.get(language, r"(?!)")), re.compile(CONTAINERS.get(language, r"(?!)"))
    out = []

    def named(a: int, b: int, top: bool) -> Part | None:
        for kind, pattern in kinds:
            found = pattern.match(plain, a, b)
            if found:
                return Part(a, b, kind, " ".join(text[found.start(1) : found.end(1)].split()), split=True, top=top)
        return None

    for a, b in statements(plain, 0, len(plain)):
        if imports.match(plain, a, b):
            out.append(Part(a, b, imports=True))
            continue
        part = named(a, b, True)
        out.append(part or Part(a, b))
        if part:
            continue
        block = container.match(plain, a, b)
        if block:
            out += [p for p in (named(x, y, False) for x, y in statements(plain, block.end(), b - 1)) if p]
        arrow = ARROW.match(plain, a, b) if language == "ts" else None
        if arrow:
            out.append(Part(arrow.start(1), b - plain[a:b].endswith(";"), "arrow_function", split=True, top=False))
    return out


def parsed(text: str) -> list[Part]:
    """The statements of a Python file, and the definitions in the first block of its other statements; may raise SyntaxError."""
    lines = text.split("\n")
    begin = [0]
    for line in lines:
        begin.append(begin[-1] + len(line) + 1)

    def offset(line: int, column: int) -> int:
        return begin[line - 1] + len(lines[line - 1].encode()[:column].decode(errors="ignore"))

    def part(node: ast.stmt, top: bool) -> Part:
        end = offset(node.end_lineno, node.end_col_offset)
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return Part(offset(node.lineno, node.col_offset), end, imports=isinstance(node, ast.Import | ast.ImportFrom), top=top)
        if node.decorator_list:
            first = node.decorator_list[0]
            return Part(text.rindex("@", 0, offset(first.lineno, first.col_offset)), end, "decorated_definition", split=True, top=top)
        kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
        return Part(offset(node.lineno, node.col_offset), end, kind, node.name, split=True, top=top)

    out = []
    for node in ast.parse(text).body:
        own = part(node, True)
        out.append(own)
        if not own.split and not own.imports:
            out += [p for p in (part(x, False) for x in getattr(node, "body", []) if isinstance(x, ast.stmt)) if p.split]
    return out


def parts(text: str, ending: str) -> list[Part]:
    """The statements and structures of a source file by its ending; none for an unknown language or a text that does not parse."""
    language = LANGUAGES.get(ending)
    if language is None:
        return []
    if language != "python":
        return scanned(text, language)
    try:
        return parsed(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
