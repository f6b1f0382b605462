"""Symbols and raw edges of source files.

Python is read by its own parser.  Other languages are scanned: comments and strings
are blanked (positions kept), declarations found by patterns per language, and scopes
by matching brackets (Ruby: by ``end``).  The scan is an approximation of a full parser;
what it can't see are declarations made by macros or spread over odd line breaks.  Full
names hold the names of containers only, not of functions.

One pass gives both symbols and edges; files that can't be parsed give none.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    """How a language is scanned: (pattern with group ``n``, kind) of declarations, imports, exports, comments."""

    name: str
    extensions: tuple[str, ...]
    declarations: tuple[tuple[str, str], ...] = ()
    imports: tuple[str, ...] = ()
    exported: str = ""  # pattern on the declaration's start; "upper": a capital initial; "top": top level; "all"
    line_comments: tuple[str, ...] = ("//",)
    block_comments: bool = True
    blocks: str = "braces"
    quotes: str = "\"'`"
    members: tuple[str, ...] = ()  # kinds in whose bodies methods are looked for by brackets rather than by pattern


_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|override|virtual|readonly|partial|extern|unsafe|synchronized|native|default|strictfp)\s+)*"
_JS = (
    (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)", "class"),
    (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)", "function"),
    (r"(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)", "variable"),
)
_TS = (*_JS, (r"(?:export\s+)?(?:declare\s+)?interface\s+(?P<n>[\w$]+)", "interface"), (r"(?:export\s+)?(?:declare\s+)?type\s+(?P<n>[\w$]+)\s*(?:<[^=]*>)?\s*=", "type"), (r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)", "enum"), (r"(?:export\s+)?(?:declare\s+)?namespace\s+(?P<n>[\w$.]+)", "module"))
_JS_IMPORTS = (r"import\s+(?:[^;'\"]*?\sfrom\s+)?['\"](?P<m>[^'\"]+)['\"]", r"require\(\s*['\"](?P<m>[^'\"]+)['\"]\s*\)")
_C_FUNCTION = r"^(?:[A-Za-z_][\w:<>,*& \t]*[\s*&])(?:\w+::)*(?P<n>~?[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^;{}]*)?\{"
_INCLUDE = (r"#\s*include\s*[<\"](?P<m>[^>\"]+)[>\"]",)

LANGUAGES = (
    Language("typescript", ("ts",), _TS, _JS_IMPORTS, r"export\b", members=("class",)),
    Language("tsx", ("tsx",), _TS, _JS_IMPORTS, r"export\b", members=("class",)),
    Language("javascript", ("js", "jsx", "mjs", "cjs"), _JS, _JS_IMPORTS, r"export\b", members=("class",)),
    Language("python", ("py", "pyi"), blocks="ast"),
    Language("go", ("go",), ((r"^func\s+\([^)]*\)\s*(?P<n>\w+)", "method"), (r"^func\s+(?P<n>\w+)", "function"), (r"^type\s+(?P<n>\w+)\s+struct\b", "struct"), (r"^type\s+(?P<n>\w+)\s+interface\b", "interface"), (r"^type\s+(?P<n>\w+)\s+(?!struct\b|interface\b)", "type")), (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<m>[^\"]+)\"\s*$",), "upper"),
    Language("rust", ("rs",), ((r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<n>\w+)", "function"), (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)", "struct"), (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)", "enum"), (r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)", "trait"), (r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)", "type"), (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)", "module"), (r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)", "scope"), (r"macro_rules!\s*(?P<n>\w+)", "macro"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<n>[A-Z_][A-Z0-9_]*)\s*:", "variable")), (r"^\s*(?:pub\s+)?use\s+(?P<m>[^;]+);",), r"pub\b", quotes="\""),
    Language("java", ("java",), ((_MOD + r"class\s+(?P<n>\w+)", "class"), (_MOD + r"@?interface\s+(?P<n>\w+)", "interface"), (_MOD + r"enum\s+(?P<n>\w+)", "enum"), (_MOD + r"(?:<[^>]+>\s+)?(?!\s*(?:return|new|else|throw|assert|do|case|yield)\b)[\w<>\[\],.? ]+\s+(?P<n>\w+)\s*\([^;{}]*\)\s*(?:throws[^{;]+)?[{;]", "method"), (r"(?:(?:public|private|protected)\s+)(?P<n>[A-Z]\w*)\s*\([^;{}]*\)\s*(?:throws[^{;]+)?\{", "method")), (r"^\s*import\s+(?:static\s+)?(?P<m>[\w.*]+);",), r"[\s\w@]*?\bpublic\b", quotes="\"'"),
    Language("c", ("c", "h"), ((_C_FUNCTION, "function"), (r"^(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{", "struct"), (r"^(?:typedef\s+)?enum\s+(?P<n>\w+)\s*\{", "enum"), (r"^typedef\s+[^;{}]*?\b(?P<n>\w+)\s*;", "type")), _INCLUDE, "top", quotes="\"'"),
    Language("cpp", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), ((_C_FUNCTION, "function"), (r"class\s+(?P<n>\w+)\s*(?:final\s*)?(?::[^;{]*)?\{", "class"), (r"struct\s+(?P<n>\w+)\s*(?::[^;{]*)?\{", "struct"), (r"enum\s+(?:class\s+)?(?P<n>\w+)", "enum"), (r"(?:inline\s+)?namespace\s+(?P<n>[\w:]+)\s*\{", "module")), _INCLUDE, "top", quotes="\"'", members=("class", "struct")),
    Language("csharp", ("cs",), ((_MOD + r"class\s+(?P<n>\w+)", "class"), (_MOD + r"interface\s+(?P<n>\w+)", "interface"), (_MOD + r"struct\s+(?P<n>\w+)", "struct"), (_MOD + r"enum\s+(?P<n>\w+)", "enum"), (r"namespace\s+(?P<n>[\w.]+)", "module"), (_MOD + r"(?!\s*(?:return|new|else|throw|using|await|yield|case|goto|in)\b)[\w<>\[\],.? ]+\s+(?P<n>\w+)\s*(?:<[^>]+>)?\([^;{}]*\)\s*(?:where[^{;]+)?(?:\{|=>|;)", "method"), (r"(?:(?:public|private|protected|internal)\s+)(?P<n>[A-Z]\w*)\s*\([^;{}]*\)\s*(?::\s*(?:base|this)\s*\([^;{}]*\)\s*)?\{", "method")), (r"^\s*using\s+(?:static\s+)?(?P<m>[\w.]+);",), r"[\s\w]*?\bpublic\b", quotes="\"'"),
    Language("ruby", ("rb",), ((r"^[ \t]*class\s+(?P<n>[A-Z][\w:]*)", "class"), (r"^[ \t]*module\s+(?P<n>[A-Z][\w:]*)", "module"), (r"^[ \t]*def\s+(?:self\.)?(?P<n>[\w?!=]+)", "method")), (r"^\s*require(?:_relative)?\s+['\"](?P<m>[^'\"]+)['\"]",), "all", ("#",), False, "end", "\"'"),
    Language("bash", ("sh", "bash"), ((r"^[ \t]*function\s+(?P<n>[\w:-]+)", "function"), (r"^[ \t]*(?P<n>[\w:-]+)\s*\(\)\s*\{", "function")), (r"^\s*(?:source|\.)\s+(?P<m>\S+)",), "all", ("#",), False, "braces", "\"'"),
    Language("php", ("php",), ((r"(?:(?:abstract|final)\s+)*class\s+(?P<n>\w+)", "class"), (r"interface\s+(?P<n>\w+)", "interface"), (r"trait\s+(?P<n>\w+)", "trait"), (r"enum\s+(?P<n>\w+)", "enum"), (_MOD + r"function\s+&?(?P<n>\w+)", "function")), (r"^\s*use\s+(?P<m>[\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<m>[^'\"]+)['\"]"), r"(?!.*\b(?:private|protected)\b)", ("//", "#"), True, "braces", "\"'"),
    Language("zig", ("zig",), ((r"(?:pub\s+)?(?:export\s+|inline\s+)*fn\s+(?P<n>\w+)", "function"), (r"(?:pub\s+)?const\s+(?P<n>\w+)\s*=\s*(?:packed\s+|extern\s+)?struct\b", "struct"), (r"(?:pub\s+)?const\s+(?P<n>\w+)\s*=\s*enum\b", "enum"), (r"(?:pub\s+)?const\s+(?P<n>\w+)\s*=(?!\s*(?:struct|enum|packed|extern|@import))", "variable")), (r"@import\(\s*\"(?P<m>[^\"]+)\"\s*\)",), r"pub\b", quotes="\""),
)
BY_EXTENSION = {e: lang for lang in LANGUAGES for e in lang.extensions}
_NOT_CALLS = frozenset("if for while switch catch return function def fn func sizeof typeof match when unless elif else and or not in await new class struct enum interface with assert print super del yield lambda using lock foreach until case do try throw defer go select pub loop where".split()) - {"print", "super"}
_NOT_NAMES = frozenset("if for while switch catch return else elif match sizeof foreach".split())
#: Kinds whose names are part of the full names of what they hold.
_CONTAINERS = frozenset("class enum interface module scope struct trait".split())
_LONG_STRINGS = frozenset("rust php bash ruby".split())  # quoted strings may go over several lines
_CHARACTER = re.compile(r"'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'")
_RAW = {"rust": re.compile(r'\bb?r(#*)"'), "cpp": re.compile(r'\bR"([^\s()\\]{0,16})\('), "csharp": re.compile(r'@"()')}
#: Characters at which a comment, string or pattern of a language can begin.
_BEGINS = {lang.name: re.compile("[" + re.escape("/'" + lang.quotes + "".join(m[0] for m in lang.line_comments) + {"rust": "br", "cpp": "R", "csharp": "@"}.get(lang.name, "")) + "]") for lang in LANGUAGES}
_CALL = re.compile(r"([A-Za-z_$][\w$]*[?!]?)\s*\(")


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    begin_line: int
    end_line: int
    fqn: str = ""
    signature: str = ""
    docstring: str | None = None
    exported: bool = False
    scopes: list[str] = field(default_factory=list)
    body: str = ""

    def row(self) -> dict:
        plain = {k: getattr(self, k) for k in "docstring end_line fqn kind name signature".split()}
        return plain | {"start_line": self.begin_line, "is_exported": self.exported, "body_hash": hashlib.sha256(self.body.encode()).hexdigest()}


def language_of(path: str) -> Language | None:
    return BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def blank(source: str, lang: Language) -> tuple[str, list[tuple[int, int]]]:
    """The source with comments and the inside of strings as blanks, and where comments are."""
    out, comments, i, n = list(source), [], 0, len(source)
    begins = _BEGINS[lang.name]
    while i < n:
        c = source[i]
        if lang.block_comments and source.startswith("/*", i):
            j = source.find("*/", i + 2)
            j = n if j < 0 else j + 2
            comments.append((i, j))
        elif any(source.startswith(m, i) for m in lang.line_comments) and not source.startswith("#{", i) and not (c == "#" and lang.name == "php" and source.startswith("#[", i)):
            j = source.find("\n", i)
            j = n if j < 0 else j
            comments.append((i, j))
        elif lang.name == "rust" and c == "'":
            m = _CHARACTER.match(source, i)  # else a lifetime
            if m:
                for k in range(i + 1, m.end() - 1):
                    out[k] = " "
            i = m.end() if m else i + 1
            continue
        elif lang.name in _RAW and (m := _RAW[lang.name].match(source, i)) and (not i or not source[i - 1].isalnum()):
            stop = {"rust": '"' + m.group(1), "cpp": ")" + m.group(1) + '"', "csharp": '"'}[lang.name]
            j = source.find(stop, m.end())
            while lang.name == "csharp" and 0 <= j and source.startswith('""', j):
                j = source.find(stop, j + 2)
            j = n if j < 0 else j
            for k in range(m.end(), j):
                if out[k] != "\n":
                    out[k] = " "
            if lang.name == "cpp":  # the parentheses that belong to the quotes
                out[m.end() - 1] = " "
                if j < n:
                    out[j] = " "
            i = j + len(stop)
            continue
        elif c == "/" and lang.members == ("class",) and (m := _pattern_literal(source, i, "".join(out[max(0, i - 40) : i]))):
            for k in range(i + 1, m - 1):
                out[k] = " "
            i = m
            continue
        elif c in lang.quotes:
            j = i + 1
            while j < n and source[j] != c and (c == "`" or lang.name in _LONG_STRINGS or source[j] != "\n"):
                j += 2 if source[j] == "\\" else 1
            for k in range(i + 1, min(j, n)):
                if out[k] != "\n":
                    out[k] = " "
            i = j + 1
            continue
        else:
            m = begins.search(source, i + 1)
            i = m.start() if m else n
            continue
        for k in range(i, j):
            if out[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out), comments


def _pattern_literal(source: str, at: int, before: str) -> int | None:
    """One past the end of a regular expression that begins at a slash; None if the slash divides."""
    before = before.rstrip()
    if before and before[-1] not in "(=,:[!&|?{};+" and not re.search(r"\b(?:return|typeof|case)$", before):
        return None
    m = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/").match(source, at)
    return m.end() if m else None


def _brackets(text: str) -> dict[int, int]:
    """Where each opening bracket is closed."""
    stack, out, shut = [], {}, {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m.group()
        if c in shut:
            while stack and text[stack[-1]] != shut[c] and c == "}":
                stack.pop()  # something before was left open
            if stack and text[stack[-1]] == shut[c]:
                out[stack.pop()] = m.start()
        else:
            stack.append(m.start())
    return out


def _body_of(text: str, at: int, pairs: dict[int, int], cpp: bool) -> int | None:
    """The opening brace of a body that follows a parameter list; None if there is only a declaration."""
    typed = listed = False
    while at < len(text):
        c = text[at]
        if c == ";" or c == "=" and not text.startswith("=>", at):
            return None
        if c in "([":
            at = pairs.get(at, len(text))
        elif c == ":":
            typed, listed = True, cpp and not text.startswith("::", at) and text[at - 1] != ":"
        elif c == "{":
            last = text[:at].rstrip()[-1:]
            held = pairs.get(at, len(text))
            if cpp and listed and (last.isalnum() or last == "_") and text[held + 1 :].lstrip()[:1] in (",", "{"):
                at = held  # a member that is initialised
            elif not cpp and typed and (last in ":|&<,(" or text[:at].rstrip().endswith("=>")):
                at = held  # an object type
            else:
                return at
        elif c == "}":
            return None
        elif c == "\n" and not cpp and typed and text[:at].rstrip()[-1:] not in ":|&<," and text[at:].lstrip()[:1] not in ("{", "|", "&"):
            return None
        at += 1
    return None


_NAME_BEFORE = re.compile(r"(?P<n>[#~]?[A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\s*$")
_ACCESS = frozenset("public private protected".split())


def _members(text: str, begin: int, end: int, pairs: dict[int, int], cpp: bool) -> Iterator[tuple[int, int, str, int | None]]:
    """(begin, place of the name, name, end or None without a body) of the methods right within a class body."""
    at, first, value = begin, None, False
    while at < end:
        c = text[at]
        if c == "(" and first is not None:
            shut = pairs.get(at)
            if shut is None:
                return
            m = None if value else _NAME_BEFORE.search(text, first, at)
            if m and m.group("n") not in _NOT_NAMES:
                body = _body_of(text, shut + 1, pairs, cpp)
                stop = pairs.get(body, end) + 1 if body is not None and body < end else None
                yield first, m.start("n"), m.group("n"), stop
                if stop is not None:
                    at, first = stop, None
                    continue
                value = True  # what follows up to the declaration's end is no name
            at = shut + 1
            continue
        if c in "{[(":
            generic = first is not None and text.count("<", first, at) > text.count(">", first, at)
            at = pairs.get(at, end) + 1
            if c == "{" and not generic:
                first, value = None, False
            continue
        if c == ";" or c == "\n" and value and not cpp:
            first, value = None, False
        elif cpp and c == ":" and first is not None and text[first:at].strip() in _ACCESS:
            first = None
        elif c == "=":
            value = True
        elif first is None and not c.isspace():
            first = at
        at += 1


def _script_end(text: str, at: int, pairs: dict[int, int]) -> int | None:
    """One past the end of a function whose name ends here: of its body, which comes after its parameters or its arrow."""
    arrow = bool(re.compile(r"\s*[:=]").match(text, at))
    while at < len(text):
        if text[at] == "(" and not arrow:
            body = _body_of(text, pairs.get(at, len(text)) + 1, pairs, False)
            return pairs.get(body, len(text) - 1) + 1 if body is not None else None
        if arrow and text.startswith("=>", at):
            body = at + 2 + len(text[at + 2 :]) - len(text[at + 2 :].lstrip())
            return pairs.get(body, len(text) - 1) + 1 if text.startswith("{", body) else None
        if arrow and re.compile(r"function\b").match(text, at):
            arrow = False
        at = pairs.get(at, at) + 1
    return None


def _is_function(text: str, at: int, pairs: dict[int, int]) -> bool:
    """Whether the variable whose name ends here is given a function."""
    m = re.compile(r"\s*(?::(?:[^=;{]|=>)*)?=(?![=>])\s*(?:async\b\s*)?(?:(?P<f>function\b|[\w$]+\s*=>)|(?:<[^=;()]*>\s*)?(?P<p>\())").match(text, at)
    if not m or m.group("f"):
        return bool(m)
    shut = pairs.get(m.start("p"))
    return shut is not None and bool(re.compile(r"\s*(?::(?:[^=;{}]|\{[^{}]*\}|=(?!>))*)?=>").match(text, shut + 1))


def _clean_comment(text: str) -> str:
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|\*+/|///?!?|//!|\*|#+|--)?\s?", "", line)
        lines.append(re.sub(r"\s*\*+/\s*$", "", line).strip())
    return "\n".join(x for x in lines if x).strip()


def _block_end(text: str, at: int, lang: Language, pairs: dict[int, int]) -> int:
    """One past the end of the definition that starts at ``at``."""
    if lang.blocks == "end":
        depth, line_at = 0, text.rfind("\n", 0, at) + 1
        for m in re.finditer(r"^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|^[ \t]*end\b", text[line_at:], re.M):
            depth += -1 if m.group().strip() == "end" else 1
            if depth == 0:
                return line_at + m.end()
        return len(text)
    depth, k = 0, at - 1
    while (k := k + 1) < len(text):
        c = text[k]
        if c in "([" and not depth and k in pairs:
            k = pairs[k]
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k + 1
            if depth < 0:
                return k
        elif c == ";" and depth == 0:
            return k + 1
        elif c == "\n" and depth == 0 and "{" not in text[at:k] and re.match(r"\s*\n|\s*$|\s*(?:type|func|const|let|var|export|class)\b", text[k + 1 : k + 40]) and text[at:k].count("(") == text[at:k].count(")"):
            return k
    return len(text)


def _signature(text: str, kind: str) -> str:
    head = text.split("{", 1)[0]
    if kind == "variable":
        head = head.split("=", 1)[0]
    return re.sub(r"\s+", " ", head).strip().rstrip(";").strip()


def _import_name(raw: str) -> str:
    """The last segment of an imported path."""
    raw = raw.strip().strip("\"'<>;{} ")
    raw = raw.split(" as ")[0].strip()
    raw = re.sub(r"::\{.*$", "", raw, flags=re.S).replace("\\", "/")
    last = re.split(r"/|::", raw)[-1]
    if "." in last and not raw.startswith(".") and "/" not in raw:
        parts = [p for p in last.split(".") if p and p != "*"]
        return parts[-1] if parts and language_of("x." + parts[-1]) is None else parts[0] if parts else last
    return re.sub(r"\.(?:tsx?|jsx?|mjs|cjs|py|rb|h|hpp|zig|php|sh)$", "", last)


def _scan(path: str, source: str, lang: Language) -> tuple[list[Symbol], list[tuple[str, str, str]]]:
    text, comments = blank(source, lang)
    if lang.name == "php":
        text = text.replace("<?php", "    ;").replace("<?=", "  ;")  # what comes after begins a statement
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    line = lambda p: next_index(starts, p)
    pairs = _brackets(text)
    found: dict[int, Symbol] = {}
    declared: set[int] = set()
    for pattern, kind in lang.declarations:
        for m in re.finditer(r"(?m)" + (pattern if pattern.startswith("^") else r"(?:^|(?<=[{};]))[ \t]*" + pattern), text):
            name_at = m.start("n")
            if name_at in found or m.group("n") in _NOT_NAMES:
                continue
            if kind == "variable" and lang.members == ("class",):
                if _is_function(text, m.end("n"), pairs):
                    kind_ = "function"
                elif m.group().lstrip().startswith("export"):
                    kind_ = kind
                else:
                    continue
            else:
                kind_ = kind
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            end = _script_end(text, m.end("n"), pairs) if kind_ == "function" and lang.members == ("class",) else None
            end = _block_end(text, begin, lang, pairs) if end is None else end
            found[name_at] = Symbol(m.group("n"), kind_, begin, end, line(begin), line(max(begin, end - 1)), body=source[begin:end])
    # an interface has none with a body, but what it declares is no call
    for holder in [x for x in found.values() if lang.members and x.kind in (*lang.members, "interface")]:
        brace = text.find("{", holder.start, holder.end)
        if brace < 0 or brace not in pairs:
            continue
        for begin, name_at, name, end in _members(text, brace + 1, pairs[brace], pairs, "struct" in lang.members):
            declared |= {name_at, name_at + (name[0] in "#~")}
            if end is not None and name_at not in found:
                found[name_at] = Symbol(name, "method", begin, end, line(begin), line(end - 1), body=source[begin:end])
    symbols = sorted(found.values(), key=lambda s: (s.start, -s.end))
    for i, s in enumerate(symbols):
        outer = [o for o in symbols[:i] if o.start <= s.start and s.end <= o.end and o is not s]
        holders = [o for o in outer if o.kind in _CONTAINERS]
        s.scopes = [o.name for o in holders]
        if s.kind == "function" and holders and holders[-1].kind not in ("module", "namespace"):
            s.kind = "method"
        s.fqn = "::".join([path, *s.scopes, s.name])
        s.signature = _signature(s.body, s.kind)
        if "struct" in lang.members and s.kind in ("function", "method"):
            s.signature = re.sub(r"\s*(?<!:):(?!:)(?=[^()]*\w+\s*[({]).*$", "", s.signature) if ")" in s.signature else s.signature
        head = source[s.start : s.start + 200].split("{")[0]
        s.exported = {"upper": s.name[:1].isupper(), "top": not s.scopes, "all": True}.get(lang.exported, False) if lang.exported in ("upper", "top", "all") else bool(re.match(r"\s*" + lang.exported, head))
        before = [c for c in comments if c[1] <= s.start and not source[c[1] : s.start].strip()]
        if before and s.begin_line - line(before[-1][1]) <= 2:
            k = len(before) - 1
            while k and not source[before[k - 1][1] : before[k][0]].strip() and source[before[k - 1][1] : before[k][0]].count("\n") <= 1:
                k -= 1
            s.docstring = _clean_comment(source[before[k][0] : before[-1][1]]) or None
    named = set(found) | declared
    edges = []
    for p in lang.imports:
        for m in re.finditer("(?m)" + p, source):
            if not any(a <= m.start() < b for a, b in comments):
                edges.append((path, _import_name(m.group("m")), "imports"))
    scopes = [s for s in symbols if s.kind in ("function", "method", "macro")]
    for m in _CALL.finditer(text):
        if m.group(1) in _NOT_CALLS and text[m.start() - 1 : m.start()] != "." or m.start(1) in named:
            continue
        inside = [s for s in scopes if s.start <= m.start() < s.end]
        name = m.group(1) if lang.name == "ruby" else m.group(1).rstrip("?!")
        edges.append((inside[-1].fqn if inside else path, name, "calls"))
    return [s for s in symbols if s.kind != "scope"], edges


def next_index(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def _python(path: str, source: str) -> tuple[list[Symbol], list[tuple[str, str, str]]]:
    tree = ast.parse(source)
    lines = source.split("\n")
    symbols: list[Symbol] = []
    edges: list[tuple[str, str, str]] = []

    def visit(node: ast.AST, scopes: list[str], owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                edges.extend((path, a.name.split(".")[-1], "imports") for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                edges.append((path, (child.module or child.names[0].name).split(".")[-1], "imports"))
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                body = "\n".join(lines[first - 1 : child.end_lineno])
                head = re.sub(r"\s+", " ", "\n".join(lines[child.lineno - 1 : child.body[0].lineno])).strip()
                end = _python_head(head)
                fqn = "::".join([path, *scopes, child.name])
                symbols.append(Symbol(child.name, kind, first, child.end_lineno or first, first, child.end_lineno or first, fqn, end, ast.get_docstring(child), not child.name.startswith("_"), scopes, body))
                for d in child.decorator_list:
                    visit(ast.Expr(d), scopes, owner, in_class)
                visit(child, [*scopes, child.name] if kind == "class" else scopes, owner if kind == "class" else fqn, kind == "class")
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        edges.append((owner, name, "calls"))
                visit(child, scopes, owner, in_class)

    visit(tree, [], path, False)
    return sorted(symbols, key=lambda s: s.begin_line), edges


def _python_head(head: str) -> str:
    depth = 0
    for i, c in enumerate(head):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth == 0:
            return head[:i].strip()
    return head


def parse(path: str, source: str) -> tuple[list[Symbol], list[tuple[str, str, str]]]:
    """Symbols (in order of lines; of neighbours with one name the first) and raw edges of a file."""
    lang = language_of(path)
    if lang is None:
        return [], []
    try:
        symbols, edges = _python(path, source) if lang.blocks == "ast" else _scan(path, source, lang)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    kept = [s for i, s in enumerate(symbols) if not i or symbols[i - 1].fqn != s.fqn]
    return kept, edges


_SYMBOL = "name string, kind string, fqn string, signature string, docstring string, start_line long, end_line long, is_exported boolean, body_hash string"
_PARSED = f"path string, language string, content_hash string, line_count long, byte_size long, symbols array<struct<{_SYMBOL.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<from_fqn:string,to_name:string,kind:string>>"


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    symbol = pa.struct([(n, number if t == "long" else pa.bool_() if t == "boolean" else text) for n, t in (x.split() for x in _SYMBOL.split(", "))])
    edge = pa.struct([(n, text) for n in ("from_fqn", "to_name", "kind")])
    kinds = {"path": text, "language": text, "content_hash": text, "line_count": number, "byte_size": number, "symbols": pa.list_(symbol), "edges": pa.list_(edge)}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


#: Files whose symbols and edges are handed over at once.
_AT_ONCE = 500


def parse_files(sources: DataFrame) -> DataFrame:
    """One row per file of (path, content) with arrays of symbols and edges, in a single pass.

    Files are spread evenly over tasks first, in a number that isn't lowered when they are
    few in bytes: parsing takes far more time than reading, and a table of small files or one
    that is compressed well would else be parsed by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                lang = language_of(path)
                if lang is None or content is None:
                    continue
                symbols, edges = parse(path, content)
                raw = content.encode()
                edges = [dict(zip(("from_fqn", "to_name", "kind"), e, strict=True)) for e in edges]
                rows.append((path, lang.name, hashlib.sha256(raw).hexdigest(), content.count("\n") + (not content.endswith("\n")) * bool(content), len(raw), [s.row() for s in symbols], edges))
                if len(rows) == _AT_ONCE:
                    yield _arrow(rows)
                    rows = []
            yield _arrow(rows)

    spark = sources.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return sources.select("path", "content").repartition(tasks, "path").mapInArrow(run, _PARSED)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("edges").alias("e")).select("path", "e.*")
