"""Code without what only looks like code: strings and comments, over lines.

A scan of a whole file, one pattern a language, blanks the insides of strings
and comments, byte for byte, so that lines and columns stay.  What is imported
by a string keeps it.  Where indents nest, lines that start within brackets or
strings are marked, as their indent says nothing.

A file is broken if its brackets do not meet.  Where indents nest, the scan takes
up again at the next line that can only stand outside of brackets (``def``,
``class``, a decorator), and what is between the open bracket and that line is
blanked; where braces nest, a broken file is read by its indents.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(mark: str, plain: str, other: str = r"\\.", close: str | None = None) -> str:
    """From ``mark`` to ``close`` or the end: runs of ``plain`` characters and ``other`` things between them."""
    return rf"{mark}[^{plain}]*+(?:(?:{other})[^{plain}]*+)*+(?:{close or mark}|\Z)"


_DOUBLE, _SINGLE = _quoted('"', r'"\\\n', close=r'"|(?=\n)'), _quoted("'", r"'\\\n", close=r"'|(?=\n)")
_LONG, _LONG_SINGLE = _quoted('"""', r'"\\', r'\\.|"(?!"")'), _quoted("'''", r"'\\", r"\\.|'(?!'')")
_DOUBLE_LINES, _SINGLE_LINES = _quoted('"', r'"\\'), _quoted("'", r"'\\")
_CHARACTER = r"'(?:\\(?:[ux]\{?[0-9A-Fa-f]+\}?|[0-7]{1,3}|.)|[^'\\\n])'"
_HASH, _SLASHES, _BLOCK = r"\#[^\n]*", r"//[^\n]*", _quoted(r"/\*", "*", r"\*(?!/)", r"\*/")
#: After what a value can't end with, a slash starts a pattern.
_PATTERN = r"(?:(?<=[(,=:\[!&|?{};])|(?<=[(,=:\[!&|?{};]\x20)|(?<=return\x20))/(?![*/\x20])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/"
_HEREDOC = r"<<[~-]?(?P<q>[\"'`]?)(?P<here>[A-Za-z_]\w*)(?P=q)[^\n]*\n(?:(?!\s*(?P=here)\s*$)[^\n]*\n)*+\s*(?P=here)\b"
_C = (_SLASHES, _BLOCK, _DOUBLE, _CHARACTER)

#: What to blank, by language.  A template is ended by a scan of its own.
_BLANKED = {
    "python": (_HASH, _LONG, _LONG_SINGLE, _DOUBLE, _SINGLE),
    "javascript": (_SLASHES, _BLOCK, _DOUBLE, _SINGLE, "`", _PATTERN),
    "go": (*_C, r"`[^`]*+(?:`|\Z)"),
    "rust": (_SLASHES, _BLOCK, r'\bb?r(?P<h>\#*+)"(?:[^"]|"(?!(?P=h)))*+(?:"(?P=h)|\Z)', _DOUBLE_LINES, _CHARACTER),
    "java": (_SLASHES, _BLOCK, _LONG, _DOUBLE, _CHARACTER),
    "c": _C,
    "cpp": (_SLASHES, _BLOCK, r'\bR"(?P<d>[^()\\\s]{0,16})\((?:[^)]|\)(?!(?P=d)"))*+(?:\)(?P=d)"|\Z)', _DOUBLE, _CHARACTER),
    "c_sharp": (_SLASHES, _BLOCK, _LONG, r'(?:@\$?|\$@)"(?:[^"]|"")*+(?:"|\Z)', _DOUBLE, _CHARACTER),
    "ruby": (_HASH, r"^=begin\b(?:(?!^=end\b).)*+", _HEREDOC, _DOUBLE_LINES, _SINGLE_LINES, _PATTERN),
    "php": (r"(?:\A(?!<\?)|\?>)(?:[^<]|<(?!\?))*+", r"\#(?!\[)[^\n]*", _SLASHES, _BLOCK, r"<<<[ \t]*[\"']?(?P<here>\w+)[\"']?\n(?:(?![ \t]*(?P=here)\b)[^\n]*\n)*+[ \t]*(?P=here)\b", _DOUBLE_LINES, _SINGLE_LINES),
    "bash": (r"(?:^|(?<=[\s;]))\#[^\n]*", _HEREDOC, r"'[^']*+(?:'|\Z)", _DOUBLE_LINES, r"\\."),
    "lua": (r"--\[(?P<e>=*)\[(?:[^\]]|\](?!(?P=e)\]))*+(?:\](?P=e)\]|\Z)", r"--[^\n]*", _DOUBLE, _SINGLE, r"\[(?P<f>=*)\[(?:[^\]]|\](?!(?P=f)\]))*+(?:\](?P=f)\]|\Z)"),
    "sql": (r"--[^\n]*", _BLOCK, r"'(?:[^']|'')*+(?:'|\Z)", r'"[^"\n]*"'),
}
_BLANKED |= {"typescript": _BLANKED["javascript"], "tsx": _BLANKED["javascript"], "kotlin": _BLANKED["java"], "scala": _BLANKED["java"], "swift": _BLANKED["java"]}
_RUN = re.compile(r"[^\r\n]+")
_BY_STRING = ("javascript", "typescript", "tsx", "go", "c", "cpp", "php", "ruby", "lua")
#: Strings that import, by what is before them on their line, and what they hold.
_IMPORTING = re.compile(r"(?:^\s*(?:import|export|include|using|use)\b|\bfrom|\brequire\s*\(|\bimport\s*\(|^\s*\#\s*include)[^\"'`]*$|^\s*(?:[\w.]+\s+)?$")
_IMPORTED = re.compile(r"""["'][\w./@:+~$*!?=&\x20-]+["']""")
_OUTSIDE = re.compile(r"\s*(?:(?:async\s+)?def\s+\w|class\s+\w|@\w)")
_BRACKET = re.compile(r"[()\[\]{}]")


@cache
def _blanked(language: str) -> re.Pattern:
    return re.compile("|".join(_BLANKED[language]), re.S | re.M)


def _template_end(text: str, at: int) -> int:
    """Where the template that starts at ``at`` ends, with templates in its values."""
    open_, depth, at = [-1], 0, at + 1
    for m in re.compile(r"\\.|`|\$\{|[{}]", re.S).finditer(text, at):
        mark, inside = m.group(), open_[-1] == -1
        if mark == "`":
            open_.append(-1) if not inside else open_.pop()
            if not open_:
                return m.end()
        elif mark == "${" and inside:
            open_.append(depth)
        elif mark in "{}" and not inside:
            depth += 1 if mark == "{" else -1
            if depth < open_[-1]:
                depth = open_.pop()
    return len(text)


def _spaces(text: str) -> str:
    if "\n" not in text and "\r" not in text:
        return " " * len(text.encode())
    return _RUN.sub(lambda r: " " * len(r.group().encode()), text)


def _imports(text: str, at: int) -> bool:
    """Whether what is before ``at`` on its line imports; no further back than such lines are long."""
    first = max(0, at - 400)
    start = text.rfind("\n", first, at) + 1 or first
    return bool(_IMPORTING.search(text[start:at]))


def blanked(text: str, language: str) -> tuple[str, set[int]]:
    """``text`` with strings and comments blank, and the lines that start in one.

    A string keeps its first mark, and on one line its last."""
    out, at, inside, line, counted = [], 0, set(), 0, 0
    pattern = _blanked(language)
    m = pattern.search(text)
    while m:
        a, b = m.span()
        if a == b:  # nothing before the first code
            m = pattern.search(text, b + 1) if b < len(text) else None
            continue
        if text[a] == "`" and b == a + 1:
            b = _template_end(text, a)
        part = text[a:b]
        out.append(text[at:a])
        if more := part.count("\n"):
            line += text.count("\n", counted, a)
            inside.update(range(line + 1, line + more + 1))
            line, counted = line + more, b
        if part[0] not in "\"'`":
            out.append(_spaces(part))
        elif not more and language in _BY_STRING and _IMPORTED.fullmatch(part) and _imports(text, a):
            out.append(part)
        else:
            out.append(part[0] + (_spaces(part[1:]) if more else _spaces(part[1:-1]) + part[1:][-1:]))
        at = b
        m = pattern.search(text, b)
    return "".join([*out, text[at:]]), inside


_MARK = re.compile(r"[(){};]|\btypedef\b")
_GROUP = re.compile(r"\s*(const|type)\s*\(\s*$")


def ahead(lines: list[str], language: str) -> tuple[list[str], list[bool]]:
    """What follows each line that its definitions need: the rest of a parameter
    list, up to the next brace or semicolon, and the brace on a line of its own.

    Lines of a group in brackets (Go) get the word before the group, and those
    that end a ``typedef`` (C) that word.  Only lists that start outside of
    brackets go on, so no text is in two of them.  Also whether the last code of
    a line goes on at the next, so that what starts there does not end there."""
    out, on, last = [""] * len(lines), [False] * len(lines), 0
    outer: list[tuple[int, bool]] = []
    depth, typed, waits, before, group = 0, False, None, None, None
    for k, line in enumerate(lines):
        code = line.strip()
        if not code:
            continue
        if waits is not None:
            end = re.search(r"[{};]", code)
            out[waits] += " " + (code[: end.end()] if end else code)
        elif before is not None and code[0] == "{":
            out[before] += " {"
            on[last] = True
        if group and (len(outer), depth) == (group[1], 1) and code[0] != ")":
            out[k] += f" {group[0]}"
        free, ended = depth == 0, False
        for m in _MARK.finditer(code):
            mark = m.group()
            if mark == "typedef":
                typed = typed or language == "c" and not depth
            elif mark in "()":
                depth = max(0, depth + (1 if mark == "(" else -1))
            else:
                if mark == "{":
                    outer.append((depth, typed))
                    depth, typed = 0, False
                elif mark == "}":
                    depth, typed = outer.pop() if outer else (0, False)
                elif typed and not depth:
                    out[k], typed = " typedef", False
                free, ended = depth == 0, True
        if language == "go":
            if m := _GROUP.match(code):
                group = (m.group(1), len(outer))
            elif group and not depth and len(outer) <= group[1]:
                group = None
        if ended:
            waits = None
        before = None if code[-1] in "{};" else k if waits is None else waits if not depth else None
        if not depth:
            waits = None
        elif waits is None and free and not group and code[-1] not in "{};":
            waits, before = k, None
        on[k], last = waits is not None, k
    return out, on


def scanned(text: str, language: str, by_indent: bool) -> tuple[str, list[bool], bool]:
    """The code of a file, whether each line starts within a string (or, where
    indents nest, brackets), and whether it is broken."""
    code, inside = blanked(text, language)
    pairs = "{}" if language == "bash" else "()[]{}"
    lines = code.split("\n")
    within = [k in inside for k in range(len(lines))]
    if not by_indent:
        return code, within, any(code.count(a) != code.count(b) for a, b in zip(pairs[::2], pairs[1::2]))
    broken, open_ = False, []
    for k, line in enumerate(lines):
        if open_ and _OUTSIDE.match(line) and not within[k]:
            broken = True
            for j in range(open_[0][1], k):
                lines[j], within[j] = _spaces(lines[j]), False
            open_ = []
        within[k] = within[k] or bool(open_)
        for mark in _BRACKET.findall(line):
            if mark in "([{":
                open_.append((mark, k))
            elif open_ and "([{".index(open_[-1][0]) == ")]}".index(mark):
                open_.pop()
            else:
                broken = True
    if open_:
        broken = True
        for j in range(open_[0][1], len(lines)):
            lines[j], within[j] = _spaces(lines[j]), False
    return "\n".join(lines) if broken else code, within, broken


_SCANNED = T.StructType([T.StructField("code", T.StringType()), T.StructField("within", T.ArrayType(T.BooleanType())), T.StructField("broken", T.BooleanType()), T.StructField("ahead", T.ArrayType(T.StringType())), T.StructField("unfinished", T.ArrayType(T.BooleanType()))])


@F.pandas_udf(_SCANNED)
def scan(content, language, by_indent):
    """Contents (null: nothing to scan) as struct<code, within, broken, ahead, unfinished>; where indents nest the last two are empty."""
    import pandas as pd

    def row(text: str | None, lang: str, indent: bool) -> tuple:
        if text is None:
            return None, None, None, None, None
        code, within, broken = scanned(text, lang, indent)
        return code, within, broken, *(([], []) if indent else ahead(code.split("\n"), lang))

    return pd.DataFrame([row(*r) for r in zip(content, language, by_indent)], columns=["code", "within", "broken", "ahead", "unfinished"])
