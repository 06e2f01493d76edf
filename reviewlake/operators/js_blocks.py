"""Definitions in one JavaScript or TypeScript file.

Not a grammar: comments, strings and regular expressions are blanked out with offsets kept,
brackets are paired, and the headers of the four captured shapes (function declaration, class
declaration, method, variable holding a function) are matched on what is left.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

_NAME = r"(?:[^\W\d]|\$)[\w$]*"
_START = r"(?<![\w$.#@])"
_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|[`{}/]", re.S)
_TEMPLATE_TEXT = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?!>)(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_REGEX_MAY_FOLLOW = re.compile(
    r"(?:\A|[(,=:\[!&|?{};+\-*%~^>]|\b(?:return|typeof|case|in|of|do))\s*\Z")

_FUNCTION = re.compile(rf"{_START}(?:async\s+)?function\s+(?P<name>{_NAME})\s*(?:<[^()]*>)?\s*(?=\()")
_CLASS = re.compile(rf"{_START}class\b\s*(?!extends\b)(?P<name>{_NAME})?")
_METHOD = re.compile(
    rf"{_START}(?:(?:public|private|protected|static|override|async|get|set)\s+)*(?:\*\s*)?"
    rf"{_START}(?P<name>{_NAME})\s*\??\s*(?:<[^(){{}}]*>)?\s*(?=\()")
_VARIABLE = re.compile(
    rf"{_START}(?P<name>{_NAME})\s*(?::(?:[^;{{}}=]|=>)*?)?=(?![=>])\s*(?P<async>async\b\s*)?"
    rf"(?P<value>function\b\s*(?!\*)|(?:<[^()]*?>\s*)?(?=\()|{_NAME}\s*=>)")

_LOOK_BACK = 80  # characters that may hold the keyword or sign before a token

# Behind these a function or class is an expression; behind these a brace opens an object.
_OPERAND_NEXT = re.compile(
    r"(?:[=(,:?\[!&|+\-*/%^~<>.]|\bvoid[ \t]|\b(?:return|typeof|new|await|yield|in|of|case|throw|delete"
    r"|instanceof|extends|abstract))\s*\Z")
_OBJECT_NEXT = re.compile(r"(?:[=(,:\[?&|]|\b(?:return|default))\s*\Z")
_DECLARE_NEXT = re.compile(r"\b(?:const|let|var)\s+\Z")
_DECLARE_HERE = re.compile(r"\b(?:const|let|var)\s")
_TYPE_NEXT = re.compile(r"(?:[:|&<,(]|=>)\s*\Z")
_NEW_STATEMENT = re.compile(r"[\w$\]>)}]\s*\n\s*[\w$@]")
_CONTINUES = re.compile(r"\s*[.?:&|+\-*/%=<>(\[]")
_OPEN_END = "?:&|+-*/%=<>(.,"
_CONTROL = {"if", "for", "while", "switch", "catch", "with"}


def js_definitions(source: str) -> Iterator[dict[str, Any]]:
    code = _Code(_mask(source))
    spans: dict[tuple[int, int], tuple[str, str]] = {}
    class_bodies = set()

    for m in _FUNCTION.finditer(code.text):
        body = code.body(m.end())
        if body is not None and not code.before(m.start(), _OPERAND_NEXT):
            spans[m.start(), code.close[body] + 1] = (m["name"], "function")
    for m in _CLASS.finditer(code.text):
        body = code.find("{", m.end())
        if body is not None:
            class_bodies.add(body)
            if m["name"] and not code.before(m.start(), _OPERAND_NEXT):
                spans[m.start(), code.close[body] + 1] = (m["name"], "class")
    for m in _METHOD.finditer(code.text):
        owner = code.brace_around(m.start())
        if owner is None or m["name"] == "function" or code.before(m.start(), r"\bfunction\s*\Z"):
            continue
        if owner not in class_bodies and (
                m["name"] in _CONTROL or not code.before(owner, _OBJECT_NEXT)):
            continue
        body = code.body(m.end())
        if body is not None:
            spans[m.start(), code.close[body] + 1] = (m["name"], "method")
    for m in _VARIABLE.finditer(code.text):
        end = code.function_end(m) if code.is_declared(m.start()) else None
        if end is not None:
            spans[m.start(), end] = (m["name"], "function")

    lines = [m.start() for m in re.finditer("\n", source)]
    for (start, end), (name, kind) in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
        yield {
            "name": name,
            "type": kind,
            "line_number": bisect_left(lines, start) + 1,
            "code": source[start:end],
        }


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _mask(source: str) -> str:
    """Same length, code only. A string leaves a 0 at its start: an operand was there."""
    out: list[str] = []
    braces: list[int] = []  # open braces inside each ${ } being read
    at, tail = 0, ""  # the end of what is masked so far, without blanks but one

    def put(masked: str) -> None:
        nonlocal tail
        out.append(masked)
        kept = masked[-_LOOK_BACK:].rstrip() or masked.rstrip()[-_LOOK_BACK:]
        blank = not kept or masked[-1:].isspace()
        tail = (tail + kept)[-_LOOK_BACK:]
        if blank and not tail.endswith(" "):
            tail += " "

    def template(at: int) -> int:
        end = _TEMPLATE_TEXT.match(source, at + 1).end()
        end += 2 if source.startswith("${", end) else 1
        if source.startswith("${", end - 2):
            braces.append(0)
        put(_blank(source[at:end]))
        return end

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            put(source[at:m.start()])
        at, token = m.start(), m.group()
        if token == "`":
            at = template(at)
        elif token == "}" and braces and braces[-1] == 0:
            braces.pop()
            at = template(at)
        elif token in "{}":
            if braces:
                braces[-1] += 1 if token == "{" else -1
            put(token)
            at += 1
        elif token == "/":
            regex = _REGEX.match(source, at)
            if regex and _REGEX_MAY_FOLLOW.search(tail):
                put("0" + _blank(regex.group())[1:])
                at = regex.end()
            else:
                put(token)
                at += 1
        else:
            put(_blank(token) if token[0] == "/" else "0" + _blank(token)[1:])
            at = m.end()
    out.append(source[at:])
    return "".join(out)


class _Code:
    """Masked text with its bracket pairs."""

    def __init__(self, text: str):
        self.text = text
        self.close: dict[int, int] = {}
        self._at: list[int] = []
        self._around: list[int | None] = []
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", text):
            if m.group() in "([{":
                stack.append(m.start())
            else:
                while stack and text[stack[-1]] + m.group() not in ("()", "[]", "{}"):
                    stack.pop()
                if stack:
                    self.close[stack.pop()] = m.start()
            self._at.append(m.start())
            self._around.append(stack[-1] if stack else None)
        self._open = {c: o for o, c in self.close.items()}
        self._declared: dict[int, bool] = {}  # by comma: is it between declarators?

    def _behind_code(self, at: int) -> int:
        """Where the blanks before `at` begin."""
        while at and self.text[at - 1].isspace():
            at -= 1
        return at

    def before(self, at: int, pattern) -> bool:
        """Does `pattern` match at the end of what stands before `at`, over any blanks?"""
        begin = self._behind_code(at)
        blank = self.text[begin:at][:1]
        return bool(re.search(pattern, self.text[max(0, begin - _LOOK_BACK):begin] + blank))

    def brace_around(self, at: int) -> int | None:
        k = bisect_left(self._at, at) - 1
        owner = self._around[k] if k >= 0 else None
        return owner if owner in self.close and self.text[owner] == "{" else None

    def find(self, wanted: str, at: int) -> int | None:
        """First `wanted` bracket from `at` over other bracket pairs; None if one ends first."""
        while m := re.compile(r"[()\[\]{};]").search(self.text, at):
            if m.start() not in self.close:
                return None
            if m.group() == wanted:
                return m.start()
            at = self.close[m.start()] + 1
        return None

    def body(self, paren: int) -> int | None:
        """Opening brace of the body behind a parameter list, over a return type."""
        if paren not in self.close:
            return None
        begin = self.close[paren] + 1
        typed = re.compile(r"\s*:").match(self.text, begin)
        at = typed.end() if typed else begin
        while (brace := self.find("{", at)) is not None:
            between = self.text[begin:brace]
            if not typed:
                return None if between.strip() else brace
            if _NEW_STATEMENT.search(between) or re.search(r"=(?!>)", between):
                return None
            if not _TYPE_NEXT.search(between):
                return brace
            at = self.close[brace] + 1
        return None

    def is_declared(self, at: int) -> bool:
        """Is the name at `at` declared by const, let or var, perhaps behind a comma?"""
        if self.before(at, _DECLARE_NEXT):
            return True
        comma = at = self._behind_code(at) - 1
        if at < 0 or self.text[at] != ",":
            return False
        found = False
        while at >= 0 and self.text[at] not in ";({[":
            if at in self._declared:  # an earlier declarator of the list has been here
                found = self._declared[at]
                break
            at = self._open.get(at, at)
            if _DECLARE_HERE.match(self.text, at):
                found = True
                break
            at -= 1
        self._declared[comma] = found
        return found

    def function_end(self, m: re.Match) -> int | None:
        """End of the function that is the whole value of a declarator, None if it is not one."""
        if m["value"].startswith("function"):
            paren = self.find("(", m.end())
            body = None if paren is None else self.body(paren)
            return None if body is None else self._unless_continued(self.close[body] + 1)
        at = m.end()
        if not m["value"].endswith("=>"):
            if at not in self.close:
                return None
            arrow = re.compile(r"\s*(?::(?:[^;=]|=>)*?)?=>").match(self.text, self.close[at] + 1)
            if not arrow:
                return None
            at = arrow.end()
        begin = re.compile(r"\s*").match(self.text, at).end()
        if self.text[begin:begin + 1] == "{" and begin in self.close:
            return self._unless_continued(self.close[begin] + 1)
        at = end = begin
        while at < len(self.text) and self.text[at] not in ",;)]}":
            if (self.text[at] == "\n" and end > begin and self.text[end - 1] not in _OPEN_END
                    and not _CONTINUES.match(self.text, at)):
                break
            at = self.close.get(at, at) + 1
            if not self.text[at - 1].isspace():
                end = at
        return end if end > begin else None

    def _unless_continued(self, end: int) -> int | None:
        return None if re.compile(r"[^\S\n]*[(\[.]|\s*\.").match(self.text, end) else end
