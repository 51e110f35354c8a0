"""The grammar of BibTeX files.

A block starts with `@`, a word and a bracket. At the start of a line that begins a new block whatever stands before, so a file
falls into segments at those lines that are read by themselves; behind a block's end the next one may also follow on the same
line, and other text there is no part of any block. A block is read by states: its key up to a comma, then names up to `=`,
values (braces that nest, quotes, words, joined by `#`), and behind a value a comma or the block's end. What breaks this is a
`ParsingFailedBlock`, and the rest of its segment is not read; a field given twice is a `DuplicateFieldKeyBlock`; a key or
@string name that an earlier block of the file has is a `DuplicateBlockKeyBlock` (blank keys are not held against each other).
A word that an earlier @string names stands for its value. @comment and @preamble go, but must end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

START = re.compile(r"^[ \t]*@[ \t]*\w+[ \t]*[{(]")
BLOCK = re.compile(r"@\s*(\w+)\s*([{(])")
STEP = re.compile(r"\\.|[{}()]", re.S)
QUOTED = re.compile(r'\\.|[{}"]', re.S)
MARK = re.compile(r'\\.|[{}",=)]', re.S)
WORD = re.compile(r'[^\s,#{}"=()]+')
SPACES = re.compile(r"\s*")

FAILED, TWICE, SAME_KEY = "ParsingFailedBlock", "DuplicateFieldKeyBlock", "DuplicateBlockKeyBlock"


class Broken(ValueError):
    """A block that does not follow the grammar."""


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`; escaped brackets don't count."""
    begin, depth = text[at], 0
    end = {"{": "}", "(": ")"}[begin]
    for m in STEP.finditer(text, at):
        if m[0] == begin:
            depth += 1
        elif m[0] == end:
            depth -= 1
            if not depth:
                return m.start()
    raise Broken("a bracket without end")


def closing_quote(text: str, at: int) -> int:
    """The place of the quote that closes the one at `at`: outside of braces."""
    depth = 0
    for m in QUOTED.finditer(text, at + 1):
        if m[0] == '"' and depth <= 0:
            return m.start()
        depth += {"{": 1, "}": -1}.get(m[0], 0)
    raise Broken("a quote without end")


def mark(text: str, at: int, end: str) -> re.Match:
    """The next sign that parts a block: a bracket, quote, comma or equals sign."""
    for m in MARK.finditer(text, at):
        if m[0][0] != "\\" and (m[0] != ")" or end == ")"):
            return m
    raise Broken("a block without end")


def value(text: str, at: int, end: str) -> tuple[list[tuple[str, bool]], int]:
    """The parts of a value (text, and whether it is a word that may stand for another) and the place of the sign behind it."""
    parts = []
    while True:
        at = SPACES.match(text, at).end()
        c = text[at : at + 1]
        if c == "{":
            stop = closing(text, at)
            parts.append((text[at + 1 : stop], False))
            at = stop + 1
        elif c == '"':
            stop = closing_quote(text, at)
            parts.append((text[at + 1 : stop], False))
            at = stop + 1
        elif word := WORD.match(text, at):
            parts.append((word[0], not word[0].isdigit()))
            at = word.end()
        elif parts or c not in (",", end):
            raise Broken("a value is missing")
        at = SPACES.match(text, at).end()
        if text[at : at + 1] != "#":
            if text[at : at + 1] not in (",", end) or at >= len(text):
                raise Broken("something behind a value")
            return parts, at
        at += 1


def fields(text: str, at: int, end: str) -> tuple[list[tuple[str, list]], int]:
    """Names and value parts from `at` to the block's end, and the place behind that."""
    out = []
    while True:
        m = mark(text, at, end)
        name = text[at : m.start()].strip()
        if m[0] == end and not name:
            return out, m.end()
        if m[0] != "=" or not name:
            raise Broken("a name without value")
        parts, at = value(text, m.end(), end)
        out.append((name, parts))
        if text[at] == end:
            return out, at + 1
        at += 1


def blocks(segment: str, keep_first: frozenset[str] = frozenset()) -> Iterator[dict]:
    """line (within the segment), type, key, fields (name, parts) and error of the blocks of a segment."""
    at = line = counted = 0
    while (m := BLOCK.search(segment, at)) is not None:
        line, counted, kind = line + segment.count("\n", counted, m.start()), m.start(), m[1].lower()
        end, key, found, error = {"{": "}", "(": ")"}[m[2]], "", [], ""
        try:
            if kind in ("comment", "preamble"):
                at = closing(segment, m.end() - 1) + 1
                continue
            at = m.end()
            if kind != "string":
                sign = mark(segment, at, end)
                if sign[0] not in (",", end):
                    raise Broken("a key without comma")
                key, at = segment[at : sign.start()].strip(), sign.end()
            if kind == "string" or sign[0] == ",":
                found, at = fields(segment, at, end)
        except Broken:
            yield {"line": line, "type": kind, "key": key, "fields": [], "error": FAILED}
            return
        seen: set[str] = set()
        own = []
        for name, parts in found:
            if (low := name.lower()) in seen:
                error = error if low in keep_first else TWICE
                continue
            seen.add(low)
            own.append((name, parts))
        yield {"line": line, "type": kind, "key": key, "fields": own, "error": error}


def segments(text: str) -> Iterator[tuple[int, str]]:
    """The first line and the text of each segment."""
    held, begin = [], 0
    for k, line in enumerate(re.split(r"\r\n|\r|\n", text)):
        if held and START.match(line):
            yield begin, "\n".join(held)
            held, begin = [], k
        held.append(line)
    yield begin, "\n".join(held)


def joined(parts: list[tuple[str, bool]], names: dict[str, str]) -> str:
    return "".join(names.get(t.lower(), t) if ref else t for t, ref in parts)


def parse(text: str, keep_first: frozenset[str] = frozenset()) -> Iterator[dict]:
    """Entries of a whole file: line, type, key, fields (name, value) and error. Fields named in keep_first may come again."""
    names: dict[str, str] = {}
    keys: set[str] = set()
    for begin, segment in segments(text):
        for b in blocks(segment, keep_first):
            key = f"@{b['fields'][0][0].lower()}" if b["type"] == "string" and b["fields"] else b["key"]
            error = b["error"] or (SAME_KEY if key and key in keys else "")
            keys.add(key)
            if b["type"] == "string" and not error:
                names |= {n.lower(): joined(p, names) for n, p in b["fields"]}
                continue
            yield {"line": begin + b["line"], "type": b["type"], "key": b["key"], "fields": [{"name": n, "value": joined(p, names)} for n, p in b["fields"]], "error": error}
