"""The strict dialect: text to Select and back.

    select    := SELECT [DISTINCT] ('*' | key | value) [WHERE condition]
    condition := key '=' string | key BETWEEN string AND string

Words are case-insensitive; in a string '' stands for a quote. Offsets in errors are bytes of UTF-8.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_LEXEME = re.compile(rb"[ \t\n\f\r]+|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[*=])|'(?P<text>(?:[^']|'')*)'")


class ParseError(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(f"at byte {at}: {message}")
        self.at, self.message = at, message


def quoted(raw: bytes) -> str:
    return "'" + raw.decode("utf-8", "replace").replace("'", "''") + "'"


@dataclass(frozen=True)
class KeyEquals:
    key: bytes

    def holds(self, key: bytes) -> bool:
        return key == self.key

    def __str__(self) -> str:
        return f"key = {quoted(self.key)}"


@dataclass(frozen=True)
class KeyBetween:
    low: bytes
    high: bytes

    def holds(self, key: bytes) -> bool:
        return self.low <= key <= self.high

    def __str__(self) -> str:
        return f"key BETWEEN {quoted(self.low)} AND {quoted(self.high)}"


@dataclass(frozen=True)
class Select:
    fields: str = "*"  # "*", "key" or "value"
    where: KeyEquals | KeyBetween | None = None
    distinct: bool = False

    @property
    def columns(self) -> tuple[str, ...]:
        return ("key", "value") if self.fields == "*" else (self.fields,)

    def __str__(self) -> str:
        return " ".join(["SELECT", *["DISTINCT"] * self.distinct, self.fields, *([f"WHERE {self.where}"] if self.where else [])])


def _shown(c: str) -> str:
    """A character as a message quotes it."""
    escapes = {"\\": r"\\", "'": r"\'", "\0": r"\0", "\x0b": r"\u{b}"}
    return "'" + escapes.get(c, c if c.isprintable() else f"\\u{{{ord(c):x}}}") + "'"


def lexemes(query: str) -> list[tuple[int, str, bytes]]:
    """(offset, kind, content) with kinds word (upper case), *, =, text and end."""
    raw, at, out = query.encode(), 0, []
    while at < len(raw):
        m = _LEXEME.match(raw, at)
        if not m:
            if raw[at:at + 1] == b"'":
                raise ParseError(at, "string is never closed")
            raise ParseError(at, f"unexpected {_shown(raw[at:].decode()[0])}")
        if (word := m["word"]) is not None:
            out.append((at, "word", word.upper()))
        elif m["mark"] is not None:
            out.append((at, m["mark"].decode(), b""))
        elif m["text"] is not None:
            out.append((at, "text", m["text"].replace(b"''", b"'")))
        at = m.end()
    return [*out, (len(raw), "end", b"")]


def parse(query: str) -> Select:
    found = iter(lexemes(query))
    here = next(found)
    names = {"*": "'*'", "=": "'='", "text": "a string", "end": "the end of the query"}

    def refuse(wanted: str):
        raise ParseError(here[0], f"expected {wanted}, found {names.get(here[1]) or here[2].decode()}")

    def take(kind: str, content: bytes | None = None) -> bytes | None:
        """The content of the lexeme here if it is as asked for, and on to the next; else None."""
        nonlocal here
        if here[1] != kind or content not in (None, here[2]):
            return None
        got = here[2]
        here = next(found, here)
        return got

    def must(wanted: str, kind: str, content: bytes | None = None) -> bytes:
        got = take(kind, content)
        return refuse(wanted) if got is None else got

    string = lambda: must("a string in single quotes", "text")
    must("SELECT", "word", b"SELECT")
    distinct = take("word", b"DISTINCT") is not None
    for kind, content, fields in (("*", None, "*"), ("word", b"KEY", "key"), ("word", b"VALUE", "value")):
        if take(kind, content) is not None:
            break
    else:
        refuse("'*', key or value")
    where = None
    if take("word", b"WHERE") is not None:
        must("key (conditions on the key only, so far)", "word", b"KEY")
        if take("=") is not None:
            where = KeyEquals(string())
        elif take("word", b"BETWEEN") is not None:
            low = string()
            must("AND", "word", b"AND")
            where = KeyBetween(low, string())
        else:
            refuse("'=' or BETWEEN")
    if here[1] != "end":
        refuse("the end" if where else "WHERE or the end")
    return Select(fields, where, distinct)
