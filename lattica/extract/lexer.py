"""Blanking comments and strings, so that patterns see code only; positions stay."""

from __future__ import annotations

import re
from bisect import bisect_right

_STRINGS = r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\""
_TOKENS = {
    "python": re.compile(r"(?s)(#[^\n]*)|(\"\"\".*?\"\"\"|'''.*?'''|" + _STRINGS + ")"),
    "ruby": re.compile(r"(?s)(#[^\n]*)|(" + _STRINGS + ")"),
    "c": re.compile(r"(?s)(//[^\n]*|/\*.*?\*/)|(`(?:\\.|[^`\\])*`|" + _STRINGS + ")"),
    "php": re.compile(r"(?s)(//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/)|(" + _STRINGS + ")"),
}


def blank(source: str, family: str = "c") -> str:
    """``source`` with comments and the insides of strings as spaces; quotes and line ends stay."""

    def spaces(text: str) -> str:
        return re.sub(r"[^\n]", " ", text)

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return spaces(m[1])
        q = 3 if m[2][:3] in ('"""', "'''") else 1
        return m[2][:q] + spaces(m[2][q:-q]) + m[2][-q:]

    return _TOKENS[family].sub(one, source)


class Code:
    """A source beside its blanked form."""

    def __init__(self, source: str, family: str = "c"):
        self.source, self.plain = source, blank(source, family)
        self.ends = [m.start() for m in re.finditer("\n", source)]

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1 if at else 1

    def find(self, pattern: str, flags: int = 0):
        return re.finditer(pattern, self.plain, flags)

    def literal(self, at: int) -> str | None:
        """The string that starts at ``at``, if one does."""
        quote = self.plain[at : at + 1]
        if quote not in ("'", '"', "`") or not quote:
            return None
        end = self.plain.find(quote, at + 1)
        return self.source[at + 1 : end] if end > 0 else None

    def closing(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at``."""
        depth = 0
        for i in range(at, len(self.plain)):
            c = self.plain[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    return i
        return len(self.plain)

    def arguments(self, at: int) -> list[tuple[int, int]]:
        """Spans of the arguments of the call whose bracket is at ``at``."""
        end, depth, start, out = self.closing(at), 0, at + 1, []
        for i in range(at + 1, end):
            c = self.plain[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "," and not depth:
                out.append((start, i))
                start = i + 1
        out.append((start, end))
        trimmed = []
        for a, b in out:
            while a < b and self.plain[a].isspace():
                a += 1
            while b > a and self.plain[b - 1].isspace():
                b -= 1
            if a < b:
                trimmed.append((a, b))
        return trimmed

    def text(self, span: tuple[int, int]) -> str:
        return self.source[span[0] : span[1]]
