"""Finite automata over the text of dumps and CSV files, run from any of their states.

A file that is read in splits has to be understood in pieces whose beginning state nobody knows yet. A lexer here has a
short list of states; ``scan`` reads whole lines from one of them and says in which it ends, and where the first and the
last unit (a statement, a record) end. :mod:`.chunked` puts the pieces of a file together.

No token reaches over a line end except those that are states, so pieces that end with a line lose nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MYSQL, POSTGRES = "mysql", "postgres"


@dataclass
class Scan:
    """What a piece of text holds, read from one state.

    ``first`` is where its first unit ends (0 if none was open at the start, -1 if none ends), ``last`` where the last
    one does, ``mid`` the state at ``first``. ``header`` tells what opened the block that the text ends in: null if it was
    open from the start, empty if its opening began before the text.
    """

    state: int
    first: int
    last: int
    mid: int
    header: str | None


class CsvLexer:
    """Records of quoted CSV. States: at a record's start; inside a quoted field.

    A quote opens a field only at its start; inside, two quotes are one.
    """

    start, states = 0, (0, 1)

    def __init__(self, delimiter: str = ",", quote: str = '"'):
        d, q = re.escape(delimiter), re.escape(quote)
        self.opens = re.compile(rf"(?:\A|(?<=\n)|(?<={d})){q}")
        self.rest = re.compile(rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}")

    def ends(self, text: str, state: int) -> tuple[list[int], int]:
        """Where records end, and the state at the end."""
        out, at = [], 0
        while True:
            if state:
                closed = self.rest.match(text, at)
                if not closed:
                    return out, 1
                at, state = closed.end(), 0
            opened = self.opens.search(text, at)
            stop = opened.start() if opened else len(text)
            line = text.find("\n", at, stop)
            while line >= 0:
                out.append(line + 1)
                line = text.find("\n", line + 1, stop)
            if not opened:
                return out, 0
            at, state = opened.end(), 1

    def scan(self, text: str, state: int) -> Scan:
        ends, after = self.ends(text, state)
        first = 0 if not state else ends[0] if ends else -1
        return Scan(after, first, max(first, ends[-1]) if ends else first, 0, None)


class SqlLexer:
    """Statements of a MySQL or PostgreSQL dump.

    A state is a context (``S`` before a statement's first word, ``O`` inside a statement, ``C`` inside a COPY statement)
    and a mode (code, a kind of string, quoted name or comment), or one of two blocks: ``copy``, the data lines of COPY, and
    ``other``, what stands between ``DELIMITER`` lines (bodies of routines). Comments of PostgreSQL nest three deep at most.
    ``tags`` are the dollar quotes that the file uses.
    """

    start = 0

    def __init__(self, dialect: str = MYSQL, tags: tuple[str, ...] = ()):
        self.dialect, mysql = dialect, dialect == MYSQL
        escaped = lambda q: re.compile(rf"(?s)[^{q}\\]*+(?:(?:\\.|{q}{q})[^{q}\\]*+)*+{q}")
        plain = lambda q: re.compile(rf"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}")
        self.closers = {"'": escaped("'") if mysql else plain("'"), '"': escaped('"') if mysql else plain('"')}
        if mysql:
            self.closers["`"] = plain("`")
        else:
            self.closers["e'"] = escaped("'")
            self.closers |= {t: re.compile(rf"(?s).*?{re.escape(t)}") for t in tags}
        comments = ["/*"] if mysql else ["/*", "/*/*", "/*/*/*"]
        modes = ["", *self.closers, *comments]
        self.states = [("S", m) for m in ("", *comments)] + [(c, m) for c in ("O" if mysql else "OC") for m in modes] + [("copy", ""), ("other", "")]
        self.number = {s: k for k, s in enumerate(self.states)}
        line = r"(?:--(?=\s|\Z)|#)[^\n]*" if mysql else r"--[^\n]*"
        signs = r"'|\"|`|;|/\*" if mysql else r"'|\"|;|/\*|(?<![\w$])\$(?:[^\W\d]\w*)?\$"
        self.token = re.compile(rf"{line}|{signs}")
        self.lead = re.compile(rf"\s*(?:(?P<line>{line})|(?P<block>/\*)|(?P<end>;)|(?P<other>DELIMITER[ \t]+(?!;)\S[^\n]*)|(?P<copy>COPY\b)|(?P<word>\S))?", re.IGNORECASE)

    def scan(self, text: str, state: int, statements: list[str] | None = None, copied: list[tuple[str | None, str]] | None = None, header: str | None = None) -> Scan:
        """``statements`` receives each statement that ends here, without comments; ``copied`` header and lines of COPY blocks."""
        context, mode = self.states[state]
        clean = state == self.start or context in ("copy", "other")
        first = last = 0 if clean else -1
        mid = state if clean else -1
        opened = clean  # whether the running statement begins in this text
        begin = at = 0
        gaps: list[tuple[int, int]] = []  # comments of the running statement
        n, from_state = len(text), header

        def own(end: int) -> str:
            pieces, lo = [], begin
            for a, b in gaps:
                pieces.append(text[lo:a])
                lo = b
            return " ".join([*pieces, text[lo:end]]) if gaps else text[begin:end]

        while at < n:
            if context == "copy":
                end = _COPY_END.search(text, at)
                if copied is not None:
                    copied.append((from_state, text[at : end.start() if end else n]))
                at = end.end() if end else n
                if end:
                    context, from_state = "S", None
                begin, gaps, opened, last = at, [], True, at
            elif context == "other":
                end = _DELIMITER_END.search(text, at)
                at = end.end() if end else n
                context = "S" if end else context
                begin, gaps, opened, last = at, [], True, at
            elif mode.startswith("/*"):
                lo, depth = at, len(mode) // 2
                while depth:
                    sign = _COMMENT.search(text, at)
                    if not sign:
                        at = n
                        break
                    depth += 1 if sign[0] == "/*" and self.dialect == POSTGRES else -1 if sign[0] == "*/" else 0
                    at = sign.end()
                mode = "/*" * min(depth, 3)
                if gaps and gaps[-1][1] == lo:
                    gaps[-1] = (gaps[-1][0], at)
                else:
                    gaps.append((lo, at))
            elif mode:
                closed = self.closers[mode].match(text, at)
                at, mode = (closed.end(), "") if closed else (n, mode)
            else:
                if context == "S":
                    found = self.lead.match(text, at)
                    kind = found.lastgroup
                    if kind in ("line", "block"):
                        gaps.append((found.start(kind), found.end(kind)))
                        at, mode = found.end(), "/*" if kind == "block" else ""
                        continue
                    if kind is None:
                        at = found.end()
                        continue
                    if kind == "other":
                        if self.dialect == MYSQL:
                            context, at = "other", found.end()
                            continue
                        kind = "word"
                    context = "C" if kind == "copy" and self.dialect == POSTGRES else "O"
                    at = found.start(kind)
                sign = self.token.search(text, at)
                if not sign:
                    at = n
                elif sign[0] == ";":
                    at = sign.end()
                    whole = own(sign.start())
                    if context == "C" and _FROM_STDIN.search(whole):
                        line = text.find("\n", at)
                        at = line + 1 if line >= 0 else n
                        context, from_state = "copy", whole if opened else ""
                    else:
                        context = "S"
                        if statements is not None and whole.strip():
                            statements.append(whole.strip())
                    last = at
                    if first < 0:
                        first, mid = at, self.number[context, ""]
                    begin, gaps, opened = at, [], True
                elif sign[0] == "/*":
                    gaps.append((sign.start(), sign.end()))
                    at, mode = sign.end(), "/*"
                elif sign[0][0] in "-#":
                    gaps.append(sign.span())
                    at = sign.end()
                elif sign[0] not in self.closers:
                    at = sign.end()
                else:
                    mode = sign[0]
                    if mode == "'" and self.dialect == POSTGRES and _PREFIX_E.search(text, max(0, sign.start() - 2), sign.start()):
                        mode = "e'"
                    at = sign.end()
        return Scan(self.number[context, mode], first, last, mid, from_state if context == "copy" else None)


_COPY_END = re.compile(r"(?m)^\\\.\r?$\n?")
_DELIMITER_END = re.compile(r"(?im)^\s*DELIMITER[ \t]+;[ \t\r]*$")
_COMMENT = re.compile(r"/\*|\*/")
_FROM_STDIN = re.compile(r"(?i)\bFROM\s+stdin\b")
_PREFIX_E = re.compile(r"(?:^|[^\w$])[eE]\Z")
