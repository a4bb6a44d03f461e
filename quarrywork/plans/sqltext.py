"""Helpers that spell the text functions in DuckDB's SQL for the twins."""

from __future__ import annotations

SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The pattern with Unicode white space and word classes spelled out."""
    pattern = pattern.replace(r"[\s\S]", "(?s:.)")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
            i += 2
        elif two == r"\w":
            out.append(r"\p{L}\p{M}\p{Nd}\p{Pc}" if in_class else r"[\p{L}\p{M}\p{Nd}\p{Pc}]")
            i += 2
        elif two == r"\d":
            out.append(r"\p{Nd}")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[" and not in_class:
                in_class = True
            elif pattern[i] == "]" and in_class and pattern[i - 1] != "[":
                in_class = False
            out.append(pattern[i])
            i += 1
    return "".join(out)


def replace_all(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, {q(re2(pattern))}, {q(replacement)}, 'g')"


def rules(expr: str, items: tuple[tuple[str, str], ...]) -> str:
    for pattern, replacement in items:
        expr = replace_all(expr, pattern, replacement)
    return expr


def strip(expr: str) -> str:
    return replace_all(replace_all(expr, r"^\s+"), r"\s+$")


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(re2(pattern))}))"


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(re2(chr(92) + 'S+'))})"
