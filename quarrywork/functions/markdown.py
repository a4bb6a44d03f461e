"""Markdown and text cleaning as chains of built-in regular expression calls.

The patterns are fixed values. Flags: ``m`` line anchors, ``s`` dot matches a line
end, ``i`` ignore case, ``d`` only ``\\n`` ends a line, ``U`` Unicode classes.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .scan import SPACES

# Fixed values: (pattern, replacement) in the order they are applied to count plain text.
PLAIN_RULES = (
    (r"```[\s\S]*?```", ""),
    (r"`[^`]+`", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", r"\1"),
    (r"\*([^*]+)\*", r"\1"),
    (r"__([^_]+)__", r"\1"),
    (r"_([^_]+)_", r"\1"),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"(?m)^>\s+", ""),
    (r"(?m)^[\s]*[-*+]\s+", ""),
    (r"(?m)^[\s]*\d+\.\s+", ""),
    (r"(?m)^[-*_]{3,}$", ""),
    (r"\n{3,}", "\n\n"),
)

# Rules that turn Markdown into readable text.
TEXT_RULES = (
    (r"(?s)```[\w]*\n?(.*?)```", r"\1"),
    (r"`([^`]+)`", r"\1"),
    (r"(?m)^#{1,6}\s*(.+)$", r"\1"),
    (r"\*\*\*(.+?)\*\*\*", r"\1"),
    (r"___(.+?)___", r"\1"),
    (r"\*\*(.+?)\*\*", r"\1"),
    (r"__(.+?)__", r"\1"),
    (r"\*(.+?)\*", r"\1"),
    (r"_(.+?)_", r"\1"),
    (r"~~(.+?)~~", r"\1"),
    (r"\[([^\]]+)\]\([^\)]+\)", r"\1"),
    (r"!\[([^\]]*)\]\([^\)]+\)", r"\1"),
    (r"\[([^\]]+)\]\[[^\]]*\]", r"\1"),
    (r"(?m)^\[[^\]]+\]:\s*\S+.*$", ""),
    (r"(?m)^>\s*", ""),
    (r"(?m)^[\s]*[-*+]\s+", "• "),
    (r"(?m)^[\s]*(\d+)\.\s+", r"\1. "),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"<[^>]+>", ""),
    (r"\n{3,}", "\n\n"),
)

# Macro and script fragments.
MACRO_RULES = (
    (r"(?is)Sub\s+\w+.*?End\s+Sub", ""),
    (r"(?is)Function\s+\w+.*?End\s+Function", ""),
    (r"(?i)\{?MACRO\w+\}?", ""),
    (r"(?i)\{?DDE\w+\}?", ""),
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?i)javascript:", ""),
)

# Document properties.
METADATA_RULES = (
    (r"(?i)Author:\s*[^\n]+", ""),
    (r"(?i)Created:\s*[^\n]+", ""),
    (r"(?i)Modified:\s*[^\n]+", ""),
    (r"(?i)Creator:\s*[^\n]+", ""),
    (r"(?i)Producer:\s*[^\n]+", ""),
    (r"(?i)Keywords:\s*[^\n]+", ""),
    (r"(?i)Subject:\s*[^\n]+", ""),
    (r"(?i)<meta[^>]*>", ""),
    (r"(?is)<dc:creator[^>]*>.*?</dc:creator>", ""),
    (r"(?is)<dc:date[^>]*>.*?</dc:date>", ""),
)

# An e-mail address and what replaces it.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_MASK = "[EMAIL_REDACTED]"

# What counts as a structural element.
STRUCTURE_PATTERNS = {
    "h1": r"(?m)^#\s+",
    "h2": r"(?m)^##\s+",
    "h3": r"(?m)^###\s+",
    "h4_plus": r"(?m)^#{4,6}\s+",
    "bullet_items": r"(?m)^[\s]*[-*+]\s+",
    "numbered_items": r"(?m)^[\s]*\d+\.\s+",
    "fences": r"```",
    "inline_code": r"`[^`]+`",
    "links": r"\[([^\]]+)\]\([^)]+\)",
    "images": r"!\[([^\]]*)\]\([^)]+\)",
    "blockquotes": r"(?m)^>\s+",
    "table_rows": r"(?m)^\|.+\|$",
}
NAMED_IMAGES = r"!\[([^\]]+)\]\([^)]+\)"


def java_pattern(pattern: str) -> str:
    """Unicode classes and ``\\n`` as the only line end, as in the pattern's definition."""
    return "(?dU)" + pattern


def java_replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text)


def apply_rules(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, java_pattern(pattern), java_replacement(replacement))
    return text


def re2_pattern(pattern: str) -> str:
    """The same classes for RE2, whose own are ASCII; it knows ``\\n`` alone as a line end."""
    spaces = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    for java, re2 in ((r"[\s\S]", "(?s:.)"), (r"[\s]", r"\s"), (r"\s", f"[{spaces}]"), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(java, re2)
    return pattern


def plain_texts(texts: pa.Array) -> list[str | None]:
    """:func:`md_to_plain` of an Arrow column, by RE2: some hundred MB a second and rule, in time linear in the text."""
    for pattern, replacement in PLAIN_RULES:
        texts = pc.replace_substring_regex(texts, re2_pattern(pattern), replacement)
    return [t if t is None else t.strip(SPACES) for t in texts.to_pylist()]


def structure_counts(texts: pa.Array) -> dict[str, pa.Array]:
    """The counts that :func:`structure_of` needs, of an Arrow column."""

    def count(pattern: str) -> pa.Array:
        if not pattern.startswith("(?m)^"):
            return pc.count_substring_regex(texts, pattern)
        # that function goes on behind a match as if a line began there; a replacement, of one byte more, does not
        return pc.subtract(pc.binary_length(pc.replace_substring_regex(texts, pattern, r"a\0")), pc.binary_length(texts))

    return {name: count(re2_pattern(p)) for name, p in {**STRUCTURE_PATTERNS, "named_images": NAMED_IMAGES}.items()}


def strip(text: Column) -> Column:
    """Remove white space at both ends (any Unicode white space)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def md_to_plain(text: Column) -> Column:
    """Plain text for counting: code is dropped, link text kept."""
    return strip(apply_rules(text, PLAIN_RULES))


def md_to_text(text: Column) -> Column:
    """Plain text for reading: code is kept, bullets become dots, lines are trimmed."""
    lines = F.split(apply_rules(text, TEXT_RULES), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def remove_macros(text: Column) -> Column:
    return apply_rules(text, MACRO_RULES)


def strip_metadata(text: Column) -> Column:
    return apply_rules(text, METADATA_RULES)


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, java_pattern(EMAIL_PATTERN), EMAIL_MASK)


def clean_text(
    text: Column, macros: bool = True, metadata: bool = True, emails: bool = True, output: str = "markdown"
) -> Column:
    """The cleaners in their fixed order, each behind a flag, then the output form."""
    if macros:
        text = remove_macros(text)
    if metadata:
        text = strip_metadata(text)
    if emails:
        text = redact_emails(text)
    if output == "text":
        text = md_to_text(text)
    elif output != "markdown":
        raise ValueError(f"unknown output form: {output}")
    return text


def structure(text: Column) -> dict[str, Column]:
    """Counts of headers, list items, code, links, images, quotes and table rows."""
    patterns = {**STRUCTURE_PATTERNS, "named_images": NAMED_IMAGES}
    return structure_of({name: F.regexp_count(text, F.lit(java_pattern(p))) for name, p in patterns.items()})


def structure_of(counts: dict[str, Column]) -> dict[str, Column]:
    """The structure from the counts of ``STRUCTURE_PATTERNS`` and of images with a name."""
    count = dict(counts)
    fences, named_images = count.pop("fences"), count.pop("named_images")
    count["code_blocks"] = F.floor(fences / 2).cast("int")
    count["headers_total"] = count["h1"] + count["h2"] + count["h3"] + count["h4_plus"]
    count["list_items_total"] = count["bullet_items"] + count["numbered_items"]
    count["links_only"] = count["links"] - named_images
    return count
