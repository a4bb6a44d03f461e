"""Web pages to text, as chains of built-in regular expression calls."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from ..functions.markdown import apply_rules

_HIDDEN = ("script", "style", "head", "noscript", "template")
_BLOCKS = "p|div|section|article|main|header|footer|nav|aside|table|tr|ul|ol|blockquote|pre|form|figure"
HREF = r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

#: Visible text with headers, list items, links and emphasis marked as Markdown.
MARK_RULES = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>|\z)", "") for tag in _HIDDEN),
    (r"\s+", " "),
    (rf"(?i)<a\s(?:[^>]*\s)?{HREF}[^>]*>(.*?)</a\s*>", r"[\4](\1\2\3)"),
    (r"(?i)<a(?:\s[^>]*)?>(.*?)</a\s*>", r"[\1]()"),
    *((rf"(?i)<h{n}(?:\s[^>]*)?>", f"\n\n{'#' * n} ") for n in range(1, 7)),
    (r"(?i)<li(?:\s[^>]*)?>", "\n- "),
    (r"(?i)<br(?:\s[^>]*|/)?>", "\n"),
    (rf"(?i)<(?:/(?:{_BLOCKS}|h[1-6])\s*|(?:{_BLOCKS})(?:\s[^>]*)?)>", "\n\n"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"<[/!?a-zA-Z][^>]*>", ""),
)
SPACE_RULES = (
    (r" {2,}", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+", ""),
    (r"\s+\z", ""),
)
#: A reference after its ``&``: by number, or by name; some old names need no semicolon.
REFERENCE = r"^(#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[A-Za-z][A-Za-z0-9]*)(;?)"
_CP1252 = {str(n): bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(128, 160)}


def reference_names() -> dict[str, str]:
    """Character names of HTML with their semicolon, if they need one, from the standard library's table."""
    return dict(html5)


def character(code: Column) -> Column:
    """The character of a number; numbers of old Windows pages are read as such, those of no character are U+FFFD."""
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    old = F.from_json(F.lit(json.dumps(_CP1252)), "map<string,string>")
    return F.when(code.between(128, 159), F.element_at(old, code.cast("string"))).otherwise(point)


def decoded(text: Column) -> Column:
    """Character references as characters, each once; what is none stays. A no-break space becomes a space."""
    names = F.from_json(F.lit(json.dumps(reference_names())), "map<string,string>")

    def part(piece: Column) -> Column:
        return F.get(F.transform(F.array(F.regexp_extract(piece, REFERENCE, 0)), lambda named: of(piece, named)), F.lit(0))

    def of(piece: Column, named: Column) -> Column:
        body = F.rtrim(named, F.lit(";"))
        number = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 9)).cast("bigint")
        found = F.when(F.startswith(body, F.lit("#")), character(number)).when(body != "", F.try_element_at(names, named))
        rest = F.substr(piece, F.length(named) + 1)
        return F.when(found.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(F.when(found == " ", " ").otherwise(found), rest))

    def whole(value: Column) -> Column:
        pieces = F.split(value, "&")
        others = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        joined = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(others, part), ""))
        return F.when(F.contains(value, F.lit("&")), joined).otherwise(value)

    # one element, so that the text is worked out once however often it is named
    return F.get(F.transform(F.array(text), whole), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Visible text of a page as Markdown."""
    return apply_rules(decoded(apply_rules(html, MARK_RULES)), SPACE_RULES)


TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = rf"(?is)<a\s(?:[^>]*\s)?{HREF}"


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, TITLE, 1)), F.lit(""))


def links(html: Column) -> Column:
    """Targets of all links, quoted or not, references decoded."""
    whole = F.regexp_extract_all(html, F.lit(LINK), F.lit(0))
    return F.transform(whole, lambda x: decoded(F.concat(*[F.regexp_extract(x, LINK, n) for n in (1, 2, 3)])))


def url_file_name(url: Column, content_type: Column) -> Column:
    """File name a downloaded page is stored under.

    The last path part of the address, ``document`` when there is none; without an
    ending it gets the one of its content type, ``.html`` if that is unknown.
    """
    from ..functions.fixed import CONTENT_TYPE_EXTENSIONS

    path = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "")
    name = F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("document"))
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPE_EXTENSIONS.items() for x in pair])
    kind = F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))
    ending = F.coalesce(F.element_at(kinds, kind), F.lit(".html"))
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, ending))
