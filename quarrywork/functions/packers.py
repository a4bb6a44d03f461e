"""Small per-document helpers for chunkers whose next cut depends on the previous one.

Each takes one whole text and yields ``(text, start_char, end_char)`` in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Span = tuple[str, int, int]

_SENTENCE_END = re.compile(r"[.!?]+[\s\n]+|\n{2,}")
_PARAGRAPH_BREAK = "\n\n"
_LOOK_BACK = 100


def estimate(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def cut_at_boundaries(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Windows of ``4 * size`` characters, each end pulled back to a sentence or word end.

    A boundary is used only in the last 100 characters and past half of the window.
    The run stops with the chunk that reaches the end of the text.
    """
    width, back = 4 * size, 4 * overlap
    total, start = len(text), 0
    if total <= width:
        yield text, 0, total
        return
    while True:
        end = min(start + width, total)
        if end < total:
            floor, half = max(end - _LOOK_BACK, start), start + width // 2
            dot = text.rfind(". ", floor, end)
            gap = text.rfind(" ", floor, end)
            if dot > half:
                end = dot + 1
            elif gap > half:
                end = gap
        yield text[start:end].strip(), start, end
        if end >= total:
            return
        start = end - back


def _trimmed_pieces(text: str, bounds: list[tuple[int, int]]) -> Iterator[Span]:
    for low, high in bounds:
        piece = text[low:high]
        body = piece.strip()
        if body:
            start = low + len(piece) - len(piece.lstrip())
            yield body, start, start + len(body)


def paragraphs(text: str) -> Iterator[Span]:
    bounds, low = [], 0
    while (hit := text.find(_PARAGRAPH_BREAK, low)) >= 0:
        bounds.append((low, hit))
        low = hit + len(_PARAGRAPH_BREAK)
    bounds.append((low, len(text)))
    return _trimmed_pieces(text, bounds)


def sentences(text: str) -> Iterator[Span]:
    """Sentences with their end marks; the fragment after the last mark is kept."""
    bounds, low = [], 0
    for hit in _SENTENCE_END.finditer(text):
        bounds.append((low, hit.end()))
        low = hit.end()
    bounds.append((low, len(text)))
    return _trimmed_pieces(text, bounds)


def pack(pieces: Iterator[Span], joiner: str, fits, carry) -> Iterator[Span]:
    """Greedy packing: pieces are joined while ``fits(joined)``, then ``carry(chunk)`` opens the next.

    Offsets are those of the pieces in the source; the carried text is not counted.
    """
    parts: list[str] = []
    length = start = end = 0
    for body, low, high in pieces:
        grown = length + len(joiner) + len(body) if parts else len(body)
        if parts and not fits(grown):
            chunk = joiner.join(parts)
            yield chunk.strip(), start, end
            tail = carry(chunk)
            parts = [tail] if tail else []
            length = len(tail)
            grown = length + len(joiner) + len(body) if parts else len(body)
            start = low
        elif not parts:
            start = low
        parts.append(body)
        length, end = grown, high
    if parts:
        yield joiner.join(parts).strip(), start, end


def pack_paragraphs(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Paragraphs up to ``4 * size`` characters, carrying the last ``4 * overlap`` characters."""
    limit, back = 4 * size, 4 * overlap
    return pack(
        paragraphs(text), _PARAGRAPH_BREAK,
        lambda n: n <= limit,
        lambda chunk: chunk[-back:] if back else "",
    )


def pack_sentences(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Sentences up to ``size`` estimated tokens, carrying the last quarter of ``overlap`` in words."""
    keep = -(-overlap // 4)

    def carry(chunk: str) -> str:
        return " ".join(chunk.split()[-keep:]) if keep else ""

    return pack(sentences(text), " ", lambda n: max(1, n // 4) <= size, carry)


def cut_fixed(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Windows of ``4 * size`` characters every ``4 * (size - overlap)``, then the last ``4 * overlap`` characters."""
    width, back = 4 * size, 4 * overlap
    step = width - back
    last = max(0, -((width - len(text)) // step))
    for start in range(0, last * step + 1, step):
        yield text[start : start + width], start, min(len(text), start + width)
    if back and len(text) - back > last * step:
        yield text[-back:], len(text) - back, len(text)


def cut_tokens(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Windows of ``size`` words with the white space after them."""
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+\s*|\s+", text)]
    step = size - overlap
    last = max(0, -((size - len(tokens)) // step))
    for first in range(0, last * step + 1, step):
        own = tokens[first : first + size]
        yield text[own[0][0] : own[-1][1]], own[0][0], own[-1][1]


STRATEGIES = {
    "character": cut_at_boundaries,
    "recursive_character": pack_paragraphs,
    "semantic_window": pack_sentences,
}
