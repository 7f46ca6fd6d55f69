"""Bytes of a text as words, in bounded pieces.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``, which is what
``bytes.split()`` cuts; only A-Z are lower-cased.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import count

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = b" \t\n\x0b\x0c\r"
PIECE = 1 << 20


def to_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; a null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_pieces(data: bytes, piece: int = PIECE, lower: bool = True) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists that cover about ``piece`` bytes each, so a
    very long text never becomes one list.  Cuts lie on white space only."""
    if len(data) <= piece:
        yield (data.translate(ASCII_LOWER) if lower else data).split()
        return
    start, size = 0, len(data)
    while start < size:
        end = min(start + piece, size)
        while end < size and data[end] not in SPACES:
            end += 1
        part = data[start:end]
        yield (part.translate(ASCII_LOWER) if lower else part).split()
        start = end


def free_names(taken: Iterable[str], wanted: Sequence[str]) -> dict[str, str]:
    """A name for each wanted column that no taken column has (Spark ignores case):
    itself, or with the first free number behind it."""
    used, found = {c.lower() for c in taken}, {}
    for name in wanted:
        numbered = (name if not i else f"{name}_{i}" for i in count())
        found[name] = next(n for n in numbered if n.lower() not in used)
        used.add(found[name].lower())
    return found
