"""Terms of UTF-8 texts: runs of ASCII letters, digits and all characters beyond ASCII."""

from __future__ import annotations

import re
from collections.abc import Iterator

# A-Z are in no term because texts are lower-cased first; every byte of a character beyond ASCII is 0x80 or more.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20


def term_lists(raw: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, A-Z lower-cased, as lists from about ``piece`` bytes each.

    Pieces end between terms, so long texts cost the memory of a piece. Null has no terms.
    """
    raw = (raw or b"").lower()  # of bytes: A-Z alone
    at = 0
    while at < len(raw):
        stop = len(raw)
        if at + piece < stop and (gap := _GAP.search(raw, at + piece)):
            stop = gap.start()
        yield _TERM.findall(raw, at, stop)
        at = stop
