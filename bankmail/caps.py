"""Limits on how much of a text is kept. Nothing is cut unless a caller asks for it."""

from __future__ import annotations

from dataclasses import dataclass

from bankmail import dims


@dataclass(frozen=True)
class Caps:
    """Characters, items and lengths kept; None keeps all."""

    body: int | None = None
    raw: int | None = None
    offer: int | None = None
    links: int | None = None
    link_chars: int | None = None
    images: int | None = None
    image_min: int = 0
    image_chars: int | None = None


WHOLE = Caps()
#: The limits of the behaviour to match.
PARITY = Caps(
    body=dims.MAX_BODY_CHARS,
    raw=dims.MAX_RAW_CHARS,
    offer=dims.MAX_OFFER_CHARS,
    links=dims.MAX_LINKS,
    link_chars=dims.MAX_LINK_CHARS,
    images=dims.MAX_IMAGES,
    image_min=dims.MIN_OCR_CHARS,
    image_chars=dims.MAX_OCR_CHARS,
)
