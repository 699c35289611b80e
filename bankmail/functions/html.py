"""What a mail's HTML part holds: its text, its images, its links."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankmail import dims
from bankmail.functions.once import let

# Text inside these is not shown to a reader.
_HIDDEN = {"script", "style", "template", "rt", "rp"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.current: list[str] = []
        self.hidden: list[str] = []

    def _break(self) -> None:
        piece = "".join(self.current).strip()
        if piece:
            self.pieces.append(piece)
        self.current = []

    def handle_starttag(self, tag, attrs):
        self._break()
        if tag in _HIDDEN:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._break()

    def handle_endtag(self, tag):
        self._break()
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.current.append(data)

    def handle_comment(self, data):
        self._break()

    def handle_decl(self, decl):
        self._break()

    def handle_pi(self, data):
        self._break()


def _text_of(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser._break()
    return " ".join(parser.pieces)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text nodes, each stripped, joined by one blank. NULL stays NULL and costs nothing.

    Spark has no HTML parser, so this one runs in Python, a batch of rows at a time.
    """
    return html.map(_text_of)


_ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_VALUE = r"""[^\s"'<>/=]+(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


# Named escapes that occur in addresses.
_ESCAPES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
#: What numbers 128 to 159 stand for on the web: the characters of Windows.
_WINDOWS = {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}


def _character(number: Column) -> Column:
    """The character of a number; the replacement character where there is none."""
    valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    code = F.when(valid, number).otherwise(0xFFFD)
    windows = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])
    return F.when((number >= 0x80) & (number < 0xA0), F.try_element_at(windows, number)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescaped(text: Column) -> Column:
    """Named and numeric escapes decoded, each once: what comes out is not decoded again."""

    def decoded(piece: Column) -> Column:
        number = r"^&#([0-9]{1,8});?"
        hexadecimal = r"^&#[xX]([0-9A-Fa-f]{1,7});?"
        rest = lambda pattern: F.regexp_replace(piece, F.lit(pattern), F.lit(""))
        out = F.when(F.rlike(piece, F.lit(number)), F.concat(_character(F.regexp_extract(piece, number, 1).cast("int")), rest(number)))
        out = out.when(F.rlike(piece, F.lit(hexadecimal)), F.concat(_character(F.conv(F.regexp_extract(piece, hexadecimal, 1), 16, 10).cast("int")), rest(hexadecimal)))
        for escape, char in _ESCAPES.items():
            out = out.when(F.startswith(piece, F.lit(escape)), F.concat(F.lit(char), F.substr(piece, F.lit(len(escape) + 1))))
        return out.otherwise(piece)

    pieces = F.split(text, "(?=&)")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def _tags(html: Column, tag: str) -> Column:
    """Inside of every `<tag ...>`, comments and script or style bodies left out."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    seen = F.regexp_replace(seen, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    # most bodies have no such tag at all: a plain search settles that
    present = F.when(F.lower(html).contains(f"<{tag}"), seen).otherwise(F.lit(""))
    pattern = rf"""(?is)<{tag}(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    return F.regexp_extract_all(present, F.lit(pattern), 1)


def _attribute(inside: Column, name: str) -> Column:
    """Value of the last attribute of that name, unquoted and unescaped; NULL when absent."""
    names = F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(inside, F.lit(_VALUE), 1)
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: p["n"] == name)
    raw = F.try_element_at(pairs, F.lit(-1))["v"]
    quoted = r"""(?s)^(["'])(.*)\1\z"""
    value = let(raw, lambda v: F.when(F.rlike(v, F.lit(quoted)), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return let(value, unescaped)


def image_urls(html: Column) -> Column:
    """`http` sources of `<img>` tags in order; width or height of exactly 0 or 1 is a tracker."""
    images = F.transform(
        _tags(html, "img"),
        lambda t: F.struct(
            _attribute(t, "src").alias("src"),
            F.coalesce(_attribute(t, "width"), F.lit("")).alias("width"),
            F.coalesce(_attribute(t, "height"), F.lit("")).alias("height"),
        ),
    )
    usable = F.filter(
        images,
        lambda i: F.startswith(i["src"], F.lit("http"))
        & ~i["width"].isin("0", "1")
        & ~i["height"].isin("0", "1"),
    )
    return F.transform(usable, lambda i: i["src"])


def links(html: Column, first: int | None = None, max_chars: int | None = None) -> Column:
    """Distinct `http` targets in first-seen order, none to unsubscribe; the `first` ones and those below `max_chars` where given."""
    targets = F.filter(
        F.transform(_tags(html, "a"), lambda t: _attribute(t, "href")),
        lambda h: F.startswith(h, F.lit("http"))
        & ~F.contains(F.lower(h), F.lit("unsubscribe"))
        & (F.lit(True) if max_chars is None else F.length(h) < max_chars),
    )
    found = F.array_distinct(targets)
    return found if first is None else F.slice(found, 1, first)


def needs_ocr(body: Column, html: Column) -> Column:
    """Almost no text, and at least one usable image to read instead."""
    from bankmail.functions.text import strip

    short = F.length(strip(F.coalesce(body, F.lit("")))) < dims.MIN_BODY_CHARS
    return F.when(short, F.size(image_urls(html)) > 0).otherwise(F.lit(False))


def usable_image(content_type: Column, content_length: Column, width: Column, height: Column) -> Column:
    """An image by content type, of plausible size; a length of 0 or NULL means not declared."""
    size = F.coalesce(content_length, F.lit(0))
    return (
        F.startswith(F.coalesce(content_type, F.lit("")), F.lit("image/"))
        & ((size <= 0) | (size >= dims.IMAGE_MIN_BYTES))
        & (size <= dims.IMAGE_MAX_BYTES)
        & (width >= dims.IMAGE_MIN_SIDE)
        & (height >= dims.IMAGE_MIN_SIDE)
    )


# The executors need not have this package: what `html_text` runs travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
