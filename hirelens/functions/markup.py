"""Entity decoding and HTML text.

Spark has no built-in for either. Texts that use only the common entities and plain tags stay in
the JVM, where a few replacements are exact; any other text goes to Python, one column at a time,
with nulls in place of the rows that stayed behind.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..fixed_values import BLOCK_TAGS

# The functions below travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECODING_PASSES = 3

# A name as `unescape` looks for it, and what stands for an ampersand that is to stay: no text holds half a surrogate pair.
NAMED_ENTITY = re.compile(r"&([^\t\n\f <&#;]{1,32};?)")
KEPT_AMPERSAND = "\ud800"

# Entities decoded in the JVM; the ampersand comes last, so a pass never decodes its own output.
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&",
}
COMMON_NAMES = "(?:lt|gt|quot|apos|#39|nbsp|amp);"
# Anything else that could be an entity: now, or after decoding the ampersands before it.
OTHER_ENTITY = f"&(?!{COMMON_NAMES})[A-Za-z#]"
OTHER_ENTITY_DEEP = f"&(?:amp;)*(?!{COMMON_NAMES})[A-Za-z#]"
# A "<" that does not open a plain tag, or opens an element whose content is not parsed as usual.
UNUSUAL_MARKUP = (
    r"(?i)<(?:/?(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)\b"
    r"|(?!/?[a-z][a-z0-9]*(?:\s+[a-z-]+=\"[^\"<>&]*\")*\s*/?>))"
)
BLOCK_MARKUP = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>"


class TextOfMarkup(HTMLParser):
    """Character data of a document, with a line break around block elements."""

    def __init__(self, drop_script: bool) -> None:
        super().__init__()
        self.drop_script = drop_script
        self.pieces: list[str] = []

    def _boundary(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.pieces.append("\n")

    def handle_starttag(self, tag, attrs):
        self._boundary(tag)

    def handle_endtag(self, tag):
        self._boundary(tag)

    def handle_data(self, data):
        if not (self.drop_script and self.cdata_elem):
            self.pieces.append(data)


def without_bare_entities(text: str, bare: tuple[str, ...] | None) -> str:
    """The text with the ampersands marked that begin a name without a semicolon, unless the name begins with one of `bare`.
    None: HTML's own list, so nothing is marked."""
    if bare is None or "&" not in text:
        return text

    def marked(found: re.Match) -> str:
        name = found[1]
        return found[0] if name.startswith(bare) or (name in html5 and name.endswith(";")) else KEPT_AMPERSAND + name

    return NAMED_ENTITY.sub(marked, text)


def decode_once(text: str, bare: tuple[str, ...] | None = None) -> str:
    return unescape(without_bare_entities(text, bare)).replace(KEPT_AMPERSAND, "&")


def decode_until_stable(text: str, bare: tuple[str, ...] | None = None) -> str:
    for _ in range(DECODING_PASSES):
        before, text = text, decode_once(text, bare)
        if text == before:
            break
    return text


def markup_text(text: str, drop_script: bool, bare: tuple[str, ...] | None = None) -> str:
    reader = TextOfMarkup(drop_script)
    reader.feed(without_bare_entities(decode_until_stable(text, bare), bare))
    reader.close()
    return decode_once("".join(reader.pieces).replace(KEPT_AMPERSAND, "&"), bare)


def map_texts(texts: pa.Array, change: Callable[[str], str], rows: int = 200) -> pa.Array:
    """The changed texts, so many at a time: of a batch only these are Python strings at once."""
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    parts = [
        pa.array([None if text is None else change(text) for text in texts.slice(first, rows).to_pylist()], pa.string())
        for first in range(0, len(texts), rows)
    ]
    return pa.concat_arrays(parts)


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return map_texts(texts, unescape)


def decode_common(text: Column, passes: int = 1) -> Column:
    decoded = text
    for _ in range(passes):
        for entity, mark in COMMON_ENTITIES.items():
            decoded = F.replace(decoded, F.lit(entity), F.lit(mark))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def unescape_entities(text: Column) -> Column:
    """One decoding pass."""
    unusual = F.contains(text, F.lit("&")) & F.rlike(text, F.lit(OTHER_ENTITY))
    return F.coalesce(_unescape(F.when(unusual, text)), decode_common(text))


def is_unusual(text: Column, decoded: Column) -> Column:
    """Whether a text, fully decoded in `decoded`, needs the real parser."""
    return (F.contains(text, F.lit("&")) & F.rlike(text, F.lit(OTHER_ENTITY_DEEP))) | (
        F.contains(decoded, F.lit("<")) & F.rlike(decoded, F.lit(UNUSUAL_MARKUP))
    )


def without_plain_tags(decoded: Column) -> Column:
    """Line breaks for block tags, nothing for the others."""
    bare = F.regexp_replace(F.regexp_replace(decoded, BLOCK_MARKUP, "\n"), "<[^>]*>", "")
    return F.when(F.contains(decoded, F.lit("<")), bare).otherwise(decoded)


def parsed_markup(text: Column, drop_script: bool = False, bare: tuple[str, ...] | None = None) -> Column:
    """Python's reading of a text: decoded until stable, parsed, decoded once more. `bare` are the entities that are read
    without their semicolon as well; None: those that HTML reads so."""

    @F.arrow_udf(StringType())
    def _markup(texts: pa.Array) -> pa.Array:
        return map_texts(texts, lambda one: markup_text(one, drop_script, bare))

    return _markup(text)
