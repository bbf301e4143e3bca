"""Text cleaning, title tokens, slugs and small array helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import TITLE_STOP_WORDS
from .binding import computed_once
from .markup import (
    DECODING_PASSES, decode_common, is_unusual, parsed_markup, unescape_entities, without_plain_tags,
)

# Field and item marks keep the texts of a row apart while they are cleaned together.
FIELD_MARK, ITEM_MARK = "\u0000", "\u0001"
MARKS = r"\x00\x01"
# Whitespace as text lines know it: Unicode white space and the four separators; and line ends.
BLANK = r"[\s\x1c\x1d\x1e\x1f]"
LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
# Blanks at either end of a text or of a field.
EDGE = rf"(?U)(?<![^{MARKS}]){BLANK}+|{BLANK}+(?![^{MARKS}])"
BLANK_RUN = r" [ \t]+|\t[ \t]*"
LINE_BREAKS = rf"(?U)[{BLANK}&&[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]]*{LINE_END}{BLANK}*"
# One look per blank decides whether there is anything to tidy.
UNTIDY = rf"(?U)(?={BLANK})(?:\t|{LINE_END}|  |(?<![^{MARKS}]){BLANK}|{BLANK}(?![^{MARKS}]))"
# The same for texts of ASCII characters only, without the Unicode classes, which cost several times as much per character.
ASCII_BLANK, ASCII_LINE_END = r"[\t-\r\x1c-\x20]", r"[\n-\r\x1c-\x1e]"
ASCII_EDGE = rf"(?={ASCII_BLANK})(?:(?<![^{MARKS}]){ASCII_BLANK}+|{ASCII_BLANK}++(?![^{MARKS}]))"
ASCII_LINE_BREAKS = rf"[\t\x1f ]*{ASCII_LINE_END}{ASCII_BLANK}*"
ASCII_UNTIDY = rf"(?={ASCII_BLANK})(?:\t|{ASCII_LINE_END}|  |(?<![^{MARKS}]){ASCII_BLANK}|{ASCII_BLANK}(?![^{MARKS}]))"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(as_column(text), F.lit(""))


def tidy_lines(text: Column | str) -> Column:
    """Collapse blanks inside lines, trim each line, drop empty lines. No entity decoding.

    Works on one text or on marked fields; most are tidy already and pass after one look.
    """
    body = as_column(text)
    spaced = F.regexp_replace(body, BLANK_RUN, " ")

    def tidied(untidy: str, line_breaks: str, edge: str) -> Column:
        joined = F.regexp_replace(spaced, line_breaks, "\n")
        return F.when(F.rlike(body, F.lit(untidy)), F.regexp_replace(joined, edge, "")).otherwise(body)

    is_ascii = F.octet_length(body) == F.length(body)
    return F.when(is_ascii, tidied(ASCII_UNTIDY, ASCII_LINE_BREAKS, ASCII_EDGE)).otherwise(tidied(UNTIDY, LINE_BREAKS, EDGE))


def clean_text(value: Column | str) -> Column:
    """Entity-decoded text with tidy lines; an empty string where there is none.

    For one short column. Tables with many text columns use `cleaned`.
    """
    text = as_column(value).cast("string")
    return F.coalesce(tidy_lines(unescape_entities(text)), F.lit(""))


def glued_list(items: Column | str) -> Column:
    """An array of texts as one value for `cleaned`; read it back with `glued_items`."""
    return F.array_join(F.transform(as_column(items), lambda item: F.coalesce(item, F.lit(""))), ITEM_MARK)


def glued_items(text: Column | str) -> Column:
    """The non-blank items of a cleaned list."""
    return F.filter(F.split(as_column(text), ITEM_MARK), lambda item: item != "")


def cleaned(table: DataFrame, fields: Mapping[str, Column | str]) -> DataFrame:
    """Add a cleaned column per field; missing values become empty strings.

    The fields of a row are decoded and tidied as one string, so the work per row does not grow
    with the number of columns, and at most one column crosses to Python.
    """
    pieces = [
        F.coalesce(F.replace(as_column(value).cast("string"), F.lit(FIELD_MARK), F.lit("")), F.lit(""))
        for value in fields.values()
    ]
    glued = table.withColumn("_glued", F.concat_ws(FIELD_MARK, *pieces))
    decoded = computed_once(glued, {"_glued": unescape_entities(F.col("_glued"))})
    split = computed_once(decoded, {"_parts": F.split(tidy_lines("_glued"), FIELD_MARK)}).drop("_glued")
    return split.withColumns({name: F.col("_parts")[i] for i, name in enumerate(fields)}).drop("_parts")


def html_texts(
    table: DataFrame, fields: Mapping[str, Column | str], drop_script: bool = False, bare: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add a column of readable text per (up to three times escaped) HTML field. `bare`: see `parsed_markup`.

    The steps are plain projections, each read more than once by the next, which the optimiser does not merge; so no text is
    decoded or scanned twice, and a query that leaves a text out does not read it.
    """
    names = list(fields)
    raw = table.withColumns({name: as_column(value).cast("string") for name, value in fields.items()})
    decoded = raw.withColumns({f"_d_{n}": decode_common(F.col(n)) for n in names})
    # A pass for itself each, so that texts without an ampersand left are not searched for entities again.
    for _ in range(DECODING_PASSES - 1):
        decoded = decoded.withColumns({f"_d_{n}": decode_common(F.col(f"_d_{n}")) for n in names})
    sorted_out = decoded.withColumns({f"_odd_{n}": F.when(is_unusual(F.col(n), F.col(f"_d_{n}")), F.col(n)) for n in names})
    tagless = sorted_out.withColumns({f"_d_{n}": without_plain_tags(F.col(f"_d_{n}")) for n in names})
    once = tagless.withColumns({f"_d_{n}": decode_common(F.col(f"_d_{n}")) for n in names})
    read = once.withColumns({
        n: F.coalesce(parsed_markup(F.col(f"_odd_{n}"), drop_script, bare), decode_common(F.col(f"_d_{n}")))
        for n in names
    }).drop(*(f"_odd_{n}" for n in names), *(f"_d_{n}" for n in names))
    return read.withColumns({n: F.coalesce(tidy_lines(n), F.lit("")) for n in names})


def strip_tags(value: Column | str, decode: bool = True) -> Column:
    """Tags to blanks first, then one decoding pass, then single-spaced."""
    bare = F.regexp_replace(as_column(value), "<[^>]+>", " ")
    if decode:
        bare = unescape_entities(bare)
    return F.trim(F.regexp_replace(bare, rf"(?U){BLANK}+", " "))


def title_tokens(title: Column | str) -> Column:
    """Distinct words of a title longer than two letters, without seniority words."""
    words = F.split(F.regexp_replace(F.lower(as_column(title)), "[^a-z0-9 ]", " "), " +")
    kept = F.filter(words, lambda word: F.length(word) > 2)
    return F.array_distinct(F.array_except(kept, F.array(*map(F.lit, TITLE_STOP_WORDS))))


def token_overlap(left: Column | str, right: Column | str) -> Column:
    return F.size(F.array_intersect(as_column(left), as_column(right)))


def slugify(text: Column | str) -> Column:
    dashed = F.regexp_replace(F.trim(F.lower(as_column(text))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"\A-|-\z", "")


def posting_slug(company_id: Column | str, title: Column | str) -> Column:
    return F.concat_ws("-", as_column(company_id), slugify(title))


def url_base(url: Column | str) -> Column:
    return F.substring_index(as_column(url), "?", 1)


def join_parts(*parts: Column | str) -> Column:
    """The non-empty parts joined by a comma and a blank; empty when there are none."""
    return F.concat_ws(", ", *(blank_to_null(part) for part in parts))


def first_or_blank(items: Column | str) -> Column:
    return F.coalesce(F.try_element_at(as_column(items), F.lit(1)), F.lit(""))


def contains_keyword(keyword: str, *columns: Column | str) -> Column:
    """True when any column holds the trimmed keyword, ignoring case; a blank keyword matches."""
    wanted = keyword.strip().lower()
    if not wanted:
        return F.lit(True)
    found = F.lit(False)
    for column in columns:
        held = F.contains(F.lower(as_column(column)), F.lit(wanted))
        found = found | F.coalesce(held, F.lit(False))
    return found


# Shapes of personal contact data; bounded so that a long text is scanned once.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}"


def redact_personal(text: Column | str) -> Column:
    """Mask e-mail addresses and telephone numbers."""
    body = as_column(text)
    no_mail = F.when(
        F.contains(body, F.lit("@")), F.regexp_replace(body, EMAIL_PATTERN, "[email]")
    ).otherwise(body)
    return F.regexp_replace(no_mail, PHONE_PATTERN, "[phone]")
