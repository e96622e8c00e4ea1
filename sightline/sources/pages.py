"""Visible text of HTML pages as column expressions, with its content hash."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content a reader doesn't see, elements that break the line, and table cells.
HIDDEN_TAGS = ("script", "style", "noscript", "ix:header", "head")
BLOCK_TAGS = ("p", "div", "br", "tr", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header",
              "footer", "ul", "ol", "dt", "dd", "hr", "title")
CELL_TAGS = ("td", "th")

#: What may follow a tag's name up to its end; quoted values may hold ``>``.
ATTRIBUTES = r"""(?:[\s/](?:[^'">]|"[^"]*"|'[^']*')*)?>"""
#: Replacements in order, the same in Spark and in the SQL twins: what is cut, what breaks a line, what parts words.
CUTS = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    *((rf"(?is)<{tag}{ATTRIBUTES}.*?(?:</{tag}\s*>|\z)", "") for tag in HIDDEN_TAGS),
    (r"(?is)<[!?][^>]*>", ""),
    (rf"(?is)</?(?:{'|'.join(BLOCK_TAGS)}){ATTRIBUTES}", "\n"),
    (rf"(?is)</?(?:{'|'.join(CELL_TAGS)}){ATTRIBUTES}", " "),
    (rf"(?is)</?[a-z][^\s/>]*{ATTRIBUTES}", ""),
)
BLANKS = r"[\t\x0B\f\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TIDY = ((r"\r\n?", "\n"), (r"\x{200B}", ""), (BLANKS, " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+\z", ""))
#: Named references with their closing semicolon; all others stay as they are written.
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def replaced(text: Column, steps) -> Column:
    for pattern, plain in steps:
        text = F.regexp_replace(text, pattern, plain)
    return text


def character(code: Column) -> Column:
    """The character of a code point; the replacement character for 0, surrogates and numbers beyond Unicode."""
    bad = (code <= 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | code.isNull()
    return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")


def unescaped(text: Column) -> Column:
    """Character references replaced once: named ones of the table, decimal and hexadecimal ones."""
    names = F.create_map(*[F.lit(part) for pair in NAMED.items() for part in pair])

    def one(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexadecimal = F.conv(F.substring(name, 3, 9), 16, 10).cast("long")
        code = F.when(name.rlike("^#[xX]"), hexadecimal).when(name.startswith("#"), F.substring(name, 2, 10).cast("long"))
        char = F.when(name.startswith("#"), character(code)).when(name != "", F.try_element_at(names, name))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when(at == 0, part).when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def tidy(text: Column) -> Column:
    """Single spaces inside lines, at most one empty line in a row, none at the ends, a closing line break."""
    return F.concat(replaced(text, TIDY), F.lit("\n"))


def visible_text(html: Column) -> Column:
    """The text a reader sees: block tags break lines, cells part words, hidden elements and comments go.

    A hidden element that is never closed hides the rest. Null stays null; a page without text is one line break.
    """
    return tidy(unescaped(replaced(html, CUTS)))


def page_text(pages: DataFrame, html: str = "html", name: str | None = None) -> DataFrame:
    """Adds ``text`` and ``content_hash`` (SHA-256 of the text).

    ``name``: a column of document names; documents that end in .txt and do not open with an html tag within 2,000
    characters are plain text and only tidied.
    """
    page = F.col(html)
    text = visible_text(page)
    if name:
        plain = F.lower(name).endswith(".txt") & ~F.contains(F.lower(F.substring(page, 1, 2000)), F.lit("<html"))
        text = F.when(plain, tidy(page)).otherwise(text)
    return pages.withColumn("text", text).withColumn("content_hash", F.sha2("text", 256))
