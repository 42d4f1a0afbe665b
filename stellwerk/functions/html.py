"""HTML helpers for what needs real entity and nesting rules.

A page becomes a list of text pieces plus elements that remember which pieces
they cover and, when they close, the last element inside them: descendants are
one slice of the list, so a page costs time in proportion to its length.  The
functions below read fields off that and run as Arrow UDFs.

Pages of plain, well-formed tags are read by one split at their tags; whatever is not certain to mean
the same there - scripts, odd quotes, stray '<' - sends the whole page through ``HTMLParser``.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.constants import MIN_MAIN_TEXT

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}
_VERBATIM = {"pre", "textarea"}
# What is inside them is not markup, or not in every version of the parser.
_SPECIAL = _HIDDEN | {"textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}
_NAME = r"[a-zA-Z][a-zA-Z0-9]*"
_END = re.compile(rf"</({_NAME})[ \t\r\n\f]*>")
_START = re.compile(
    rf"""<({_NAME})((?:[ \t\r\n\f]+[a-zA-Z][-\w]*(?:="[^"]*"|='[^']*')?)*)[ \t\r\n\f]*(/?)>""", re.ASCII
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
_SKIPPED = re.compile(r"<!DOCTYPE[ \t\r\n\f][^\[\]<>]*>|<!--(?:(?!--)[^<>])*-->", re.IGNORECASE)
_OPEN_REFERENCE = re.compile(r"&(?!#?[0-9A-Za-z]+;)")


# Plain tags that this worker has met, by what their brackets hold.
_KNOWN_TAGS: dict[str, tuple[str, str, dict]] = {}
KEPT_TAGS = 4096


def _plain_tag(inside: str) -> tuple[str, str, dict] | None:
    """Kind ('start', 'empty', 'end', 'none'), name and attributes of a plain tag, from what its brackets hold; None for any other."""
    markup = f"<{inside}>"
    if markup[1] == "/":
        match = _END.fullmatch(markup)
        return ("end", match.group(1).lower(), {}) if match else None
    if markup[1] == "!":
        return ("none", "", {}) if _SKIPPED.fullmatch(markup) else None
    match = _START.fullmatch(markup)
    if match is None or (tag := match.group(1).lower()) in _SPECIAL:
        return None
    attrs = {}
    for found in _ATTRIBUTE.finditer(match.group(2)):
        name, double, single = found.groups()
        value = double if double is not None else single
        if value is not None and "&" in value:
            if _OPEN_REFERENCE.search(value):
                return None
            value = html.unescape(value)
        attrs[name.lower()] = value
    return "empty" if match.group(3) or tag in _VOID else "start", tag, attrs


class _Page(HTMLParser):
    def __init__(self, markup: str) -> None:
        self._clear()
        if not self._read_plain(markup):
            self._clear()
            super().__init__(convert_charrefs=True)
            self.feed(markup)
            self.close()
            self._flush()
        for element in self._open:
            self._close(element)

    def _clear(self) -> None:
        self.pieces: list[str] = []
        self.elements: list[dict] = []
        self._open: list[dict] = []
        self._buffer: list[str] = []
        self._depth: dict[str, int] = {}

    def _read_plain(self, markup: str) -> bool:
        """Read a page of plain tags; False, with the page half read, if it has any other."""
        references, known = "&" in markup, _KNOWN_TAGS
        pieces, elements, opened, depth = self.pieces, self.elements, self._open, self._depth
        text, *segments = markup.split("<")
        if text:
            self._plain_text(text)
        for segment in segments:
            inside, closed, text = segment.partition(">")
            plain = known.get(inside)
            if plain is None:
                plain = _plain_tag(inside) if closed else None
                if plain is None:
                    return False
                if len(known) >= KEPT_TAGS:
                    known.clear()
                known[inside] = plain
            elif not closed:
                return False
            kind, tag, attrs = plain
            if kind == "start":
                start, index = len(pieces), len(elements)
                element = {"tag": tag, "attrs": attrs, "start": start, "end": start, "index": index, "last": index}
                elements.append(element)
                opened.append(element)
                depth[tag] = depth.get(tag, 0) + 1
            elif kind == "end":
                if opened and opened[-1]["tag"] == tag:
                    element = opened.pop()
                    element["end"], element["last"] = len(pieces), len(elements) - 1
                    depth[tag] -= 1
                else:
                    self._end(tag)
            elif kind == "empty":
                start, index = len(pieces), len(elements)
                elements.append({"tag": tag, "attrs": attrs, "start": start, "end": start, "index": index, "last": index})
            if text:
                if references or text.isspace():
                    self._plain_text(text)
                else:
                    pieces.append(text)
        return True

    def _plain_text(self, text: str) -> None:
        text = html.unescape(text)
        if text.isspace() and not self._count(_VERBATIM):
            text = "\n" if "\n" in text else " "
        self.pieces.append(text)

    def _close(self, element: dict) -> None:
        element["end"] = len(self.pieces)
        element["last"] = len(self.elements) - 1

    def _flush(self) -> None:
        text = "".join(self._buffer)
        self._buffer.clear()
        if not text or self._count(_HIDDEN):
            return
        if not text.strip() and not self._count(_VERBATIM):
            text = "\n" if "\n" in text else " "
        self.pieces.append(text)

    def _count(self, tags) -> int:
        """Open elements of the given kinds."""
        return sum(self._depth.get(tag, 0) for tag in tags)

    def handle_starttag(self, tag, attrs):
        self._flush()
        start, index = len(self.pieces), len(self.elements)
        element = {"tag": tag, "attrs": dict(attrs), "start": start, "end": start, "index": index, "last": index}
        self.elements.append(element)
        if tag not in _VOID:
            self._open.append(element)
            self._depth[tag] = self._depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        self._end(tag)

    def _end(self, tag: str) -> None:
        if not self._depth.get(tag):
            return
        while True:
            element = self._open.pop()
            self._close(element)
            self._depth[element["tag"]] -= 1
            if element["tag"] == tag:
                return

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def find(self, tag=None, css_class=None, within=None, **attrs):
        """Elements in page order, optionally only the descendants of another element."""
        first, stop = (0, len(self.elements)) if within is None else (within["index"] + 1, within["last"] + 1)
        for i in range(first, stop):
            element = self.elements[i]
            if tag and element["tag"] != tag:
                continue
            held = element["attrs"]
            if css_class and css_class not in (held.get("class") or "").split():
                continue
            if not attrs or all(held.get(k) == v for k, v in attrs.items()):
                yield element

    def text(self, element, separator=""):
        return separator.join(self.pieces[element["start"]:element["end"]])

    def strings(self, element):
        stripped = (piece.strip() for piece in self.pieces[element["start"]:element["end"]])
        return [piece for piece in stripped if piece]


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def strip_tags(raw: str) -> str:
    """Unescaped, tag-free text with single blanks."""
    return _squeeze(" ".join(_Page(html.unescape(raw)).pieces))


def page_lines(raw: str) -> str:
    """Text pieces of a page, one per line."""
    return "\n".join(_Page(raw).pieces)


def find_main_text(raw: str, selectors: list[str], strict: bool = False) -> str | None:
    """Text of the first selector ('.class' or tag) that is long enough, else of the body."""
    page = _Page(raw)
    for selector in selectors:
        wanted = {"css_class": selector[1:]} if selector.startswith(".") else {"tag": selector}
        element = next(page.find(**wanted), None)
        if element is not None:
            text = _squeeze(page.text(element, " "))
            if len(text) > MIN_MAIN_TEXT:
                return text
    body = next(page.find("body"), None)
    if body is None:
        return None
    text = _squeeze(page.text(body, " "))
    return None if strict and len(text) <= MIN_MAIN_TEXT else text


def find_listings(raw: str) -> list[dict]:
    """Link, title and the next two texts of each listing container."""
    page = _Page(raw)
    containers = list(page.find("div", "stellenanzeige")) or list(page.find("article"))
    found = []
    for container in containers:
        links = (a for a in page.find("a", within=container) if a["attrs"].get("href") is not None)
        link = next(links, None)
        if link is None:
            continue
        title = "".join(page.strings(link))
        texts = [text for text in page.strings(container) if text != title]
        found.append({
            "title": title, "href": link["attrs"]["href"],
            "company": texts[0] if texts else None,
            "location": texts[1] if len(texts) > 1 else None,
        })
    return found


def find_table_rows(raw: str) -> list[dict]:
    """Fields of each result-table row by their data-field attribute."""
    page = _Page(raw)
    found = []
    for row in page.find("tr", "ia-e-table__row"):
        cells = {}
        for cell in page.find("td", within=row):
            cells.setdefault(cell["attrs"].get("data-field"), cell)
        key_cell = cells.get("StellenangebotId")
        span = next(page.find("span", within=key_cell), None) if key_cell else None

        def text(field):
            return page.text(cells[field]).strip() if field in cells else ""

        found.append({
            "row_id": page.text(span).strip() if span else None,
            "title": text("Stellenbezeichnung"), "company": text("Behoerde"),
            "location": text("PLZOrte"), "published": text("Von"),
            "deadline": text("Bewerbungsfrist"),
        })
    return found


def find_filter_links(raw: str) -> list[str]:
    """Decoded pf= values of nofollow links with class pos, distinct, in page order."""
    values: dict[str, None] = {}
    page = _Page(raw)
    for link in page.find("a", "pos"):
        if "nofollow" not in (link["attrs"].get("rel") or "").split():
            continue
        match = re.search(r"[?&]pf=([^&]+)", link["attrs"].get("href") or "")
        if match:
            values[unquote(match.group(1))] = None
    return [value for value in values if value]


def _apply(function, column: pa.Array) -> list:
    return [None if x is None else function(x) for x in column.to_pylist()]


@F.arrow_udf(T.StringType())
def html_text(raw: pa.Array) -> pa.Array:
    return pa.array(_apply(strip_tags, raw), pa.string())


@F.arrow_udf(T.StringType())
def html_lines(raw: pa.Array) -> pa.Array:
    return pa.array(_apply(page_lines, raw), pa.string())


def main_text(selectors: list[str], strict: bool = False):
    """UDF for one portal's selector list; ``strict`` also bounds the body fallback."""

    @F.arrow_udf(T.StringType())
    def extract(raw: pa.Array) -> pa.Array:
        return pa.array(_apply(lambda page: find_main_text(page, selectors, strict), raw), pa.string())

    return extract


_LISTING = ("title", "href", "company", "location")
_TABLE_ROW = ("row_id", "title", "company", "location", "published", "deadline")


def _texts(names: tuple[str, ...]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in names]))


def structs(lists: list[list[dict] | None], names: tuple[str, ...]) -> pa.Array:
    """Lists of records with text fields, one column of all records per field."""
    ends = np.cumsum([0, *(0 if records is None else len(records) for records in lists)])
    every = [record for records in lists if records for record in records]
    values = pa.StructArray.from_arrays([pa.array([record[name] for record in every], pa.string()) for name in names], names)
    missing = pa.array([records is None for records in lists], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=missing)


@F.arrow_udf(_texts(_LISTING))
def html_listings(raw: pa.Array) -> pa.Array:
    return structs(_apply(find_listings, raw), _LISTING)


@F.arrow_udf(_texts(_TABLE_ROW))
def html_table_rows(raw: pa.Array) -> pa.Array:
    return structs(_apply(find_table_rows, raw), _TABLE_ROW)


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_filter_links(raw: pa.Array) -> pa.Array:
    return pa.array(_apply(find_filter_links, raw), pa.list_(pa.string()))
