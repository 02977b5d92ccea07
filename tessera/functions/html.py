"""Pages to text, titles, metadata and links, with the standard library's parser, a batch at a time."""

from __future__ import annotations

import html as html_text
import json
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Elements whose text is no content, elements that end a line, and the metadata that names a date.
_SKIPPED = {"script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form", "iframe"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "blockquote", "pre", "hr", "dt", "dd", "main", "figure", "figcaption"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_PUBLISHED = {"article:published_time": "article:published_time", "datepublished": "datePublished", "date": "date", "dc.date": "dc.date", "pubdate": "pubdate"}
_MODIFIED = ("article:modified_time", "datemodified")
_LOGIN = re.compile(r"/(?:accounts/)?(?:login|signin|sign-in|auth)(?:/|$)", re.I)
_SPACES = re.compile(r"[ \t\r\f\v ]+")

PAGE = StructType([StructField(c, StringType()) for c in ("title", "text", "published_at", "basis", "modified_at")] + [StructField("links", ArrayType(StringType()))])


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] | None = None
        self.first_title = False
        self.in_title = False
        self.skip: list[str] = []
        self.meta: dict[str, str] = {}
        self.blobs: list[str] = []
        self.blob = False
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            self.blob = True
            self.blobs.append("")
        if tag == "meta" and (name := (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()) and a.get("content"):
            self.meta[name] = a["content"]  # the last one that says anything
        if tag == "a" and a.get("href"):
            self.links.append(a["href"].strip())
        if tag in _SKIPPED:
            self.skip.append(tag)
        if tag == "title":
            self.in_title = True
            self.first_title = self.title is None and not self.skip
            if self.first_title:
                self.title = []
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.blob = False
        if self.skip and tag in self.skip:
            while self.skip.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.blob:
            self.blobs[-1] += data
        if self.in_title:
            if self.first_title:
                self.title.append(data)
        if not self.skip and not self.blob:
            self.parts.append(data)


def normal_text(text: str) -> str:
    """Runs of blanks folded, lines stripped, blank lines dropped."""
    lines = (_SPACES.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def first_string(value: object, key: str) -> str | None:
    """The first text under `key` in nested JSON values, in order of the document."""
    todo = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            if isinstance(at.get(key), str):
                return at[key]
            at = list(at.values())
        if isinstance(at, list):
            todo += reversed(at)
    return None


def parse_page(html: str | None) -> tuple[str | None, str, str | None, str, str | None, list[str]]:
    """(title, text, published_at, basis, modified_at, links); a null page gives an empty text and basis unknown.

    Dates of JSON-LD count where no metadata names when the page was published.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    title = " ".join("".join(page.title).split()) or None if page.title is not None else None
    date, basis = next(((page.meta[k], f"meta:{name}") for k, name in _PUBLISHED.items() if k in page.meta), (None, "unknown"))
    changed = next((page.meta[k] for k in _MODIFIED if k in page.meta), None)
    if date is None:
        nodes = [x for x in map(parsed_json, page.blobs) if x is not None]
        if date := first_string(nodes, "datePublished"):
            basis = "jsonld:datePublished"
        changed = changed or first_string(nodes, "dateModified")
    return title, normal_text("".join(page.parts)), date or None, basis, changed or None, page.links


def parsed_json(text: str) -> object:
    """The JSON value of a text, or None."""
    try:
        return json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(PAGE)
def extract_page(html: pd.Series) -> pd.DataFrame:
    """What parse_page gives, as a struct column."""
    return pd.DataFrame([parse_page(h) for h in html], columns=["title", "text", "published_at", "basis", "modified_at", "links"])


def same_site_links(base: str, links: list[str], prefix: str = "/", limit: int | None = None) -> list[str]:
    """Absolute links of `base`'s origin under a path prefix, in order, without query, fragment, repeats and itself."""
    origin, found = urlsplit(base), {}
    for link in links:
        try:
            u = urlsplit(urldefrag(urljoin(base, link))[0])
        except ValueError:
            continue
        if u.scheme in ("http", "https") and u.netloc.lower() == origin.netloc.lower() and u.path.startswith(prefix) and not _LOGIN.search(u.path):
            found.setdefault(f"{u.scheme}://{u.netloc.lower()}{u.path}")
    found.pop(f"{origin.scheme}://{origin.netloc.lower()}{origin.path}", None)
    return list(found)[:limit]


@F.pandas_udf(ArrayType(StringType()))
def site_links(base: pd.Series, links: pd.Series) -> pd.Series:
    """same_site_links under the folder of each base, as a column."""
    return pd.Series([None if b is None or ls is None else same_site_links(b, list(ls), urlsplit(b).path.rsplit("/", 1)[0] + "/") for b, ls in zip(base, links)])


def json_block(text: str | None) -> str | None:
    """The first balanced JSON object or array in a noisy text that parses, or None."""
    for start in (m.start() for m in re.finditer(r"[{\[]", text or "")):
        depth, quoted, escaped = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if quoted:
                quoted = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    try:
                        json.loads(text[start : at + 1])
                    except ValueError:
                        break
                    return text[start : at + 1]
    return None


def canonical_json(text: str | None) -> str | None:
    """The JSON text with sorted keys and without spaces, nulls and other scripts kept; None if it doesn't parse."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(StringType())
def canonical(column: pd.Series) -> pd.Series:
    """canonical_json of a column."""
    return column.map(canonical_json)


@F.pandas_udf(StringType())
def nested(column: pd.Series, key: pd.Series) -> pd.Series:
    """first_string of a column of JSON texts under a key; the outermost value goes first, then the order of the document."""
    return pd.Series([None if x is None else first_string(parsed_json(x), k) for x, k in zip(column, key)], dtype=object)


@F.pandas_udf(StringType())
def decoded(column: pd.Series) -> pd.Series:
    """Texts with their character references decoded."""
    return column.map(lambda x: None if x is None else html_text.unescape(x))


@F.pandas_udf(StringType())
def block(column: pd.Series) -> pd.Series:
    """json_block of a column."""
    return column.map(json_block)
