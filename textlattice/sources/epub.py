"""EPUB files: container, package, spine and text, one row per spine part."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

PART = "title string, language string, pos int, href string, text string, error string"
_MIME = b"application/epub+zip"
# Elements that are left out, and those that end a paragraph.
_SKIP = {"script", "style", "head", "title"}
_BREAK = {"p", "div", "section", "article", "blockquote", "li", "tr", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}


class BadEpub(ValueError):
    """The archive isn't a readable EPUB."""


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list[str]] = [[]]
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _SKIP
        if tag in _BREAK:
            self.parts.append([])

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in _SKIP))
        if tag in _BREAK:
            self.parts.append([])

    def handle_data(self, data):
        if not self.skip:
            self.parts[-1].append(data)


def xhtml_text(markup: str) -> str:
    """Paragraphs joined by blank lines, white space collapsed."""
    p = _Text()
    p.feed(markup)
    p.close()
    return "\n\n".join(x for x in (" ".join("".join(part).split()) for part in p.parts) if x)


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def parts(content: bytes | None) -> list[dict]:
    """A row per spine part in reading order; missing members are skipped."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content or b""))
        names = set(z.namelist())
        if "mimetype" in names and z.read("mimetype").strip() != _MIME:
            raise BadEpub("wrong mimetype")
        if "META-INF/container.xml" not in names:
            raise BadEpub("no container")
        root = next((e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile"), None)
        if not root or root not in names:
            raise BadEpub("no package file")
        package = ElementTree.fromstring(z.read(root))
        first = lambda name: next((" ".join((e.text or "").split()) for e in package.iter() if _local(e) == name and (e.text or "").strip()), None)
        items = {e.get("id"): e.get("href") for e in package.iter() if _local(e) == "item"}
        order = [items[e.get("idref")] for e in package.iter() if _local(e) == "itemref" and e.get("idref") in items]
        language = (first("language") or "").split("-")[0].lower() or None
        out = []
        for pos, href in enumerate(order):
            member = posixpath.normpath(posixpath.join(posixpath.dirname(root), (href or "").split("#")[0]))
            if member in names:
                out.append({"title": first("title"), "language": language, "pos": pos, "href": href, "text": xhtml_text(z.read(member).decode("utf-8", "replace"))})
        if not out:
            raise BadEpub("no readable spine part")
        return out
    except (BadEpub, zipfile.BadZipFile, ElementTree.ParseError, KeyError, NotImplementedError, RuntimeError) as e:
        return [{"error": str(e)[:200] or type(e).__name__}]


_FIELDS = [("title", pa.string()), ("language", pa.string()), ("pos", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("error", pa.string())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            rows = parts(content.as_py())
            yield pa.record_batch([pa.array([path.as_py()] * len(rows), pa.string()), *(pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS)], names=["path", *(n for n, _ in _FIELDS)])


def epub_parts(files: DataFrame) -> DataFrame:
    """files: path, content."""
    return files.select("path", "content").mapInArrow(_read, "path string, " + PART)
