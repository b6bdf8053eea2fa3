"""HTML pages to elements, titles and links, in one Arrow UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from loomdex.config import PAGE_ENDINGS
from loomdex.functions.urls import joined
from loomdex.runtime import text_blocks, trimmed

# Elements that have no end tag, and those whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(["style", "script", "head", "title", "meta", None])
PAGE = "title string, elems array<struct<tag string, text string>>, links array<string>, n_tags int, n_loc int, is_html boolean, error string"


class _Page(HTMLParser):
    """Keeps a stack of open tags; text belongs to its top."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.texts: list[tuple[str | None, str]] = []
        self.links: list[str] = []
        self.tags: dict[str, int] = {}
        self.title: list[str] | None = None
        self.title_tags = 0
        self.last_comment = False

    def handle_starttag(self, tag, attrs):
        self.last_comment = True
        self.tags[tag] = self.tags.get(tag, 0) + 1
        if self.stack[-1:] == ["title"]:
            self.title_tags += 1
        if tag == "title" and self.title is None:
            self.title = []
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v is not None][:1]
        if tag not in VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        self.last_comment = True
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_comment(self, data):
        self.last_comment = True

    def handle_data(self, data):
        parent = self.stack[-1] if self.stack else None
        if parent == "title" and self.tags["title"] == 1 and self.title is not None:
            self.title.append(data)
        if parent == "loc":
            self.links.append(data.strip())
        if self.texts and not self.last_comment and self.texts[-1][0] == parent:
            self.texts[-1] = (parent, self.texts[-1][1] + data)
        else:
            self.texts.append((parent, data))
        self.last_comment = False


def parse(html: str, url: str) -> dict:
    from urllib.parse import urlparse

    path = urlparse(url or "").path
    name = path.rpartition("/")[2].strip()
    p = _Page()
    p.feed(html)
    p.close()
    n, end = sum(p.tags.values()), path[:-1] if path.endswith(("/", "~")) else path
    is_html = "html" in p.tags or (("." not in end[-6:] or end.endswith(PAGE_ENDINGS)) and n > 0)
    if is_html:
        title = "".join(p.title) if p.title and not p.title_tags else None
        title = name if title is None else title.strip().split("\n")[0]
        elems = [{"tag": t, "text": x.strip()} for t, x in p.texts if t not in HIDDEN and x.strip()]
    else:
        title, elems = name, [{"tag": None, "text": html}]
    return {"title": title, "elems": elems, "links": p.links, "n_tags": n, "n_loc": p.tags.get("loc", 0), "is_html": bool(is_html), "error": None}


#: Bytes of markup that a Python worker parses at a time; a longer page is parsed alone.
BLOCK_BYTES = 1 << 20
_TYPES = {"title": pa.string(), "elems": pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())])), "links": pa.list_(pa.string()), "n_tags": pa.int32(), "n_loc": pa.int32(), "is_html": pa.bool_(), "error": pa.string()}


def one(html: str, url: str) -> dict:
    """A page's parts, its links joined with its URL; a page that can't be read has only its error."""
    try:
        out = parse(html, url)
    except Exception as e:  # one bad page must not end the job: it is reported in its row
        out = dict.fromkeys(_TYPES) | {"error": f"{type(e).__name__}: {e}"}
    return out | {"links": joined(url, out["links"])}


def pages(raw: DataFrame) -> DataFrame:
    """raw(page_id, url, html) -> page_id, url and PAGE: one pass of one worker a task, which holds a block of pages at a time."""

    def each(batches):
        for whole in batches:
            for b in text_blocks(whole, "html", BLOCK_BYTES):
                rows = [one(h, u or "") for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *[pa.array([r[c] for r in rows], t) for c, t in _TYPES.items()]], names=["page_id", "url", *_TYPES])

    return raw.mapInArrow(trimmed(each), f"page_id {raw.schema['page_id'].dataType.simpleString()}, url string, {PAGE}")
