"""HTML to text and image references, as Arrow-batched jobs over a page table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions.text import ColumnLike, col

# Tags that break lines, tags without content, tags left out.
BLOCK_TAGS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ol", "ul"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED_TAGS = {"script", "style"}


class _PageReader(HTMLParser):
    """Collects the text pieces and the images of a page."""

    def __init__(self, descriptions: dict[int, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.images: list[dict[str, str]] = []
        self._descriptions = descriptions
        self._open: list[str] = []
        self._text: list[str] = []
        self._skip = 0

    def flush(self) -> None:
        text = "".join(self._text).strip()
        self._text.clear()
        if text and not self._skip:
            self.pieces.append(text + " ")

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag == "body":
            # Only the body counts once there is one.
            self.pieces.clear()
        if tag == "img":
            at = len(self.images)
            values = {k: v or "" for k, v in attrs}
            self.images.append({"src": values.get("src", ""), "alt": values.get("alt", "")})
            self.pieces.append(self._descriptions.get(at, ""))
        elif tag == "br":
            self.pieces.append("\n")
        elif tag == "li":
            self.pieces.append("\n* ")
        elif tag in BLOCK_TAGS:
            self.pieces.append("\n")
        if tag not in VOID_TAGS:
            self._open.append(tag)
            self._skip += tag in SKIPPED_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag not in self._open:
            return
        while True:
            closed = self._open.pop()
            self._skip -= closed in SKIPPED_TAGS
            if closed in BLOCK_TAGS:
                self.pieces.append("\n")
            if closed == tag:
                return

    def handle_data(self, data):
        self._text.append(data)

    def handle_comment(self, data):
        self.flush()
        self._text.append(data)
        self.flush()


def read_page(html: str | None, descriptions: dict[int, str] | None = None) -> tuple[str, list[dict[str, str]]]:
    """(text, images) of one page; ``descriptions`` are put where their images stand."""
    reader = _PageReader(descriptions or {})
    reader.feed(html or "")
    reader.close()
    reader.flush()
    lines = (line.strip() for line in "".join(reader.pieces).splitlines())
    return "\n".join(line for line in lines if line), reader.images


def html_to_text(pages: DataFrame, key: str, html: str = "html", descriptions: str | None = None) -> DataFrame:
    """(key, text) per page; ``descriptions`` names a map column image position -> text."""
    schema = T.StructType([pages.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = batch[descriptions] if descriptions else [None] * len(batch)
            texts = [read_page(h, dict(d) if d is not None else None)[0] for h, d in zip(batch[html], told)]
            yield pd.DataFrame({key: batch[key], "text": texts})

    keep = [key, html] + ([descriptions] if descriptions else [])
    return pages.select(*keep).mapInPandas(run, schema)


def image_refs(pages: DataFrame, key: str, html: str = "html", base_url: str | None = None) -> DataFrame:
    """One row per image: position, src, alt, resolved address, mime type and inline bytes."""
    fields = [T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("src", "alt", "resolved")]]
    schema = T.StructType([pages.schema[key], *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases = batch[base_url] if base_url else [None] * len(batch)
            rows = [
                (k, i, im["src"], im["alt"], resolve(im["src"], b))
                for k, h, b in zip(batch[key], batch[html], bases)
                for i, im in enumerate(read_page(h)[1])
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    keep = [key, html] + ([base_url] if base_url else [])
    found = pages.select(*keep).mapInPandas(run, schema)
    inline = F.startswith("src", F.lit("data:"))
    payload = F.regexp_extract("src", r"^data:[^,]*,(.*)$", 1)
    return found.withColumn("mime", mime_type("src")).withColumn("data", F.when(inline, F.try_to_binary(payload, F.lit("base64"))))


def resolve(src: str, base: str | None) -> str | None:
    """Inline and absolute addresses as they are, relative ones against the base."""
    if src.startswith(("data:", "http://", "https://")):
        return src
    return urljoin(base, src) if base else None


def mime_type(src: ColumnLike) -> Column:
    value = col(src)
    low = F.lower(value)
    inline = F.regexp_extract(value, r"^data:([^;,]*)", 1)
    return (
        F.when(F.startswith(value, F.lit("data:")), F.when(inline != "", inline).otherwise("image/png"))
        .when(low.rlike(r"\.jpe?g"), "image/jpeg").when(F.contains(low, F.lit(".gif")), "image/gif")
        .when(F.contains(low, F.lit(".webp")), "image/webp").otherwise("image/png")
    )
