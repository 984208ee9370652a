"""Documents to ordered blocks (E1) and titles.

Plain text is parsed by JVM expressions (split into lines). Markdown and HTML go
through a vectorized pandas UDF built on the standard library parser; a document
is one row, so parsing needs no shuffle and a task only ever holds its own batch.
Every block is ``struct<text, headings: array<string>>``; the heading path is the
stack of enclosing headings (Markdown ``#`` levels, HTML ``h1``-``h6``).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import derive_title

BLOCK_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("headings", T.ArrayType(T.StringType())),
])
BLOCKS_TYPE = T.ArrayType(BLOCK_TYPE)


def text_blocks(text: Column | str) -> Column:
    """Plain text: one block per line, no headings."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(t, "\n"), lambda line: F.struct(
        line.alias("text"), F.array().cast("array<string>").alias("headings")))


# --- Markdown and HTML --------------------------------------------------------------------

_MD_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t#]*$")

# HTML elements whose text is not content, and elements that end a block.
_SKIP_TAGS = {"script", "style", "nav", "noscript", "template", "svg", "iframe"}
_RAW_TAGS = {"script", "style"}  # no page text, closed or not
_BLOCK_TAGS = {"p", "div", "li", "td", "th", "pre", "blockquote", "section", "article", "main",
               "header", "footer", "aside", "ul", "ol", "table", "tr", "dd", "dt", "figcaption",
               "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "body", "html"}
# Tags that may stand in a head; any other start tag ends it (its end tag is optional).
_HEAD_TAGS = {"head", "html", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
_HEADING_TAGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}


def _enter(stack: list[tuple[int, str]], level: int, text: str) -> None:
    """A heading ends every open heading of its own level or a deeper one."""
    while stack and stack[-1][0] >= level:
        stack.pop()
    stack.append((level, text))


def _markdown(text: str) -> list[dict]:
    stack: list[tuple[int, str]] = []
    blocks = []
    para: list[str] = []

    def flush():
        if para:
            blocks.append({"text": "\n".join(para), "headings": [t for _, t in stack]})
            para.clear()

    for line in text.split("\n"):
        m = _MD_HEADING.match(line)
        if m:
            flush()
            level = len(m.group(1))
            _enter(stack, level, m.group(2).strip())
        elif line.strip():
            para.append(line)
        else:
            flush()
    flush()
    return blocks


class _HtmlBlocks(HTMLParser):
    def __init__(self, skip_tags=frozenset(_SKIP_TAGS)):
        super().__init__(convert_charrefs=True)
        self.skip_tags = skip_tags
        self.open_skips: list[str] = []  # elements whose content is left out, as they opened
        self.blocks: list[dict] = []
        self.stack: list[tuple[int, str]] = []
        self.in_head = False
        self.buf: list[str] = []
        self.heading_level = 0
        self.title: list[str] = []
        self.in_title = False

    def _flush(self):
        text = " ".join("".join(self.buf).split())
        self.buf = []
        if not text:
            return
        if self.heading_level:
            _enter(self.stack, self.heading_level, text)
        else:
            self.blocks.append({"text": text, "headings": [t for _, t in self.stack]})

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.in_head = True
        elif tag not in _HEAD_TAGS:
            self.in_head = False
        if tag == "title":
            self.in_title = True
        if tag in self.skip_tags:
            self.open_skips.append(tag)
            return
        if tag in _BLOCK_TAGS and not self.open_skips:
            self._flush()
            self.heading_level = _HEADING_TAGS.get(tag, 0)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.in_head = False
        if tag in self.skip_tags:
            if tag in self.open_skips:  # what has not been closed inside it ends with it
                del self.open_skips[len(self.open_skips) - 1 - self.open_skips[::-1].index(tag):]
            return
        if tag in _BLOCK_TAGS and not self.open_skips:
            self._flush()
            self.heading_level = 0

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.open_skips and not self.in_head and not self.in_title:
            self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def _html(text: str) -> list[dict]:
    """Blocks of a page. An element to leave out that is never closed does not take the rest of the page with it: the page
    is read again without leaving out that kind (at most once a kind)."""
    skipped = frozenset(_SKIP_TAGS)
    while True:
        p = _HtmlBlocks(skipped)
        p.feed(text)
        p.close()
        unclosed = set(p.open_skips) - _RAW_TAGS
        if not unclosed:
            return p.blocks
        skipped -= unclosed


_PARSERS = {"markdown": _markdown, "md": _markdown, "html": _html, "htm": _html,
            "text": lambda t: [{"text": line, "headings": []} for line in t.split("\n")]}


def format_of(uri: Column | str) -> Column:
    """Format from the file extension: md/markdown, htm/html, else text."""
    u = F.col(uri) if isinstance(uri, str) else uri
    ext = F.lower(F.regexp_extract(u, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("htm", "html"), "html") \
        .otherwise("text")


def parse_documents(corpus: DataFrame, text_col: str = "text", fmt: Column | str | None = None) -> DataFrame:
    """Add ``blocks`` to each document (E1). ``fmt`` defaults to the uri extension.

    Plain text keeps its text column; other formats replace it by the blocks.
    """
    txt = F.col(text_col)
    if isinstance(fmt, str) and fmt == "text":
        return corpus.withColumn("blocks", text_blocks(txt))  # JVM only
    f = format_of("uri") if fmt is None else (F.lit(fmt) if isinstance(fmt, str) else fmt)
    # An explicit mapInPandas stage (not a scalar UDF) so later Python UDFs over the
    # blocks are planned as their own Arrow stage; the text itself is not sent back.
    src = corpus.withColumn("_fmt", f)
    keep = [c for c in corpus.columns if c != text_col]
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("blocks", BLOCKS_TYPE)])

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            out["blocks"] = [
                [] if t is None else _PARSERS.get((fm or "text").lower(), _PARSERS["text"])(t)
                for t, fm in zip(pdf[text_col], pdf["_fmt"])]
            yield out

    return src.mapInPandas(run, schema)
