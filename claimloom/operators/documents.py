"""Pages as nested documents: blocks with containers, tables with spans, links, metadata, structured data and counts.

The markup is read once per page by a small event handler, in Arrow batches bounded in bytes; what follows (links,
statistics, sections, tables, text) is DataFrame work on the nested columns. A page that can't be read
gives a row with ``error`` set and no blocks. Elements whose end tag is missing end where another one must start.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements that make a block, those that only part text, those whose text is none, and page parts that aren't content.
BLOCKS = {*HEADINGS, "p", "pre", "blockquote", "li", "dt", "dd", "td", "th", "caption", "noscript"}
PARTS = {"div", "section", "article", "main", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "form", "fieldset", "figure", "body", "br", "hr"}
SILENT = {"script", "style", "template", "svg", "math"}
CONTAINERS = {"nav", "header", "footer", "aside", "main", "article"}
CHROME = {"nav", "header", "footer", "aside"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col", "embed", "area", "base", "param", "track"}
#: Open elements that the start of another one ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that part text, and for each the open ones that its start ends, in order.
PARTING = BLOCKS | PARTS | CONTAINERS
ENDED = {tag: sorted(ENDS.get(tag, set()) | (set() if tag == "br" else {"p", *HEADINGS})) for tag in PARTING}
#: The same as sums of powers of two, one for each element; lists and tables keep what is outside them open.
BIT = {tag: 1 << i for i, tag in enumerate(sorted(PARTING))}
ENDING = {tag: sum(BIT[t] for t in others) for tag, others in ENDED.items()}
KEEPING = {"ul", "ol", "dl", "table"}
#: Texts of pages held at once, in bytes, and those pages; the widest span of a cell, and the places of a grid whose spans are laid out.
PAGE_BYTES, PAGES, WIDEST, GRID_CELLS = 2 << 20, 500, 1000, 200_000

_CELL = "array<array<struct<text string, header boolean, rowspan int, colspan int>>>"
_GRID = "array<array<struct<text string, header boolean, block int, origin boolean>>>"
SCHEMA = (
    "page_id long, title string, language string, canonical_url string, meta map<string,string>, "
    "blocks array<struct<kind string, text string, level int, container string, in_chrome boolean, list int, ordered boolean, table_index int, above int>>, "
    f"tables array<struct<caption string, header_rows {_CELL}, rows {_CELL}, head_grid {_GRID}, grid {_GRID}>>, "
    "links array<struct<text string, href string, resolved string, host string, is_pdf boolean, container string, in_chrome boolean, block_index int>>, "
    "linked array<struct<block_index int, first int, links long, characters long, block_characters long>>, "
    "json_ld_types array<string>, embedded_json int, scripts int, embeds int, warnings array<string>, error string"
)
#: The columns that :func:`cells` and :func:`statements` read.
PLACED = (
    "page_id long, blocks array<struct<kind string, text string, level int, in_chrome boolean, above int>>, "
    f"tables array<struct<caption string, head_grid {_GRID}, grid {_GRID}>>"
)


def _span(value: str | None) -> int:
    return max(1, min(WIDEST, int(value))) if (value or "").isdigit() else 1


def laid_out(rows: list[list[dict]]) -> list[list[dict]]:
    """The places of a table's rows: a cell takes the first free ones of its row and those below that its rowspan covers.

    Rows have as many places as they need. ``origin`` marks a cell's first place; an empty place has no text. A table whose spans cover more than ``GRID_CELLS``
    places is laid out without spans.
    """
    if all(c["colspan"] == c["rowspan"] == 1 for r in rows for c in r):
        return [[{"text": c["text"], "header": c["header"], "block": c["block"], "origin": True} for c in r] for r in rows]
    spans = sum(c["colspan"] * min(c["rowspan"], len(rows) - i) for i, r in enumerate(rows) for c in r) <= GRID_CELLS
    grid, above = [], {}
    for row in rows:
        line, column = {k: c for k, (c, _) in above.items()}, 0
        below = {k: (c, left - 1) for k, (c, left) in above.items() if left > 1}
        for cell in row:
            while column in line:
                column += 1
            place = {"text": cell["text"], "header": cell["header"], "block": cell["block"], "origin": False}
            for k in range(column, column + (cell["colspan"] if spans else 1)):
                if k not in line:
                    line[k] = place | {"origin": k == column}
                    if spans and cell["rowspan"] > 1:
                        below[k] = (place, cell["rowspan"] - 1)
        grid.append([line.get(k, {"text": "", "header": False, "block": None, "origin": False}) for k in range(max(line, default=-1) + 1)])
        above = below
    return grid


def json_types(value) -> list[str]:
    """Types of a JSON-LD value, those in lists and ``@graph`` too."""
    if isinstance(value, list):
        return [t for v in value for t in json_types(v)]
    if not isinstance(value, dict):
        return []
    own = value.get("@type") or []
    return [str(t) for t in (own if isinstance(own, list) else [own])] + json_types(value.get("@graph") or [])


#: Elements whose content the parser may read otherwise than as markup.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
#: A text without references and a tag without attributes after it.
_PLAIN = re.compile("([^<&]*+)<(/?)([a-zA-Z][a-zA-Z0-9]*)>")


class DocumentReader(HTMLParser):
    """Gathers one page's document; text belongs to the innermost open block, or is a block of its own."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        # an open element: tag, number of its list, and of it and those around it the innermost block, container, whether any is chrome, list, and the tags inside the innermost list or table
        self.url, self.stack, self.text = url, [(None, -1, "text", None, False, None, 0)], []
        self.doc = {"title": None, "language": None, "canonical_url": None, "meta": {}, "blocks": [], "tables": [], "links": [], "json_ld_types": [], "embedded_json": 0, "scripts": 0, "embeds": 0, "warnings": [], "error": None}
        self.lists, self.silent, self.script, self.link, self.rows, self.headings = 0, None, None, None, [], []

    def updatepos(self, i, j):
        """Lines aren't counted."""
        return j

    def parse_starttag(self, i):
        return self.plain(i) or super().parse_starttag(i)

    def parse_endtag(self, i):
        return (self.plain(i) if self.cdata_elem is None else None) or super().parse_endtag(i)

    def plain(self, i: int) -> int | None:
        """Takes the tags without attributes from ``i`` on and the texts between them, up to what the parser must read; the place after them, null without any."""
        end, data = None, self.rawdata
        m = _PLAIN.match(data, i)
        while m:
            text, ends, tag = m.groups()
            tag = tag.lower()
            if not ends and tag in RAW:
                break
            if text:
                self.handle_data(text)
            if ends:
                self.handle_endtag(tag)
            else:
                self.lasttag = tag
                self.handle_starttag(tag, ())
            end = m.end()
            m = _PLAIN.match(data, end)
        return end

    def flush(self) -> None:
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        _, _, tag, container, chrome, at, _ = self.stack[-1]
        cells = tag in ("td", "th") and self.rows
        if tag == "caption" and self.rows:
            self.doc["tables"][self.rows[-1]]["caption"] = text
        elif cells and (cell := self.cell()) is not None:
            cell["text"] = f"{cell['text']} {text}" if cell["text"] else text
            cell["block"] = len(self.doc["blocks"]) if cell["block"] is None else cell["block"]
        level = HEADINGS.get(tag)
        if level and not chrome:
            self.headings = [h for h in self.headings if h[0] < level]
        over = self.headings[-1][1] if self.headings and not chrome else None
        if level and not chrome:
            self.headings.append((level, len(self.doc["blocks"])))
        kind = "p" if tag == "text" else tag
        at = at if tag in ("li", "dt", "dd") else None
        self.doc["blocks"].append({"kind": kind, "text": text, "level": level, "container": container, "in_chrome": chrome, "list": at[1] if at else None, "ordered": at[0] == "ol" if at else None, "table_index": self.rows[-1] if cells else None, "above": over})

    def cell(self) -> dict | None:
        rows = self.doc["tables"][self.rows[-1]]["all"]
        return rows[-1][1][-1] if rows and rows[-1][1] else None

    def pop(self, tag: str) -> None:
        """Ends the innermost ``tag`` and all that is open inside it."""
        if tag != "table" and self.stack[-1][0] == tag:
            self.stack.pop()
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for x in self.stack[i:]:
                    if x[0] == "table" and self.rows:
                        self.rows.pop()
                del self.stack[i:]
                break

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        a = dict(attrs) if attrs else {}
        if tag in PARTING:
            self.open(tag, a)
        elif tag == "html":
            self.doc["language"] = a.get("lang")
        elif tag == "meta" and (a.get("name") or a.get("property")):
            self.doc["meta"].setdefault((a.get("name") or a.get("property")).lower(), a.get("content") or "")
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.doc["canonical_url"] = a.get("href")
        elif tag in ("iframe", "embed", "object", "video"):
            self.doc["embeds"] += 1
        elif tag in SILENT or tag == "title":
            self.flush()
            self.silent, self.script = tag, ((a.get("type") or "").lower(), a.get("id"), []) if tag in ("script", "title") else None
            self.doc["scripts"] += tag == "script"
        elif tag == "a":
            self.link = (a.get("href"), [], len(self.doc["blocks"]), self.stack[-1][3], self.stack[-1][4])

    def open(self, tag: str, a: dict) -> None:
        """Starts an element that parts text."""
        if self.text:
            self.flush()
        inner = self.stack[-1][6]
        if ENDING[tag] & inner:
            for other in ENDED[tag]:
                if BIT[other] & inner:
                    self.pop(other)
        if tag == "table":
            self.doc["tables"].append({"caption": None, "all": []})
            self.rows.append(len(self.doc["tables"]) - 1)
        elif self.rows and tag == "tr":
            part = next((x[0] for x in reversed(self.stack) if x[0] in ("thead", "tbody", "tfoot", "table")), None)
            self.doc["tables"][self.rows[-1]]["all"].append((part == "thead", []))
        elif self.rows and tag in ("td", "th"):
            rows = self.doc["tables"][self.rows[-1]]["all"]
            if not rows:
                rows.append((False, []))
            down, across = (WIDEST if (a.get("rowspan") or "").strip() == "0" else _span(a.get("rowspan")), _span(a.get("colspan"))) if a else (1, 1)
            rows[-1][1].append({"text": "", "header": tag == "th", "block": None, "rowspan": down, "colspan": across})
        if tag in VOID:
            return
        _, _, block, container, chrome, at, inner = self.stack[-1]
        keeping = tag in KEEPING
        if keeping and tag != "table":
            self.lists += 1
            at = (tag, self.lists - 1)
        self.stack.append((tag, self.lists - 1, tag if tag in BLOCKS else block, tag if tag in CONTAINERS else container, chrome or tag in CHROME, at, 0 if keeping else inner | BIT[tag]))

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent:
                self.silent, said = None, self.script
                self.said(tag, said)
            return
        if tag == "a" and self.link:
            self.end_link()
        if tag in PARTING:
            self.flush()
            self.pop(tag)

    def end_link(self) -> None:
        href, words, at, container, chrome = self.link
        self.link = None
        if href is not None:
            resolved = urljoin(self.url, href)
            parts = urlsplit(resolved)
            self.doc["links"].append({"text": " ".join("".join(words).split()), "href": href, "resolved": resolved, "host": parts.hostname, "is_pdf": parts.path.lower().endswith(".pdf"), "container": container, "in_chrome": chrome, "block_index": at})

    def said(self, tag: str, script) -> None:
        """What a title or a script holds: JSON is read, anything else is left alone."""
        if not script:
            return
        kind, name, words = script
        text = "".join(words)
        if tag == "title":
            self.doc["title"] = self.doc["title"] or " ".join(text.split())[:300]
        elif kind in ("application/ld+json", "application/json") or name == "__NEXT_DATA__":
            try:
                value = json.loads(text)
            except ValueError:
                self.doc["warnings"].append(f"JSON_MALFORMED: {kind or name}")
                return
            if kind == "application/ld+json":
                self.doc["json_ld_types"] += json_types(value)
            else:
                self.doc["embedded_json"] += 1

    def handle_data(self, data):
        if self.silent:
            if self.script:
                self.script[2].append(data)
            return
        if self.link:
            self.link[1].append(data)
        self.text.append(data)

    def finish(self) -> dict:
        self.close()
        if self.link:
            self.end_link()
        self.flush()
        for t in self.doc["tables"]:
            rows = t.pop("all")
            heads = [r for head, r in rows if head]
            if not heads and rows and rows[0][1] and all(c["header"] for c in rows[0][1]):
                heads = [rows[0][1]]
                rows = rows[1:]
            t["header_rows"], t["rows"] = heads, [r for head, r in rows if not head]
            t["head_grid"], t["grid"] = laid_out(t["header_rows"]), laid_out(t["rows"])
        seen, links = set(), []
        for x in self.doc["links"]:
            key = (x["text"], x["href"], x["container"], x["block_index"])
            if key not in seen:
                seen.add(key)
                links.append(x)
        return self.doc | {"links": links, "linked": self.linked(links), "meta": list(self.doc["meta"].items())}

    def linked(self, links: list[dict]) -> list[dict]:
        """Blocks with links: where theirs begin (a block's stand together), their number, their characters and the block's."""
        out, blocks = [], self.doc["blocks"]
        for i, x in enumerate(links):
            at = x["block_index"]
            if at >= len(blocks):
                break
            if not out or out[-1]["block_index"] != at:
                out.append({"block_index": at, "first": i, "links": 0, "characters": 0, "block_characters": len(blocks[at]["text"])})
            out[-1]["links"] += 1
            out[-1]["characters"] += len(x["text"])
        return out


def read_page(page_id: int | None, url: str | None, html: str | None) -> dict:
    """One page's document; what goes wrong is its ``error``, never an exception."""
    reader = DocumentReader(url or "")
    try:
        reader.feed(html or "")
        return {"page_id": page_id} | reader.finish()
    except Exception as e:  # noqa: BLE001
        return {"page_id": page_id} | DocumentReader("").finish() | {"error": f"{type(e).__name__}: {e}"[:300]}


def documents(pages: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """One nested document for every row of ``pages`` (page_id, url, html); null html is an empty document. Of a narrower ``schema`` only those parts leave the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        columns = to_arrow_schema(StructType.fromJson(fields))
        for b in batches:
            held, size = [], 0
            for page in b.to_pylist():
                held.append(read_page(page["page_id"], page["url"], page["html"]))
                size += len(page["html"] or "")
                if size > PAGE_BYTES or len(held) == PAGES:
                    yield pa.RecordBatch.from_pylist(held, schema=columns)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=columns)

    fields = pages.sparkSession.createDataFrame([], schema).schema.jsonValue()
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def links(docs: DataFrame) -> DataFrame:
    return docs.select("page_id", F.posexplode("links").alias("link_index", "l")).select("page_id", "link_index", "l.*")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of each document's parts, from the nested columns."""
    n = lambda test: F.size(F.filter("blocks", test)).cast("long")
    return docs.select(
        "page_id", F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.length(b["text"])).alias("text_characters"), F.size("blocks").cast("long").alias("blocks"), n(lambda b: b["level"].isNotNull()).alias("headings"),
        n(lambda b: b["kind"] == "p").alias("paragraphs"), n(lambda b: b["kind"] == "li").alias("list_items"), F.size("tables").cast("long").alias("tables"), F.size("links").cast("long").alias("links"),
        F.size(F.filter("links", lambda x: x["is_pdf"])).cast("long").alias("pdf_links"), F.col("embeds").cast("long").alias("embeds"), F.size("json_ld_types").cast("long").alias("json_ld_types"),
        F.col("embedded_json").cast("long").alias("embedded_json"), F.col("scripts").cast("long").alias("scripts"), F.when(F.col("error").isNotNull(), "FAILED").when(F.size("warnings") > 0, "PARTIAL").otherwise("OK").alias("status"),
    )


def block_statistics(docs: DataFrame) -> DataFrame:
    """Per row of pages: blocks, headings, characters outside chrome, blocks in chrome."""
    n = lambda test: F.size(F.filter("blocks", test)).cast("long")
    body = F.aggregate(F.filter("blocks", lambda b: ~b["in_chrome"]), F.lit(0).cast("long"), lambda s, b: s + F.length(b["text"]))
    return docs.select("page_id", F.size("blocks").cast("long").alias("blocks"), n(lambda b: b["level"].isNotNull()).alias("headings"), body.alias("body_chars"), n(lambda b: b["in_chrome"]).alias("chrome_blocks"))


def visible_text(blocks: Column) -> Column:
    """Text of all blocks outside page chrome, one a line."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: ~b["in_chrome"]), lambda b: b["text"]), "\n")


def _profile(x: Column) -> list[Column]:
    """Of an element of ``linked``: the share of its block's text that is in links (3 places), and whether links are all or most (0.8) of it."""
    share = F.round(F.least(F.lit(1.0), x["characters"] / x["block_characters"]), 3)
    return [share.alias("text_fraction"), (x["characters"] >= x["block_characters"]).alias("is_link_only"), (share >= 0.8).alias("is_link_dominated")]


def link_profiles(docs: DataFrame) -> DataFrame:
    """Per block with links of each document: their number, the share of its text that is theirs (3 places) and whether links are all or most (0.8) of it."""
    return docs.select("page_id", F.explode("linked").alias("x")).select("page_id", "x.block_index", "x.links", *_profile(F.col("x")))


def profiled_links(docs: DataFrame) -> DataFrame:
    """Links that stand in a block, beside the shares of :func:`link_profiles` of that block; no row leaves its task."""
    beside = lambda x: F.transform(F.slice("links", x["first"] + 1, x["links"].cast("int")), lambda y: F.struct(y.alias("l"), *_profile(x)))
    return docs.select("page_id", F.explode(F.flatten(F.transform("linked", beside))).alias("x")).select("page_id", "x.l.*", "x.text_fraction", "x.is_link_only", "x.is_link_dominated")


def heading_path(blocks: Column, block: Column) -> Column:
    """Texts of the headings that ``block`` stands under, outermost first: each block knows the nearest one, each heading the nearest of a lesser level."""
    hops, at = [], block["above"]
    for _ in range(len(HEADINGS)):
        over = F.get(blocks, at)
        hops.append(over["text"])
        at = over["above"]
    return F.array_compact(F.array(*reversed(hops)))


def sections(docs: DataFrame) -> DataFrame:
    """Each block outside chrome with the headings it stands under, outermost first, and itself if it is one.

    A heading closes those of its own and deeper levels. Columns: page_id, place (among those blocks), kind, text, heading_path.
    """
    own = lambda b: F.concat(heading_path(F.col("blocks"), b), F.when(b["level"].isNotNull(), F.array(b["text"])).otherwise(F.array().cast("array<string>")))
    body = F.filter("blocks", lambda b: ~b["in_chrome"])
    return docs.select("page_id", F.posexplode(F.transform(body, lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), own(b).alias("heading_path")))).alias("place", "s")).select("page_id", "place", "s.*")


def statements(docs: DataFrame) -> DataFrame:
    """What the body of each document says: blocks that are neither chrome nor headings, and table cells with their labels.

    Columns: page_id, place (of the block among all blocks), kind (``td`` for cells), text, heading (the nearest), column_header, row_label. A cell is stated
    once, whatever it spans; cells of header rows only label others.
    """
    b = F.transform("blocks", lambda b, i: F.struct(i.alias("place"), b.alias("b")))
    b = F.filter(b, lambda x: ~x["b"]["in_chrome"] & x["b"]["level"].isNull() & ~x["b"]["kind"].isin("td", "th"))
    said = lambda x: F.struct(x["place"].alias("place"), x["b"]["kind"].alias("kind"), x["b"]["text"].alias("text"), F.get("blocks", x["b"]["above"])["text"].alias("heading"))
    none = F.get("tables", F.lit(-1))
    # blocks and tables together, so that each page is read once
    texts = F.transform(b, lambda x: F.struct(said(x).alias("said"), F.lit(None).cast("int").alias("table_index"), none.alias("t")))
    tables = F.transform("tables", lambda t, i: F.struct(F.lit(None).cast("struct<place:int,kind:string,text:string,heading:string>").alias("said"), i.alias("table_index"), t.alias("t")))
    c = _places(docs.select("page_id", "blocks", F.explode(F.concat(texts, tables)).alias("x")).select("page_id", "blocks", "x.*"), F.posexplode_outer, "said")
    block = F.col("said").isNotNull()
    c = c.filter(block | (F.col("origin") & F.col("block").isNotNull() & ~F.col("in_chrome")))
    either = lambda ours, theirs: F.when(block, F.col("said")[ours]).otherwise(theirs).alias(ours)
    return c.select("page_id", either("place", F.col("block")), either("kind", F.lit("td")), either("text", F.col("text")), either("heading", F.col("heading")), "column_header", "row_label")


def headings(docs: DataFrame) -> DataFrame:
    """Headings outside chrome: page_id, place (among all blocks), level, text."""
    h = docs.select("page_id", F.posexplode("blocks").alias("place", "b")).filter("b.level is not null and not b.in_chrome")
    return h.select("page_id", "place", "b.level", "b.text")


def distinct_bodies(docs: DataFrame) -> DataFrame:
    """Documents by a digest of what they hold, the smallest page id of each and their number."""
    return docs.groupBy(F.sha2(F.to_json(F.struct("title", "blocks", "tables")), 256).alias("document_hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


def cells(docs: DataFrame) -> DataFrame:
    """Every place of every table's body with its labels: page_id, table_index, row_index, column_index, text, header, block, origin, in_chrome, caption, heading, column_header, row_label, row_text.

    Spans are laid out, so a place has the text of the cell that covers it (``origin`` at the cell's first place). ``column_header`` joins the different texts
    of all header rows over the column, from the top. ``row_label`` joins the different texts to the left that label the row: the first one, header
    cells and those without a digit; null in the first column. ``row_text``: the row's different texts, parted by bars. ``block``: place of the cell's text among all blocks.
    """
    return _places(docs.select("page_id", "blocks", F.posexplode("tables").alias("table_index", "t")), F.posexplode)


def _places(t: DataFrame, each: Callable[[str], Column], *more: str) -> DataFrame:
    """The rows of :func:`cells` of tables ``t``, with the columns ``more``; ``each`` parts rows and their places."""
    wide = F.array_max(F.transform("t.head_grid", lambda r: F.size(r)))
    over = lambda j: F.array_join(F.array_distinct(F.filter(F.transform("t.head_grid", lambda r: F.get(r, j)["text"]), lambda x: x != "")), " ")
    heads = F.when(F.coalesce(wide, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), wide - 1), over))
    # headers are made once a table, before its rows are parted
    t = t.select("page_id", "blocks", *more, "table_index", "t.caption", heads.alias("heads"), "t.grid")
    rows = t.select("page_id", "blocks", *more, "table_index", "caption", "heads", each("grid").alias("row_index", "row"))
    texts = F.array_join(F.array_distinct(F.filter(F.transform("row", lambda c: c["text"]), lambda x: x != "")), " | ")
    c = rows.withColumn("row_text", texts).select("*", each("row").alias("column_index", "c"))
    left = F.transform(F.slice("row", F.lit(1), F.col("column_index")), lambda x, k: F.when((k == 0) | x["header"] | ~x["text"].rlike(r"\d"), x["text"]))
    label = F.when(F.col("column_index") > 0, F.array_join(F.array_distinct(F.filter(left, lambda x: x.isNotNull() & (x != ""))), " "))
    block = F.get("blocks", F.col("c.block"))
    header = F.get("heads", F.col("column_index"))
    return c.select(
        "page_id", "table_index", "row_index", "column_index", "c.text", "c.header", "c.block", "c.origin", F.coalesce(block["in_chrome"], F.lit(False)).alias("in_chrome"), "caption",
        F.get("blocks", block["above"])["text"].alias("heading"), F.when(header != "", header).alias("column_header"), label.alias("row_label"), "row_text", *more,
    )
