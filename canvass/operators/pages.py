"""Jobs over a table of fetched pages.

Parsing markup is the one step that needs Python: a small event reader per page
inside ``mapInArrow``, one Arrow batch at a time.  Everything after it works on
lines and cells as arrays inside the row, so no page is shuffled.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass import config as C
from canvass.functions.once import bind
from canvass.functions.text import as_col, lines, strip, str_array


_SPACE, _TAG = r"[ \t\n\r\f]", r"[a-zA-Z][-a-zA-Z0-9:]*"
_VALUE = rf"""="[^"&]*"|='[^'&]*'|=[-a-zA-Z0-9_.#%]+(?={_SPACE}|>)"""
# Well-formed markup, a token at a time; what is not surely read alike is left to HTMLParser.
_TOKEN = re.compile(
    r"([^<&]+)"
    rf"|<({_TAG})((?:{_SPACE}+[a-zA-Z][-a-zA-Z0-9_:.]*(?:{_VALUE})?)*){_SPACE}*(/?)>"
    rf"|</({_TAG}){_SPACE}*>"
    r"|&([a-zA-Z][-.a-zA-Z0-9]*);"
    r"|&#([0-9]+|[xX][0-9a-fA-F]+);"
    r"|<!--(?![->])[^-]*(?:-(?!-)[^-]*)*-->|<!(?i:doctype)[^>]*>")
_ATTR = re.compile(rf"([a-zA-Z][-a-zA-Z0-9_:.]*)({_VALUE})?(?={_SPACE}|$)")
_RAW = re.compile(rf"[^<]*</({_TAG}){_SPACE}*>")
_BLOCK, _LINE, _VOID, _OPAQUE = (frozenset(x) for x in (C.BLOCK_TAGS, C.LINE_TAGS, C.VOID_TAGS, C.OPAQUE_TAGS))


def _attrs(text: str) -> list:
    """(name, value) of a start tag's attributes; without a value it is None."""
    return [(name.lower(), (value[2:-1] if value[1] in "'\"" else value[1:]) if value else None)
            for name, value in _ATTR.findall(text)]


class _Reader(HTMLParser):
    """Collects text runs; tolerant of unclosed and unmatched tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open_tags, self.opaque = [], 0

    def begin(self, tag, attrs):
        """An element opened."""

    def end(self, tag):
        """An element closed."""

    def text(self, data):
        """A text run outside opaque elements."""

    def handle_starttag(self, tag, attrs):
        self.begin(tag, dict(attrs))
        if tag in _VOID:
            self.end(tag)
            return
        self.open_tags.append(tag)
        self.opaque += tag in _OPAQUE

    def handle_startendtag(self, tag, attrs):
        self.begin(tag, dict(attrs))
        self.end(tag)

    def handle_endtag(self, tag):
        if tag in _VOID or tag not in self.open_tags:
            return
        while self.open_tags:
            closed = self.open_tags.pop()
            self.opaque -= closed in _OPAQUE
            self.end(closed)
            if closed == tag:
                return

    def handle_data(self, data):
        if not self.opaque:
            self.text(data)

    def handle_entityref(self, name):
        if not self.opaque:
            self.text(unescape(f"&{name};"))

    def handle_charref(self, name):
        if not self.opaque:
            self.text(unescape(f"&#{name};"))

    def plain(self, html: str) -> int:
        """Read well-formed markup; returns where it ends, always between two tokens."""
        at = 0
        while token := _TOKEN.match(html, at):
            data, tag, attrs, empty, ended, entity, char = token.groups()
            after = token.end()
            if data:
                self.handle_data(data)
            elif tag:
                tag = tag.lower()
                if empty:
                    self.handle_startendtag(tag, _attrs(attrs))
                elif tag in self.CDATA_CONTENT_ELEMENTS:
                    raw = _RAW.match(html, after)
                    if not raw or raw.group(1).lower() != tag:
                        return at
                    self.handle_starttag(tag, _attrs(attrs))
                    self.handle_endtag(tag)  # these are opaque, so that their text is not read
                    after = raw.end()
                elif tag in getattr(self, "RCDATA_CONTENT_ELEMENTS", ()) or tag == "plaintext":
                    return at  # newer parsers read what is inside these in another way
                else:
                    self.handle_starttag(tag, _attrs(attrs) if attrs else ())
            elif ended:
                self.handle_endtag(ended.lower())
            elif entity:
                self.handle_entityref(entity)
            elif char:
                self.handle_charref(char)
            at = after
        return at

    def run(self, html: str):
        html = html or ""
        end = self.plain(html)
        if end < len(html):
            self.feed(html[end:])
            self.close()
        while self.open_tags:
            self.end(self.open_tags.pop())
        return self


class _Text(_Reader):
    """All text; block elements break lines."""

    def __init__(self):
        super().__init__()
        self.parts = []

    def begin(self, tag, attrs):
        if tag in _BLOCK and not self.opaque:
            self.parts.append("\n")

    end = lambda self, tag: self.begin(tag, None)

    def text(self, data):
        if data.strip():
            self.parts.append(data)

    def value(self) -> str:
        collapsed = (" ".join(x.split()) for x in " ".join(self.parts).split("\n"))
        return "\n".join(x for x in collapsed if x)


class _Blocks(_Reader):
    """Text of the innermost block elements, one line each; else the whole text."""

    def __init__(self):
        super().__init__()
        self.stack, self.done, self.whole = [], [], []

    def begin(self, tag, attrs):
        if tag == "br":
            self.text("\n")
        elif tag in _LINE:
            if self.stack:  # those further out have been marked by the blocks inside them
                self.stack[-1]["inner"] = False
            self.stack.append({"inner": True, "text": [], "order": len(self.done) + len(self.stack)})

    def end(self, tag):
        if tag in _LINE and self.stack:
            block = self.stack.pop()
            if block["inner"]:
                self.done.append("".join(block["text"]))

    def text(self, data):
        self.whole.append(data)
        if self.stack and self.stack[-1]["inner"]:  # only an innermost block's text is read
            self.stack[-1]["text"].append(data)

    def value(self) -> str:
        squeeze = lambda t: " ".join(t.replace("\t", " ").split(" ")).strip()
        collapse = lambda t: "\n".join(" ".join(p for p in ln.split(" ") if p) for ln in squeeze(t).split("\n"))
        if not self.done:
            return collapse("".join(self.whole))
        return "\n".join(x for x in (collapse(d) for d in self.done) if x)


class _Rows(_Reader):
    """Table rows: cell texts, heading text, links."""

    def __init__(self):
        super().__init__()
        self.rows, self.row, self.cell, self.kind, self.link = [], None, None, None, None

    def begin(self, tag, attrs):
        if tag == "tr":
            self.row = {"cells": [], "heading": None, "links": [], "labels": []}
        elif self.row is not None and tag in ("td", "th"):
            self._close_cell()  # an unclosed cell ends where the next begins
            self.cell, self.kind = [], tag
        elif self.row is not None and tag == "a":
            self.link = (attrs.get("href") or "", [])
        if self.cell is not None and tag in _BLOCK:
            self.cell.append("\n")

    def end(self, tag):
        if self.cell is not None and tag in _BLOCK and tag not in ("td", "th", "tr"):
            self.cell.append("\n")
        if self.row is None:
            return
        if tag == "a" and self.link is not None:
            self.row["links"].append(self.link[0])
            self.row["labels"].append(" ".join("".join(self.link[1]).split()))
            self.link = None
        elif tag == self.kind:
            self._close_cell()
        elif tag == "tr":
            self._close_cell()
            self.rows.append(self.row)
            self.row = None

    def _close_cell(self):
        if self.kind == "td":
            self.row["cells"].append(_tidy(self.cell))
        elif self.kind == "th":
            self.row["heading"] = _tidy(self.cell)
        self.cell = self.kind = None

    def text(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(data)
        if self.link is not None:
            self.link[1].append(data)


class _Elements(_Reader):
    """Text of the elements a selector picks."""

    def __init__(self, tag=None, classes=(), id_prefix=None, id_suffix="", any_of=()):
        super().__init__()
        self.tag, self.classes, self.any_of = tag, set(classes), set(any_of)
        self.id_prefix, self.id_suffix = id_prefix, id_suffix
        self.depths, self.found = [], []

    def _wanted(self, tag, attrs):
        if self.tag and tag != self.tag:
            return False
        if self.any_of and not self.any_of & set((attrs.get("class") or "").split()):
            return False
        if self.classes and not self.classes <= set((attrs.get("class") or "").split()):
            return False
        if self.id_prefix is not None:
            eid = attrs.get("id") or ""
            return eid.startswith(self.id_prefix) and eid.endswith(self.id_suffix)
        return True

    def begin(self, tag, attrs):
        for d in self.depths:
            d["text"].append("\n" if tag in _BLOCK else "")
        if tag not in _VOID and not self.opaque and self._wanted(tag, attrs):
            eid = attrs.get("id") or ""
            if self.id_prefix is not None:
                eid = eid[len(self.id_prefix): len(eid) - len(self.id_suffix)]
            if self.any_of:
                eid = min(self.any_of & set((attrs.get("class") or "").split()))
            item = {"tag": tag, "level": len(self.open_tags), "name": eid, "text": []}
            self.depths.append(item)
            self.found.append(item)

    def end(self, tag):
        for d in self.depths:
            d["text"].append("\n" if tag in _BLOCK else "")
        self.depths = [d for d in self.depths if d["level"] != len(self.open_tags) or tag in _VOID]

    def text(self, data):
        if data.strip():
            for d in self.depths:
                d["text"].append(data)


def _tidy(parts) -> str:
    collapsed = (" ".join(x.split()) for x in " ".join(p for p in parts if p).split("\n"))
    return "\n".join(x for x in collapsed if x)


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _per_page(pages: DataFrame, schema: str, rows_of) -> DataFrame:
    """Run a reader over (page_id, html); ``rows_of(html)`` gives tuples after the id."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    laid = pa.schema([("page_id", pa.int64()), *[(name, _ARROW[kind]) for name, kind in fields]])

    def job(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(pid, *row) for pid, html in zip(ids, texts) for row in rows_of(html)]
            columns = zip(*out) if out else [()] * len(laid)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, laid)], schema=laid)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(job, "page_id long, " + schema)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): visible text, one line per block."""
    return _per_page(pages, "text string", lambda html: [(_Text().run(html).value(),)])


def page_block_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): innermost blocks as lines, inline text flowing."""
    return _per_page(pages, "text string", lambda html: [(_Blocks().run(html).value(),)])


def page_table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_no, links, labels, heading, cells) of every table row."""

    def rows_of(html):
        for i, r in enumerate(_Rows().run(html).rows):
            yield i, r["links"], r["labels"], r["heading"], r["cells"]

    return _per_page(
        pages, "row_no int, links array<string>, labels array<string>, heading string, cells array<string>", rows_of)


def listing_rows(table_rows: DataFrame, href: str) -> DataFrame:
    """Table rows that hold a record link, read into listing fields."""
    from canvass.functions.fields import classify_cells

    hit = F.array_position(F.transform("links", lambda x: x.rlike(href)), F.lit(True)).cast("int")
    got = table_rows.withColumn("_hit", hit).where("_hit > 0").withColumn("_c", classify_cells("cells"))
    link = F.element_at("links", F.col("_hit"))
    head_lines = lines("heading")
    return got.select(
        "page_id", "row_no", F.regexp_extract(link, href, 1).alias("native_id"),
        F.element_at("labels", F.col("_hit")).alias("name"), link.alias("link"),
        F.array_join(F.slice(head_lines, F.lit(2), F.greatest(F.size(head_lines) - 1, F.lit(0))), "\n").alias("blurb"),
        "_c.*")


def page_elements(pages: DataFrame, tag=None, classes=(), id_prefix=None, id_suffix="") -> DataFrame:
    """(page_id, pos, name, text) of selected elements; empty ones are dropped."""

    def rows_of(html):
        for i, item in enumerate(_Elements(tag, classes, id_prefix, id_suffix).run(html).found):
            text = _tidy(item["text"])
            if text and (id_prefix is None or item["name"]):
                yield i, item["name"], text

    return _per_page(pages, "pos int, name string, text string", rows_of)


def page_marked(pages: DataFrame, classes) -> DataFrame:
    """(page_id, pos, name, text) of elements of any of the classes, in the order of the page; name is the class."""

    def rows_of(html):
        for i, item in enumerate(_Elements(any_of=classes).run(html).found):
            text = _tidy(item["text"])
            if text:
                yield i, item["name"], text

    return _per_page(pages, "pos int, name string, text string", rows_of)


def label_value(text) -> Column:
    """A 'Label: value' block as struct(label, value); other text gives null."""
    pattern = r"(?s)^([A-Za-z ]{2,30}):\s*(.*)$"
    hit = as_col(text).rlike(pattern)
    return F.when(hit, F.struct(
        F.lower(strip(F.regexp_extract(as_col(text), pattern, 1))).alias("label"),
        strip(F.regexp_extract(as_col(text), pattern, 2)).alias("value")))


def field_map(elements: DataFrame) -> DataFrame:
    """Selected elements as one name -> text map per page; the last of a name wins.

    The number of fields of a page is fixed by its form, not by the data.
    """
    last = elements.groupBy("page_id", "name").agg(F.max_by("text", "pos").alias("text"))
    return last.groupBy("page_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "text")))).alias("fields"))


# --- over raw markup, without parsing --------------------------------------------
def page_links(pages: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Distinct matches of a link pattern per page."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(group)))
    return pages.select("page_id", F.explode(found).alias("link"))


def page_title(html) -> Column:
    """The title, white space collapsed; empty when there is none."""
    inner = F.regexp_extract(as_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return strip(F.regexp_replace(inner, r"\s+", " "))


# --- over text, inside the row ----------------------------------------------------
def sections(text_lines, is_heading) -> Column:
    """array<struct(heading, body)>: a page's lines cut at its headings.

    Headings are lower-cased without a trailing colon, copies of a heading are
    joined, text before the first has the heading ''.
    """
    ls = as_col(text_lines)
    positions = F.filter(F.transform(ls, lambda x, i: F.when(is_heading(x), i + 1)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), positions)
    ends = F.concat(positions, F.array(F.size(ls) + 1))
    cut = F.zip_with(starts, ends, lambda s, e: F.struct(
        F.when(s == 0, F.lit("")).otherwise(
            strip(F.regexp_replace(strip(F.lower(F.get(ls, s - 1))), ":+$", ""))).alias("heading"),
        F.array_join(F.slice(ls, s + 1, e - s - 1), "\n").alias("body")))
    filled = F.filter(cut, lambda c: c["body"] != "")
    names = F.array_distinct(F.transform(filled, lambda c: c["heading"]))
    return F.transform(names, lambda h: F.struct(
        h.alias("heading"),
        F.array_join(F.transform(F.filter(filled, lambda c: c["heading"] == h), lambda c: c["body"]), "\n")
        .alias("body")))


def section_merge(containers: DataFrame, page: str, pos: str, text: str, is_heading) -> DataFrame:
    """Sections over all content containers of a page; short ones and page furniture are skipped."""
    head = F.substring(text, 1, 60)
    chrome = F.exists(str_array(C.CHROME_MARKERS), lambda m: head.contains(m))
    kept = containers.where((F.length(text) >= C.MIN_CONTAINER_CHARS) & ~chrome)
    cut = kept.select(page, pos, F.posexplode(sections(lines(text), is_heading)).alias("i", "s"))
    return cut.groupBy(page, F.col("s.heading").alias("heading")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(pos, "i", F.col("s.body").alias("b")))), lambda x: x["b"]),
            "\n").alias("body"))


def label_value_lines(text_lines, labels: dict) -> Column:
    """struct(one value per label, body): a bare number belongs to the label just before it.

    ``labels`` maps a name to the lower-case start of its line.  A figure on the
    label's own line wins; lines that are neither stay body.
    """
    bare = r"^\$?\s*[\d,]+(?:\.\d{2})?$"
    tail = lambda x: F.when(x.contains(":"), strip(F.regexp_replace(x, r"^[^:]*:", ""))).otherwise(F.lit(""))

    def label_of(x):
        low, chain = F.lower(x), F.lit(None).cast("string")
        for name, start in reversed(list(labels.items())):
            chain = F.when(low.startswith(start), F.lit(name)).otherwise(chain)
        return chain

    named = F.transform(as_col(text_lines), lambda x: F.struct(x.alias("line"), label_of(x).alias("label")))
    cut = F.transform(named, lambda t: F.struct(
        t["line"].alias("line"), t["label"].alias("label"),
        F.when(t["label"].isNotNull(), tail(t["line"])).alias("tail"), t["line"].rlike(bare).alias("bare")))
    tagged = F.transform(cut, lambda t: F.struct(
        t["line"].alias("line"), t["label"].alias("label"),
        F.when(t["tail"].rlike(r"\d"), t["tail"]).alias("tail"), t["bare"].alias("bare")))

    # an array that is read at every element must be bound, or each reading makes it anew
    def owners(v):
        previous = lambda i: F.get(v["tagged"], i - 1)
        waits = lambda i: (i > 0) & previous(i)["label"].isNotNull() & previous(i)["tail"].isNull()
        return F.transform(v["tagged"], lambda t, i: F.struct(
            t["line"].alias("line"),
            F.when(t["label"].isNotNull(), t["label"]).when(waits(i) & t["bare"], previous(i)["label"]).alias("owner"),
            F.when(t["label"].isNotNull(), t["tail"]).when(waits(i) & t["bare"], t["line"]).alias("value")))

    def build(v):
        last_of = lambda name: F.try_element_at(
            F.filter(v["owned"], lambda o: (o["owner"] == name) & o["value"].isNotNull()), F.lit(-1))["value"].alias(name)
        loose = F.filter(v["owned"], lambda o: o["owner"].isNull())
        return F.struct(*[last_of(name) for name in labels],
                        F.array_join(F.transform(loose, lambda o: o["line"]), "\n").alias("body"))

    return bind({"owned": bind({"tagged": tagged}, owners)}, build)


def body_between(text_lines, title) -> Column:
    """Lines after the first one holding the title, up to a closing label, without navigation words."""
    title = as_col(title)

    def after_title(v):
        after = F.array_position(F.transform(v["lines"], lambda x: x.contains(title)), F.lit(True)).cast("int")
        start = F.coalesce(after, F.lit(0))
        return F.slice(v["lines"], start + 1, F.greatest(F.size(v["lines"]) - start, F.lit(0)))

    def before_label(v):
        stop = F.array_position(F.transform(v["rest"], lambda x: x.isin(C.STOP_LABELS)), F.lit(True)).cast("int")
        kept = F.when(stop > 0, F.slice(v["rest"], F.lit(1), stop - 1)).otherwise(v["rest"])
        return F.array_join(F.filter(kept, lambda x: ~x.isin(C.NAVIGATION_WORDS)), "\n")

    rest = bind({"lines": as_col(text_lines)}, after_title)
    return bind({"body": bind({"rest": rest}, before_label)}, lambda v: F.when(v["body"] != "", v["body"]))


# --- over listing rows ------------------------------------------------------------
def listing_dedupe(rows: DataFrame, key: list, item: str, page: str, pos: str) -> DataFrame:
    """First occurrence of every id in page order; an aggregate, no window."""
    rest = [c for c in rows.columns if c not in (*key, item)]
    best = rows.groupBy(*key, item).agg(F.min_by(F.struct(*rest), F.struct(page, pos)).alias("_r"))
    return best.select(*key, item, "_r.*")


def paging_end(rows: DataFrame, key: list, item: str, page: str, per_page: int) -> DataFrame:
    """First page that adds no new id or is short; later pages do not count."""
    first = rows.groupBy(*key, item).agg(F.min(page).alias(page))
    fresh = first.groupBy(*key, page).agg(F.count(F.lit(1)).alias("n_new"))
    sizes = rows.groupBy(*key, page).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = sizes.join(fresh, [*key, page], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    stops = (F.col("n_new") == 0) | (F.col("n_rows") < per_page)
    return joined.groupBy(*key).agg(
        F.coalesce(F.min(F.when(stops, F.col(page))), F.max(page) + 1).alias("last_page"), F.count(F.lit(1)).alias("pages"))


def distinct_per_host(rows: DataFrame, host: str, item: str) -> DataFrame:
    """Distinct ids per host, and over all hosts together (host null)."""
    pairs = rows.select(host, item).distinct()
    return pairs.groupBy(host).agg(F.count(F.lit(1)).alias("n_items")).unionByName(
        pairs.agg(F.count(F.lit(1)).alias("n_items")).select(F.lit(None).cast("string").alias(host), "n_items"))


def tenant_classify(fetches: DataFrame, vendor_host: str) -> DataFrame:
    """Which probed names are real tenants.

    fetches: slug, final_host, title, n_ids, is_control.  Real means the final
    host still starts with the slug and is not the vendor's own.
    """
    real = F.col("final_host").startswith(F.concat("slug", F.lit("."))) & (F.col("final_host") != vendor_host)
    pattern = r"(?i)Opportunities\s*-\s*(.+)\s*$"
    named = F.when(F.col("title").rlike(pattern), strip(F.regexp_extract("title", pattern, 1))).otherwise(F.col("title"))
    return fetches.select(
        "slug", "final_host", "is_control", real.alias("is_tenant"),
        F.when(real, named).otherwise(F.lit("")).alias("institution"),
        F.when(~real, "redirected off-host").when(F.col("n_ids") == 0, "no rows on page 1").otherwise("").alias("note"))


def discriminator_broken(classified: DataFrame) -> DataFrame:
    """One row: did a control name pass for a tenant?"""
    return classified.agg(
        F.coalesce(F.max(F.col("is_control") & F.col("is_tenant")), F.lit(False)).alias("broken"),
        F.count_if(F.col("is_tenant") & ~F.col("is_control")).alias("tenants"))


def category_tags(links: DataFrame, item: str = "slug", page: str = "page") -> DataFrame:
    """Themed pages every item is listed on; only the known pages count."""
    return links.where(F.col(page).isin(sorted(C.CATEGORY_PAGES))).groupBy(item).agg(
        F.sort_array(F.collect_set(page)).alias("pages"))
