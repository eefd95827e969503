"""Documents as blocks: sections, chapters, kinds, abstracts; and web pages as text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folioweave.functions.score import section_kind
from folioweave.functions.text import strip, truthy

BLOCK = "type STRING, text STRING, text_level INT, page_idx INT, img_path STRING, table_body STRING, latex STRING"


def parse_blocks(documents: DataFrame, doc_id: str, content: str) -> DataFrame:
    """(doc_id, ord, type, content, level, page) from JSON block lists; a text with a level is a title, empty blocks but images and tables are dropped."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.from_json(content, f"ARRAY<STRUCT<{BLOCK}>>")).alias("ord", "b"))
    level = F.coalesce("b.text_level", F.lit(0))
    kind = F.when((F.col("b.type") == "text") & (level > 0), "title").otherwise(F.col("b.type"))
    text = F.when(F.col("b.type") == "image", F.col("b.img_path")).when(F.col("b.type") == "table", F.coalesce(truthy(F.col("b.table_body")), F.col("b.latex"))).when(F.col("b.type") == "equation", F.coalesce(truthy(F.col("b.latex")), F.col("b.text"))).otherwise(F.col("b.text"))
    out = rows.select("doc_id", "ord", kind.alias("type"), F.coalesce(text, F.lit("")).alias("content"), level.alias("level"), F.coalesce("b.page_idx", F.lit(0)).alias("page"))
    return out.filter((F.col("content") != "") | F.col("type").isin("image", "table"))


def parse_layout(documents: DataFrame, doc_id: str, content: str) -> DataFrame:
    """(doc_id, ord, type, content, level, page) from nested layouts: pages of paragraphs of lines of spans.

    The text spans of a paragraph are joined by blanks; a paragraph without lines has a text of its own.  Paragraphs of type
    text without text are dropped, those with a level are titles; ``ord`` counts over the pages.
    """
    para = "type: STRING, text_level: INT, text: STRING, lines: ARRAY<STRUCT<spans: ARRAY<STRUCT<type: STRING, content: STRING>>>>"
    pages = F.from_json(F.col(content), f"STRUCT<pdf_info: ARRAY<STRUCT<page_idx: INT, para_blocks: ARRAY<STRUCT<{para}>>>>>")["pdf_info"]
    placed = F.flatten(F.transform(pages, lambda p, i: F.transform(p["para_blocks"], lambda b: F.struct(F.coalesce(p["page_idx"], i).alias("page"), b.alias("b")))))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(placed).alias("ord", "x")).select("doc_id", "ord", "x.page", "x.b")
    spans = F.flatten(F.transform("b.lines", lambda line: F.coalesce(line["spans"], F.array().cast("array<struct<type:string,content:string>>"))))
    said = F.array_join(F.transform(F.filter(spans, lambda s: s["type"] == "text"), lambda s: F.coalesce(s["content"], F.lit(""))), " ")
    text = strip(F.coalesce(F.when(F.col("b.lines").isNotNull(), said).otherwise(F.col("b.text")), F.lit("")))
    level, kind = F.coalesce("b.text_level", F.lit(0)), F.coalesce("b.type", F.lit("text"))
    out = rows.select("doc_id", "ord", F.when((kind == "text") & (level > 0), "title").otherwise(kind).alias("type"), text.alias("content"), level.alias("level"), "page", kind.alias("was"))
    return out.filter((F.col("content") != "") | (F.col("was") != "text")).drop("was")


def markdown_blocks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, type, content, level, page) from plain or marked-up text: lines that start with # are titles of that level."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("ord", "line")).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    marks = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    title = F.length(marks) > 0
    content = F.when(title, strip(F.regexp_replace("line", r"^#{1,6}\s+", ""))).otherwise(F.col("line"))
    return rows.select("doc_id", "ord", F.when(title, "title").otherwise("text").alias("type"), content.alias("content"), F.when(title, F.length(marks)).otherwise(0).alias("level"), F.lit(0).alias("page"))


def _in_order(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, title, level, text): a title opens a section; its text blocks joined by blank lines.

    Section 0 is what comes before the first title.  Windows run within a document.
    """
    opens = ((F.col("type") == "title") & (F.col("level") > 0)).cast("int")
    rows = blocks.withColumn("section", F.sum(opens).over(_in_order()))
    told = F.when((F.col("type") == "text") & (F.col("content") != ""), F.struct("ord", "content"))
    head = F.struct("ord", "content", "level")
    g = rows.groupBy("doc_id", "section").agg(F.min(F.when(opens == 1, head)).alias("h"), F.array_sort(F.collect_list(told)).alias("t"))
    return g.select("doc_id", F.col("section").cast("long").alias("section"), F.col("h.content").alias("title"), F.coalesce("h.level", F.lit(0)).alias("level"), F.array_join(F.col("t.content"), "\n\n").alias("text"))


def chapters(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, title, level, parent): each title with the nearest earlier title of a smaller level; NULL at the top."""
    titles = blocks.filter((F.col("type") == "title") & (F.col("level") > 0))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r["level"] for r in titles.select("level").distinct().collect())[:-1]  # a row per level of headings
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("ord")), True).over(before)) for k in levels]
    parent = F.greatest(*last) if len(last) > 1 else last[0] if last else F.lit(None)
    return titles.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("content").alias("title"), "level", parent.cast("long").alias("parent"))


def full_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, title, level, text): each titled section with the text of all sections below it, in order; empty parts leave no gap.

    A section ends before the next title of its level or a smaller one; windows and joins run within a document.
    """
    own = sections(blocks).filter("section > 0")
    after = Window.partitionBy("doc_id").orderBy("section").rowsBetween(1, Window.unboundedFollowing)
    levels = sorted(r["level"] for r in own.select("level").distinct().collect())  # a row per level of headings
    ends = [F.when(F.col("level") >= k, F.first(F.when(F.col("level") == k, F.col("section")), True).over(after)) for k in levels]
    end = F.least(*ends) if len(ends) > 1 else ends[0] if ends else F.lit(None)
    spans = own.select("doc_id", "section", "title", "level", F.coalesce(end, F.lit(1 << 62)).alias("end"))
    parts = own.filter("text <> ''").select(F.col("doc_id").alias("of"), F.col("section").alias("part"), "text")
    inside = (F.col("of") == F.col("doc_id")) & (F.col("part") >= F.col("section")) & (F.col("part") < F.col("end"))
    listed = spans.join(parts, inside, "left").groupBy("doc_id", "section", "title", "level").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "text")))).alias("t"))
    return listed.select("doc_id", "section", "title", "level", F.array_join(F.col("t.text"), "\n\n").alias("text"))


def find_section(sections: DataFrame, query: str, top_only: bool = True) -> DataFrame:
    """The first section of each document whose title holds ``query``, whatever the case: of the top level only, or of any level in order."""
    rows = sections.filter(F.lower("title").contains(query.lower()))
    if top_only:
        top = sections.filter("title IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min("level").alias("top"))
        rows = rows.join(top, (F.col("of") == F.col("doc_id")) & (F.col("level") == F.col("top"))).drop("of", "top")
    first = F.min_by(F.struct(*(c for c in rows.columns if c != "doc_id")), "section").alias("s")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "s.*")


def standard_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, kind, text): the text under each kind of section a title names; the last one of a kind wins."""
    named = sections(blocks).withColumn("kind", section_kind(F.col("title"))).filter("kind IS NOT NULL")
    return named.groupBy("doc_id", "kind").agg(F.max_by("text", "section").alias("text"))


def document_type(blocks: DataFrame) -> DataFrame:
    """(doc_id, paper_points, book_points, type): book if its signs outweigh those of a paper."""
    title = F.col("type") == "title"
    low = F.lower("content")
    paper = F.sum(F.when(title & section_kind(F.col("content")).isNotNull(), 1).otherwise(0))
    book = F.sum(F.when(title & low.rlike(r"^chapter\s+\d+"), 2).otherwise(0)) + F.sum(F.when(title & low.rlike(r"^\d+\.\d+"), 1).otherwise(0)) + F.when(F.max("page") > 50, 2).otherwise(0)
    points = blocks.groupBy("doc_id").agg(paper.alias("paper_points"), book.alias("book_points"))
    return points.withColumn("type", F.when(F.col("book_points") > F.col("paper_points"), "book").otherwise("paper"))


def abstracts(blocks: DataFrame) -> DataFrame:
    """(doc_id, abstract): the first block that says it is one, else the first long text of the first page."""
    says = (F.col("type") == "text") & F.lower("content").startswith("abstract")
    bare = strip(F.regexp_replace("content", r"(?i)^abstract[\s:.—–-]*", ""))
    first = (F.col("type") == "text") & (F.col("page") == 0) & (F.length("content") > 50)
    g = blocks.groupBy("doc_id").agg(F.min_by(F.when(says, bare), F.when(says, F.col("ord"))).alias("a"), F.min_by(F.when(first, F.col("content")), F.when(first, F.col("ord"))).alias("b"))
    return g.select("doc_id", F.coalesce("a", F.when(F.length("b") < 2000, F.col("b"))).alias("abstract"))


def titles(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first title block."""
    is_title = F.col("type") == "title"
    return blocks.groupBy("doc_id").agg(F.min_by(F.when(is_title, F.col("content")), F.when(is_title, F.col("ord"))).alias("title")).filter("title IS NOT NULL")


def tables(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, content) of each table that is not empty."""
    return blocks.filter("type = 'table' AND content <> ''").select("doc_id", "ord", "content")


def inverted_text(index: Column) -> Column:
    """The text an inverted index (word to positions) stands for; places no word takes stay empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.cast("int").alias("p"), e["key"].alias("w")))))
    last = F.array_max(F.transform(pairs, lambda x: x["p"]))
    words = F.map_from_entries(F.array_sort(pairs))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(words, i), F.lit(""))), " "))


# Elements that hold a page's content, in the order they are looked for, and those that hold none.
CONTENT = (("tag", "article"), ("role", "main"), ("class", "article-content"), ("class", "paper-content"), ("class", "full-text"), ("class", "content-body"), ("id", "article-body"), ("id", "main-content"), ("tag", "main"), ("tag", "body"))
_NO_TAGS = frozenset(("nav", "header", "footer", "aside", "script", "style", "noscript"))
_NO_CLASSES = frozenset(("sidebar", "advertisement", "ads", "cookie-banner", "nav", "menu", "social-share", "related-articles"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def nodes(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.nodes()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes the nearest open element of its name, others are left open to the end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _is(node: _Node, rule: tuple[str, str]) -> bool:
    kind, value = rule
    return node.tag == value if kind == "tag" else value in node.attrs.get("class", "").split() if kind == "class" else node.attrs.get(kind) == value


def _prune(node: _Node) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or not (c.tag in _NO_TAGS or _NO_CLASSES & set(c.attrs.get("class", "").split()))]
    for c in node.children:
        if isinstance(c, _Node):
            _prune(c)


def _markdown(node: _Node) -> str:
    flat = lambda n: re.sub(r"\s+", " ", n.text()).strip()
    out: list[str] = []

    def walk(n: _Node) -> None:
        run: list[str] = []

        def close() -> None:
            said = re.sub(r"\s+", " ", "".join(run)).strip()
            if said:
                out.append(said)
            run.clear()

        for c in n.children:
            if isinstance(c, str):
                run.append(c)
            elif c.tag in ("a", "em", "strong", "b", "i", "span", "sub", "sup", "code", "small", "u"):
                run.append(c.text())
            else:
                close()
                if re.fullmatch("h[1-6]", c.tag):
                    out.append(f"{'#' * int(c.tag[1])} {flat(c)}")
                elif c.tag in ("ul", "ol"):
                    items = [x for x in c.children if isinstance(x, _Node) and x.tag == "li"]
                    out.append("\n".join((f"{i}. " if c.tag == "ol" else "- ") + flat(x) for i, x in enumerate(items, 1)))
                elif c.tag == "pre":
                    out.append("```\n" + c.text() + "\n```")
                elif c.tag == "blockquote":
                    out.append("> " + flat(c))
                elif c.tag == "p":
                    if flat(c):
                        out.append(flat(c))
                elif c.tag not in ("table", "img", "figure"):
                    walk(c)
        close()

    walk(node)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out)).strip()


def _outer(node: _Node) -> str:
    attrs = "".join(f' {k}="{v}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + "".join(c if isinstance(c, str) else _outer(c) for c in node.children) + ("" if node.tag in _VOID else f"</{node.tag}>")


def page_tree(page: str) -> _Node:
    """The root of a page's elements."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def read_page(page: str) -> dict:
    """Title, authors, keywords, DOI, description, content as markdown, image addresses and tables of a web page."""
    root = page_tree(page)
    every = list(root.nodes())
    metas = [(n.attrs.get("name") or n.attrs.get("property") or "", n.attrs.get("content", "")) for n in every if n.tag == "meta"]
    title = next((re.sub(r"\s+", " ", n.text()).strip() for n in every if n.tag == "title"), None)
    named = lambda *names: [v for k, v in metas if k.lower() in names and v]
    title = next(iter(named("citation_title")), title)
    keywords = [w.strip() for v in named("keywords", "citation_keywords") for w in re.split("[,;]", v) if w.strip()]
    _prune(root)
    every = list(root.nodes())
    content = next((n for rule in CONTENT for n in every if _is(n, rule)), root)
    inside = list(content.nodes())
    figures = [a for n in inside if n.tag == "img" and (a := n.attrs.get("src") or n.attrs.get("data-src"))]
    return {
        "title": title, "authors": named("citation_author", "author"), "keywords": keywords, "doi": next(iter(named("citation_doi", "dc.identifier")), None),
        "description": next(iter(named("description", "og:description")), None), "markdown": _markdown(content), "figures": figures, "tables": [_outer(n) for n in inside if n.tag == "table"],
    }


_LISTS = ("authors", "keywords", "figures", "tables")
_FIELDS = ("title", "authors", "keywords", "doi", "description", "markdown", "figures", "tables")
PAGE = T.StructType([T.StructField(f, T.ArrayType(T.StringType()) if f in _LISTS else T.StringType()) for f in _FIELDS])


@F.pandas_udf(PAGE)
def _pages(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(t or "") for t in texts], columns=list(_FIELDS))


def extract_pages(pages: DataFrame, page_id: str, page: str) -> DataFrame:
    """(page_id, title, authors, keywords, doi, description, markdown, figures, tables) of web pages; NULL pages give empty fields."""
    return pages.select(F.col(page_id), _pages(F.col(page)).alias("p")).select(page_id, "p.*")
