"""Tagged markup: tokens, the document tree, and its HTML, Markdown and JSON; structure trees."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import trimmed
from ..functions.lineage import cut

TAG = r"</[a-z_]+\s*>|<[a-z_]+(?:\s+[^>]*?)?\s*/?>|<loc_\d+>"

#: Node kinds by tag.
NODES = {
    "text": "paragraph", "section_header": "section_header", "table": "table", "otsl": "table_body", "fcel": "table_cell", "ecel": "table_cell_empty", "list_item": "list_item",
    "page_header": "page_header", "page_footer": "page_footer", "caption": "caption", "formula": "formula", "footnote": "footnote", "picture": "picture",
}


def tokens(docs: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Tokens of tagged text, in order: keys, pos, type, name, text, page, value, attrs. Texts between tags are trimmed, empty ones dropped."""
    source = F.coalesce(F.col(raw), F.lit(""))
    tags, texts = F.regexp_extract_all(source, F.lit(TAG), F.lit(0)), F.split(source, TAG, -1)
    tag = lambda i, t: F.struct((2 * i + 1).alias("at"), t.alias("tag"), F.lit(None).cast("string").alias("text"))
    between = lambda i, t: F.struct((2 * i).alias("at"), F.lit(None).cast("string").alias("tag"), trimmed(t).alias("text"))
    both = F.concat(F.transform(texts, lambda t, i: between(i, t)), F.transform(tags, lambda t, i: tag(i, t)))
    kept = F.array_sort(F.filter(both, lambda s: s["tag"].isNotNull() | (s["text"] != "")))
    out = docs.select(*keys, F.posexplode(kept).alias("pos", "s")).select(*keys, F.col("pos").cast("long").alias("pos"), F.col("s.tag").alias("tag"), "s.text")
    t = F.col("tag")
    name = F.regexp_extract(t, r"^</?([a-z_]+)", 1)
    loc = t.rlike(r"^<loc_\d+>$")
    kind = F.when(t.isNull(), "TEXT").when(loc, "LOC").when(t.startswith("</"), F.when(name == "page", "PAGE_CLOSE").otherwise("TAG_CLOSE")).when(name == "page", "PAGE_OPEN").when(t.endswith("/>"), "TAG_SELF").otherwise("TAG_OPEN")
    out = out.withColumn("type", kind)
    attrs = F.nullif(F.regexp_extract(t, r"^<[a-z_]+\s+([^>]*?)\s*/?>$", 1), F.lit(""))
    named = F.col("type").isin("TAG_OPEN", "TAG_CLOSE", "TAG_SELF")
    return out.select(
        *keys, "pos", "type", F.when(named, name).alias("name"), "text",
        F.when(F.col("type") == "PAGE_OPEN", F.coalesce(F.regexp_extract(t, r'number="(\d+)"', 1).try_cast("long"), F.lit(0))).alias("page"),
        F.when(F.col("type") == "LOC", F.regexp_extract(t, r"\d+", 0).cast("long")).alias("value"), F.when(F.col("type") == "TAG_OPEN", attrs).alias("attrs"),
    )


class Node:
    """A node of the document tree."""

    def __init__(self, kind: str, value: object = None):
        self.kind, self.value, self.children = kind, value, []

    def text(self) -> str:
        return self.value if self.kind == "text_content" else "".join(c.text() for c in self.children)

    def as_dict(self) -> dict:
        out = {"type": self.kind}
        if self.kind == "page":
            out["pageNumber"] = self.value
        elif self.kind == "text_content":
            return out | {"value": self.value}
        return out | {"children": [c.as_dict() for c in self.children]}


class TreeBuilder:
    """Tokens to a tree. Table rows end at <nl/>; a close tag closes all that is open inside its element; unknown tags are nothing."""

    def __init__(self):
        self.root = Node("document")
        self.open = [self.root]
        self.row: Node | None = None

    def feed(self, kind: str, name: str | None, text: str | None, page: int | None) -> None:
        if kind == "TEXT":
            self._add(Node("text_content", text))
        elif kind == "PAGE_OPEN":
            self.open.append(self._add(Node("page", page)))
        elif kind == "PAGE_CLOSE":
            self._end_row()
            del self.open[1:]
        elif kind == "TAG_SELF":
            if name == "picture":
                self._add(Node("picture"))
            elif name == "nl" and self._body():
                self._end_row()
                self.row = Node("table_row")
        elif name in NODES and kind == "TAG_OPEN":
            self._start(NODES[name])
        elif name in NODES and kind == "TAG_CLOSE":
            self._stop(NODES[name])

    def _add(self, node: Node) -> Node:
        self.open[-1].children.append(node)
        return node

    def _body(self) -> Node | None:
        return next((n for n in reversed(self.open) if n.kind == "table_body"), None)

    def _end_row(self) -> None:
        body = self._body()
        if self.row and self.row.children and body:
            body.children.append(self.row)
        self.row = None

    def _start(self, kind: str) -> None:
        node = Node(kind)
        if kind in ("table_cell", "table_cell_empty"):
            self.row = self.row or Node("table_row")
            self.row.children.append(node)
        else:
            self._add(node)
            if kind == "table_body":
                self.row = Node("table_row")
        self.open.append(node)

    def _stop(self, kind: str) -> None:
        if kind == "table_body":
            self._end_row()
        if kind in ("table_cell", "table_cell_empty"):
            if self.open[-1].kind == kind:
                self.open.pop()
            return
        while len(self.open) > 1 and self.open.pop().kind != kind:
            pass


#: Opening and closing HTML of node kinds.
HTML_TAGS = {
    "paragraph": ("<p>", "</p>"), "section_header": ("<h2>", "</h2>"), "table": ('<table class="tablecoil">\n', "\n</table>"), "list_item": ("<li>", "</li>"),
    "page_header": ('<header class="page-header">', "</header>"), "page_footer": ('<footer class="page-footer">', "</footer>"), "caption": ("<figcaption>", "</figcaption>"),
    "formula": ('<span class="formula">', "</span>"), "footnote": ('<aside class="footnote">', "</aside>"),
}
MARKDOWN_MARKS = {"paragraph": ("", "\n"), "section_header": ("## ", "\n"), "list_item": ("- ", ""), "caption": ("*", "*\n"), "formula": ("`", "`\n"), "footnote": ("> ", "\n")}


def to_html(node: Node) -> str:
    if node.kind == "text_content":
        return html.escape(node.value, quote=True).replace("&#x27;", "'")
    if node.kind == "picture":
        return '<figure class="picture">[Image]</figure>'
    if node.kind == "table_body":
        if not node.children:
            return "<tbody></tbody>"
        rows = [[_inner_html(c) for c in row.children] for row in node.children]
        head = "".join(f"<th>{c}</th>" for c in rows[0])
        body = "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows[1:])
        return f"<thead><tr>{head}</tr></thead>" + (f"\n<tbody>\n{body}\n</tbody>" if body else "")
    if node.kind == "page":
        return f'<section class="page" data-page="{node.value}">\n{_inner_html(node)}\n</section>'
    first, last = HTML_TAGS.get(node.kind, ("", ""))
    return first + _inner_html(node) + last


def _inner_html(node: Node) -> str:
    """Children one to a line, neighbouring list items inside one list. An empty cell has nothing."""
    if node.kind == "table_cell_empty":
        return ""
    out: list[str] = []
    items: list[str] = []
    for child in [*node.children, None]:
        if child is not None and child.kind == "list_item":
            items.append(to_html(child))
            continue
        if items:
            out.append("<ul>\n" + "\n".join(items) + "\n</ul>")
            items = []
        if child is not None:
            out.append(to_html(child))
    return "\n".join(out)


def to_markdown(node: Node) -> str:
    if node.kind == "text_content":
        return node.value
    if node.kind == "picture":
        return "[Image]\n"
    if node.kind in ("page_header", "page_footer"):
        return ""
    if node.kind == "table":
        body = next((c for c in node.children if c.kind == "table_body"), None)
        if not body or not body.children:
            return ""
        lines = ["| " + " | ".join("" if c.kind == "table_cell_empty" else c.text() for c in row.children) + " |" for row in body.children]
        lines.insert(1, "| " + " | ".join(["---"] * max(1, len(body.children[0].children))) + " |")
        return "\n".join(lines) + "\n"
    if node.kind in MARKDOWN_MARKS:
        first, last = MARKDOWN_MARKS[node.kind]
        return first + node.text() + last
    inner = "\n".join(map(to_markdown, node.children))
    return ("\n---\n\n" if node.kind == "page" and node.value > 1 else "") + inner


FORMS = {"html": to_html, "markdown": to_markdown, "json": lambda n: json.dumps(n.as_dict(), indent=2, ensure_ascii=False)}


def rendered(docs: DataFrame, keys: list[str], raw: str = "raw", forms: tuple[str, ...] = ("html", "markdown")) -> DataFrame:
    """keys and the chosen forms of each document's tree. The tree is a stack machine over one document's tokens, which one shuffle packs."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    packed = tokens(docs, keys, raw).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "type", "name", "text", F.coalesce("page", F.lit(0)).alias("page")))).alias("a"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {f: [] for f in forms}
            for listed in frame["a"]:
                tree = TreeBuilder()
                for t in listed:
                    tree.feed(t["type"], t["name"], t["text"], t["page"])
                for f in forms:
                    out[f].append(FORMS[f](tree.root))
            yield frame[keys].assign(**out)

    return packed.mapInPandas(run, ", ".join(f"{k} {fields[k]}" for k in keys) + "".join(f", {f} string" for f in forms))


def marked_text(ops: DataFrame, keys: list[str]) -> DataFrame:
    """The marked-content id of each text operator: keys, idx (running), mcid of the innermost marked section that has one. One page's operators go through one fold."""
    fields = {f.name: f.dataType.simpleString() for f in ops.schema}
    packed = ops.where("fn in ('beginMarkedContent', 'beginMarkedContentProps', 'endMarkedContent', 'showText')").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("op_seq", "fn", F.coalesce("mcid", F.lit(-1)).alias("mcid")))).alias("a"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page in frame.itertuples(index=False):
                stack, idx = [], 0
                for op in page.a:
                    if op["fn"].startswith("begin"):
                        stack.append(op["mcid"])
                    elif op["fn"] == "endMarkedContent":
                        stack[-1:] = []
                    else:
                        inner = next((m for m in reversed(stack) if m >= 0), None)
                        if inner is not None:
                            out.append((*[getattr(page, k) for k in keys], idx, inner))
                        idx += 1
            yield pd.DataFrame(out, columns=[*keys, "idx", "mcid"])

    return packed.mapInPandas(run, ", ".join(f"{k} {fields[k]}" for k in keys) + ", idx long, mcid long")


def struct_cells(nodes: DataFrame, keys: list[str], depth: int = 12) -> DataFrame:
    """Cells of tables in structure trees (node_id, parent_id, ord, role, mcid): keys, table_id, r, c, mcids.

    The path from each cell up to its row and table, and from each leaf up to its cell, is walked by joins by page and node,
    ``depth`` levels at a time until every path has ended, however deep the trees are. A tree with a cycle is an error.
    """
    up = nodes.select(*keys, F.col("node_id").alias("_id"), F.col("parent_id").alias("_up"), F.col("role").alias("_role"), F.col("ord").alias("_ord"))

    def nearest(start: DataFrame, roles: tuple[str, ...], name: str) -> DataFrame:
        walk = start.withColumn("_at", F.col("parent_id")).withColumn(name, F.lit(None).cast("long")).withColumn(f"{name}_ord", F.lit(None).cast("long"))
        walked, highest = 0, None
        while True:
            for _ in range(depth):
                walk = walk.join(up.withColumnRenamed("_id", "_at"), [*keys, "_at"], "left")
                here = F.col(name).isNull() & F.col("_role").isin(*roles)
                walk = walk.withColumn(f"{name}_ord", F.when(here, F.col("_ord")).otherwise(F.col(f"{name}_ord"))).withColumn(name, F.when(here, F.col("_at")).otherwise(F.col(name))).withColumn("_at", F.when(F.col(name).isNull(), F.col("_up"))).drop("_up", "_role", "_ord")
            walk, walked = cut(walk), walked + depth
            if walk.where("_at is not null").isEmpty():
                return walk.drop("_at")
            highest = highest or nodes.groupBy(*keys).count().agg(F.max("count")).first()[0]
            if walked > highest:
                raise ValueError("a structure tree has a cycle")

    cells = nodes.where("role in ('TD', 'TH')").select(*keys, F.col("node_id").alias("cell_id"), "parent_id", "ord")
    cells = nearest(nearest(cells, ("TR", "THead", "TBody", "TFoot"), "row_id"), ("Table",), "table_id").drop("table_id_ord", "parent_id")
    leaves = nearest(nodes.where("mcid is not null").select(*keys, "node_id", "parent_id", "ord", "mcid"), ("TD", "TH"), "cell_id").where("cell_id is not null")
    content = leaves.groupBy(*keys, "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "mcid"))), lambda s: s["mcid"]).alias("mcids"))
    rows = Window.partitionBy(*keys, "table_id").orderBy("row_id_ord", "row_id")
    cols = Window.partitionBy(*keys, "row_id").orderBy("ord", "cell_id")
    out = cells.where("table_id is not null").withColumn("r", (F.dense_rank().over(rows) - 1).cast("long")).withColumn("c", (F.row_number().over(cols) - 1).cast("long"))
    return out.join(content, [*keys, "cell_id"], "left").select(*keys, "table_id", "r", "c", "mcids")
