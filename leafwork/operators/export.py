"""Emitters: tables and blocks as Markdown, XML, HTML; documents out of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import escape


def _rows(cells: DataFrame, keys: list[str], cell: Column, joint: str) -> DataFrame:
    """keys, r, text: the cells of each row, by column, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("c", cell.alias("t"))))
    return cells.groupBy(*keys, "r").agg(F.array_join(F.transform(ordered, lambda i: i["t"]), joint).alias("text"), F.count("*").alias("n"))


def _stacked(rows: DataFrame, keys: list[str], text: Column, joint: str, head: str = "", foot: str = "", name: str = "doc") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("r", text.alias("t"))))
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda i: i["t"]), joint), F.lit(foot)).alias(name))


def gfm_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown of cells (r, c, text): the first row is the head; bars are escaped, line breaks become blanks."""
    safe = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), F.lit("|"), F.lit("\\|"))
    rows = _rows(cells, keys, safe, " | ")
    line = F.concat(F.lit("| "), F.col("text"), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    return _stacked(rows, keys, F.when(F.col("r") == 0, F.concat(line, rule)).otherwise(line), "\n", name="markdown")


def xml_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, xml of cells (r, c, text): header elements in the first row, cell elements in others."""
    tag = F.when(F.col("r") == 0, "header").otherwise("cell")
    safe = escape(F.coalesce("text", F.lit("")), quotes=True, apostrophes=True)
    rows = _rows(cells, keys, F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")), "")
    return _stacked(rows, keys, F.concat(F.lit("  <row>"), F.col("text"), F.lit("</row>")), "\n", "<table>\n", "\n</table>", name="xml")


def html_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html of cells (r, c, rowspan, colspan, text): th in the first row, a blank entity in empty cells."""
    tag = F.when(F.col("r") == 0, "th").otherwise("td")
    span = lambda c: F.when(F.col(c) > 1, F.concat(F.lit(f' {c}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    body = F.when(F.coalesce("text", F.lit("")) == "", "&nbsp;").otherwise(escape(F.col("text")))
    rows = _rows(cells, keys, F.concat(F.lit("<"), tag, span("colspan"), span("rowspan"), F.lit(">"), body, F.lit("</"), tag, F.lit(">")), "")
    return _stacked(rows, keys, F.concat(F.lit("<tr>"), F.col("text"), F.lit("</tr>")), "\n", "<table>\n<tbody>\n", "\n</tbody>\n</table>", name="html")


def block_markdown(kind: Column, text: Column, level: Column | int = 2) -> Column:
    """One block: heading, divider, list entry, callout, image or paragraph."""
    marks = F.repeat(F.lit("#"), level if isinstance(level, Column) else F.lit(level))
    return (
        F.when(kind == "HEADING", F.concat(marks, F.lit(" "), text))
        .when(kind == "DIVIDER", "---")
        .when(kind == "LIST", F.concat(F.lit("- "), F.regexp_replace(text, r"^(?:[•‣◦▪▫–—―·○◉-]|\d{1,3}[.)]|[a-zA-Z][.)]|[ivxIVX]+[.)])\s+", "")))
        .when(kind == "BOX", F.concat(F.lit("> "), text))
        .when(kind == "IMAGE", F.concat(F.lit("![image]("), text, F.lit(")")))
        .when(kind.isin("HEADER", "FOOTER"), "")
        .otherwise(text)
    )


def block_xml(kind: Column, text: Column) -> Column:
    safe = escape(text, quotes=True, apostrophes=True)
    tag = F.when(kind == "HEADING", "heading").when(kind == "BOX", "callout").when(kind == "LIST", "item").when(kind == "IMAGE", "image").otherwise("paragraph")
    return F.when(kind == "DIVIDER", "<divider/>").otherwise(F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")))


def ordered_text(blocks: DataFrame, keys: list[str], order: list[str], text: Column, joint: str, name: str) -> DataFrame:
    """keys and the non-empty texts of their rows, by order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.filter(F.transform(ordered, lambda i: i["_t"]), lambda t: t != ""), joint).alias(name))


def document(pages: DataFrame, keys: list[str], styles: Column | str = "") -> DataFrame:
    """keys, html, text of documents out of page_num, html, text: a style block first, a page break between texts; a set message if no page has content."""
    css = styles if isinstance(styles, Column) else F.lit(styles)
    listed = F.array_sort(F.collect_list(F.struct("page_num", "html", "text")))
    out = pages.groupBy(*keys).agg(listed.alias("_p"))
    html = F.array_join(F.filter(F.transform("_p", lambda p: p["html"]), lambda t: t != ""), "\n")
    text = F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n--- page break ---\n\n")
    whole = F.when(html == "", "<p>No content could be extracted.</p>").otherwise(F.concat(F.lit("<style>"), css, F.lit("</style>\n"), html))
    return out.select(*keys, whole.alias("html"), text.alias("text"))


def with_images(pages: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Image placeholders with their data URLs: images has image_id and png, regions has image_id."""
    url = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("png"), "\\s", ""))
    return pages.join(images.select("image_id", url.alias("data_url")), "image_id", "left")


def wrapped(kind: str, title: Column, body: Column) -> Column:
    """A whole file around a body: html, or doc (HTML for word processors)."""
    space = ' xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:w="urn:schemas-microsoft-com:office:word"' if kind == "doc" else ""
    return F.concat(F.lit(f'<!DOCTYPE html>\n<html{space}>\n<head><meta charset="UTF-8"><title>'), escape(title, quotes=True), F.lit("</title></head>\n<body>\n"), body, F.lit("\n</body>\n</html>"))


def markdown_html(source: Column) -> Column:
    """Markdown as HTML by line-wise rewriting: headings, rules, quotes, list entries, bold, italic, code, then paragraphs."""
    out = source
    for n in (6, 5, 4, 3, 2, 1):
        out = F.regexp_replace(out, rf"(?m)^{'#' * n} (.+)$", f"<h{n}>$1</h{n}>")
    for pattern, becomes in ((r"(?m)^---+$", "<hr>"), (r"(?m)^> (.+)$", "<blockquote>$1</blockquote>"), (r"(?m)^[-*] (.+)$", "<li>$1</li>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"), (r"`(.+?)`", "<code>$1</code>")):
        out = F.regexp_replace(out, pattern, becomes)
    return F.regexp_replace(out, r"(?m)^(?!<)(.+)$", "<p>$1</p>")
