"""Report Markdown to tables: sections, blocks, table cells, links, graph, inline tags.

A report is one row; its lines are walked inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.fold import growing_fold, let
from ..functions.paths import stays_inside
from ..functions.text import lines_of, strip
from .runs import report_name

SECTION_HEAD = r"\A###? "
IMAGE_LINE = r"\A!\[[^\]]*\]\([^)]+\)\z"
TABLE_RULE = r"(?U)\A\|?\s*:?-+"
BLOCK_START = r"\A(?:#{1,3} |[-*>] |!\[|\|)"
IMAGE_OR_LINK = r"!\[([^\]]*)\]\(([^)]+)\)|\[([^\]]+)\]\((https?://[^)]+)\)"


def _cut_before(lines: Column, opens) -> Column:
    """Split an array of lines into runs, each starting at a line for which ``opens``."""
    starts = F.filter(
        F.transform(lines, lambda x, i: F.when((i == 0) | opens(x), i)), lambda i: i.isNotNull()
    )
    return let(
        starts,
        lambda at: F.transform(
            at, lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - s)
        ),
    )


def sections_array(text: Column, most: int | None = None) -> Column:
    """(title, body) of the first non-empty sections; the lead has a default title."""
    runs = let(lines_of(text), lambda lines: _cut_before(lines, lambda x: x.rlike(SECTION_HEAD)))

    def section(run: Column) -> Column:
        head = F.get(run, F.lit(0))
        headed = head.rlike(SECTION_HEAD)
        body = F.when(headed, F.slice(run, F.lit(2), F.size(run))).otherwise(run)
        return F.struct(
            F.when(headed, strip(F.regexp_replace(head, r"\A[# ]+", "")))
            .otherwise(P.SECTION_DEFAULT).alias("title"),
            strip(F.array_join(body, "\n")).alias("body"),
        )

    every = F.filter(F.transform(runs, section), lambda s: s["body"] != "")
    return every if most is None else F.slice(every, 1, most)


def _rows(df: DataFrame, array: Column, n: str = "n") -> DataFrame:
    return (
        df.select("doc_id", F.posexplode_outer(array).alias(n, "_x"))
        .filter(F.col("_x").isNotNull())
        .select("doc_id", (F.col(n) + 1).alias(n), "_x.*")
    )


def report_sections(reports: DataFrame, *, most_sections: int | None = None) -> DataFrame:
    return _rows(reports, sections_array(F.col("text"), most_sections))


def _kind(line: Column) -> Column:
    return (
        F.when(line == "", "blank")
        .when(line.rlike(IMAGE_LINE), "image")
        .when(line.startswith("|"), "table")
        .when(line.startswith("### "), "h3")
        .when(line.startswith("## "), "h2")
        .when(line.startswith("# "), "h1")
        .when(line.startswith("> "), "quote")
        .when(line.rlike(r"\A[-*] "), "bullet")
        .otherwise("paragraph")
    )


def blocks_array(text: Column) -> Column:
    """Typed blocks (kind, content, lines) of a report, blank lines left out.

    Adjacent plain lines make one paragraph. Pipe lines make one table when the second
    of them is a rule; without a rule they are plain text.
    """
    lines = F.transform(lines_of(text), strip)
    kinds = let(
        lines,
        lambda every: F.transform(every, lambda x: F.struct(x.alias("line"), _kind(x).alias("kind"))),
    )

    def typed(every: Column) -> Column:
        return F.transform(
            every,
            lambda x, i: F.struct(
                x["line"].alias("line"), x["kind"].alias("kind"),
                # A table opens at a pipe line whose next line is a rule.
                ((x["kind"] == "table") & F.coalesce(F.get(every, i + 1)["line"], F.lit("")).rlike(TABLE_RULE)).alias("opens"),
            ),
        )

    def groups(every: Column) -> Column:
        state = {"i": F.lit(0), "table": F.lit(False), "plain": F.lit(False)}

        def step(acc: Column, x: Column) -> dict[str, Column]:
            pipe = x["kind"] == "table"
            more_table = pipe & acc["table"]
            more_plain = (x["kind"] == "paragraph") & ~x["line"].rlike(BLOCK_START) & acc["plain"]
            table = more_table | x["opens"]
            return {
                "i": acc["i"] + 1, "table": table, "plain": (x["kind"] == "paragraph") | (pipe & ~table),
                "starts": F.when(more_table | more_plain, acc["starts"])
                .otherwise(F.array_append(acc["starts"], acc["i"] + 1)),
            }

        return let(
            growing_fold(every, state, "starts", "int", step),
            lambda at: F.transform(
                at, lambda s, k: F.slice(every, s, F.coalesce(F.get(at, k + 1), F.size(every) + 1) - s)
            ),
        )

    def block(run: Column) -> Column:
        head = F.get(run, F.lit(0))
        texts = F.transform(run, lambda x: x["line"])
        content = (
            F.when(head["kind"].isin("h1", "h2", "h3"), F.regexp_replace(head["line"], r"\A#{1,3} ", ""))
            .when(head["kind"].isin("quote", "bullet"), F.substring(head["line"], 3, 1 << 30))
            .when(head["opens"], F.array_join(texts, "\n"))
            .otherwise(F.array_join(texts, " "))
        )
        kind = F.when((head["kind"] == "table") & ~head["opens"], "paragraph").otherwise(head["kind"])
        return F.struct(kind.alias("kind"), content.alias("content"), F.size(run).alias("lines"))

    runs = let(let(kinds, typed), groups)
    return F.filter(F.transform(runs, block), lambda b: b["kind"] != "blank")


def report_blocks(reports: DataFrame) -> DataFrame:
    return _rows(reports, blocks_array(F.col("text")))


def report_tables(reports: DataFrame) -> DataFrame:
    """Cells of pipe tables: (doc_id, table_no, row_no, col_no, cell), rule rows left out."""
    tables = F.filter(blocks_array(F.col("text")), lambda b: b["kind"] == "table")
    cells = lambda row: F.transform(F.split(F.trim(row, F.lit("|")), r"\|"), strip)
    rows = reports.select("doc_id", F.posexplode(F.transform(tables, lambda b: F.split(b["content"], "\n"))).alias("t", "rows"))
    kept = F.filter(
        F.transform("rows", cells), lambda r: ~F.forall(r, lambda c: c.rlike(r"\A:?-+:?\z"))
    )
    split = rows.select("doc_id", (F.col("t") + 1).alias("table_no"), F.posexplode(kept).alias("r", "row"))
    return split.select(
        "doc_id", "table_no", (F.col("r") + 1).alias("row_no"), F.posexplode("row").alias("c", "cell")
    ).select("doc_id", "table_no", "row_no", (F.col("c") + 1).alias("col_no"), "cell")


def report_links(reports: DataFrame, *, most_images: int | None = None) -> DataFrame:
    """(doc_id, n, kind, label, target): web links, and local images that may be copied."""
    marks = F.regexp_extract_all("text", F.lit(IMAGE_OR_LINK), F.lit(0))

    def parse(mark: Column) -> Column:
        image = mark.startswith("!")
        return F.struct(
            F.when(image, "image").otherwise("link").alias("kind"),
            F.regexp_extract(mark, r"\A!?\[([^\]]*)\]", 1).alias("label"),
            F.regexp_extract(mark, r"\A!?\[[^\]]*\]\((.+)\)\z", 1).alias("target"),
        )

    parsed = F.transform(marks, parse)
    links = F.filter(parsed, lambda m: m["kind"] == "link")
    images = F.filter(parsed, lambda m: (m["kind"] == "image") & stays_inside(m["target"]))
    if most_images is not None:
        images = F.slice(images, 1, most_images)
    return _rows(reports, links).unionByName(_rows(reports, images))


def inline_render(text: Column) -> Column:
    """Escaped text with links, code and bold as tags."""
    escaped = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    linked = F.regexp_replace(
        escaped, r"\[([^\]]+)\]\((https?://[^)]+)\)", '<link href="$2" color="#0066cc">$1</link>'
    )
    coded = F.regexp_replace(linked, r"`([^`]+)`", '<font face="Courier">$1</font>')
    return F.regexp_replace(coded, r"\*\*([^*]+)\*\*", "<b>$1</b>")


def section_graph(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canvas of a report: (nodes, edges); sections in one column, images beside them."""
    node_id = lambda name: F.substring(F.sha2(name, 256), 1, 16)
    cards = report_sections(reports).withColumn(
        "name", F.concat(F.format_string("%02d_", F.col("n")), report_name(F.col("title")), F.lit(".md"))
    )
    section_nodes = cards.select(
        "doc_id", node_id(F.col("name")).alias("node_id"), F.concat(F.lit("cards/"), F.col("name")).alias("file"),
        F.lit(0).alias("x"), ((F.col("n") - 1) * 300).alias("y"), F.lit(520).alias("width"), F.lit(240).alias("height"),
    )
    stem = F.regexp_extract("target", r"([^/\\]+?)(\.[^./\\]*)?\z", 1)
    ending = F.lower(F.regexp_extract("target", r"([^/\\]+?)(\.[^./\\]*)?\z", 2))
    images = report_links(reports).filter("kind = 'image'").withColumn(
        "name", F.concat(F.format_string("%02d_", F.col("n")), report_name(stem), ending)
    )
    image_nodes = images.select(
        "doc_id", node_id(F.col("name")).alias("node_id"), F.concat(F.lit("assets/"), F.col("name")).alias("file"),
        F.lit(620).alias("x"), ((F.col("n") - 1) * 340).alias("y"), F.lit(520).alias("width"), F.lit(300).alias("height"),
    )
    titles = sections_array(F.col("text"))
    names = F.transform(
        titles,
        lambda s, i: node_id(F.concat(F.format_string("%02d_", i + 1), report_name(s["title"]), F.lit(".md"))),
    )
    linked = let(
        names,
        lambda ids: F.transform(
            F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))),
            lambda to, i: F.struct(
                F.format_string("e%03d", i + 2).alias("edge_id"), F.get(ids, i).alias("from_node"), to.alias("to_node")
            ),
        ),
    )
    edges = _rows(reports, linked).drop("n")
    return section_nodes.unionByName(image_nodes), edges
