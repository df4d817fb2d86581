"""Document pages with nested blocks, as a workspace API returns them in JSON.

Works over raw dumps: pages and blocks, one JSON object a line. Text is pre-order: a block's own, then its children's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.temporal import parse_time
from kairograph.functions.text import word_count
from kairograph.operators.settle import filed, settle

MIN_WORDS = 50
#: The block types whose own text counts.
BLOCK_TYPES = ("paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "to_do", "code", "quote")
RICH_TEXT = "array<struct<plain_text:string>>"
PAGE = f"id string, created_time string, last_edited_time string, url string, properties map<string,struct<type:string,title:{RICH_TEXT}>>"


def plain_text(rich_text: Column) -> Column:
    return F.array_join(F.transform(rich_text, lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")


def block_text(raw: Column) -> Column:
    """Own text of a block's JSON; '' for other types."""
    fields = F.from_json(raw, "map<string,string>")
    kind = F.element_at(fields, F.lit("type"))
    content = F.from_json(F.try_element_at(fields, kind), f"rich_text {RICH_TEXT}")
    return F.when(kind.isin(*BLOCK_TYPES), F.coalesce(plain_text(content["rich_text"]), F.lit(""))).otherwise("")


def page_title(properties: Column) -> Column:
    """Text of the first property whose type is title; '' if there is none."""
    titled = F.filter(F.map_values(properties), lambda p: p["type"] == "title")
    return F.coalesce(plain_text(F.try_element_at(titled, F.lit(1))["title"]), F.lit(""))


def page_texts(blocks: DataFrame, levels: int = 1000) -> DataFrame:
    """(page_id, text) of blocks (parent, pos, raw): top blocks have the page as parent.

    Blocks with children find their page and path of positions by doubling: each round joins a block with the one that it
    has got up to, so a depth of n takes log n rounds. A block whose way up never ends belongs to no page. Paths sort a
    parent before its children, so one ordered aggregate a page gives pre-order.
    """
    own = settle(blocks.select("parent", "pos", F.get_json_object("raw", "$.id").alias("id"), block_text(F.col("raw")).alias("text")))
    parents = own.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    inner = own.select("id", F.col("parent").alias("up"), F.array("pos").alias("path")).join(parents, "id", "left_semi")
    ids = inner.select(F.col("id").alias("up"), F.lit(False).alias("__top")).distinct()
    state = filed(inner.join(ids, "up", "left").select("id", "up", "path", F.coalesce("__top", F.lit(True)).alias("done")))
    while True:
        left = state.where("not done")
        found = filed(left.alias("c").join(state.alias("p"), F.expr("c.up = p.id")).select("c.id", "p.up", F.expr("p.path || c.path").alias("path"), "p.done"))
        if found.where("done").isEmpty():
            break  # what is left, if anything, goes round in circles
        state = filed(state.where("done").union(found))
    ways = state.where("done").select(F.col("id").alias("parent"), F.col("up").alias("page_id"), "path")
    if not ways.where(F.size("path") >= levels).isEmpty():
        raise RuntimeError(f"blocks nest over {levels} levels")
    below = own.join(ways, "parent").select("page_id", F.expr("path || array(pos)").alias("path"), "text")
    top = own.join(ids.select(F.col("up").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("page_id"), F.array("pos").alias("path"), "text")
    found = top.union(below)
    ordered = F.array_sort(F.collect_list(F.struct("path", "text")))
    lines = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")
    return found.groupBy("page_id").agg(F.array_join(lines, "\n").alias("text"))


def fresh(pages: DataFrame, cursor: str | None) -> DataFrame:
    """Pages edited after the cursor; a missing time counts as old. Without a cursor all."""
    return pages if cursor is None else pages.where(F.coalesce("last_edited_time", F.lit("")) > cursor)


def fetch(pages: DataFrame, blocks: DataFrame, cursor: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of pages with enough words: page_id, page_title, plain_text_content, last_edited_time, created_time, url."""
    rows = fresh(pages, cursor).select(F.col("id").alias("page_id"), page_title(F.col("properties")).alias("page_title"), "last_edited_time", "created_time", "url")
    texts = rows.join(page_texts(blocks), "page_id").where(word_count(F.col("text")) >= min_words)
    return texts.select("page_id", "page_title", F.col("text").alias("plain_text_content"), "last_edited_time", "created_time", "url")


def as_episodes(rows: DataFrame) -> DataFrame:
    """source_id, source_type, text, reference_time, metadata."""
    return rows.select(
        F.col("page_id").alias("source_id"), F.lit("notion_page").alias("source_type"), F.col("plain_text_content").alias("text"),
        F.coalesce(parse_time(F.col("last_edited_time")), F.current_timestamp()).alias("reference_time"),
        F.to_json(F.struct("page_title", "created_time", "last_edited_time", "url")).alias("metadata"),
    )
