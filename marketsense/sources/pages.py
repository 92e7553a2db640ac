"""Ticker universe, page headlines and news lists from landed tables."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from marketsense.functions import text as tx
from marketsense.functions.sentiment import LookupTable
from marketsense.functions.text import strip


def ticker_universe(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct symbols with dots written as dashes."""
    return symbols.select(F.replace(F.col(column), F.lit("."), F.lit("-")).alias("symbol")).distinct()


def symbols_of_tables(pages: DataFrame, column: str = "html", cell: str = r"<td[^>]*>([^<]*)</td>") -> DataFrame:
    """Symbols in the first cell of every row of each page's first table."""
    table = F.regexp_extract(column, r"(?s)<table.*?</table>", 0)
    rows = F.regexp_extract_all(table, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))
    symbol = F.transform(rows, lambda row: strip(F.regexp_extract(row, cell, 1)))
    return ticker_universe(pages.select(F.explode(F.filter(symbol, lambda s: s != "")).alias("symbol")))


# Tokens of a page: what holds no text (comments, scripts, styles, declarations), tags, text; a lone "<" is text.
TOKEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?][^>]*>|</?[a-z][^>]*>|[^<]+|<"
TAG = r"^</?([a-zA-Z][^\s/>]*)[^>]*>$"
RAW = r"(?is)^<(script|style)\b"

# Elements that never have content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]


def element(tag: str | None = None, css_class: str | None = None) -> str:
    """Pattern of the opening tag of an element selected by tag and/or any of its classes.

    Tags match in any case, class lists in either kind of quotes or none.
    """
    name = re.escape(tag) if tag else r"[a-zA-Z][a-zA-Z0-9]*"
    attribute = r"(?:[\s/][^>]*)?"
    if css_class:
        one = re.escape(css_class)
        lists = [rf"{quote}(?:[^{quote}]*\s)?(?-i:{one})(?:\s[^{quote}]*)?{quote}" for quote in "\"'"]
        attribute = rf"\s(?:[^>]*?\s)?class\s*=\s*(?:{lists[0]}|{lists[1]}|(?-i:{one})(?=[\s>]))[^>]*"
    return rf"(?is)^<{name}{attribute}>$"


SPANS = "array<struct<at:int,stop:int>>"
OPEN = "array<struct<name:string,at:int>>"


def _spans(tokens: Column, wanted: Column) -> Column:
    """array<struct<at, stop>>: where the content of each wanted element ends; ``wanted`` are the places of opening tags.

    One fold over the tags with the stack of open elements as its state.  A closing tag
    closes the last element of its name and all that were opened since; without such an
    element it says nothing.  What is never closed ends with the page.
    """
    name = lambda token: F.lower(F.regexp_extract(token, TAG, 1))
    kind = lambda token: F.when(token.startswith("</"), -1).when(token.endswith("/>") | name(token).isin(VOID), 0).otherwise(1)
    marked = F.transform(tokens, lambda token, place: F.struct(name(token).alias("name"), place.alias("place"), kind(token).alias("kind")))
    raw = _places(tokens, RAW)
    tags = F.filter(marked, lambda tag: (tag["name"] != "") & ~F.array_contains(raw, tag["place"]))

    def step(state: Column, tag: Column) -> Column:
        place, stack = tag["place"], state["stack"]
        chosen = F.array_contains(wanted, place)
        opened = F.concat(stack, F.array(F.struct(tag["name"].alias("name"), F.when(chosen, place).otherwise(-1).alias("at"))))
        empty = F.concat(state["done"], F.array(F.struct(place.alias("at"), (place + 1).alias("stop"))))

        def closed(above: Column) -> Column:
            """``above``: how many elements the closing tag ends; 0: none."""
            kept = F.size(stack) - above
            ended = F.filter(F.slice(stack, kept + 1, F.greatest(above, F.lit(1))), lambda one: one["at"] >= 0)
            spans = F.transform(ended, lambda one: F.struct(one["at"].alias("at"), place.alias("stop")))
            return F.struct(F.slice(stack, F.lit(1), kept).alias("stack"), F.concat(state["done"], spans).alias("done"))

        above = F.array_position(F.reverse(F.transform(stack, lambda one: one["name"])), tag["name"]).cast("int")
        return (
            F.when(tag["kind"] == 1, F.struct(opened.alias("stack"), state["done"].alias("done")))
            .when((tag["kind"] == -1) & (above > 0), closed(above))
            .when((tag["kind"] == 0) & chosen, F.struct(stack.alias("stack"), empty.alias("done")))
            .otherwise(state)
        )

    start = F.struct(F.array().cast(OPEN).alias("stack"), F.array().cast(SPANS).alias("done"))

    def finish(state: Column) -> Column:
        left = F.filter(state["stack"], lambda one: one["at"] >= 0)
        return F.concat(state["done"], F.transform(left, lambda one: F.struct(one["at"].alias("at"), F.size(tokens).alias("stop"))))

    return F.aggregate(tags, start, step, finish)


def _places(tokens: Column, opening: str) -> Column:
    """Places of the tokens that are the opening tag."""
    return F.array_compact(F.transform(tokens, lambda token, place: F.when(token.rlike(opening), place)))


# Named character references, by Python's table of the published list; those that need no semicolon are read with one, too.
_NAMED = {name.removesuffix(";"): signs for name, signs in html5.items() if name.endswith(";")}
_REFERENCE = r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});"
# Code points that stand for those of the Windows code page.
_WINDOWS = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"


def decode_references(text: Column) -> Column:
    """Character references (``&eacute;``, ``&#8217;``, ``&#x27;``) as the signs they stand for; unknown names stay."""
    table = LookupTable({name: float(place) for place, name in enumerate(_NAMED)})
    signs, bound = F.from_json(F.lit(json.dumps(list(_NAMED.values()))), "array<string>"), table.bind()

    def sign(code: Column) -> Column:
        whole = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        odd = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.when(odd, "\ufffd").when(code.between(0x80, 0x9F), F.substring(F.lit(_WINDOWS), (code - 0x7F).cast("int"), F.lit(1))).otherwise(whole)

    def decoded(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9))
        known = F.get(signs, table.get(bound, name).cast("int"))
        return F.when(digits.isNotNull(), tx.let(digits.cast("bigint"), sign)).otherwise(F.coalesce(known, F.concat(F.lit("&"), name, F.lit(";"))))

    def joined(names: Column) -> Column:
        between = F.split(text, _REFERENCE)
        return F.array_join(F.zip_with(between, names, lambda part, name: F.concat(part, F.when(name.isNull(), "").otherwise(decoded(name)))), "")

    return F.when(text.contains("&"), tx.let(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), joined)).otherwise(text)


def plain_text(tokens: Column) -> Column:
    """The text among the tokens, character references decoded, stripped."""
    # Tags and what holds no text begin with "<" and more.
    return strip(decode_references(F.array_join(F.filter(tokens, lambda token: ~token.startswith("<") | (token == "<")), "")))


def page_headlines(pages: DataFrame, source: Column, outer: str, inner: str, limit: int = 5) -> DataFrame:
    """First ``limit`` outer elements of each page (nested ones count, too), as text.

    The text is that of the first inner element if there is one, else that of
    the outer element itself; both reach to where the element is closed, by its own
    closing tag or by that of an element around it.
    """
    rows = pages.select("page_id", source.alias("source"), F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    rows = rows.select("*", F.slice(_places(F.col("tokens"), outer), 1, limit).alias("outer"), _places(F.col("tokens"), inner).alias("inner"))
    rows = rows.where(F.size("outer") > 0)
    rows = rows.withColumn("spans", _spans(F.col("tokens"), F.array_union("outer", "inner")))
    stop_of = lambda place: F.get(F.filter("spans", lambda span: span["at"] == place), F.lit(0))["stop"]
    rows = rows.select("page_id", "source", "tokens", "inner", "spans", F.posexplode("outer").alias("place", "at"))
    first = F.array_min(F.filter("inner", lambda place: (place > F.col("at")) & (place < stop_of(F.col("at")))))
    rows = rows.withColumn("at", F.coalesce(first, "at"))
    content = F.slice("tokens", F.col("at") + 2, stop_of(F.col("at")) - F.col("at") - 1)
    return rows.select("page_id", "source", "place", plain_text(content).alias("headline"))


def news_frame(news: DataFrame) -> DataFrame:
    """Titles with their publish time (epoch seconds) as a timestamp."""
    return news.select("title", F.timestamp_seconds("publish_time").alias("date"))
