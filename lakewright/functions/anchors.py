"""Quoted blocks in messages, and Markdown tables of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewright.functions.sheets import once

QUOTED = r"(?s)<quoted_{0}[^>]*>.*?</quoted_{0}>\n*"
#: Entities of attributes, in the order in which they are decoded.
ENTITIES = (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))
NUMERIC = r"^[-+]?\d+(?:[.,]\d+)?%?$"
SPACE = r"[\s\x{A0}\x{FEFF}]"


def _attribute(block: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf'{name}="([^"]*)"', 1), F.lit(""))


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def quoted_anchors(content: Column) -> Column:
    """kind, path, name, page, unit, label and role of each quoted file with a path, then of each quoted message."""
    text = F.lit(None).cast("string")

    def of_file(block: Column) -> Column:
        path = _decoded(_attribute(block, "path"))
        parts = F.filter(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
        name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.trim(path))
        page = F.nullif(F.regexp_extract(block, r'page="\s*(\d+)\s*"', 1), F.lit("")).cast("int")
        return F.struct(F.lit("file").alias("kind"), path.alias("path"), name.alias("name"), page.alias("page"), _decoded(_attribute(block, "semantic_unit_id")).alias("unit"), _decoded(_attribute(block, "source_label")).alias("label"), text.alias("role"))

    def of_message(block: Column) -> Column:
        role = F.when(_attribute(block, "role") == "user", "user").otherwise("assistant")
        return F.struct(F.lit("message").alias("kind"), F.lit("").alias("path"), text.alias("name"), F.lit(None).cast("int").alias("page"), text.alias("unit"), text.alias("label"), role.alias("role"))

    found = lambda what: F.regexp_extract_all(content, F.lit(QUOTED.format(what)), F.lit(0))
    files = F.filter(found("file"), lambda b: _attribute(b, "path").isNotNull())
    return F.concat(F.transform(files, of_file), F.transform(found("message"), of_message))


def without_anchors(content: Column) -> Column:
    for what in ("file", "message"):
        content = F.regexp_replace(content, QUOTED.format(what), "")
    return F.regexp_replace(content, f"^{SPACE}+|{SPACE}+$", "")


def column_name(i: Column) -> Column:
    """A, B, ... of a column counted from 0, for the first 702."""
    letter = lambda x: F.char(F.lit(65) + x)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26).cast("int") - 1), letter(i % 26)))


def markdown_table(rows: Column, prefix: str = "Column") -> Column:
    """rows: an array of arrays of texts. Blanks are collapsed and bars escaped, empty rows go, short rows are filled up; a first row without a word gets a header of column names. Empty without cells."""
    cell = lambda x: F.replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE + "+", " ")), F.lit("|"), F.lit("\\|"))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda x: x != ""))

    def table(rs: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        named = F.exists(rs[0], lambda x: (x != "") & ~x.rlike(NUMERIC))
        own = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit(prefix + " "), column_name(i)))
        head = F.when(named, line(rs[0])).otherwise(line(own))
        body = F.when(named, F.slice(rs, 2, F.size(rs))).otherwise(rs)
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(head, rule), F.transform(body, line)), "\n")

    # without the widest row's size found first, each row would look for it
    sized = lambda rs: once(F.array_max(F.transform(rs, lambda r: F.size(r))), lambda width: table(rs, width))
    return once(clean, lambda rs: F.when(F.size(rs) > 0, sized(rs)).otherwise(""))
