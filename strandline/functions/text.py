"""Tokens and small renderings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a token by default (words, up to three digits, runs of other signs).
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def count_tokens(text: Column) -> Column:
    """The number of tokens of a text as INT; null and empty text have none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def norm(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space, trimmed: for looking up probes."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def row_md(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def header_md(cells: Column) -> Column:
    """A header row and its separator; empty without a header."""
    line = F.concat(row_md(cells), F.lit("\n|"), F.repeat(F.lit("---|"), F.greatest(F.lit(1), F.size(cells))))
    return F.when(F.size(cells) > 0, line).otherwise(F.lit(""))


def table_markdown(grid: Column) -> Column:
    """A grid as a table; the separator follows the first of several rows."""
    rows = F.transform(grid, row_md)
    split = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.greatest(F.lit(1), F.size(grid[0]))))
    several = F.concat(F.slice(rows, 1, 1), F.array(split), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    return F.array_join(F.when(F.size(grid) > 1, several).otherwise(rows), "\n")


def body_rows(grid: Column, header: Column) -> Column:
    """The rows of a grid without the first one if that is the header."""
    rest = F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0)))
    return F.when(F.size(grid) == 0, grid).when(F.get(grid, F.lit(0)) == header, rest).otherwise(grid)


def embed_text(heading_path: Column, summary: Column, leading: Column, content: Column, trailing: Column) -> Column:
    """What is embedded for a unit: its context's parts that aren't empty, and always its content, with blank lines between."""
    some = lambda c: F.when(c != "", c)
    path = F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > "))
    before, after = F.concat(F.lit("[before] "), some(leading)), F.concat(F.lit("[after] "), some(trailing))
    return F.concat_ws("\n\n", path, some(summary), before, F.coalesce(content, F.lit("")), after)


def display_number(value: Column, decimals: Column) -> Column:
    """1,234 for whole values, else (or where ``decimals`` holds) 1,234.00; ``?`` for null."""
    whole = ~decimals & (F.abs(value - F.round(value)) < 1e-9) & (F.abs(value) < 1e15)
    return F.when(value.isNull(), "?").when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
