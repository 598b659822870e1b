"""Markdown and HTML of document frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(order: Sequence[str], value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("__v")))), lambda x: x["__v"])


def rows_of(cells: DataFrame, keys: Sequence[str], row: str, column: str, text: Column) -> DataFrame:
    """Cells gathered into one array of texts for each table row."""
    return cells.groupBy(*keys, row).agg(_ordered([column], text).alias("texts"))


def _line(texts: Column) -> Column:
    return F.when(F.size(texts) == 0, "| |").otherwise(F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |")))


def pipe_table(rows: DataFrame, keys: Sequence[str], row: str, padded: bool = False) -> DataFrame:
    """A pipe table; the first row is the header. Padded tables cut or fill each row to the header's width."""
    tables = rows.groupBy(*keys).agg(_ordered([row], F.col("texts")).alias("__rows"))
    width = F.size(F.col("__rows")[0])
    if padded:
        fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
        tables = tables.withColumn("__rows", F.transform("__rows", fit))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.col("__rows")[0])), " | "), F.lit(" |"))
    lines = F.transform("__rows", _line)
    body = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return tables.select(*keys, F.array_join(body, "\n").alias("markdown"))


def html_table(cells: DataFrame, keys: Sequence[str], row: str, column: str, text: Column, col_span: Column, row_span: Column) -> DataFrame:
    """An HTML table; spans above one are attributes."""
    span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    td = F.concat(F.lit("<td"), span("colspan", col_span), span("rowspan", row_span), F.lit(">"), text, F.lit("</td>"))
    rows = cells.groupBy(*keys, row).agg(F.array_join(_ordered([column], td), "").alias("__tds"))
    tr = F.concat(F.lit("<tr>"), F.col("__tds"), F.lit("</tr>"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(_ordered([row], tr), ""), F.lit("</table>")).alias("html"))


def document(blocks: DataFrame, doc: str, section: str, order: str, block: str, marker: str = "<!-- foliograph:section -->") -> DataFrame:
    """Blocks joined by blank lines, sections by a marker comment; empty blocks are left out."""
    own = blocks.filter(F.col(block) != "")
    parts = own.groupBy(doc, section).agg(F.array_join(_ordered([order], F.col(block)), "\n\n").alias("__s"))
    return parts.groupBy(doc).agg(F.array_join(_ordered([section], F.col("__s")), f"\n\n{marker}\n\n").alias("markdown"))


def grid_places(cells: DataFrame, table: str) -> DataFrame:
    """Grid column of each cell when cells before it span columns or rows.

    The place of a cell depends on all before it, so tables are brought
    together and sorted, and each partition is walked once.
    """
    import pandas as pd

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[tuple[int, int]] = set()
        now = object()
        for pdf in batches:
            columns = []
            for t, row, cols, rows in zip(pdf[table], pdf["row"], pdf["col_span"], pdf["row_span"], strict=True):
                if t != now:  # rows of a table stand together, also across batches
                    now, taken = t, set()
                c = 0
                while (row, c) in taken:
                    c += 1
                taken.update((row + i, c + j) for i in range(rows) for j in range(cols))
                columns.append(c)
            yield pdf.assign(grid_column=columns)

    kind = cells.schema[table].dataType.simpleString()
    own = cells.select(table, "row", "ordinal", "col_span", "row_span")
    together = own.repartition(table).sortWithinPartitions(table, "row", "ordinal")
    return together.mapInPandas(place, f"{table} {kind}, row int, ordinal int, col_span int, row_span int, grid_column int")


def pad_rows(rows: DataFrame, keys: Sequence[str], width: int, most: int = 10_000) -> DataFrame:
    """Every row filled with empty cells to its table's widest row, and the width each column gets."""
    from pyspark.sql import Window

    widest = F.least(F.max(F.size("texts")).over(Window.partitionBy(*keys)), F.lit(most))
    out = rows.withColumn("columns", widest)
    out = out.withColumn("texts", F.concat(F.col("texts"), F.array_repeat(F.lit(""), F.greatest(F.col("columns") - F.size("texts"), F.lit(0)))))
    return out.withColumn("column_width", F.when(F.col("columns") > 0, F.floor(F.lit(width) / F.col("columns"))).cast("int"))
