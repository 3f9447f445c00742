"""Values read from tables in texts, line by line as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import amount, stripped


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n (from 0), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def _runs(rows: DataFrame, key: str, header: str, row: str) -> DataFrame:
    """rows with is_header, header_n (of the last header line) and in_run: whether a line is in the unbroken rows below it."""
    order = W.partitionBy(key).orderBy("n")
    two = F.concat_ws("\n", "line", F.lead("line").over(order))
    depth = header.count("\\n")
    marked = rows.withColumn("is_header", (two if depth else F.col("line")).rlike(header))
    marked = marked.withColumn("header_n", F.last(F.when(F.col("is_header"), F.col("n")), ignorenulls=True).over(order))
    below = F.coalesce(F.col("n") > F.col("header_n") + depth, F.lit(False))
    breaks = F.sum((below & ~F.col("line").rlike(row)).cast("int")).over(W.partitionBy(key, "header_n").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("in_run", below & (breaks == 0))


def row_runs(rows: DataFrame, key: str, header: str, row: str) -> DataFrame:
    """Lines in the table below each header line, up to the first line that is no row: key, header_n, n, line.

    header and row are regular expressions over the line; a header of two lines is joined by a line break.
    """
    return _runs(rows, key, header, row).where("in_run").select(key, "header_n", "n", "line")


def lot_tables(docs: DataFrame, key: str, header: str, text: str = "text") -> DataFrame:
    """For each document with a lot table: key, lots, lot_sum and reason; the sum is null where the table is ambiguous.

    Rows are number, price and name parted by tabs.  reason is the first that holds: several_tables, no_rows,
    repeated_number, bad_price, not_contiguous.  One pass over the lines.
    """
    cells = F.split("line", "\t")
    number, price = F.get(cells, F.lit(0)).try_cast("long"), amount(stripped(F.get(cells, F.lit(1))))
    in_run = F.col("in_run")
    rows = _runs(lines(docs, key, text), key, header, r"^\d+\t[^\t]*\t").where("in_run OR is_header")
    rows = rows.select(key, "is_header", "in_run", F.when(in_run, number).alias("number"), F.when(in_run, price).alias("price"))
    both = rows.groupBy(key).agg(
        F.count_if("is_header").alias("tables"), F.count_if("in_run").alias("lots"), F.count_distinct("number").alias("d"), F.max("number").alias("top"), F.min("number").alias("low"),
        F.count("price").alias("priced"), F.sum("price").alias("total"),
    )
    reason = (
        F.when(F.col("tables") > 1, "several_tables")
        .when(F.col("lots") == 0, "no_rows")
        .when(F.col("d") < F.col("lots"), "repeated_number")
        .when(F.col("priced") < F.col("lots"), "bad_price")
        .when((F.col("low") != 1) | (F.col("top") != F.col("lots")), "not_contiguous")
    )
    return both.select(key, "lots", F.when(reason.isNull(), F.col("total")).alias("lot_sum"), reason.alias("reason"))


def column_totals(docs: DataFrame, key: str, markers: list[str], column: str, text: str = "text") -> DataFrame:
    """The sum of a column in sheets of tab-parted lines: key, total, rows.

    A line with all markers is a header and sets the column anew; rows start with a number.  A value that is no number makes the total null.
    """
    every = lines(docs, key, text)
    head = F.lit(True)
    for m in markers:
        head = head & F.contains("line", F.lit(m))
    cells = F.split("line", "\t")
    place = F.array_position(F.transform(cells, stripped), column)
    order = W.partitionBy(key).orderBy("n")
    marked = every.withColumn("_head", head).withColumn("_at", F.last(F.when(F.col("_head"), place), ignorenulls=True).over(order))
    rows = marked.where(~F.col("_head") & (F.col("_at") > 0) & (F.size(cells) >= F.col("_at")) & stripped(F.get(cells, F.lit(0))).rlike(r"^\d+$"))
    values = rows.select(key, amount(stripped(F.get(cells, (F.col("_at") - 1).cast("int")))).alias("value"))
    return values.groupBy(key).agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("total"), F.count(F.lit(1)).alias("rows"))


def agreed(tables: DataFrame, group: str, value: str) -> DataFrame:
    """One value a group if all its rows agree: group, value, agree."""
    found = tables.groupBy(group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all"))
    agree = (F.col("_n") == F.col("_all")) & (F.col("_low") == F.col("_high"))
    return found.select(group, F.when(agree, F.col("_low")).alias(value), F.coalesce(agree, F.lit(False)).alias("agree"))
