"""A bank of questions out of tables of cells, as spreadsheets give them.

cells: (sheet, row, col, value), rows and columns from 1; what is in row 1 of a sheet names its columns. A row of a
sheet is gathered, as it has no more cells than the sheet has columns; rows are numbered over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.inventory import next_codes

# Categories, answer types, ids of questions, and the names of columns in the order they are looked for.
CATEGORIES = ["WHO", "WHAT", "WHEN", "WHERE", "WHY", "FRAMEWORK"]
ANSWERS = ["text", "choice", "number", "path", "bool"]
QUESTION_ID = r"(?i)\bQ(?:uestion)?\s*0*([1-9]|1\d|20)\b"
PLAIN_ID = r"^0*([1-9]|1\d|20)$"
ID, TEXT, CATEGORY, ANSWER, CHOICES = ["id", "question_id", "qid", "q"], ["question", "text", "prompt"], ["category", "bucket", "type"], ["answer_type", "answer", "response_type"], ["choices", "options", "choice"]
NOT_NOTES = ["category", "answer_type", "choices"]


def _key(c: Column) -> Column:
    return F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit("_"))


def table_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, cells): the rows with a value, each an array (col, value, header, key) in order of columns; values are trimmed."""
    value = F.trim(F.replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    clean = cells.select("sheet", "row", "col", value.alias("value")).where("value <> ''")
    heads = clean.where("row = 1").select("sheet", "col", F.col("value").alias("header"))
    rows = clean.join(heads, ["sheet", "col"], "left")
    return rows.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value", "header", _key(F.col("header")).alias("key")))).alias("cells"))


def _field(names: list[str]) -> Column:
    """The value under the first of the names that the row has a column of; of columns of one name the last counts."""

    def of(name: str) -> Column:
        there = F.filter("cells", lambda x: x["key"] == name)
        return F.when(F.size(there) > 0, F.get(there, F.size(there) - 1)["value"])

    return F.coalesce(*map(of, names), F.lit(""))


def sorted_out(cells: DataFrame) -> DataFrame:
    """(sheet, row, kind, cells, raw_id, text): `header`, `question` or `other` rows.

    A row is a question if its id is one, if it has a text in a column for questions, or if it holds an id of a question
    and a question mark.
    """
    raw_id, field = _field(ID), _field(TEXT)
    joined = F.array_join(F.transform("cells", lambda x: x["value"]), " | ")
    is_id = raw_id.rlike(QUESTION_ID) | raw_id.rlike(PLAIN_ID)
    question = is_id | (field != "") | (joined.rlike(QUESTION_ID) & F.contains(joined, F.lit("?")))
    asked = F.get(F.filter("cells", lambda x: F.contains(x["value"], F.lit("?"))), F.lit(0))["value"]
    kind = F.when(F.col("row") == 1, "header").when(question, "question").otherwise("other")
    return table_rows(cells).select("sheet", "row", kind.alias("kind"), "cells", raw_id.alias("raw_id"), F.when(field != "", field).otherwise(F.coalesce(asked, joined)).alias("text"))


def bank(cells: DataFrame) -> DataFrame:
    """(id, text, category, answer_type, choices, notes, sheet, row) of the questions; one without an id of its own gets its number, counted over sheets and rows in order."""
    rows = sorted_out(cells).where("kind = 'question'").withColumn("_at", F.struct("sheet", "row"))
    none = rows.select(F.lit(0).alias("n")).limit(0)
    numbered = next_codes(rows, none, "n", "_at", 1)
    own = F.regexp_extract(F.when(F.col("raw_id") != "", F.col("raw_id")).otherwise(F.col("text")), QUESTION_ID, 1)
    number = F.when(own != "", own.cast("int")).otherwise(F.col("n").cast("int"))
    given, upper = F.upper(_field(CATEGORY)), F.upper("text")
    category = F.when(given.isin(CATEGORIES), given)
    for c in CATEGORIES:
        category = category.when(upper.startswith(c) | F.contains(upper, F.lit(f"[{c}]")), c)
    answer = F.lower(_field(ANSWER))
    has = lambda *words: answer.rlike("|".join(words))
    kind = F.when(answer.isin(ANSWERS), answer).when(has("yes", "bool"), "bool").when(has("path", "folder"), "path").when(has("number", "count"), "number").when(has("choice", "select"), "choice").otherwise("text")
    choices = F.filter(F.transform(F.split(_field(CHOICES), r"\s*[|,;]\s*"), F.trim), lambda x: x != "")
    rest = F.filter("cells", lambda x: (x["value"] != F.col("raw_id")) & (x["value"] != F.col("text")) & ~F.coalesce(x["key"].isin(NOT_NOTES), F.lit(False)))
    notes = F.array_join(F.transform(rest, lambda x: F.concat(F.coalesce(x["header"], F.concat(F.lit("Column "), x["col"].cast("string"))), F.lit(": "), x["value"])), "\n")
    return numbered.select(F.concat(F.lit("Q"), F.when(number < 10, F.lit("0")).otherwise(F.lit("")), number.cast("string")).alias("id"), "text", category.otherwise("WHAT").alias("category"), kind.alias("answer_type"), choices.alias("choices"), notes.alias("notes"), "sheet", "row")
