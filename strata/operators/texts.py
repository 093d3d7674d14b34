"""Scans of text files, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.joins import within_spans

HEADER = r"^(##|###|####) |^\*\*[^*]+:\*\*"


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of files (file, text), lines numbered from 1; null texts have none."""
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("_at", "text")).select("file", (F.col("_at") + 1).alias("line"), "text")


def format_issues(files: DataFrame, spaces: bool = True) -> DataFrame:
    """(file, line, kind): trailing whitespace, tabs where spaces are the style, mixed indents, a missing last newline."""
    t = F.col("text")
    kinds = F.array_compact(F.array(
        F.when((t != "") & t.rlike(r"\s$"), "trailing-whitespace"), F.when(F.lit(spaces) & t.startswith("\t"), "tab-indent"), F.when(t.contains("\t") & t.contains("    "), "mixed-indent"),
    ))
    found = lines(files).select("file", "line", F.explode(kinds).alias("kind"))
    last = files.filter("text <> '' AND NOT endswith(text, '\n')").select("file", F.size(F.split("text", "\n")).alias("line"), F.lit("missing-newline").alias("kind"))
    return found.union(last)


def blank_runs(files: DataFrame) -> DataFrame:
    """(file, line): every third line of a run of blank lines."""
    numbered = lines(files).withColumn("_blank", F.trim("text") == "")
    order = Window.partitionBy("file").orderBy("line")
    island = numbered.withColumn("_run", F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(order)).filter("_blank")
    return island.withColumn("_k", F.row_number().over(Window.partitionBy("file", "_run").orderBy("line"))).filter("_k % 3 = 0").select("file", "line")


def indent_votes(files: DataFrame, head: int = 50) -> DataFrame:
    """(file, style): tabs or spaces, whichever begins more of the first `head` lines; files without either have no vote."""
    first = lines(files).filter(F.col("line") <= head)
    votes = first.groupBy("file").agg(F.count_if(F.col("text").startswith("\t")).alias("_tabs"), F.count_if(F.col("text").startswith("    ")).alias("_spaces")).filter("_tabs + _spaces > 0")
    return votes.select("file", F.when(F.col("_tabs") > F.col("_spaces"), "tabs").otherwise("spaces").alias("style"))


def within_budget(text: Column, budget: int) -> Column:
    """The lines of a text that fit a budget of tokens (half a line's length, rounded up), then how many were dropped.

    Once a plain line doesn't fit, no plain line after it is kept; headers are kept until the budget is overrun.
    """
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.lit(0).alias("dropped"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        cost = F.ceil(F.length(line) / 2).cast("long")
        header = line.rlike(HEADER)
        keep = F.when(header, acc["used"] <= budget).otherwise(~acc["full"] & (acc["used"] + cost <= budget))
        return F.struct(
            F.when(keep, acc["used"] + cost).otherwise(acc["used"]).alias("used"), (acc["full"] | (~header & ~keep)).alias("full"),
            F.when(keep, acc["dropped"]).otherwise(acc["dropped"] + 1).alias("dropped"), F.when(keep, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"),
        )

    def end(acc: Column) -> Column:
        note = F.concat(F.lit("... ("), acc["dropped"].cast("string"), F.lit(" lines dropped)"))
        return F.array_join(F.when(acc["dropped"] > 0, F.concat(acc["kept"], F.array(note))).otherwise(acc["kept"]), "\n")

    return F.aggregate(F.split(text, "\n"), state, step, end)


def branch_complexity(symbols: DataFrame, branches: DataFrame) -> DataFrame:
    """(id, complexity): 1 and a point for each branch node (file, kind, has_if_child, start_row, end_row) within the span;
    a plain else is none."""
    points = F.when(F.col("kind").isNull() | ((F.col("kind") == "else") & ~F.col("has_if_child")), 0).otherwise(1)
    summed = branches.groupBy("file", "start_row", "end_row").agg(F.sum(points).alias("_points")).filter("_points > 0")
    inside = within_spans(symbols.select("id", "file", "line", "end_line"), summed, "start_row").filter("end_row <= end_line")
    found = inside.groupBy("id").agg(F.sum("_points").alias("_points"))
    return symbols.select("id").distinct().join(found, "id", "left").select("id", (F.lit(1) + F.coalesce("_points", F.lit(0))).cast("long").alias("complexity"))


def concept_search(corpus: DataFrame, text: Column, tokens: list[str], rank: Column, k: int = 15) -> DataFrame:
    """corpus's id and score: the share of tokens that the lower-cased text contains, times 1 + rank; the first k."""
    hits = sum((F.lower(text).contains(t).cast("int") for t in tokens), F.lit(0))
    scored = corpus.select("id", F.round(hits / len(tokens) * (1 + rank), 9).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "id").limit(k)
