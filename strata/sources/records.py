"""Records in text: manifests, git output, diagnostics, audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as texts

# Fixed value: a line of a type checker.
DIAGNOSTIC = r"^(.+?):(\d+):(\d+) - (error|warning) (\S+): (.*)$"


def package_dependencies(manifests: DataFrame, most: int = 15) -> DataFrame:
    """(file, name, version, type) of package.json texts (file, text): dependencies, then devDependencies, `most` in all."""
    parsed = manifests.withColumn("_j", F.from_json("text", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"))
    rows = lambda c, t: F.transform(F.map_entries(F.coalesce(F.col(f"_j.{c}"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(t).alias("type")))
    return parsed.select("file", F.inline(F.slice(F.concat(rows("dependencies", "runtime"), rows("devDependencies", "dev")), 1, most)))


def section(text: Column, name: str) -> Column:
    """The lines of a [name] section of a TOML text."""
    return F.split(F.regexp_extract(text, rf"(?s)(?:^|\n)\[{name}\]\n(.*?)(?:\n\[|\z)", 1), "\n")


def cargo_dependencies(manifests: DataFrame, most: int = 15) -> DataFrame:
    found = manifests.select("file", F.explode(F.slice(F.filter(section(F.col("text"), "dependencies"), lambda x: x.rlike(r"^[\w-]+\s*=")), 1, most)).alias("_l"))
    return found.select("file", F.regexp_extract("_l", r"^([\w-]+)", 1).alias("name"), F.regexp_extract("_l", r"\"([^\"]+)\"", 1).alias("version"))


def requirements(manifests: DataFrame, most: int = 15) -> DataFrame:
    found = manifests.select("file", F.explode(F.slice(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^[#-]")), 1, most)).alias("_l"))
    return found.select("file", F.regexp_extract("_l", r"^\s*([\w.-]+)", 1).alias("name"), F.trim(F.regexp_replace("_l", r"^\s*[\w.-]+", "")).alias("version"))


def go_requirements(manifests: DataFrame, most: int = 15) -> DataFrame:
    """Lines of go.mod that a tab begins; they are what is meant there."""
    found = manifests.select("file", F.explode(F.slice(F.filter(F.split("text", "\n"), lambda x: x.startswith("\t") & (F.trim(x) != "")), 1, most)).alias("_l"))
    return found.select("file", F.regexp_extract("_l", r"^\t(\S+)", 1).alias("name"), F.regexp_extract("_l", r"^\t\S+\s+(\S+)", 1).alias("version"))


def numstat(lines: DataFrame) -> DataFrame:
    """(added, removed, modified) over `git diff --numstat` lines (line); rows without numbers don't count."""
    parts = lines.select(F.split("line", "\t").alias("_p")).select(F.expr("try_cast(_p[0] AS BIGINT)").alias("a"), F.expr("try_cast(get(_p, 1) AS BIGINT)").alias("r")).filter("a IS NOT NULL AND r IS NOT NULL")
    return parts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("added"), F.coalesce(F.sum("r"), F.lit(0)).alias("removed"), F.count(F.lit(1)).alias("modified"))


def commits(lines: DataFrame, most: int = 10) -> DataFrame:
    """(ord, hash, subject) of the first `git log --oneline` lines (ord, line)."""
    return lines.select("ord", F.regexp_extract("line", r"^(\S+)", 1).alias("hash"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("subject")).orderBy("ord").limit(most)


def diagnostics(lines: DataFrame) -> DataFrame:
    """(file, line, col, severity, code, message) of type-checker lines (text); messages redacted, 200 characters at most."""
    found = lines.filter(F.col("text").rlike(DIAGNOSTIC))
    part = lambda k: F.regexp_extract("text", DIAGNOSTIC, k)
    return found.select(
        part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("code"),
        F.substring(texts.redacted(part(6)), 1, 200).alias("message"),
    )


def audit_log(rows: DataFrame, slow_ms: int = 500, last: int = 3) -> DataFrame:
    """The last errors and slow calls of an audit log (ts, tool, success, durationMs), newest first, with `why`."""
    errors = rows.filter("NOT success").orderBy(F.desc("ts")).limit(last).withColumn("why", F.lit("error"))
    return errors.union(rows.filter(F.col("durationMs") > slow_ms).orderBy(F.desc("ts")).limit(last).withColumn("why", F.lit("slow")))


def pyproject_dependencies(manifests: DataFrame, most: int = 15) -> DataFrame:
    """(file, name, version) of the [project.dependencies] section of pyproject texts; comments don't count."""
    rows = F.filter(section(F.col("text"), r"project\.dependencies"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    found = manifests.select("file", F.explode(F.slice(rows, 1, most)).alias("_l"))
    line = r"^\"?([^\"<>=]+)\"?\s*[<>=]*\s*\"?([^\"]*)\"?"
    return found.select("file", F.trim(F.regexp_extract("_l", line, 1)).alias("name"), F.trim(F.regexp_extract("_l", line, 2)).alias("version"))


def export(diagnostics: DataFrame, order: str, most: int = 100) -> DataFrame:
    """(n, errors, warnings, kept, files) of diagnostics (file, severity): counts, how many a report shows, a digest of all files."""
    bad = F.col("severity") == "error"
    files = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "file"))), lambda x: x["file"]), ",").cast("binary"))
    return diagnostics.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("errors"), F.count_if(~bad).alias("warnings"), F.least(F.count(F.lit(1)), F.lit(most)).alias("kept"), files.alias("files"))


def append_log(rows: DataFrame, path: str) -> None:
    """Rows appended to a log of JSON lines."""
    rows.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def retained(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """A log (ts) without what is older than `days`."""
    return log.filter(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def setting(config: Column, path: str, default: int) -> Column:
    """A whole number of a JSON text, or the default where the text is no object or lacks it."""
    return F.coalesce(F.get_json_object(config, path).try_cast("int"), F.lit(default))


def review_comment(counts: DataFrame, changed: DataFrame, errors: DataFrame, callers: DataFrame, most: int = 5, critical: int = 10) -> DataFrame:
    """(comment): verdict, counts (a row: errors, warnings), changed files (a row: changed), the first errors (file, ord), and the
    symbols with most callers (symbol, callers, ord), those with `critical` or more marked as top."""
    first = errors.orderBy("ord").limit(most).agg(F.array_sort(F.collect_list(F.struct("ord", "file"))).alias("_errors"))
    top = callers.orderBy(F.desc("callers"), "ord").limit(most)
    mark = F.when(F.col("callers") >= critical, " top").otherwise("")
    line = F.concat(F.lit("- "), "symbol", F.lit(" "), F.col("callers").cast("string"), mark)
    top = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("callers")).alias("n"), "ord", line.alias("line")))).alias("_top"))
    rows = counts.crossJoin(changed).crossJoin(first).crossJoin(top)  # single rows
    text = F.concat_ws(
        "\n", F.concat(F.lit("Verdict: "), F.when(F.col("errors") > 0, "FAIL").otherwise("PASS")), F.concat(F.lit("Errors: "), F.col("errors").cast("string"), F.lit(", warnings: "), F.col("warnings").cast("string")),
        F.concat(F.lit("Changed files: "), F.col("changed").cast("string")), F.transform("_errors", lambda e: F.concat(F.lit("- "), e["file"])), F.transform("_top", lambda t: t["line"]),
    )
    return rows.select(text.alias("comment"))
