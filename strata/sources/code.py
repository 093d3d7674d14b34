"""Source trees as fact tables: a scan of files, Python facts from its own parser, an incremental refresh.

Python is parsed with the standard library; other languages are admitted and listed, but have no parser here.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import paths

MAX_BYTES = 2 * 1024 * 1024
FACTS = "file string, fact string, name string, kind string, line int, end_line int, visibility string, other string"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)


def decoded(raw: bytes | None) -> str:
    """UTF-8, else GBK, where at most a twentieth of the first 64 KB can't be read; else UTF-8 with marks."""
    raw = raw or b""
    for encoding in ("utf-8", "gbk"):
        head = raw[:65536].decode(encoding, "replace")
        if head.count("�") <= 0.05 * max(1, len(head)):
            return raw.decode(encoding, "replace")
    return raw.decode("utf-8", "replace")


def scan(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """(file, modified, content) of source files under root: known extensions, no skipped directories, MAX_BYTES at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    file = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/").removeprefix("file://")) + "/", "")
    files = files.filter(F.col("length") <= MAX_BYTES).select(file.alias("file"), F.col("modificationTime").alias("modified"), "content")
    kept = paths.language(F.col("file")).isNotNull() & ~paths.is_skipped(F.col("file")) & ~paths.is_non_source(F.col("file"))
    return files.filter(kept if tests else kept & ~paths.is_test_file(F.col("file")))


def _quoted(path: str) -> str:
    return "\\Q" + path + "\\E"


def python_facts(file: str, text: str) -> Iterator[tuple]:
    """Rows of FACTS: symbols, imports, bindings, calls, refs, types and branches; none of a text that isn't Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    exported = set()
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            exported = {c.value for c in ast.walk(node.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)}

    def visibility(name: str) -> str:
        return "exported" if name in exported else "private" if name.startswith("_") and not name.startswith("__") else "public"

    def symbols(body: list, inside: str) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if inside else "function"
                signature = text.splitlines()[node.lineno - 1].strip()
                yield file, "symbol", node.name, kind, node.lineno, node.end_lineno, visibility(node.name), signature if len(signature) <= 120 else signature[:117] + "..."
                if kind == "class":
                    yield from symbols(node.body, node.name)
            elif isinstance(node, (ast.If, ast.Try, ast.With)):
                yield from symbols([n for n in ast.iter_child_nodes(node) if isinstance(n, ast.stmt)], inside)

    yield from symbols(tree.body, "")
    for node in ast.walk(tree):
        line, end = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
        if isinstance(node, ast.Import):
            for a in node.names:
                yield file, "import", a.name, "import", line, end, None, None
                yield file, "binding", a.asname or a.name.split(".")[0], "namespace", line, end, None, a.name
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            yield file, "import", module, "import", line, end, None, None
            for a in node.names:
                yield file, "binding", a.asname or a.name, "named", line, end, None, f"{module}:{a.name}"
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                yield file, "call", node.func.id, "direct", line, end, None, None
            elif isinstance(node.func, ast.Attribute):
                yield file, "call", node.func.attr, "member", line, end, None, None
            for a in node.args:
                if isinstance(a, ast.Name):
                    yield file, "ref", a.id, "ref", line, end, None, None
        elif isinstance(node, ast.Return) and isinstance(node.value, ast.Name):
            yield file, "ref", node.value.id, "ref", line, end, None, None
        elif isinstance(node, ast.ClassDef):
            for b in node.bases:
                if isinstance(b, ast.Name):
                    yield file, "type", b.id, "type", line, end, None, None
        elif isinstance(node, (ast.arg, ast.AnnAssign)) and node.annotation is not None:
            for n in ast.walk(node.annotation):
                if isinstance(n, ast.Name):
                    yield file, "type", n.id, "type", line, end, None, None
        if isinstance(node, _BRANCHES):
            place = node if line else node.pattern
            yield file, "branch", "", "branch", place.lineno, (node.body[-1].end_lineno if isinstance(node, ast.match_case) else end), None, None
        elif isinstance(node, ast.BoolOp):
            for _ in node.values[1:]:
                yield file, "branch", "", "branch", line, end, None, None


def facts(files: DataFrame) -> DataFrame:
    """All facts of files (file, content) in one long table; files without a parser have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f, raw in zip(batch.file, batch.content) if f.endswith((".py", ".pyi")) for r in dict.fromkeys(python_facts(f, decoded(raw)))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])

    return files.select("file", "content").mapInPandas(parse, FACTS)


def symbols(found: DataFrame) -> DataFrame:
    """(id, name, kind, file, line, end_line, visibility, signature) of a table of facts; the last of an id stays."""
    own = found.filter("fact = 'symbol'").withColumn("id", F.concat_ws("::", "file", "name", F.col("line").cast("string")))
    return own.dropDuplicates(["id"]).select("id", "name", "kind", "file", F.col("line").cast("long"), F.col("end_line").cast("long"), "visibility", F.col("other").alias("signature"))


def refreshed(old: DataFrame, kept: DataFrame, new_files: DataFrame) -> DataFrame:
    """Facts after a change: old facts of files that are still there unchanged, and facts of new and changed files.

    old: facts with `modified` of the file; kept and new_files: the scan before and now (file, modified[, content]).
    """
    same = new_files.select("file", "modified").join(kept.select("file", "modified"), ["file", "modified"], "left_semi")
    return old.join(same.select("file"), "file", "left_semi").unionByName(facts(new_files.join(same.select("file"), "file", "left_anti")))
