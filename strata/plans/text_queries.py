"""Queries over texts, paths, labels and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import paths
from strata.functions import text as texts
from strata.operators import texts as scans
from strata.plans.bindings import GRAPH_SQL, symbols, table
from strata.plans.registry import query
from strata.sources import records


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")


LINES = "l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@query(f"""WITH {LINES} SELECT file, line::INT AS line, 'trailing-whitespace' AS kind FROM l WHERE text <> '' AND regexp_matches(text, '\\s$')
UNION ALL SELECT file, line, 'tab-indent' FROM l WHERE text LIKE chr(9) || '%' UNION ALL SELECT file, line, 'mixed-indent' FROM l WHERE contains(text, chr(9)) AND contains(text, '    ')
UNION ALL SELECT doc_id, len(string_split(text, chr(10))), 'missing-newline' FROM documents WHERE text <> '' AND right(text, 1) <> chr(10)""")
def format_issues(spark, sf_dir):
    return scans.format_issues(files(spark, sf_dir))


#: Texts laid out like code: sentences apart by blank lines and indented by spaces, clauses by tabs.
LAID = "laid AS (SELECT doc_id, replace(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10) || '    '), ', ', chr(10) || chr(9)) AS text FROM documents)"
LAID_LINES = "WITH " + LAID + ", " + LINES.replace("FROM documents", "FROM laid")


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("text", F.replace(F.replace("text", F.lit(". "), F.lit("\n\n\n\n    ")), F.lit(", "), F.lit("\n\t")))


@query(f"""{LAID_LINES}, i AS (SELECT *, sum(CASE WHEN trim(text) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line) AS run FROM l), k AS (SELECT file, line, row_number() OVER (PARTITION BY file, run ORDER BY line) AS k FROM i WHERE trim(text) = '') SELECT file, line::INT AS line FROM k WHERE k % 3 = 0""")
def blank_runs(spark, sf_dir):
    return scans.blank_runs(_laid(spark, sf_dir))


@query(f"""{LAID_LINES}, v AS (SELECT file, count(*) FILTER (text LIKE chr(9) || '%') AS t, count(*) FILTER (text LIKE '    %') AS s FROM l WHERE line <= 50 GROUP BY file) SELECT CASE WHEN t > s THEN 'tabs' ELSE 'spaces' END AS style, count(*) AS n FROM v WHERE t + s > 0 GROUP BY 1""")
def indent_vote(spark, sf_dir):
    return scans.indent_votes(_laid(spark, sf_dir)).groupBy("style").agg(F.count(F.lit(1)).alias("n"))


def _redact_sql(column: str) -> str:
    out = column
    for p in [texts.SECRETS[0], texts.OPEN_KEY, *texts.SECRETS[1:]]:
        quoted = p.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{texts.REDACTED}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted_md5, text <> {_redact_sql('text')} AS changed FROM documents")
def redact_text(spark, sf_dir):
    out = texts.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out.cast("binary")).alias("redacted_md5"), (F.col("text") != out).alias("changed"))


@query("SELECT doc_id, ceil((length(text) + doc_id % 3 + doc_id % 3) / 2)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    """Of texts that end in up to two characters of two units each."""
    text = F.concat("text", F.repeat(F.lit("\U0001F600"), (F.col("doc_id") % 3).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", texts.token_estimate(text).alias("tokens"))


@query()
def token_budget(spark, sf_dir):
    return files(spark, sf_dir).select("file", scans.within_budget(F.col("text"), 400).alias("text"))


@query(r"SELECT doc_id, 1 + len(regexp_extract_all(text, '\b(?:if|else|for|while|case|catch)\b|&&|\|\||\?(?::|=)')) AS complexity FROM documents")
def regex_complexity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.regex_complexity(F.col("text")).cast("long").alias("complexity"))


@query("SELECT source, count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (quality = 0) AS warnings, count(DISTINCT l.doc_id) FILTER (toxic = 1 OR quality = 0) AS n_files FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source")
def diag_summary(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return joined.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("errors"), F.count_if(F.col("quality") == 0).alias("warnings"), F.count_distinct(F.when(bad, F.col("doc_id"))).alias("n_files"))


#: Diagnostics stand for labels: of every toxic row the message of a missing module.
MESSAGE = "CASE WHEN toxic = 1 THEN 'Cannot find module ''x''' ELSE 'unused variable' END"


@query(f"WITH m AS (SELECT d.lang, {MESSAGE} AS message FROM labels l JOIN documents d ON l.doc_id = d.doc_id) SELECT lang, count(*) AS n, count(*) FILTER (message ILIKE 'cannot find module%') AS infra, NOT (count(*) > 20 AND count(*) FILTER (message ILIKE 'cannot find module%') > 0.5 * count(*)) AS reliable FROM m GROUP BY lang")
def diag_reliability(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("message", F.expr(MESSAGE.replace("''x''", "\\'x\\'")))
    infra = F.count_if(texts.is_infrastructure(F.col("message")))
    n = F.count(F.lit(1))
    return joined.groupBy("lang").agg(n.alias("n"), infra.alias("infra"), (~((n > 20) & (infra > 0.5 * n))).alias("reliable"))


@query("SELECT doc_id, (SELECT greatest(count(*) - 100, 0) FROM labels) AS dropped FROM labels ORDER BY doc_id LIMIT 100")
def diag_cap(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    n = labels.agg(F.greatest(F.count(F.lit(1)) - 100, F.lit(0)).alias("dropped"))
    return labels.orderBy("doc_id").limit(100).select("doc_id").crossJoin(n)  # a hundred rows by one


RISKS = "r AS (SELECT source, count(*) AS files, count(*) FILTER (quality = 0) AS orphans, count(*) FILTER (toxic = 1) AS errors FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)"
LEVEL = "CASE WHEN files + orphans > {h} OR orphans > 10 THEN 'high' WHEN files + orphans > {m} OR orphans > 0 THEN 'medium' ELSE 'low' END"


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("quality") == 0).alias("orphans"), F.count_if(F.col("toxic") == 1).alias("errors"))


@query(f"WITH {RISKS} SELECT source, CASE WHEN files > 10 OR orphans > 30 THEN 'high' WHEN files > 3 OR orphans > 10 THEN 'medium' ELSE 'low' END AS impact, {LEVEL.format(h=60, m=20)} AS verify, {LEVEL.format(h=30, m=10)} AS pre_commit FROM r")
def risk_levels(spark, sf_dir):
    r, f, o = _risks(spark, sf_dir), F.col("files"), F.col("orphans")
    return r.select("source", texts.risk("impact", f, o, o, o).alias("impact"), texts.risk("verify", f, o, o, o).alias("verify"), texts.risk("verify", f, o, o, o, True).alias("pre_commit"))


@query(f"""WITH {RISKS}, x AS (SELECT *, {LEVEL.format(h=60, m=20)} AS risk FROM r) SELECT source,
CASE WHEN errors > 2 THEN 'FAIL' WHEN risk = 'high' OR orphans > 5 THEN 'WARN' ELSE 'PASS' END AS by_text, CASE WHEN errors > 2 THEN 'FAIL' WHEN risk <> 'low' THEN 'FAIL' WHEN orphans > 5 THEN 'WARN' ELSE 'PASS' END AS by_json, CASE WHEN errors > 2 OR risk = 'high' THEN 'FAIL' ELSE 'PASS' END AS by_sync, errors <= 2 AND risk = 'low' AND orphans = 0 AS ready FROM x""")
def verify_verdict(spark, sf_dir):
    r = _risks(spark, sf_dir).withColumn("risk", texts.risk("verify", F.col("files"), F.lit(0), F.col("orphans"), F.col("orphans")))
    args = (F.col("errors") - 2, F.lit(False), F.col("risk"), F.col("orphans") - 5)
    ready = (F.col("errors") <= 2) & (F.col("risk") == "low") & (F.col("orphans") == 0)
    return r.select("source", texts.verdict("text", *args).alias("by_text"), texts.verdict("json", *args, pre_commit=True).alias("by_json"), texts.verdict("sync", *args).alias("by_sync"), ready.alias("ready"))


def _any(patterns: list[str], column: str) -> str:
    return f"regexp_matches({column}, '{'|'.join(patterns)}')"


SKIP = ", ".join(f"'{d}'" for d in paths.SKIP_DIRS)
TEST_DIRS = ", ".join(f"'{d}'" for d in paths.TEST_DIRS)
PATHS = f"WITH {GRAPH_SQL}, p AS (SELECT DISTINCT file AS path FROM symbols UNION SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') FROM pages)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return symbols(spark, sf_dir).select(F.col("file").alias("path")).union(urls).distinct()


@query(f"{PATHS} SELECT path, {_any(paths.NON_SOURCE, 'path')} AS non_source, {_any(paths.TEST_FILE, 'path')} OR list_has_any(string_split(path, '/'), [{TEST_DIRS}]) AS test_file, list_has_any(string_split(path, '/'), [{SKIP}]) AS skipped FROM p")
def path_predicates(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", paths.is_non_source(p).alias("non_source"), paths.is_test_file(p).alias("test_file"), paths.is_skipped(p).alias("skipped"))


@query(f"{PATHS} SELECT contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__') OR starts_with(path, 'tests/') AS is_test, count(*) AS n FROM p GROUP BY 1")
def test_split(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(paths.is_test_path(F.col("path")).alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{PATHS} SELECT path FROM p WHERE NOT {_any(paths.NON_SOURCE, 'path')} AND NOT list_has_any(string_split(path, '/'), [{SKIP}]) AND len(list_filter(string_split(path, '/'), lambda s: s LIKE '.%' AND s NOT IN ('.github', '.husky', '.vscode', '.claude'))) = 0")
def trackable_paths(spark, sf_dir):
    return _paths(spark, sf_dir).filter(paths.is_trackable(F.col("path")))


@query(f"{PATHS} SELECT path, CASE WHEN trim(path) = '' THEN 'missing' WHEN list_contains(string_split(path, '/'), '..') OR starts_with(path, '/') THEN 'traversal' ELSE 'ok' END AS status, regexp_replace(path, '^/([a-zA-Z])/', '\\1:/') AS normalized FROM p")
def path_containment(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", paths.containment(F.col("path")).alias("status"), paths.normalized(F.col("path")).alias("normalized"))


NAMES = "n AS (SELECT DISTINCT string_split(text, ' ')[1] AS name, role AS kind FROM conversations)"


@query(f"""WITH {NAMES} SELECT name, kind, regexp_matches(name, '^(register|createTool)') OR name IN ('execute', 'handler') AS registration, regexp_matches(name, '^(test_|Test)') OR (name IN ('main', 'init') AND kind = 'function') OR kind = 'module' AS entry_point,
regexp_matches(name, '^(test_|Test|handle_|on_|middleware)|(_handler|Handler)$') AS framework FROM n""")
def name_predicates(spark, sf_dir):
    names = table(spark, sf_dir, "conversations").select(F.split("text", " ")[0].alias("name"), F.col("role").alias("kind")).distinct()
    n, k = F.col("name"), F.col("kind")
    return names.select("name", "kind", paths.is_registration(n).alias("registration"), paths.is_entry_point(n, k).alias("entry_point"), paths.is_framework_handler(n, k, F.lit("")).alias("framework"))


@query(r"""SELECT conv_id, turn, trim(text) <> '' AND (regexp_matches(trim(text), '\s') OR regexp_matches(trim(text), '(?i)^(how|what|where|why|who|when|which)') OR regexp_matches(trim(text), '^[a-z][a-z0-9 ]{10,}$')) AS natural, contains(text, '/') OR contains(text, '\') OR regexp_matches(text, '\.(""" + paths.FILE_EXTENSIONS + r""")$') AS path FROM conversations""")
def nl_classifier(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", paths.is_natural_language(F.col("text")).alias("natural"), paths.is_file_path(F.col("text")).alias("path"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'file not found') OR contains(lower(text), 'enoent') THEN 'file not found' WHEN contains(lower(text), 'permission') OR contains(lower(text), 'eacces') THEN 'permission denied' WHEN contains(lower(text), 'network') OR contains(lower(text), 'enotfound') OR contains(lower(text), 'econnrefused') THEN 'network issue' WHEN contains(lower(text), 'type error') OR contains(lower(text), 'syntax error') OR contains(lower(text), 'typecheck') THEN 'type or syntax error' WHEN contains(lower(text), 'timeout') OR contains(lower(text), 'timed out') THEN 'timeout' ELSE 'other' END AS class FROM conversations")
def error_classes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.error_class(F.col("text")).alias("class"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '" + texts.CONTEXT_FILES + r"')::INT + regexp_matches(text, '`[^`\s]+`')::INT + regexp_matches(text, '(?i)[\w.-]+\.[a-z]{1,8}:\d+([-–]\d+)?\b')::INT + regexp_matches(text, '(?i)graph_')::INT AS score, len(string_split_regex(trim(text), '\s+')) >= 30 AS long FROM conversations")
def context_score(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.context_score(F.col("text")).alias("score"), (F.size(F.split(F.trim("text"), r"\s+")) >= 30).alias("long"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'dd if=|mkfs|mkswap|fdisk|parted|sfdisk') OR regexp_matches(lower(regexp_replace(trim(text), '\s+', ' ', 'g')), '""" + texts.ROOT_REMOVAL.replace("'", "''") + r"""') THEN 'high' WHEN """ + " OR ".join(f"contains(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), '{p}')" for p in texts.MEDIUM_RISK) + " THEN 'medium' ELSE 'none' END AS risk FROM conversations")
def command_risk(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.command_risk(F.col("text")).alias("risk"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{texts.SERIOUS}') THEN 2 WHEN regexp_matches(text, '{texts.WEIGHTY}') THEN 1 ELSE 0 END AS level FROM conversations")
def issue_level(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.issue_level(F.col("text")).alias("level"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN '[' || length(text) || ' chars]' ELSE text END AS summary FROM conversations")
def log_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.summarized(F.col("text")).alias("summary"))


@query(r"SELECT page_id AS file, regexp_extract(l, '^\s*([\w.-]+)', 1) AS name, trim(regexp_replace(l, '^\s*[\w.-]+', '')) AS version FROM (SELECT page_id, unnest(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^[#-]'))[1:15]) AS l FROM pages)")
def manifest_rows(spark, sf_dir):
    return records.requirements(table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text")))


@query("SELECT sum(CASE WHEN l_quantity > 2 THEN l_quantity::BIGINT END)::BIGINT AS added, sum(CASE WHEN l_quantity > 2 THEN l_linenumber END)::BIGINT AS removed, count(*) FILTER (l_quantity > 2) AS modified FROM lineitem")
def numstat_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first = F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("long").cast("string")).otherwise("-")
    return records.numstat(lines.select(F.concat_ws("\t", first, F.col("l_linenumber").cast("string"), F.lit("f")).alias("line")))


@query("SELECT 'f' || doc_id || '.ts' AS file, (doc_id % 100 + 1)::INT AS line, 1 AS col, CASE WHEN toxic = 1 THEN 'error' ELSE 'warning' END AS severity, 'TS' || quality AS code, 'unused' AS message FROM labels")
def log_lines(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "error").otherwise("warning")
    return records.diagnostics(labels.select(F.format_string("f%d.ts:%d:1 - %s TS%d: unused", "doc_id", F.col("doc_id") % 100 + 1, kind, "quality").alias("text")))


@query("WITH l AS (SELECT doc_id, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 5) SELECT 'FAIL: ' || (SELECT count(*) FROM labels WHERE toxic = 1) || ' errors' || chr(10) || string_agg('- document ' || doc_id, chr(10) ORDER BY doc_id) AS comment FROM l")
def pr_comment(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").filter("toxic = 1")
    n = bad.agg(F.count(F.lit(1)).alias("n"))
    top = bad.orderBy("doc_id").limit(5).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    lines = F.transform("ids", lambda d: F.concat(F.lit("- document "), d.cast("string")))
    return top.crossJoin(n).select(F.concat_ws("\n", F.concat(F.lit("FAIL: "), F.col("n").cast("string"), F.lit(" errors")), lines).alias("comment"))  # a row by a row


@query("SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT) / 3, 9) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'que') ORDER BY score DESC, doc_id LIMIT 15")
def document_search(spark, sf_dir):
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return scans.concept_search(corpus, F.col("text"), ["the", "der", "que"], F.lit(0.0)).withColumnRenamed("id", "doc_id")


CODE = "w AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '[a-z]{4,}'))) AS ws FROM pages), x AS (SELECT concat('m', page_id, '.py') AS file, unnest(ws) || '_' AS name, (2 * generate_subscripts(ws, 1) - 1)::INT AS line FROM w)"


@query(f"WITH {CODE} SELECT file, 'symbol' AS fact, name, 'function' AS kind, line, line + 1 AS end_line, 'public' AS visibility, 'def ' || name || '(x):' AS other FROM x UNION ALL SELECT file, 'call', name, 'direct', line + 1, line + 1, NULL, NULL FROM x UNION ALL SELECT file, 'ref', 'x', 'ref', line + 1, line + 1, NULL, NULL FROM x")
def parse_python_source(spark, sf_dir):
    """The facts of a module for each page, which has a function that calls itself for each different word of the page."""
    from strata.sources import code

    words = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("[a-z]{4,}"), F.lit(0))))
    text = F.array_join(F.transform(words, lambda w: F.concat(F.lit("def "), w, F.lit("_(x):\n    return "), w, F.lit("_(x)\n"))), "")
    return code.facts(table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), F.col("page_id").cast("string"), F.lit(".py")).alias("file"), F.encode(text, "UTF-8").alias("content")))
