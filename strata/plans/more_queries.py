"""Queries over commands, reports, manifests, markers and names that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import paths, shell
from strata.functions import text as texts
from strata.operators import events as rules
from strata.operators import joins
from strata.plans.bindings import GRAPH_SQL, symbols, table
from strata.plans.registry import query
from strata.sources import records


def _values(rows: list[str]) -> str:
    return "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in rows) + "]"


def _pick(rows: list[str], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, rows)), (F.expr(by) % len(rows) + 1).cast("int"))


# Commands of a shell, one for each event; what each is stands beside it for the oracle.
COMMANDS = [
    ("grep -rn foo src/app.ts", "lookup", "", False), ("git commit -m 'fix: a; b'", "", "commit", True), ("echo safe && git commit -am x", "", "commit", True),
    ("git commit --no-verify -m x", "", "commit", False), ("timeout 30 npm test", "tests", "test", False), ("timeout 60 npm test", "tests", "test", False),
    ("ls -la src", "overview", "", False), ("git status --short", "overview", "", False), ("echo 'git commit'", "", "", False), ("cat /tmp/a1.txt | tee /tmp/b2.log", "impact", "", False),
    ("cat /tmp/zz.txt |  tee /tmp/y.log", "impact", "", False), ("rm old.py", "lookup", "", False), ("npx eslint --fix .", "format", "", False), ("git log | head", "overview", "", False),
    ("echo $(git commit)", "", "", False), ("true || git commit -n", "", "", False), ("sed -i s/a/b/ x", "impact", "", False), ("pip list", "overview", "", False),
]
COMMAND_SQL = f"c AS (SELECT event_id, ts, user_id, event_type, event_id % {len(COMMANDS)} AS k, {_values([c for c, *_ in COMMANDS])}[event_id % {len(COMMANDS)} + 1] AS command FROM events)"


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", _pick([c for c, *_ in COMMANDS], "event_id").alias("command"))


@query(f"WITH {COMMAND_SQL} SELECT event_id, nullif({_values([h for _, h, *_ in COMMANDS])}[k + 1], '') AS hint FROM c")
def command_hints(spark, sf_dir):
    return _commands(spark, sf_dir).select("event_id", texts.command_hint(F.col("command")).alias("hint"))


@query(f"WITH {COMMAND_SQL} SELECT event_id, [{', '.join(str(x).lower() for *_, x in COMMANDS)}][k + 1] AS commits FROM c")
def commit_commands(spark, sf_dir):
    return _commands(spark, sf_dir).select("event_id", shell.commits(F.col("command")).alias("commits"))


#: The words of each command's segments, written out.
WORDS = [
    "grep -rn foo src/app.ts", "git commit -m fix: a; b", "echo safe / git commit -am x", "git commit --no-verify -m x", "timeout 30 npm test", "timeout 60 npm test", "ls -la src",
    "git status --short", "echo git commit", "cat /tmp/a1.txt / tee /tmp/b2.log", "cat /tmp/zz.txt / tee /tmp/y.log", "rm old.py", "npx eslint --fix .", "git log / head",
    "echo $(git commit)", "true / git commit -n", "sed -i s/a/b/ x", "pip list",
]
WORD_COUNTS = [4, 4, 6, 5, 4, 4, 3, 3, 2, 4, 4, 2, 4, 3, 2, 4, 4, 2]


@query(f"WITH {COMMAND_SQL} SELECT event_id, {_values(WORDS)}[k + 1] AS words, {WORD_COUNTS}[k + 1]::BIGINT AS n_words FROM c")
def command_words(spark, sf_dir):
    cut = _commands(spark, sf_dir).select("event_id", shell.segments_of("command").alias("s"))
    return cut.select("event_id", F.array_join(F.transform("s", lambda s: F.array_join(s, " ")), " / ").alias("words"), F.size(F.flatten("s")).cast("long").alias("n_words"))


#: Commands that are one but for timeouts, temporary files and spaces.
SAME = [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, 9, 11, 12, 13, 14, 15, 16, 17]


@query(f"WITH {COMMAND_SQL}, m AS (SELECT event_id, ts, user_id, {SAME}[k + 1] AS same, event_type <> 'error' AS start FROM c), i AS (SELECT *, sum(start::INT) OVER (PARTITION BY same ORDER BY ts, event_id) AS island FROM m), r AS (SELECT event_id, start, row_number() OVER (PARTITION BY same, island ORDER BY ts, event_id) AS n, island FROM i), f AS (SELECT event_id, same, row_number() OVER (PARTITION BY same, island ORDER BY ts, event_id) AS streak FROM i WHERE NOT start) SELECT event_id, streak, streak >= 3 AS warn FROM f")
def command_failures(spark, sf_dir):
    """Failures in a row of each command, whatever its timeouts and temporary files, by all users."""
    keyed = _commands(spark, sf_dir).withColumn("key", texts.command_key(F.col("command")))
    found = rules.failure_streaks(keyed, "key", F.col("event_type") == "error", None)
    return found.select("event_id", F.col("streak").cast("long").alias("streak"), (F.col("streak") >= 3).alias("warn"))


REPORTS = [
    ('{"result":{"verdict":"PASS"}}', True), ('{"verdict":"FAIL"}', False), ('{"result":{"errors":[]}}', False), ('{"riskLevel":"high"}', False), ("[FAIL] 5 errors", False),
    ("all fine\nVerdict: PASS", True), ("Verdict:  fail", False), ("Risk: **high**", False), ("Errors: 0", True), ("Errors: 12", False), ("", False), ("[1, 2]", False),
]


@query(f"SELECT event_id, [{', '.join(str(x).lower() for _, x in REPORTS)}][event_id % {len(REPORTS)} + 1] AS passed FROM events")
def report_passed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", texts.report_passed(_pick([r for r, _ in REPORTS], "event_id")).alias("passed"))


@query("""WITH t AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN chr(10) || 'PASS all' ELSE '' END || CASE WHEN turn % 2 = 0 THEN repeat(chr(10) || 'ok ' || turn, 40) ELSE '' END AS output FROM conversations),
s AS (SELECT *, string_split(output, chr(10)) AS rows, list_filter(string_split(output, chr(10)), lambda x: x <> '') AS filled FROM t), j AS (SELECT *, rtrim(array_to_string(filled[-5:], ' '), ' ') AS last FROM s)
SELECT conv_id, turn, CASE WHEN len(rows) >= 30 AND (contains(output, 'PASS') OR contains(output, 'FAILED') OR contains(output, 'pytest') OR turn % 2 = 0) AND length(last) <= 300 THEN last END AS summary FROM j""")
def test_summaries(spark, sf_dir):
    more = F.concat(F.when(F.col("turn") % 3 == 0, "\nPASS all").otherwise(""), F.when(F.col("turn") % 2 == 0, F.repeat(F.concat(F.lit("\nok "), F.col("turn").cast("string")), 40)).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.test_summary(F.concat("text", more)).alias("summary"))


@query("SELECT doc_id, 'f' || doc_id || (['.ts', '.py', '.rs', '', '.xyz'])[doc_id % 5 + 1] || ':' || (doc_id % 90) || ':1  ' || CASE WHEN toxic = 1 THEN 'ERR' WHEN quality = 0 THEN 'WRN' ELSE 'HNT' END || CASE WHEN quality = 1 THEN ' TS' || quality ELSE '' END || '  unused (' || (['typescript', 'python', 'rust', 'lsp', 'xyz'])[doc_id % 5 + 1] || ')' AS line FROM labels")
def compact_diagnostics(spark, sf_dir):
    file = F.concat(F.lit("f"), F.col("doc_id").cast("string"), _pick([".ts", ".py", ".rs", "", ".xyz"], "doc_id"))
    kind = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("hint")
    code = F.when(F.col("quality") == 1, "TS1")
    return table(spark, sf_dir, "labels").select("doc_id", texts.compact_diagnostic(file, F.col("doc_id") % 90, F.lit(1), kind, code, F.lit("unused")).alias("line"))


@query("SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (toxic = 0) AS warnings, least(count(*), 100) AS kept, md5(string_agg('f' || doc_id, ',' ORDER BY doc_id)) AS files FROM labels")
def diagnostics_export(spark, sf_dir):
    """All diagnostics counted, the files of all, and how many a report shows."""
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("error"))
    return records.export(rows.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), "doc_id", F.when(F.col("error"), "error").otherwise("warning").alias("severity")), "doc_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' AS stamp FROM events")
def local_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", texts.local_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[3 items]' WHEN 1 THEN '{\"a\":\"[2 items]\",\"b\":\"x\"}' ELSE CASE WHEN length(text) > 200 THEN '[' || length(text) || ' chars]' ELSE text END END AS summary FROM conversations")
def log_values(spark, sf_dir):
    value = F.when(F.col("turn") % 3 == 0, "[1,2,3]").when(F.col("turn") % 3 == 1, '{"a":[1,2],"b":"x"}').otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.summarized_json(value).alias("summary"))


@query("SELECT conv_id, turn, replace(replace(text || '`\\', '\\', '\\\\'), '`', '\\`') AS escaped FROM conversations")
def markdown_escapes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.markdown_escaped(F.concat("text", F.lit("`\\"))).alias("escaped"))


@query("SELECT l_orderkey, l_linenumber, (['error', 'warning', 'info', 'hint', 'hint'])[least(l_linenumber, 5)] AS severity, CASE l_suppkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'type_parameter' WHEN 2 THEN 'function' ELSE 'variable' END AS kind FROM lineitem")
def protocol_codes(spark, sf_dir):
    code = F.when(F.col("l_suppkey") % 4 == 0, 1).when(F.col("l_suppkey") % 4 == 1, 26).when(F.col("l_suppkey") % 4 == 2, 12).otherwise(99)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", texts.severity_name(F.col("l_linenumber")).alias("severity"), texts.symbol_kind_name(code).alias("kind"))


@query(f"WITH {GRAPH_SQL}, f AS (SELECT DISTINCT file FROM symbols) SELECT file, 'file:///srv/a%20b/' || replace(file, ' ', '%20') AS uri, '/srv/a b/' || file AS back, 'file:///C:/w/' || replace(file, ' ', '%20') AS drive, 'C:/w/' || file AS drive_back FROM f")
def file_uris(spark, sf_dir):
    f = symbols(spark, sf_dir).select("file").distinct()
    plain, drive = F.concat(F.lit("/srv/a b/"), "file"), F.concat(F.lit("C:\\w\\"), "file")
    return f.select("file", paths.file_uri(plain).alias("uri"), paths.uri_path(paths.file_uri(plain)).alias("back"), paths.file_uri(drive).alias("drive"), paths.uri_path(paths.file_uri(drive)).alias("drive_back"))


@query(f"WITH {GRAPH_SQL}, f AS (SELECT DISTINCT file FROM symbols), p AS (SELECT file, string_split(file, '/') AS s FROM f) SELECT file, CASE WHEN s[1] IN ('ASIA', 'catalog') AND s[2] IN ('CHINA', 'JAPAN', 'Brand_11', 'Brand_22') THEN s[1] || '/' || s[2] WHEN s[1] IN ('ASIA', 'EUROPE') THEN s[1] ELSE '.' END AS folder FROM p")
def nearest_marker(spark, sf_dir):
    """The nearest folder above each file that holds a marker."""
    marks = [f"{a}/{b}" for a in ("ASIA", "catalog") for b in ("CHINA", "JAPAN", "Brand_11", "Brand_22")] + ["ASIA", "EUROPE", "."]
    return joins.nearest_marked(symbols(spark, sf_dir).select("file").distinct(), spark.createDataFrame([(m,) for m in marks], "folder string"))


SERVERS = [("typescript", "local-ts", 0, "node_modules/.bin"), ("typescript", "ts", 1, "path"), ("python", "pyright", 0, "node_modules/.bin"), ("python", "pylsp", 1, "path"), ("go", "gopls", 0, "home")]


@query("SELECT 'available' AS status, language, NULL AS install FROM (VALUES ('typescript'), ('python')) t(language) UNION ALL SELECT 'missing', 'go', 'go install gopls'")
def setup_report(spark, sf_dir):
    """The first server found for each language of the project, and how to get the others."""
    wanted = symbols(spark, sf_dir).select(paths.language(F.col("file")).alias("language")).distinct()
    candidates = spark.createDataFrame(SERVERS, "language string, server string, priority int, place string")
    found = spark.createDataFrame([("path",)], "place string")
    install = spark.createDataFrame([("go", "go install gopls"), ("rust", "rustup component add rust-analyzer")], "language string, install string")
    return joins.setup_report(joins.first_available(wanted, candidates, found), install)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 2000")
def newest_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "event_type")
    return rules.newest(e, "user_id", "seq").select("user_id", "event_type", F.col("seq.ts").alias("ts"))


@query(f"WITH {GRAPH_SQL}, s AS (SELECT id, name, split_part(file, '/', 2) AS file, line, end_line FROM symbols WHERE id LIKE 'part::%') SELECT a.id, coalesce(string_agg(b.name, '/' ORDER BY b.end_line - b.line DESC, b.name) FILTER (b.id IS NOT NULL), '') AS path FROM s a LEFT JOIN s b ON a.file = b.file AND a.line BETWEEN b.line AND b.end_line AND a.id <> b.id GROUP BY a.id")
def container_path(spark, sf_dir):
    own = symbols(spark, sf_dir).filter("id LIKE 'part::%'").select("id", "name", F.split_part("file", F.lit("/"), F.lit(2)).alias("file"), "line", "end_line")
    return joins.container_paths(own)


NAMED = ["main", "app.get", "router.post", "handleLogin", "loginHandler", "UserController", "onClick", "cli", "api.delete", "EventBus", "plain", "widget.render"]
NAMED_SQL = f"s AS (SELECT conv_id * 100 + turn AS id, {_values(NAMED)}[(conv_id * 100 + turn) % 12 + 1] AS name, (['src/a.py', 'src/b.ts', 'src/c.go', 'src/d.js'])[conv_id % 4 + 1] AS file, CASE WHEN conv_id % 9 = 0 THEN 'anonymous_function' ELSE 'function' END AS kind FROM conversations)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id") * 100 + F.col("turn")
    kind = F.when(F.col("conv_id") % 9 == 0, "anonymous_function").otherwise("function").alias("kind")
    return table(spark, sf_dir, "conversations").select(key.alias("id"), _pick(NAMED, "conv_id * 100 + turn").alias("name"), _pick(["src/a.py", "src/b.ts", "src/c.go", "src/d.js"], "conv_id").alias("file"), kind, F.lit("public").alias("visibility"))


@query(f"WITH {NAMED_SQL}, e AS (SELECT id, name, file, CASE WHEN name = 'main' AND kind = 'function' THEN 'cli' WHEN name = 'cli' AND file LIKE '%.py' AND kind = 'function' THEN 'cli' WHEN (file LIKE '%.ts' OR file LIKE '%.js') AND name IN ('onClick', 'loginHandler', 'EventBus') THEN 'event' END AS category FROM s) SELECT id, name, file, category FROM e WHERE category IS NOT NULL ORDER BY category, id LIMIT 15")
def entry_point_rules(spark, sf_dir):
    """The first 15 entry points: tools before listeners."""
    c = paths.entry_category(F.col("name"), F.col("kind"), F.col("file"), F.col("visibility")).alias("category")
    order = F.when(F.col("category") == "cli", 0).when(F.col("category") == "http", 1).otherwise(2)
    return _named(spark, sf_dir).select("id", "name", "file", c).filter("category IS NOT NULL").orderBy(order, "id").limit(15)


@query(f"WITH {NAMED_SQL} SELECT file, name, count(*) AS n FROM s WHERE name IN ('app.get', 'router.post', 'handleLogin', 'loginHandler', 'UserController', 'api.delete') GROUP BY file, name")
def routes(spark, sf_dir):
    return _named(spark, sf_dir).filter(paths.is_route(F.col("name"))).groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NAMED_SQL} SELECT file, count(*) AS n FROM s WHERE kind <> 'anonymous_function' GROUP BY file")
def without_callbacks(spark, sf_dir):
    return joins.without_callbacks(_named(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


IMPORTS = [("Express", "express"), ("next/router", "next"), ("nextjs", None), ("@nestjs/core", "@nestjs/core"), ("hono-x", "hono"), ("react", None), ("koa", "koa"), ("./next", None)]


@query(f"SELECT doc_id, nullif({_values([b or '' for _, b in IMPORTS])}[doc_id % {len(IMPORTS)} + 1], '') AS framework FROM documents")
def web_frameworks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.framework(_pick([a for a, _ in IMPORTS], "doc_id")).alias("framework"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) OR (doc_id % 2 = 0 AND doc_id % 6 = 2) THEN true ELSE false END AS skipped FROM documents")
def skipped_at_home(spark, sf_dir):
    """Folders that are skipped anywhere, or only where the root lies in the home folder."""
    path = _pick(["a/node_modules/b.js", "x/.tools/y.ts", "Library/z.py", "Music/a.py", "src/m.go", "lib/q.rs"], "doc_id")
    root = F.when(F.col("doc_id") % 2 == 0, "/home/u/proj").otherwise("/srv/homes")
    return table(spark, sf_dir, "documents").select("doc_id", paths.is_skipped_at(path, root, F.lit("/home/u"), (".tools",)).alias("skipped"))


@query("SELECT p_partkey AS id, p_size * 2 + 1 AS score FROM part WHERE p_size > 1 AND p_type NOT LIKE '%.min.js' ORDER BY score DESC, p_brand, p_partkey LIMIT 5")
def top_complexity(spark, sf_dir):
    """The five most complex symbols of source files, of more than a line."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size") - 1).alias("end_line"), (F.col("p_size") * 2 + 1).alias("score"))
    return joins.most_complex(rows).select("id", "score")


SETUPS = [
    ("package.json,.prettierrc,src", "prettier", "npx prettier --write ."), ("biome.json,.eslintrc.json", "biome,eslint", "npx @biomejs/biome check --write ., npx eslint --fix ."),
    ("go.mod,main.go", "gofmt", "gofmt -w ."), ("Cargo.toml,ruff.toml", "ruff,rustfmt", "ruff format ., cargo fmt"), ("README", "", "npm install --save-dev prettier, npx prettier --write ."),
]


@query(f"SELECT doc_id, {_values([b for _, b, _ in SETUPS])}[doc_id % 5 + 1] AS formatters, {_values([c for *_, c in SETUPS])}[doc_id % 5 + 1] AS commands FROM documents")
def formatter_commands(spark, sf_dir):
    found = texts.formatters(F.split(_pick([a for a, *_ in SETUPS], "doc_id"), ","))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("formatters"), F.array_join(texts.format_commands(found), ", ").alias("commands"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT (['python', 'typescript', 'go', 'rust'])[doc_id % 4 + 1])), ',') AS languages FROM documents GROUP BY source")
def project_languages(spark, sf_dir):
    lang = paths.language(_pick(["a.py", "b.ts", "c.go", "d.rs"], "doc_id"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(lang)), ",").alias("languages"))


@query("SELECT doc_id, nullif(trim(substr(split_part(text, '.', 1), 1, 80)), '') AS description FROM documents WHERE text IS NOT NULL AND trim(substr(split_part(text, '.', 1), 1, 80)) <> ''")
def descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.first_sentence(F.col("text")).alias("description")).filter("description NOT IN ('', '-')")


@query("SELECT l_orderkey AS file, CASE WHEN n > 1 THEN key || '#' || n ELSE key END AS name, line, 'json_key' AS kind FROM (SELECT l_orderkey, l_returnflag AS key, l_linenumber // 3 AS line, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber // 3 ORDER BY l_linenumber) AS n FROM lineitem)")
def json_keys(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("key"), F.expr("l_linenumber div 3").cast("int").alias("line"), F.col("l_linenumber").alias("pos"))
    return joins.repeat_keys(pairs)


@query("WITH c AS (SELECT p_brand AS file, p_partkey AS end_row, unnest([1, 2]) AS pos, p_name AS t FROM part) SELECT 's' || p_partkey AS id, 'b ' || q.p_name AS doc FROM part JOIN (SELECT p_brand, p_partkey + 40 AS line, p_name FROM part) q ON part.p_brand = q.p_brand AND q.line = p_partkey")
def docstrings(spark, sf_dir):
    """The last comment that ends on the line before a symbol, without its marks."""
    parts = table(spark, sf_dir, "part")
    own = parts.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))
    comments = parts.select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 39).alias("end_row"), F.posexplode(F.array(F.concat(F.lit("// a "), "p_name"), F.concat(F.lit("/** b "), "p_name", F.lit(" */")))).alias("pos", "text"))
    return joins.docstrings(comments, own)


PYPROJECT = "[project]\nname = \"x\"\n[project.dependencies]\n# none\n\"numpy\" >= \"1.2\"\nrequests\n\n[tool.x]\na = 1\n"
CARGO = "[package]\nname = \"x\"\n[dependencies]\nserde = \"1.0\"\ntokio = { version = \"1.3\" }\n\n[dev-dependencies]\nz = \"9\"\n"
GO = "module x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/y v0.4.0 // indirect\n)\n"
PACKAGE = '{"dependencies":{"a":"^1"},"devDependencies":{"b":"~2"}}'


@query("SELECT page_id AS file, t.* FROM pages, (VALUES ('cargo', 'serde', '1.0'), ('cargo', 'tokio', '1.3'), ('go', 'github.com/a/b', 'v1.2.3'), ('go', 'golang.org/x/y', 'v0.4.0'), ('package', 'a', '^1'), ('package', 'b', '~2'), ('pyproject', 'numpy', '1.2'), ('pyproject', 'requests', '')) t(manifest, name, version)")
def manifests(spark, sf_dir):
    """The dependencies of manifests of four kinds."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"))
    out = None
    for kind, read, text in (("cargo", records.cargo_dependencies, CARGO), ("go", records.go_requirements, GO), ("package", records.package_dependencies, PACKAGE), ("pyproject", records.pyproject_dependencies, PYPROJECT)):
        rows = read(pages.withColumn("text", F.lit(text))).select("file", F.lit(kind).alias("manifest"), "name", "version")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT printf('%07x', o_orderkey) AS hash, 'order ' || o_orderkey AS subject FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def recent_commits(spark, sf_dir):
    line = F.concat(F.lpad(F.lower(F.hex("o_orderkey")), 7, "0"), F.lit(" order "), F.col("o_orderkey").cast("string"))
    return records.commits(table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("ord"), line.alias("line"))).select("hash", "subject")


@query("WITH e AS (SELECT event_id, ts, event_type <> 'error' AS ok, (value * 10)::BIGINT AS ms FROM events) SELECT event_id, 'error' AS why FROM (SELECT * FROM e WHERE NOT ok ORDER BY ts DESC LIMIT 3) UNION ALL SELECT event_id, 'slow' FROM (SELECT * FROM e WHERE ms > 500 ORDER BY ts DESC LIMIT 3)")
def audit_trail(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") != "error").alias("success"), (F.col("value") * 10).cast("long").alias("durationMs"))
    return records.audit_log(rows).select("event_id", "why")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 5 DAY")
def log_retention(spark, sf_dir):
    """A log appended to and read again, without what is older than five days."""
    import uuid

    from strata.scratch import scratch_root

    rows, path = table(spark, sf_dir, "events").select("event_id", "ts"), f"{scratch_root(spark)}/log-{uuid.uuid4().hex}"
    records.append_log(rows.filter("event_id % 2 = 0"), path)
    records.append_log(rows.filter("event_id % 2 = 1"), path)
    return records.retained(spark.read.schema(rows.schema).json(path), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), 5)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 100 WHEN 2 THEN 100 ELSE 7 END AS max_files FROM documents")
def settings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.setting(_pick(['{"verify":{"maxFiles":20}}', "[1]", "not json", '{"verify":{"maxFiles":7},"x":1}'], "doc_id"), "$.verify.maxFiles", 100).alias("max_files"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events) WHERE event_type = 'purchase' AND coalesce(nt, '') <> 'error') WHERE k <= 3")
def edited_files(spark, sf_dir):
    kind = F.col("event_type")
    return rules.surviving(table(spark, sf_dir, "events"), "user_id", kind == "purchase", kind == "error", 3)


@query("SELECT event_id FROM (SELECT *, max(CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS pending FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)) WHERE pending >= 1 AND event_type = 'purchase' AND value >= 10")
def blocked_edits(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "error", 2).when(kind == "view", 1).otherwise(0)
    return rules.blocked_edits(table(spark, sf_dir, "events"), "user_id", level, kind == "signup", kind == "purchase", F.col("value") < 10)


@query("WITH f AS (SELECT event_id, row_number() OVER w AS number, lag(event_id) OVER w AS b FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, number, CASE WHEN number >= 5 THEN 'strong' WHEN number >= 3 THEN 'targeted' ELSE 'brief' END AS step, CASE WHEN number IN (3, 4) THEN b END AS last_failure FROM f")
def failure_steps(spark, sf_dir):
    return rules.ladder(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error").withColumn("number", F.col("number").cast("long"))


@query("SELECT floor(value / 10)::BIGINT AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 3")
def top_messages(spark, sf_dir):
    """The three most frequent error texts, of all users and days."""
    bad = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.floor(F.col("value") / 10).cast("long").alias("error"))
    return rules.most_frequent(bad, "error", 3)


@query("SELECT user_id, max(ts) AS modified FROM events WHERE user_id <> 7 GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-02-07' - INTERVAL 7 DAY")
def stale_markers(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("modified"))
    return rules.stale_markers(last, F.expr("TIMESTAMP_NTZ '2024-02-07 00:00:00'"), F.lit(7)).select(F.col("session").alias("user_id"), "modified")


@query("SELECT conv_id, turn, CASE WHEN (length(text) - length(replace(text, 'th', ''))) // 2 >= 3 THEN 'impact' ELSE 'verify' END AS hint FROM conversations")
def edit_hints(spark, sf_dir):
    files = F.regexp_replace(F.regexp_replace("text", "[^a-z]|(?<!t)h", " "), "th", " a.ts ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.edit_hint(files).alias("hint"))


@query(f"WITH {GRAPH_SQL}, f AS (SELECT DISTINCT file, string_split(file, '/') AS s FROM symbols WHERE file NOT LIKE 'catalog/%'), w AS (SELECT file, './supply' AS spec, s[1] || '/' || s[2] || '/supply.py' AS p FROM f WHERE file LIKE '%.ts' UNION ALL SELECT file, '../' || s[2] || '/supply', s[1] || '/' || s[2] || '/supply.py' FROM f WHERE file LIKE '%.ts' UNION ALL SELECT file, '../../../out', NULL FROM f WHERE file LIKE '%.ts' UNION ALL SELECT file, '.building', s[1] || '/' || s[2] || '/building.ts' FROM f WHERE file LIKE '%.py' UNION ALL SELECT file, s[1] || '.' || s[2] || '.supply', s[1] || '/' || s[2] || '/supply.py' FROM f WHERE file LIKE '%.py') SELECT w.file, spec, g.file AS target FROM w LEFT JOIN (SELECT DISTINCT file FROM symbols) g ON g.file = p")
def resolved_imports(spark, sf_dir):
    """Relative and dotted imports, some of which lead nowhere."""
    own = symbols(spark, sf_dir)
    f, at = own.filter("file NOT LIKE 'catalog/%'").select("file").distinct(), F.split("file", "/")
    ts = F.array(F.lit("./supply"), F.concat(F.lit("../"), at[1], F.lit("/supply")), F.lit("../../../out"))
    py = F.array(F.lit(".building"), F.concat(at[0], F.lit("."), at[1], F.lit(".supply")))
    return joins.resolved_imports(f.select("file", F.explode(F.when(F.col("file").endswith(".ts"), ts).otherwise(py)).alias("spec")), own)


@query(f"WITH {GRAPH_SQL}, p AS (SELECT DISTINCT file FROM symbols UNION SELECT 'lib/x' || doc_id || (['.ts', '.test.ts', '.md', '.py'])[doc_id % 4 + 1] FROM documents UNION SELECT 'node_modules/x' || doc_id || '.ts' FROM documents UNION SELECT 'tests/x' || doc_id || '.py' FROM documents) SELECT least(count(*) FILTER (file NOT LIKE 'node_modules/%' AND file NOT LIKE '%.md' AND file NOT LIKE '%.test.ts' AND file NOT LIKE 'tests/%'), 500) AS n_files, count(*) FILTER (file NOT LIKE 'node_modules/%' AND file NOT LIKE '%.md' AND file NOT LIKE '%.test.ts' AND file NOT LIKE 'tests/%') > 500 AS truncated, count(*) FILTER (file LIKE '%.test.ts' OR file LIKE 'tests/%') AS n_tests FROM p")
def scan_report(spark, sf_dir):
    """A scan of 500 files at most."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    more = d.select(F.explode(F.array(F.concat(F.lit("lib/x"), key, _pick([".ts", ".test.ts", ".md", ".py"], "doc_id")), F.concat(F.lit("node_modules/x"), key, F.lit(".ts")), F.concat(F.lit("tests/x"), key, F.lit(".py")))).alias("file"))
    return joins.scan_report(symbols(spark, sf_dir).select("file").union(more).distinct(), 500)


@query("SELECT * FROM (VALUES ('python', 'loaded', false), ('typescript', 'degraded', true), ('go', 'unavailable', true)) t(language, status, warn)")
def parser_status(spark, sf_dir):
    parsers = spark.createDataFrame([("python", "loaded"), ("typescript", "degraded"), ("rust", "loaded")], "language string, status string")
    return joins.parser_status(symbols(spark, sf_dir), parsers)


@query(f"WITH {GRAPH_SQL}, a AS (SELECT id AS argument, CASE line % 3 WHEN 0 THEN name WHEN 1 THEN file ELSE 'none' || line END AS x FROM symbols) SELECT argument, CASE WHEN x IN (SELECT name FROM symbols) THEN 'symbol' WHEN x IN (SELECT file FROM symbols) THEN 'file' ELSE 'error' END AS mode FROM a")
def argument_modes(spark, sf_dir):
    """Whether what is asked about is a symbol, a file or neither."""
    own = symbols(spark, sf_dir)
    x = F.when(F.col("line") % 3 == 0, F.col("name")).when(F.col("line") % 3 == 1, F.col("file")).otherwise(F.concat(F.lit("none"), F.col("line").cast("string")))
    names = own.select(F.col("name").alias("x"), F.lit(True).alias("_name")).distinct()
    files = own.select(F.col("file").alias("x"), F.lit(True).alias("_file")).distinct()
    asked = own.select(F.col("id").alias("argument"), x.alias("x")).join(names, "x", "left").join(files, "x", "left")
    return asked.select("argument", paths.argument_mode(F.col("x"), F.col("_file").isNotNull(), F.col("_name").isNotNull()).alias("mode"))


@query("WITH n AS (SELECT l_suppkey AS id, count(DISTINCT l_partkey) AS callers FROM lineitem GROUP BY l_suppkey), top AS (SELECT * FROM n ORDER BY callers DESC, id LIMIT 5), e AS (SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 5) SELECT 'Verdict: ' || CASE WHEN (SELECT count(*) FROM labels WHERE toxic = 1) > 0 THEN 'FAIL' ELSE 'PASS' END || chr(10) || 'Errors: ' || (SELECT count(*) FROM labels WHERE toxic = 1) || ', warnings: ' || (SELECT count(*) FROM labels WHERE toxic = 0 AND quality = 0) || chr(10) || 'Changed files: ' || (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) || chr(10) || (SELECT string_agg('- f' || doc_id, chr(10) ORDER BY doc_id) FROM e) || chr(10) || (SELECT string_agg('- supp::' || id || ' ' || callers || CASE WHEN callers >= 10 THEN ' top' ELSE '' END, chr(10) ORDER BY callers DESC, id) FROM top) AS comment")
def verify_comment(spark, sf_dir):
    """A comment for a review: verdict, counts, the first errors, how many files changed, and the most called symbols."""
    labels = table(spark, sf_dir, "labels")
    counts = labels.agg(F.count_if(F.col("toxic") == 1).alias("errors"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 0)).alias("warnings"))
    changed = table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").agg(F.count(F.lit(1)).alias("changed"))
    callers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_distinct("l_partkey").alias("callers"))
    return records.review_comment(counts, changed, labels.filter("toxic = 1").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.col("doc_id").alias("ord")), callers.select(F.concat(F.lit("supp::"), F.col("id").cast("string")).alias("symbol"), "callers", F.col("id").alias("ord")))


@query(f"""WITH RECURSIVE v AS (SELECT *, sum((event_type = 'signup')::INT) OVER w AS island, max(ts) FILTER (event_type = 'signup') OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT user_id, island, min((ts, event_id)) AS p FROM v WHERE event_type = 'purchase' AND (c IS NULL OR date_diff('microsecond', c, ts) > 300000000) GROUP BY user_id, island), e AS (SELECT user_id AS k, struct_extract(p, 1) AS ts, struct_extract(p, 2) AS event_id FROM o), f AS (SELECT k, min((ts, event_id)) AS p FROM e GROUP BY k),
r(k, ts, event_id) AS (SELECT k, struct_extract(p, 1), struct_extract(p, 2) FROM f UNION ALL SELECT k, struct_extract(p, 1), struct_extract(p, 2) FROM (SELECT r.k, min((e.ts, e.event_id)) AS p FROM r JOIN e ON e.k = r.k AND date_diff('microsecond', r.ts, e.ts) >= 60000000 GROUP BY r.k, r.ts, r.event_id)) SELECT k AS user_id, event_id FROM r""")
def turn_reminder_once(spark, sf_dir):
    """Reminders at edits without a check in the last five minutes: one until the next check, and a minute apart."""
    kind = F.col("event_type")
    return rules.reminders(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "user_id", kind == "signup", kind == "purchase")
