"""Scalar functions of texts: redaction, classification, complexity, codecs, decision rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets, of failures that lie in the infrastructure, and words by which texts are classified.
SECRETS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)(?:[a-z][a-z0-9+\-.]*)://[^:@\s\"']+:[^@\s\"']+@",
    r"(?i)bearer\s+[A-Za-z0-9_\-+=]{20,}",
    r"(?i)(?:token|secret|password|key|credential|auth)\s*[:=]\s*[\"'\w-]{8,}",
    r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}",
    r"(?i)(?:xox[abspr]-\d+-\d+-\d+-[a-f0-9]+)",
    r"AKIA[0-9A-Z]{16}",
    r"(?:sk|rk)-[a-zA-Z0-9]{24,}",
    r"(?:eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,})",
    r"glpat-[\w-]{20,}",
    r"AIza[\w-]{35}",
    r"SG\.[\w-]{22,}",
    r"SK[\w-]{32,}",
]
OPEN_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*\z"
INFRASTRUCTURE = [r"cannot find (module|name)", r"property .* does not exist on type '\{\}'", r"cannot find name 'node:", r"implicitly has an 'any' type"]
ERRORS = [
    ("file not found", ["file not found", "enoent"]),
    ("permission denied", ["permission", "eacces"]),
    ("network issue", ["network", "enotfound", "econnrefused"]),
    ("type or syntax error", ["type error", "syntax error", "typecheck"]),
    ("timeout", ["timeout", "timed out"]),
]
BRANCHES = r"\b(if|else|for|while|case|catch)\b|&&|\|\||\?(?::|=)"
CONTEXT_FILES = r"(?i)(?:/[\w.-]+|[\w.-]+/(?:[\w.-]+/)*[\w.-]+)\.(?:tsx?|jsx?|mjs|cjs|py|go|rs|java|cs|rb|swift|kt|kts|c|cpp|cc|cxx|h|hpp|hh|hxx|vue|svelte|css|scss|less|html|json|ya?ml|md|toml|xml|sql|sh|bash|proto|graphql|prisma)\b"
HIGH_RISK = ["dd if=", "mkfs", "mkswap", "fdisk", "parted", "sfdisk"]
ROOT_REMOVAL = r"(^|[\s;|&])rm\s+(-(rf|fr|r\s*f)|--recursive\s+--force|--force\s+--recursive)(\s+--)?\s+[\"']?/(\*|\s|\"|;|'|$)"
MEDIUM_RISK = ["chmod -r 777", "chmod 777 /", "chown -r", "> /dev/sd", "> /dev/nvme", "> /dev/mmcblk", "pvcreate", "vgcreate", "lvcreate", "iptables -f", "iptables -p", "rm -r /"]
SERIOUS = r"(?i)(P0|security|crash|panic|auth.bypass|data.loss)"
WEIGHTY = r"(?i)(P1|fix:|bug|race.condition|logic.error|regression|refactor|extract|dedup|rename|move)"
EDGE_KINDS = {"call": 0, "type": 1, "import": 2, "ref": 3, "typeRef": 4, "import-binding": 5}
PROVENANCE = {"resolved": 0, "name_match": 1, "heuristic": 2, "unresolved": 3}
REDACTED = "[REDACTED]"


def redacted(text: Column) -> Column:
    """Secrets as [REDACTED]; a key block without an end goes up to the end of the text."""
    out = F.regexp_replace(text, SECRETS[0], REDACTED)
    out = F.regexp_replace(out, OPEN_KEY, REDACTED)
    return reduce(lambda c, p: F.regexp_replace(c, p, REDACTED), SECRETS[1:], out)


def token_estimate(text: Column) -> Column:
    """Half the length in 16-bit units, rounded up: a character beyond the first 65 536 counts twice."""
    return F.ceil((F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))) / 2).cast("long")


def regex_complexity(body: Column) -> Column:
    return F.regexp_count(body, F.lit(BRANCHES)) + 1


def error_class(message: Column) -> Column:
    lower, out = F.lower(message), None
    for name, words in ERRORS:
        test = reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def context_score(prompt: Column, tool_prefix: str = "graph_") -> Column:
    """How many of four kinds of context a prompt has: files, symbols in backticks, file:line, mentions of a tool."""
    tests = [CONTEXT_FILES, r"`[^`\s]+`", r"(?i)[\w.-]+\.[a-z]{1,8}:\d+([-–]\d+)?\b", rf"(?i){tool_prefix}"]
    return reduce(lambda a, b: a + b, [prompt.rlike(t).cast("int") for t in tests])


def is_infrastructure(message: Column) -> Column:
    return message.rlike("(?i)" + "|".join(INFRASTRUCTURE))


def command_risk(command: Column) -> Column:
    """high, medium or none; letter case never matters."""
    plain = F.regexp_replace(F.trim(command), r"\s+", " ")
    lower = F.lower(plain)
    high = reduce(lambda a, b: a | b, [lower.contains(p) for p in HIGH_RISK]) | lower.rlike(ROOT_REMOVAL)
    return F.when(high, "high").when(reduce(lambda a, b: a | b, [lower.contains(p) for p in MEDIUM_RISK]), "medium").otherwise("none")


def issue_level(text: Column) -> Column:
    return F.when(text.rlike(SERIOUS), 2).when(text.rlike(WEIGHTY), 1).otherwise(0)


def code_of(value: Column, codes: dict[str, int], default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), value), F.lit(default))


def risk(mode: str, files: Column, symbols: Column, new_orphans: Column, orphan_delta: Column, pre_commit: bool = False) -> Column:
    """low, medium or high: impact by files and symbols, verify and changes by files and orphans."""
    if mode == "impact":
        return F.when((files > 10) | (symbols > 30), "high").when((files > 3) | (symbols > 10), "medium").otherwise("low")
    total = files + orphan_delta
    high, medium = (30, 10) if pre_commit else (60, 20)
    return F.when((total > high) | (new_orphans > 10), "high").when((total > medium) | (new_orphans > 0), "medium").otherwise("low")


def verdict(mode: str, errors: Column, missing: Column, risk_level: Column, failures: Column, pre_commit: bool = False) -> Column:
    """PASS, WARN or FAIL by the rules of the text, the JSON or the synchronous report."""
    failed, open_ = errors > 0, failures > 0
    if mode == "text":
        return F.when(failed, "FAIL").when(missing | (risk_level == "high") | open_, "WARN").otherwise("PASS")
    if mode == "json":
        blocked = F.lit(pre_commit) & (risk_level != "low")
        return F.when(failed, "FAIL").when(missing, "WARN").when(blocked, "FAIL").when(open_, "WARN").otherwise("PASS")
    return F.when(failed | (risk_level == "high"), "FAIL").otherwise("PASS")


def summarized(value: Column) -> Column:
    """Strings over 200 characters as [n chars]."""
    return F.when(F.length(value) > 200, F.concat(F.lit("["), F.length(value).cast("string"), F.lit(" chars]"))).otherwise(value)


def markdown_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`"))


def mermaid_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")


# Numbers of the language server protocol, marks of a failed report and of test runners, tools by shell command.
SEVERITIES = {1: "error", 2: "warning", 3: "info", 4: "hint"}
SYMBOL_KINDS = [
    "file", "module", "namespace", "package", "class", "method", "property", "field", "constructor", "enum", "interface", "function", "variable", "constant",
    "string", "number", "boolean", "array", "object", "key", "null", "enum_member", "struct", "event", "operator", "type_parameter",
]
FAILED = [r"(?i)\[FAIL\]", r"(?i)Verdict:\s*FAIL", r"(?i)risk\s*[:=]\s*['\"]?\*\*high\*\*", r"Errors:\s*([1-9]\d*)"]
TEST_RUN = r"(?m)(test result:|Tests:\s+[0-9]+|Test Files:\s+[0-9]+|FAILED|PASS|pytest|^ok\s+[0-9]+|^[0-9]+\.\.[0-9]+)"
COMMAND_HINTS = [
    ("lookup", r"(^|\s)(grep|rg)\s.*\.(ts|js|py|rs|go|java|tsx|jsx|vue|svelte|dart)"),
    ("lookup", r"(^|\s)(cat|head|tail|less)\s.*\.(ts|js|py|rs|go|java|tsx|jsx|dart)"),
    ("overview", r"(^|\s)(ls|tree|find\s+\.)\s"),
    ("overview", r"(^|\s)git\s+(status|log|diff|show)"),
    ("overview", r"(npm\s+(ls|list)|pip3?\s+(list|show|freeze)|uv\s+(pip|tree)|cargo\s+tree|pnpm\s+(ls|list))"),
    ("tests", r"(npm\s+(test|tst)|pnpm\s+test|yarn\s+test|pytest|cargo\s+test|vitest|jest)"),
    ("lookup", r"(?i)(class|interface|extends|implements|abstract|inheritance)"),
    ("impact", r"(?i)(rename|refactor|extract|change\s+signature)"),
    ("lookup", r"(^|\s)rm\s.*\.(ts|js|py|rs|go|dart)"),
    ("lookup", r"(?i)(grep|rg|cat|head).*(type|interface|signature|typedef)"),
    ("format", r"(eslint|prettier|ruff\s+(check|format)|cargo\s+(fmt|clippy)|gofmt|golint)"),
    ("overview", r"(?i)(slow|bottleneck|optimize|performance|hot|critical|frequent|complexity)"),
    ("impact", r"(sed|awk|tee|cat.*EOF|>>)"),
]
SOURCES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust",
    "dart": "dart", "json": "json",
}
FORMAT_COMMANDS = [
    ("prettier", "npx prettier --write ."), ("biome", "npx @biomejs/biome check --write ."), ("eslint", "npx eslint --fix ."), ("ruff", "ruff format ."),
    ("rustfmt", "cargo fmt"), ("gofmt", "gofmt -w ."),
]
FORMAT_FILES = {
    "prettier": [".prettierrc", ".prettierrc.json", ".prettierrc.js", "prettier.config.js", "prettier.config.mjs"],
    "eslint": [".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yaml", ".eslintrc.yml", "eslint.config.js", "eslint.config.mjs"],
    "biome": ["biome.json", "biome.jsonc"], "editorconfig": [".editorconfig"], "ruff": ["ruff.toml"], "rustfmt": ["rustfmt.toml", ".rustfmt.toml", "Cargo.toml"], "gofmt": ["go.mod"],
}


def compact_diagnostic(file: Column, line: Column, col: Column, severity: Column, code: Column, message: Column) -> Column:
    """`file:line:col  ERR CODE  message (language)`; the code goes where there is none."""
    short = F.when(severity == "error", "ERR").when(severity == "warning", "WRN").when(severity == "info", "INF").otherwise("HNT")
    ext = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    source = F.when(ext == "", "lsp").otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), ext), ext))
    shown = F.when(F.coalesce(code, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), code))
    return F.concat(F.concat_ws(":", file, line.cast("string"), col.cast("string")), F.lit("  "), short, shown, F.lit("  "), message, F.lit(" ("), source, F.lit(")"))


def local_stamp(ts: Column) -> Column:
    """A time in the session's zone with its offset in numbers."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssZ")


def summarized_json(value: Column) -> Column:
    """A map of JSON texts for a log: strings over 200 characters as [n chars], arrays as [n items], objects within likewise."""
    size = F.json_array_length(value)
    inner = F.transform_values(F.from_json(value, "map<string,string>"), lambda _, v: F.when(F.json_array_length(v).isNotNull(), F.concat(F.lit("["), F.json_array_length(v).cast("string"), F.lit(" items]"))).otherwise(summarized(v)))
    return F.when(size.isNotNull(), F.concat(F.lit("["), size.cast("string"), F.lit(" items]"))).when(value.startswith("{"), F.to_json(inner)).otherwise(summarized(value))


def report_passed(content: Column) -> Column:
    """Whether a report says that all is well: a JSON one by its verdict PASS only, a text by no mark of failure; no content doesn't."""
    verdict = F.coalesce(F.get_json_object(content, "$.result.verdict"), F.get_json_object(content, "$.verdict"))
    structured = F.try_parse_json(content).isNotNull()
    failed = reduce(lambda a, b: a | b, [content.rlike(p) for p in FAILED])
    return F.when(F.coalesce(content, F.lit("")) == "", False).when(structured, F.coalesce(verdict == "PASS", F.lit(False))).otherwise(~failed)


def test_summary(output: Column) -> Column:
    """The last five lines that aren't empty of a test run's output of 30 lines or more, if that is 300 characters at most; else null."""
    rows = F.split(F.regexp_replace(output, "\n+$", ""), "\n")
    full = F.filter(rows, lambda x: x != "")
    last = F.rtrim(F.array_join(F.slice(full, -F.least(F.size(full), F.lit(5)), 5), " "))
    return F.when((F.size(rows) >= 30) & output.rlike(TEST_RUN) & (F.size(full) > 0) & (F.length(last) <= 300), last)


def command_key(command: Column) -> Column:
    """The MD5 of a command without its timeouts, names of temporary files and repeated spaces."""
    plain = F.regexp_replace(F.regexp_replace(command, "timeout [0-9]*", "timeout <N>"), r"/tmp/[a-zA-Z0-9_.-]*", "/tmp/<tmp>")
    return F.md5(F.trim(F.regexp_replace(plain, r"\s+", " ")).cast("binary"))


def command_hint(command: Column) -> Column:
    """The tool that serves better than a shell command, by the first pattern that fits; null if none does."""
    out = None
    for tool, pattern in COMMAND_HINTS:
        out = F.when(command.rlike(pattern), tool) if out is None else out.when(command.rlike(pattern), tool)
    return out


def edit_hint(output: Column) -> Column:
    """impact after an edit whose output names three files or more, else verify."""
    return F.when(F.regexp_count(output, F.lit(r"[a-zA-Z0-9_./-]+\.[a-zA-Z]{1,5}")) >= 3, "impact").otherwise("verify")


def severity_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), code), F.lit("hint"))


def symbol_kind_name(code: Column) -> Column:
    """The name of a protocol symbol kind, 1 to 26; variable for others."""
    return F.coalesce(F.get(F.array(*map(F.lit, SYMBOL_KINDS)), code - 1), F.lit("variable"))


def first_sentence(doc: Column) -> Column:
    """Up to the first full stop, 80 characters at most; - where there is no text."""
    return F.coalesce(F.trim(F.substring(F.split_part(doc, F.lit("."), F.lit(1)), 1, 80)), F.lit("-"))


def formatters(files: Column) -> Column:
    """The formatters that a folder's files (an array of names) configure, sorted."""
    tests = [F.when(F.arrays_overlap(files, F.array(*map(F.lit, own))), name) for name, own in FORMAT_FILES.items()]
    return F.array_sort(F.array_compact(F.array(*tests)))


def format_commands(found: Column) -> Column:
    """What to run for the formatters found, in their fixed order; how to get one where there is none."""
    commands = F.array_compact(F.array(*[F.when(F.array_contains(found, name), command) for name, command in FORMAT_COMMANDS]))
    return F.when(F.size(found) == 0, F.array(F.lit("npm install --save-dev prettier"), F.lit("npx prettier --write ."))).otherwise(commands)


def new_since(now: Column, baseline: Column) -> Column:
    """How many there are more than in a baseline, or all where there is none."""
    return F.when(baseline.isNull(), now).otherwise(F.greatest(now - baseline, F.lit(0)))
