"""Predicates and projections of paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of files that are not source, of test files, and names of directories that are skipped.
NON_SOURCE = [
    r"package-lock\.json$", r"^package\.json$", r"(?:^|/)tsconfig[^/]*\.json$", r"node_modules(?:/|$)", r"(?:^|/)dist(?:/|$)", r"(?:^|/)build(?:/|$)",
    r"(?:^|/)out(?:/|$)", r"(?:^|/)target(?:/|$)", r"\.json$", r"(?:^|/)vendor(?:/|$)", r"\.min\.(?:js|css|mjs|cjs)$", r"\.generated\.", r"\.bundle\.(?:js|css|mjs)$",
]
TEST_FILE = [
    r"\.(test|spec|e2e)\.(ts|js|tsx|jsx|mts|mjs|cjs|cts)$", r"(?:^|/)(?:test_[^/]+\.py|[^/]+_test\.py)$", r"(?:^|/)[^/]+_test\.go$",
    r"(?:^|/)(?:test_[^/]+\.rs|[^/]+_test\.rs)$", r"(?:^|[/.])tests?/", r"(?:^|[/.])__tests?/", r"\.test\.[a-z]+$", r"\.spec\.[a-z]+$",
    r"(?:^|[/.])test_[a-z_]+\.[a-z]+$", r"_test\.[a-z]+$",
]
TEST_DIRS = ["__tests__", "__test__", "test", "tests", "spec"]
SKIP_DIRS = [
    "node_modules", "bower_components", "vendor", "dist", "build", "out", "target", ".git", ".cache", ".worktrees", "__pycache__", "coverage", ".nyc_output",
    "tmp", "temp", ".venv", "venv", ".tox", ".next", ".nuxt", ".turbo", ".vercel", ".yarn", ".idea", ".vscode",
]
ALLOWED_DOT_DIRS = [".github", ".husky", ".vscode", ".claude"]
LANGUAGE = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".dart": "dart", ".json": "json",
}
FILE_EXTENSIONS = "ts|tsx|js|jsx|py|go|rs|dart|json|yaml|yml|mjs|cjs|rb|java|cs|c|cpp|h|hpp|css|scss|less|sh|bash|toml|html|htm|md"
DUNDERS = [
    "__init__", "__str__", "__repr__", "__len__", "__iter__", "__getitem__", "__setitem__", "__call__", "__enter__", "__exit__", "__aenter__", "__aexit__",
    "__anext__", "__aiter__", "__main__",
]
RUST_TRAITS = [
    "From", "Into", "TryFrom", "TryInto", "Display", "Debug", "Clone", "Copy", "Hash", "Eq", "PartialEq", "Ord", "PartialOrd", "Serialize", "Deserialize",
    "Iterator", "IntoIterator", "FromStr", "AsRef", "AsMut", "Deref", "DerefMut", "Fn", "FnMut", "FnOnce", "Send", "Sync", "Error", "Default", "Drop",
]
RUST_SERVICE = ["new", "run", "serve", "from_request", "into_response", "call", "poll_ready", "handle", "next"]


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_non_source(path: Column) -> Column:
    return slashes(path).rlike("|".join(NON_SOURCE))


def is_test_file(path: Column) -> Column:
    """As a scan sees it: any test pattern, or a segment that is a test directory."""
    return slashes(path).rlike("|".join(TEST_FILE)) | F.arrays_overlap(F.split(slashes(path), "/"), F.array(*map(F.lit, TEST_DIRS)))


def is_test_path(path: Column) -> Column:
    """As impact analysis sees it, on purpose another rule."""
    return path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__") | path.startswith("tests/")


def is_skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(slashes(path), "/"), F.array(*map(F.lit, SKIP_DIRS)))


def is_trackable(path: Column) -> Column:
    """Neither non-source nor under a skipped or, but for a few, a dot directory."""
    hidden = F.exists(F.split(slashes(path), "/"), lambda s: s.startswith(".") & ~s.isin(ALLOWED_DOT_DIRS))
    return ~is_non_source(path) & ~is_skipped(path) & ~hidden


def language(path: Column) -> Column:
    """The language of a path's extension; null if it has none that is known."""
    pairs = [F.lit(x) for kv in LANGUAGE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))


def module(path: Column) -> Column:
    """The first two segments; (root) for a path without a slash."""
    return F.when(path.contains("/"), F.concat_ws("/", F.slice(F.split(path, "/"), 1, 2))).otherwise("(root)")


def is_file_path(name: Column) -> Column:
    return name.contains("/") | name.contains("\\") | name.rlike(rf"\.({FILE_EXTENSIONS})$")


def is_natural_language(query: Column) -> Column:
    q = F.trim(query)
    return (q != "") & (q.rlike(r"\s") | q.rlike("(?i)^(how|what|where|why|who|when|which)") | q.rlike("^[a-z][a-z0-9 ]{10,}$"))


def is_registration(name: Column) -> Column:
    return name.startswith("register") | name.startswith("createTool") | name.isin("execute", "handler")


def is_entry_point(name: Column, kind: Column) -> Column:
    tests = name.startswith("test_") | name.startswith("Test")
    return name.isin(DUNDERS) | (name.isin("main", "init") & (kind == "function")) | (kind.isin("impl", "trait") & name.isin(RUST_TRAITS)) | (kind == "module") | tests


def is_framework_handler(name: Column, kind: Column, file: Column) -> Column:
    starts = [name.startswith(x) for x in ("test_", "Test", "handle_", "on_", "middleware")]
    out = name.endswith("_handler") | name.endswith("Handler") | (file.endswith(".rs") & (kind == "function") & name.isin(RUST_SERVICE))
    for s in starts:
        out = out | s
    return out


def is_wrapper(name: Column, kind: Column) -> Column:
    return ((kind == "function") & (name == "_require")) | (kind.isin("variable", "const") & name.isin("__filename", "__dirname"))


def normalized(path: Column) -> Column:
    """Git-Bash (/c/x) and WSL (/mnt/c/x) paths as C:/x, backslashes as slashes."""
    p = F.regexp_replace(slashes(path), "^/mnt/([a-zA-Z])/", "$1:/")
    return F.regexp_replace(p, "^/([a-zA-Z])/", "$1:/")


def containment(path: Column) -> Column:
    """traversal, missing or ok of a path relative to a root."""
    return F.when(path.isNull() | (F.trim(path) == ""), "missing").when(F.array_contains(F.split(slashes(path), "/"), "..") | slashes(path).startswith("/"), "traversal").otherwise("ok")


def distance(a: Column, b: Column, cutoff: int = 3) -> Column:
    """Edit distance; cutoff + 1 beyond the cutoff."""
    d = F.levenshtein(a, b, cutoff)
    return F.when(d < 0, cutoff + 1).otherwise(d)


def cache_key(path: Column) -> Column:
    """Last segment, _ and the first 8 hex digits of the path's SHA-256."""
    return F.concat(F.substring_index(path, "/", -1), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8))

# Folders of a home directory that aren't source, web frameworks, names by which routes are registered.
HOME_SKIP_DIRS = [
    "snap", ".Trash", "Library", "Applications", "Movies", "Music", "Pictures", "Desktop", "Documents", "Downloads", "Public", "Application Data", "My Documents",
    "Favorites", "Links", "Searches", "Videos", "OneDrive",
]
FRAMEWORKS = ["express", "fastify", "koa", "next", "nuxt", "hapi", "restify", "sveltekit", "remix", "hono", "elysia", "nestjs", "@nestjs/core"]
ROUTES = [
    "app.get", "app.post", "app.put", "app.delete", "app.patch", "app.all", "app.use", "app.route", "router.get", "router.post", "router.put", "router.delete",
    "router.patch", "server.get", "server.post",
]


def is_skipped_at(path: Column, root: Column, home: Column, more: tuple[str, ...] = ()) -> Column:
    """As is_skipped, with `more` folders of tools; where the root lies in the home folder, its own folders are skipped too."""
    at_home = (root == home) | root.startswith(F.concat(home, F.lit("/")))
    parts = F.split(slashes(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, [*SKIP_DIRS, *more]))) | (at_home & F.arrays_overlap(parts, F.array(*map(F.lit, HOME_SKIP_DIRS))))


def matches_filter(file: Column, text: str) -> Column:
    """Files whose path has the text and that are source; an empty text takes all."""
    return F.lit(True) if not text else file.contains(text) & ~is_non_source(file)


def entry_category(name: Column, kind: Column, file: Column, visibility: Column) -> Column:
    """cli for main functions and the commands of Python tools, event for listeners of scripts, else null."""
    lang = language(file)
    cli = ((kind == "function") & (name == "main")) | ((lang == "python") & name.isin("command", "group", "cli") & ((visibility == "exported") | (kind == "function")))
    event = lang.isin("javascript", "typescript", "tsx") & (name.startswith("on") | name.contains("Listener") | name.contains("Handler") | name.contains("Event"))
    return F.when(cli, "cli").when(event, "event")


def framework(module: Column) -> Column:
    """The web framework that an import names, by itself or followed by / or -; null if none."""
    lower, out = F.lower(module), None
    for name in FRAMEWORKS:
        test = (lower == name) | lower.startswith(name + "/") | lower.startswith(name + "-")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def is_route(name: Column) -> Column:
    """A name by which a route is registered, one that ends in its verb, or that of a handler or controller."""
    lower = F.lower(name)
    verbs = "|".join(sorted({r.split(".")[1] for r in ROUTES}))
    return lower.isin(ROUTES) | lower.rlike(rf"\.({verbs})$") | lower.startswith("handle") | lower.endswith("handler") | lower.endswith("controller")


def ancestors(path: Column, most: int = 50) -> Column:
    """The folders above a path, the nearest first, `.` for the root; `most` at most."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.slice(up, 1, most)


def file_uri(path: Column) -> Column:
    """An absolute path as a file:// address; C:/x becomes file:///C:/x."""
    p = slashes(path)
    parts = F.transform(F.split(p, "/"), lambda x: F.regexp_replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), "^([A-Za-z])%3A$", "$1:"))
    return F.concat(F.when(p.startswith("/"), "file://").otherwise("file:///"), F.array_join(parts, "/"))


def uri_path(uri: Column) -> Column:
    """The path of a file:// address, drives without the slash before them; anything else as it is."""
    plain = F.url_decode(F.replace(F.substring(uri, 8, 1 << 30), F.lit("+"), F.lit("%2B")))
    rooted = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))
    return F.when(uri.startswith("file://"), F.regexp_replace(rooted, "^/([A-Za-z]:)", "$1")).otherwise(uri)


def resolved(file: Column, spec: Column) -> Column:
    """The path that a relative spec means in a file: . and .. taken away; null where it leads out of the root."""
    parts = F.filter(F.concat(F.slice(F.split(file, "/"), F.lit(1), F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0))), F.split(spec, "/")), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, part: Column) -> Column:
        up = F.struct(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["inside"] & (F.size(acc["at"]) > 0)).alias("inside"))
        return F.when(part == "..", up).otherwise(F.struct(F.concat(acc["at"], F.array(part)).alias("at"), acc["inside"].alias("inside")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["inside"], F.array_join(acc["at"], "/")))


def argument_mode(argument: Column, is_file: Column, is_name: Column) -> Column:
    """What an argument of the impact tool names: a symbol, a file that no symbol is called like, or nothing known."""
    return F.when(is_name, "symbol").when(is_file, "file").otherwise("error")
