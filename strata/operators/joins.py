"""Joins of facts to symbols: interval joins, ordered first matches, anti and semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import paths

# What a module name may end in, and the files that stand for a folder.
MODULE_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs"]
INDEX_FILES = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs"]


def innermost(spans: DataFrame, sites: DataFrame) -> DataFrame:
    """(file, site, id): for each site (file, site) the span (id, file, line, end_line) of its file that holds it and ends
    soonest after its start; of equals the one that starts later, then the greater id.

    An equal join on the file with a range condition; the best span is an aggregate, which is combined before it travels.
    """
    on = (sites["file"] == spans["file"]) & (spans["line"] <= sites["site"]) & (sites["site"] <= spans["end_line"])
    best = F.max(F.struct(-(F.col("end_line") - F.col("line")), "line", "id"))
    return sites.join(spans, on).groupBy(sites["file"], sites["site"]).agg(best["id"].alias("id"))


def within_spans(spans: DataFrame, sites: DataFrame, at: str) -> DataFrame:
    """spans (file, line, end_line, ...) with the sites (file, at, ...) of their file that lie in them: an inner join.

    A span belongs to the bins that it touches, two as a rule, among those as wide as itself, up to the next power of two; a
    site to its bin of each width there is. So a site meets the spans about it only, however many its file has.
    """
    level = F.ceil(F.log2((F.col("end_line") - F.col("line") + 1).cast("double"))).cast("int")
    binned = spans.filter("end_line >= line").withColumn("_level", level).withColumn("_bin", F.explode(F.expr("sequence(shiftright(bigint(line), _level), shiftright(bigint(end_line), _level))")))
    widths = F.broadcast(binned.select("_level").distinct())  # 64 at most
    placed = sites.withColumnRenamed("file", "_file").crossJoin(widths.withColumnRenamed("_level", "_width")).withColumn("_slot", F.expr(f"shiftright(bigint(`{at}`), _width)"))
    on = (F.col("file") == F.col("_file")) & (F.col("_level") == F.col("_width")) & (F.col("_bin") == F.col("_slot")) & F.col(at).between(F.col("line"), F.col("end_line"))
    return binned.join(placed, on).drop("_level", "_bin", "_file", "_width", "_slot")


def members(containers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(container, member): symbols whose line lies in a container's span in the same file, itself excluded."""
    c = containers.select(F.col("id").alias("container"), F.col("file").alias("_file"), F.col("line").alias("_from"), F.col("end_line").alias("_to"))
    on = (F.col("file") == F.col("_file")) & F.col("line").between(F.col("_from"), F.col("_to")) & (F.col("id") != F.col("container"))
    return symbols.join(c, on).select("container", F.col("id").alias("member"))


def first_match(wanted: DataFrame, candidates: Column, known: DataFrame) -> DataFrame:
    """wanted's columns and `target`: the first of an array of candidate paths that known (file) has; null if none."""
    keyed = wanted.withColumn("_row", F.struct(*wanted.columns))
    tries = keyed.select("_row", F.posexplode(candidates).alias("_at", "_path"))
    hits = tries.join(known.select(F.col("file").alias("_path")).distinct(), "_path").groupBy("_row").agg(F.min_by("_path", "_at").alias("target"))
    return keyed.join(hits, "_row", "left").select(*wanted.columns, "target")


def module_candidates(module: Column) -> Column:
    """The paths that a module name may stand for: itself, with an extension, or an index file in it."""
    direct = [F.concat(module, F.lit(s)) for s in MODULE_SUFFIXES]
    return F.array(*direct, *[F.concat(module, F.lit(f"/index.{s}")) for s in INDEX_FILES])


def name_edges(calls: DataFrame, symbols: DataFrame, kind: str, weight: float, confidence: float) -> DataFrame:
    """Edges from callers (source, name) to every symbol of that name but the caller itself."""
    targets = symbols.select(F.col("id").alias("target"), "name")
    out = calls.join(targets, "name").filter("source <> target").select("source", "target").distinct()
    return out.select("source", "target", F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"))


def local_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from referrers (source, file, name) to the first symbol (by line, then id) of that name in the same file."""
    first = symbols.groupBy("file", "name").agg(F.min(F.struct("line", "id"))["id"].alias("target"))
    out = refs.join(first, ["file", "name"]).filter("source <> target").select("source", "target").distinct()
    return out.select("source", "target", F.lit("ref").alias("kind"), F.lit(0.5).alias("weight"), F.lit(0.9).alias("confidence"))


def binding_edges(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from the local symbol (file, local_name) to the symbol imported_name of the target file."""
    local = symbols.select(F.col("id").alias("source"), "file", F.col("name").alias("local_name"))
    far = symbols.select(F.col("id").alias("target"), F.col("file").alias("target_file"), F.col("name").alias("imported_name"))
    out = bindings.join(local, ["file", "local_name"]).join(far, ["target_file", "imported_name"]).select("source", "target").distinct()
    return out.select("source", "target", F.lit("import-binding").alias("kind"), F.lit(0.8).alias("weight"), F.lit(1.0).alias("confidence"))


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from each symbol of a file to each of a file that it imports (file, target): as many as both have, by definition."""
    a = symbols.select(F.col("id").alias("source"), "file")
    b = symbols.select(F.col("id").alias("_to"), F.col("file").alias("target"))
    out = imports.select("file", "target").distinct().join(a, "file").join(b, "target").select("source", F.col("_to").alias("target"))
    return out.select("source", "target", F.lit("import").alias("kind"), F.lit(0.3).alias("weight"), F.lit(0.5).alias("confidence"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each source, target and kind: the least by ord, then by its other columns."""
    rest = [c for c in edges.columns if c not in ("source", "target", "kind", "ord")]
    return edges.groupBy("source", "target", "kind").agg(F.min(F.struct("ord", *rest)).alias("_e")).select("source", "target", "kind", "_e.*")


def orphans(symbols: DataFrame, edges: DataFrame, facts: DataFrame, side_effects: DataFrame | None = None) -> DataFrame:
    """Symbols without incoming edge and without use (facts: file, name) in their own file, less those that are called from
    outside by convention: exported ones, types, tests, entry points, handlers and the like; side_effects (file) are files
    imported for their effects only.
    """
    name, kind, file = F.col("name"), F.col("kind"), F.col("file")
    component = (file.endswith(".tsx") | file.endswith(".jsx")) & kind.isin("function", "class") & name.rlike("^[A-Z]")
    kept = ~(
        (F.col("visibility") == "exported") | component | file.endswith(".d.ts") | kind.isin("interface", "type_alias", "anonymous_function", "impl")
        | paths.is_test_file(file) | paths.is_registration(name) | paths.is_entry_point(name, kind) | paths.is_framework_handler(name, kind, file) | paths.is_wrapper(name, kind)
    )
    out = symbols.filter(kept).join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    out = out.join(facts.select("file", "name").distinct(), ["file", "name"], "left_anti")
    return out if side_effects is None else out.join(side_effects.select("file").distinct(), "file", "left_anti")


def side_effect_files(imports: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file): targets that at least one file imports without binding a name of them."""
    bound = bindings.select("file", F.col("target_file").alias("target")).distinct()
    return imports.select("file", "target").distinct().join(bound, ["file", "target"], "left_anti").select(F.col("target").alias("file")).distinct()


def dependents(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """(file): changed files and those that import one directly."""
    direct = imports.join(changed.select(F.col("file").alias("target")), "target", "left_semi").select("file")
    return changed.select("file").union(direct).distinct()


def upgraded(edges: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """edges whose provenance rank becomes 0 where a confirmed reference (target, file, line) lies within the source's span
    and the rank was 2 or 3."""
    spans = symbols.select(F.col("id").alias("source"), F.col("file").alias("_file"), "line", "end_line")
    r = references.select("target", F.col("file").alias("_file"), F.col("line").alias("_at"))
    hits = r.join(spans, "_file").filter(F.col("_at").between(F.col("line"), F.col("end_line"))).select("source", "target").distinct().withColumn("_hit", F.lit(True))
    rank = F.when((F.col("provenance_rank") >= 2) & F.col("_hit").isNotNull(), 0).otherwise(F.col("provenance_rank"))
    return edges.join(hits, ["source", "target"], "left").withColumn("provenance_rank", rank).drop("_hit")


def type_neighbours(symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(relation, name, file): types that symbols of some names (name) point to (supertypes) or that point to them (subtypes)."""
    own = symbols.join(names.select("name"), "name", "left_semi").select(F.col("id").alias("_own"))
    types = symbols.filter(F.col("kind").isin("class", "interface", "type_alias")).select("id", "name", "file")
    up = edges.join(own, F.col("source") == F.col("_own"), "left_semi").select(F.lit("supertype").alias("relation"), F.col("target").alias("id"))
    down = edges.join(own, F.col("target") == F.col("_own"), "left_semi").select(F.lit("subtype").alias("relation"), F.col("source").alias("id"))
    return up.union(down).join(types, "id").select("relation", "name", "file").distinct()


def nearest_paths(queries: DataFrame, known: DataFrame, cutoff: int = 3) -> DataFrame:
    """(query, path, distance): the known path at the least edit distance, `cutoff` at most; the first by name of equals.

    Paths within k edits share one of k + 1 pieces of the query at a place at most k off, so both sides are keyed by their
    pieces and lengths and joined on equality; only those that meet are measured.
    """
    q = queries.select("query").distinct().withColumn("_size", F.floor(F.length("query") / (cutoff + 1)).cast("int"))
    short = q.filter("_size = 0")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(cutoff)), lambda k: F.substring(F.col("query"), k * F.col("_size") + 1, F.col("_size")))
    long_ = q.filter("_size > 0").select("query", "_size", F.explode(F.array_distinct(pieces)).alias("_piece"))
    sizes = F.broadcast(long_.select("_size").distinct())  # at most as many as lengths that a path can have
    cut = known.select(F.col("file").alias("path")).distinct().join(sizes, F.length("path") >= F.col("_size"))
    cut = cut.select("path", "_size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("path") - F.col("_size") + 1), lambda k: F.substring(F.col("path"), k, F.col("_size"))))).alias("_piece"))
    met = long_.join(cut, ["_size", "_piece"]).select("query", "path").distinct()
    brief = known.select(F.col("file").alias("path")).distinct().filter(F.length("path") <= 2 * cutoff)
    met = met.union(short.select("query").join(brief, F.abs(F.length("query") - F.length("path")) <= cutoff))
    near = met.withColumn("distance", paths.distance(F.col("query"), F.col("path"), cutoff)).filter(F.col("distance") <= cutoff)
    return near.groupBy("query").agg(F.min(F.struct("distance", "path")).alias("_m")).select("query", "_m.path", "_m.distance")


def ranked(rows: DataFrame, by: list[Column], k: int, group: list[str] | None = None) -> DataFrame:
    """The first k rows of each group, or of all."""
    if not group:
        return rows.orderBy(*by).limit(k)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col("_k") <= k).drop("_k")


def nearest_marked(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(file, folder): the nearest folder above a file (file) that has a marker (folder), null if none has."""
    up = files.select("file", F.posexplode(paths.ancestors(F.col("file"))).alias("_depth", "folder"))
    near = up.join(markers.select("folder").distinct(), "folder").groupBy("file").agg(F.min_by("folder", "_depth").alias("folder"))
    return files.select("file").distinct().join(near, "file", "left")


def first_available(wanted: DataFrame, candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(language, server): of each language's candidates (language, server, priority, place) the first whose place is found."""
    have = candidates.join(found.select("place").distinct(), "place", "left_semi").groupBy("language").agg(F.min_by("server", "priority").alias("server"))
    return wanted.select("language").distinct().join(have, "language", "left")


def setup_report(servers: DataFrame, instructions: DataFrame) -> DataFrame:
    """(status, language, install): languages with a server (language, server), and the others with how to get one."""
    gone = servers.filter("server IS NULL").join(instructions, "language", "left").select(F.lit("missing").alias("status"), "language", "install")
    return servers.filter("server IS NOT NULL").select(F.lit("available").alias("status"), "language", F.lit(None).cast("string").alias("install")).union(gone)


def container_paths(symbols: DataFrame) -> DataFrame:
    """(id, path): the names of the symbols of its file that hold a symbol (id, name, file, line, end_line), the widest first."""
    m = members(symbols, symbols).withColumnRenamed("member", "id")
    c = symbols.select(F.col("id").alias("container"), F.col("name").alias("_name"), (F.col("end_line") - F.col("line")).alias("_span"))
    held = m.join(c, "container").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(-F.col("_span"), "_name"))).alias("_in"))
    return symbols.select("id").join(held, "id", "left").select("id", F.coalesce(F.array_join(F.transform("_in", lambda x: x["_name"]), "/"), F.lit("")).alias("path"))


def repeat_keys(pairs: DataFrame) -> DataFrame:
    """(file, name, line, kind): the keys (file, key, line, pos) of JSON objects; the n-th of a line is key#n."""
    order = Window.partitionBy("file", "key", "line").orderBy("pos")
    n = F.row_number().over(order)
    return pairs.withColumn("_n", n).select("file", F.when(F.col("_n") > 1, F.concat("key", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("key")).alias("name"), "line", F.lit("json_key").alias("kind"))


def docstrings(comments: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, doc): of the comments (file, end_row, pos, text) that end on the line before a symbol the last, without its marks."""
    on = (F.col("c.file") == F.col("s.file")) & (F.col("c.end_row") == F.col("s.line") - 1)
    last = symbols.alias("s").join(comments.alias("c"), on).groupBy("s.id").agg(F.max_by("c.text", "c.pos").alias("doc"))
    return last.select("id", F.trim(F.regexp_replace("doc", r"(?m)^\s*(/\*\*?|\*/|\*|//+|#+)\s?|\s*\*/\s*$", "")).alias("doc"))


def refreshed_edges(old: DataFrame, symbols: DataFrame, changed: DataFrame, imports: DataFrame, build) -> DataFrame:
    """Edges after files changed: those of unaffected files stay, the others are built anew by build(files).

    Affected are the changed files (file), those that import one (imports: file, target) and the owners of edges that led into one.
    """
    place = symbols.select(F.col("id").alias("_id"), "file")
    into = old.join(place.join(changed.select("file"), "file", "left_semi").select(F.col("_id").alias("target")), "target", "left_semi")
    owners = into.join(place, F.col("source") == F.col("_id")).select("file")
    affected = dependents(imports, changed).union(owners).distinct()
    kept = old.join(place.join(affected, "file", "left_semi").select(F.col("_id").alias("source")), "source", "left_anti")
    return kept.unionByName(build(affected)).distinct()


def changed_files(unstaged: DataFrame, staged: DataFrame) -> DataFrame:
    """The files of both lists, each once."""
    return unstaged.union(staged).distinct()


def edit_order(sites: DataFrame, then: list[str]) -> DataFrame:
    """sites (file, line, character) with `turn`: a file's last site first; of equals by `then`, falling."""
    order = [F.desc(c) for c in ("line", "character", *then)]
    return sites.withColumn("turn", F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("long"))


def without_callbacks(symbols: DataFrame) -> DataFrame:
    return symbols.filter("kind <> 'anonymous_function'")


def most_complex(symbols: DataFrame, k: int = 5) -> DataFrame:
    """The k most complex symbols (file, line, end_line, score) of source files, of more than a line."""
    own = symbols.filter((F.col("end_line") > F.col("line")) & ~paths.is_non_source(F.col("file")))
    return own.orderBy(F.desc("score"), "file", "line").limit(k)


def resolved_imports(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(file, spec, target): the known file (file) that each relative or dotted spec of a file means, null if none."""
    dotted = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    level = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    python = F.col("file").endswith(".py") & ~F.col("spec").contains("/")
    relative = paths.resolved(F.col("file"), F.when(python & (level > 1), F.concat(F.repeat(F.lit("../"), level - 1), dotted)).when(python, dotted).otherwise(F.col("spec")))
    candidates = F.filter(F.flatten(F.array(module_candidates(relative), F.when(python, module_candidates(dotted)).otherwise(F.array().cast("array<string>")))), lambda x: x.isNotNull())
    return first_match(wanted.select("file", "spec").distinct(), candidates, known)


def scan_report(files: DataFrame, most: int = 20_000, depth: int = 50) -> DataFrame:
    """(n_files, truncated, n_tests): of paths (file) how many source files a scan takes, whether it leaves some out, and the
    test files that it doesn't take."""
    file = F.col("file")
    source = paths.language(file).isNotNull() & ~paths.is_skipped(file) & ~paths.is_non_source(file) & (F.size(F.split(file, "/")) - 1 <= depth)
    test = paths.is_test_file(file)
    n = F.count_if(source & ~test)
    return files.agg(F.least(n, F.lit(most)).alias("n_files"), (n > most).alias("truncated"), F.count_if(source & test).alias("n_tests"))


def parser_status(files: DataFrame, parsers: DataFrame) -> DataFrame:
    """(language, status, warn): the state of the parser (language, status) of each language of the files; a missing one warns."""
    present = files.select(paths.language(F.col("file")).alias("language")).filter("language IS NOT NULL").distinct()
    status = F.coalesce("status", F.lit("unavailable"))
    return present.join(parsers, "language", "left").select("language", status.alias("status"), (status != "loaded").alias("warn"))
