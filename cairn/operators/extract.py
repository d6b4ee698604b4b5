"""Language-neutral extraction from file texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.graph import PropertyGraph

_ROUTES = r"(?i)\b(?:app|router|server|api|r|e|mux)\.(get|post|put|delete|patch)\(\s*[\"'`]([^\"'`\n]+)[\"'`]|@(?:app|router|bp)\.(get|post|put|delete|patch|route)\(\s*[\"']([^\"'\n]+)[\"']|@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?[\"']([^\"'\n]+)[\"']|Route::(get|post|put|delete|patch)\(\s*[\"']([^\"'\n]+)[\"']"
# How programs read the environment: a function called with the name, a map indexed by it, or an object that has it.
_ENV_CALLS = ("getenv", "Getenv", "LookupEnv", "GetEnvironmentVariable", "readEnv", "env::var", "env::var_os", "environ.get", "ENV.fetch")
_ENV_MAPS = ("environ", "process.env", "Configuration", "ENV", "_ENV")
_ENV_OBJECTS = ("process.env", "import.meta.env")
_any_of = lambda words: "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"
_ENV_USE = rf"\b{_any_of(_ENV_CALLS)}\(\s*[\"'`]([^\"'`\n]+)[\"'`]|(?<![\w]){_any_of(_ENV_MAPS)}\[\s*[\"'`]([^\"'`\n]+)[\"'`]\s*\]|\b{_any_of(_ENV_OBJECTS)}\.([A-Z][A-Z0-9_]*)\b"



def todos(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, text): TODO, FIXME, HACK and XXX as words behind a comment opener; texts up to 500 characters."""
    lines = files.where("content is not null").select("file_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    pat = r"(?://|#|--|/\*|<!--|^\s*\*).*?\b(TODO|FIXME|HACK|XXX)\b[:\s(\-]*(.*)$"
    hit = lines.where(F.col("line").rlike(pat))
    return hit.select("file_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("line", pat, 1).alias("kind"), F.substring(F.trim(F.regexp_replace(F.regexp_extract("line", pat, 2), r"\s*(?:\*/|-->)\s*$|\r$", "")), 1, 500).alias("text"))


def endpoints(files: DataFrame) -> DataFrame:
    """(file_id, method, route): routes of common web frameworks, each once a file."""
    m = files.where("content is not null").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(_ROUTES), F.lit(0))).alias("m"))
    pick = lambda *ns: F.coalesce(*[F.nullif(F.regexp_extract("m", _ROUTES, n), F.lit("")) for n in ns])
    verb = F.upper(pick(1, 3, 5, 7))
    return m.select("file_id", F.when(verb.isin("ROUTE", "REQUEST"), "ANY").otherwise(verb).alias("method"), pick(2, 4, 6, 8).alias("route")).distinct()


def env_inventory(files: DataFrame) -> DataFrame:
    """(repo_id, name, declared, uses): variables declared in .env and .properties files against their uses in programs."""
    conf = files.where("content is not null and language is null and path rlike '\\\\.(env|properties)$|(^|/)\\\\.env$'")
    dec = conf.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z][\w.\-]*)[ \t]*="), F.lit(1))).alias("name")).distinct().withColumn("declared", F.lit(True))
    use = files.where("content is not null and language is not null").select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(_ENV_USE), F.lit(0))).alias("m"))
    use = use.select("repo_id", F.coalesce(F.nullif(F.regexp_extract("m", r"[\"'`]([^\"'`]+)[\"'`]", 1), F.lit("")), F.regexp_extract("m", r"(\w+)$", 1)).alias("name")).groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("uses"))
    return dec.join(use, ["repo_id", "name"], "full_outer").select("repo_id", "name", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("uses", F.lit(0).cast("long")).alias("uses"))


def tables(files: DataFrame) -> DataFrame:
    """(file_id, table_name, column_name, column_type, references): CREATE TABLE statements, a row a column."""
    body = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\(((?:[^()]|\([^()]*\))*)\)"
    t = files.where("content is not null").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(body), F.lit(0))).alias("s"))
    c = t.select("file_id", F.regexp_extract("s", body, 1).alias("table_name"), F.explode(F.split(F.regexp_extract("s", body, 2), r",(?![^()]*\))")).alias("col"))
    col = r"(?i)^\s*[`\"\[]?(\w+)[`\"\]]?\s+([a-z]+(?:\([^)]*\))?)"
    c = c.where(~F.col("col").rlike(r"(?i)^\s*(primary|foreign|unique|constraint|check|key|index)\b"))
    return c.select("file_id", "table_name", F.regexp_extract("col", col, 1).alias("column_name"), F.upper(F.regexp_extract("col", col, 2)).alias("column_type"), F.nullif(F.regexp_extract("col", r"(?i)references\s+[`\"\[]?([\w.]+)", 1), F.lit("")).alias("references")).where("column_name <> ''")


def file_tree(files: DataFrame, path: str = "path") -> PropertyGraph:
    """Folders, one a path prefix, files, and CONTAINS edges; repeated paths count once."""
    parts = files.where(F.col(path).isNotNull()).select(F.array_join(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != ""), "/").alias("p")).distinct()
    up = parts.select("p", F.split("p", "/").alias("s"))
    steps = up.select("p", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("n"))
    name = lambda n: F.array_join(F.slice(F.col("s"), 1, n), "/")
    rows = steps.select(F.when(F.col("n") == F.size("s"), "File").otherwise("Folder").alias("label"), name(F.col("n")).alias("file_path"), F.element_at("s", F.col("n")).alias("name"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent")).distinct()
    nodes = rows.select(F.concat_ws(":", "label", "file_path").alias("id"), "label", "name", "file_path").distinct()
    edges = rows.where("parent is not null").select(F.concat(F.lit("Folder:"), "parent").alias("source_id"), F.concat_ws(":", "label", "file_path").alias("target_id")).distinct()
    return PropertyGraph(nodes, edges.select(F.concat_ws("->", "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("path").alias("reason"), F.lit(None).cast("int").alias("step")))


def mentions(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5) -> DataFrame:
    """(doc_id, name): names of at least ``least`` characters that stand as words in a text.

    Both sides meet on the word: one shuffle by word instead of every name against every text. Names of several words
    are out of this operator's scope and match nothing.
    """
    words = texts.where(F.col(text).isNotNull()).select(F.col(key), F.explode(F.array_distinct(F.split(F.col(text), r"[^\w]+"))).alias("name")).where(F.length("name") >= least)
    return words.join(names.select("name").where(F.length("name") >= least).distinct(), "name").select(key, "name")


def parse_hunks(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """(file, start, end) of unified diffs (one text a row, equal texts once): pure deletions and removed files are left out."""
    lines = diffs.select(text).distinct().select(F.sha2(text, 256).alias("d"), F.posexplode(F.split(text, "\n")).alias("i", "l"))
    w = Window.partitionBy("d").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("file", F.last(F.when(F.col("l").rlike(r"^\+\+\+ "), F.regexp_replace(F.regexp_replace("l", r"^\+\+\+ ", ""), r"^b/", "")), ignorenulls=True).over(w))
    pat = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    h = named.where(F.col("l").rlike(pat)).select("file", F.regexp_extract("l", pat, 1).cast("int").alias("start"), F.coalesce(F.nullif(F.regexp_extract("l", pat, 2), F.lit("")), F.lit("1")).cast("int").alias("n"))
    return h.where("n > 0 and file is not null and file <> '/dev/null'").select("file", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def trace_counts(logs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(id, trace_call_count): ``Class.method`` mentions of log texts, resolved by name, first to a file that names the class."""
    calls = logs.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b([A-Z]\w+\.[A-Za-z_]\w+)"), F.lit(1))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    c = calls.select(F.split("c", r"\.")[0].alias("cls"), F.split("c", r"\.")[1].alias("name"), "n")
    j = c.join(nodes.where(F.col("label").isin("Method", "Function")).select("id", "name", "file_path"), "name")
    w = Window.partitionBy("cls", "name").orderBy(F.contains("file_path", F.col("cls")).desc(), "id")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").groupBy("id").agg(F.sum("n").alias("trace_call_count"))


def markdown_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 6000) -> DataFrame:
    """(doc_id, chunk_no, title, content): a chunk a heading, its paragraphs packed whole up to ``limit`` bytes; a longer
    section goes on in ``title (part i/n)``. Null texts have none."""
    import re

    import pyarrow as pa

    def cut(t: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        title, body = "", []
        sections = []
        for line in t.replace("\r\n", "\n").split("\n"):
            m = re.match(r"(#{1,6})\s+(.*)", line)
            if m:
                sections.append((title, "\n".join(body)))
                title, body = m[2].strip(), []
            else:
                body.append(line)
        sections.append((title, "\n".join(body)))
        for title, body in sections:
            packs: list[str] = []
            for p in (x.strip("\n") for x in re.split(r"\n\s*\n", body)):
                if not p.strip():
                    continue
                if packs and len(packs[-1].encode()) + len(p.encode()) + 2 <= limit:
                    packs[-1] += "\n\n" + p
                else:
                    packs.append(p)
            out += [(title if len(packs) == 1 else f"{title} (part {i}/{len(packs)})", p) for i, p in enumerate(packs, 1)]
        return out

    def run(batches):
        for b in batches:
            rows = [(k, i, a, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, (a, c) in enumerate(cut(t))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[key, "chunk_no", "title", "content"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_no int, title string, content string")


def lint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, todos, anchors, short_sections): residual markers, unfilled ``{{anchors}}`` and sections under 50 words."""
    base = docs.where(F.col(text).isNotNull())
    sections = F.filter(F.split(F.col(text), r"(?m)^#{1,6} .*$"), lambda s: F.trim(s) != "")
    short = F.size(F.filter(sections, lambda s: F.size(F.split(F.trim(s), r"\s+")) < 50))
    return base.select(key, F.regexp_count(text, F.lit(r"\b(TODO|TBD|FIXME)\b")).alias("todos"), F.regexp_count(text, F.lit(r"\{\{[^}]+\}\}")).alias("anchors"), short.alias("short_sections"))


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, module, target): a module's dotted or slashed name against the suffixes of all paths, shortest path first.

    Both sides meet on the suffix. imports: file, module; paths: path.
    """
    stem = F.regexp_replace("path", r"(?:/(?:index|mod|__init__))?\.\w+$", "")
    ps = paths.select("path", F.split(stem, "/").alias("s")).distinct()
    suf = ps.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice(F.col("s"), n, F.size("s")), "/"))).alias("suffix"))
    want = imports.withColumn("suffix", F.regexp_replace(F.regexp_replace(F.translate("module", ".", "/"), r"^/+", ""), r"^(?:crate|self|super)::|::", "/"))
    j = want.join(suf, "suffix").where("path <> file")
    w = Window.partitionBy("file", "module").orderBy(F.length("path"), "path")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file", "module", F.col("path").alias("target"))


def resolve_names(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, id, tier, confidence): the first tier that knows a name: its own file 1.0, an imported file 0.95, its
    folder 0.8, a unique name anywhere 0.7, any 0.5. refs: file, name; symbols: id, name, file_path; imports: file, target."""
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    s = symbols.select("id", "name", F.col("file_path").alias("at")).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("name")))
    j = refs.distinct().join(s, "name").join(imports.select("file", F.col("target").alias("at")).distinct().withColumn("imp", F.lit(True)), ["file", "at"], "left")
    tier = F.when(F.col("at") == F.col("file"), 1).when(F.col("imp"), 2).when(folder(F.col("at")) == folder(F.col("file")), 3).when(F.col("same") == 1, 4).otherwise(5)
    w = Window.partitionBy("file", "name").orderBy("tier", "id")
    best = j.withColumn("tier", tier).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select("file", "name", "id", "tier", F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.95, 0.8, 0.7, 0.5)]), F.col("tier")).alias("confidence"))
