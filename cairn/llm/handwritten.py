"""Problem 4: generated, minified and vendored source files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.automaton import automaton

#: Notice phrases (lower case) and weights; a header whose phrases weigh 1 or more was written by a tool.
NOTICES = {
    "code generated by": 1.0, "@generated": 1.0, "<auto-generated": 1.0, "auto-generated source": 1.0, "auto-generated by": 1.0,
    "auto-generated from": 1.0, "auto-generated file": 1.0, "autogenerated with": 1.0, "autogenerated by": 1.0, "autogenerated from": 1.0,
    "autogenerated file": 1.0, "automatically created by": 1.0, "automatically generated": 1.0, "this file is generated": 1.0,
    "this file was generated": 1.0, "file generated by": 1.0, "machine written from": 1.0, "machine-generated": 1.0, "machine generated": 1.0,
    "do not modify by hand": 1.0, "do not edit by hand": 1.0, "generated. do not edit": 1.0, "do not edit this generated": 1.0,
    "changes will be lost": 0.5, "will be overwritten": 0.5, "regenerate instead": 0.5, "instead of editing": 0.5, "produced from": 0.5,
    "ne pas modifier": 1.0, "fichier produit par": 0.5, "fichier généré": 1.0, "généré automatiquement": 1.0,
    "nicht von hand": 1.0, "automatisch erzeugt": 1.0, "automatisch generiert": 1.0, "generierte datei": 1.0,
}
#: Phrases that only point at a line; it is a notice if it opens with one (see _OPENING).
TRIGGERS = ("generated by", "generated from", "generated with", "generated using", "generated on", "generated file", "generated code", "generated source", "made by gnu", "created by", "produced by", "emitted by")
_OPENING = re.compile(
    r"^\W*(?:(?:this|the) (?:file|code|source|module|class|header|parser)\s+(?:is|was|has been)\s+)?(?:auto(?:matically)?[- ]?)?"
    r"(?:generated|produced|emitted)\b(?: automatically)?\s+(?:file\b|code\b|source\b|on \d|(?:by|from|with|using)\s(?!hand\b))|^\W*a \w+ (?:parser|lexer|scanner|grammar)\b.*\b(?:made|generated|created) by\b"
)
#: A line about generation, not one that says its own file was generated.
_ABOUT = re.compile(r"\b(?:documents?|describes?|explains?|shows?|checks?|helpers?|parses?|tests?|how|whether|why|edit freely)\b.*(?:generat|creat|produc|edit freely)")
#: Directories that hold nothing but third-party copies, at any depth, and names that other code has too: there a library
#: directory whose file bears its name must follow, or a file of a known library or with a version in its name.
VENDOR_ONLY = frozenset("third_party third-party thirdparty external externals extern pods carthage bower_components node_modules jspm_packages site-packages".split())
VENDOR_DIRS = VENDOR_ONLY | frozenset("vendor vendors deps".split())
LIBRARIES = frozenset("jquery bootstrap lodash underscore backbone angular react vue ember d3 three moment handlebars mustache modernizr require knockout prototype mootools zepto chart popper socket.io axios normalize zlib sqlite3 miniz stb_image lodepng rapidjson pugixml tinyxml2 googletest gtest catch doctest".split())
_VERSIONED = re.compile(r"^([a-z][a-z0-9_.]*?)[-._]v?\d+\.\d+(?:\.\d+)+(?:[-.](?:min|slim|prod|pkgd|umd|esm))?\.(?:js|mjs|cjs|css)$", re.I)
LOCKFILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock gemfile.lock cargo.lock poetry.lock pipfile.lock go.sum packages.lock.json workspace.lock".split())
_MINIFIED = re.compile(r"[.\-](?:min|prod|bundle|chunk|packed)\.(?:js|mjs|cjs|ts|css)$", re.I)
_GENERATED_NAME = re.compile(r"(?:\.pb\.(?:go|cc|h|rb)|_pb2(?:_grpc)?\.py|\.designer\.cs|\.g\.i\.cs|\.generated\.\w+)$", re.I)
_SOURCE_LINE = re.compile(r"^\W*(?:source: \S+\.(?:proto|thrift|idl|fbs|avsc|graphql)\b|(?:#line \d+ )?\"?[\w./\-]+\.(?:y|yy|l|ll|g4|peg):\d+)", re.I | re.M)
_VERSION = r"v?\d+\.\d+(?:\.\d+)?"
_BANNER = re.compile(rf"(?:/\*!.*{_VERSION}.*\blicen[cs]ed?\b|^\W*[\w.\-]+ {_VERSION}\W*$[\s\S]*?\bupstream: https?://|^\W*[\w.\-]+ - release {_VERSION}[\s\S]*?\bpermission is (?:hereby )?granted)", re.I | re.M)
_DATA = re.compile(rb"0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z0-9+/=]{60,}|[\s,;\[\]{}()\"'+]")
_SPACE = b" \t\r\n"
_PLAIN = b"0123456789,;.+-[]{}()\"' \t\r\n"
_DIGITS = re.compile(rb"\d+")


def path_reason(path: str | None) -> str | None:
    """The rule a path matches, or None; a null path matches none."""
    if not path:
        return None
    parts = [p for p in path.replace("\\", "/").split("/") if p and p != "."]
    if not parts:
        return None
    name = parts[-1]
    if name.lower() in LOCKFILES:
        return "lockfile"
    if _MINIFIED.search(name):
        return "minified"
    if _GENERATED_NAME.search(name):
        return "generated"
    stem = re.split(r"[-.](?:v?\d|min\b|slim\b)|\.\w+$", name.lower(), maxsplit=1)[0]
    if _VERSIONED.match(name):
        return "vendored"
    for i, d in enumerate(parts[:-1]):
        if d.lower() in VENDOR_ONLY or d.lower() in VENDOR_DIRS and stem in LIBRARIES:
            return "vendored"
        if d.lower() in VENDOR_DIRS and i < len(parts) - 2:
            lib = parts[i + 1].lower().rstrip("0123456789.-_")
            if lib and (name.lower().startswith(lib) or len(parts) - i > 3):
                return "vendored"
    return None


def header(text: str) -> str:
    """The comment lines at the head of a text, with those among its package and import lines."""
    out, block, quote = [], False, None
    for line in text.split("\n"):
        s = line.strip()
        if block:
            out.append(s)
            block = "*/" not in s
        elif quote:
            out.append(s)
            quote = None if quote in s else quote
        elif not s:
            continue
        elif s.startswith("/*"):
            out.append(s)
            block = "*/" not in s[2:]
        elif s[:2] == "//" or s[:1] == "#" or s[:2] == "--" or s[:1] == ";" or s.startswith("<!--"):
            out.append(s)
        elif s[:3] in ('"""', "'''"):
            out.append(s)
            quote = None if s.count(s[:3]) > 1 else s[:3]
        elif s.startswith(("package ", "import ", "using ", "namespace ", "use ", "from ", "'use strict'", '"use strict"', "export ")) and s[-1:] not in "{(":
            continue
        else:
            break
    return "\n".join(out)


def _notice(low: str) -> bool:
    """Whether a header says that a tool wrote its file: phrases that weigh 1 together, or a line that opens as a notice;
    lines that are about generation do not count."""
    weights, hits = list(NOTICES.values()), set()
    for end, i in automaton((*NOTICES, *TRIGGERS)).iter(low):
        start, stop = low.rfind("\n", 0, end) + 1, low.find("\n", end)
        line = low[start : stop if stop >= 0 else len(low)]
        if _ABOUT.search(line):
            continue
        if i < len(weights):
            hits.add(i)
        elif _OPENING.match(line):
            return True
    return sum(weights[i] for i in hits) >= 1


def content_reason(text: str, script: bool) -> str | None:
    """generated, vendored, data, minified or numbered by the text itself, or None; an empty text matches none. numbered
    are tables and accessors without a notice, told by the shape of their lines alone: the least certain of the rules."""
    if not text:
        return None
    head = header(text)
    if head:
        if _notice(head.lower()) or _SOURCE_LINE.search(head):
            return "generated"
        if _BANNER.search(head):
            return "vendored"
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    spaces = n - len(raw.translate(None, _SPACE))
    if n >= 200:
        if len(raw.translate(None, _PLAIN)) < 0.5 * (n - spaces) or spaces < 0.08 * n:
            if len(_DATA.sub(b"", raw)) < 0.3 * (n - spaces):
                return "data"
        if script and spaces < 0.1 * n and n > 200 * (raw.count(b"\n") + 1):
            return "minified"
    # tables and accessors of a tool that left no notice: few shapes of line, told apart by numbers only
    lines = raw.split(b"\n")
    if len(lines) >= 14:
        body = [x.strip() for x in lines if len(x.strip()) > 12]
        numbered = sum(1 for x in body if x[-1:] not in b",[" and _DIGITS.search(x))
        if len(body) >= 8 and numbered >= 0.75 * len(body):
            shapes = {_DIGITS.sub(b"0", x) for x in body}
            if len(shapes) <= 0.45 * len(body):
                return "numbered"
    return None


def classify(files: DataFrame, config: DataFrame, *, key: str = "file_id") -> DataFrame:
    """(file_id, path, reason): reason is ignored_dir, too_large, lockfile, minified, generated, vendored, data or numbered; null for
    files written by hand and for configuration files, of which only folder and size count.

    Rules are tried in that order. The size is that of the content or, where that is null, the size column. A null
    config_name, or one that config lacks, gives no folder and size rule; if config repeats a name, its folders and its
    least limit count once. Null path or content match no rule of theirs. One row a row of files; no shuffle of contents.
    """
    rules = config.groupBy(F.col("config_name").alias("c_name")).agg(F.array_distinct(F.flatten(F.collect_list("ignored_dirs"))).alias("c_dirs"), F.min("max_file_size_mb").alias("c_mb"))
    size = F.coalesce(F.octet_length("content").cast("long"), F.col("size"))
    dirs = F.expr("slice(split(replace(path, '\\\\', '/'), '/'), 1, greatest(size(split(replace(path, '\\\\', '/'), '/')) - 1, 0))")
    joined = files.select(F.col(key).alias("k"), "path", "content", "language", "config_name", size.alias("bytes"), dirs.alias("dirs")).join(rules, F.col("config_name") == F.col("c_name"), "left")
    first = F.when(F.coalesce(F.arrays_overlap("dirs", "c_dirs"), F.lit(False)), "ignored_dir").when(F.col("bytes") > F.col("c_mb") * 1048576, "too_large")
    rows = joined.select("k", "path", first.alias("rule"), F.when(first.isNull() & F.col("language").isNotNull(), F.col("content")).alias("content"), "language")

    def run(batches):
        for batch in batches:
            ks, paths, rules_, contents, langs = batch.columns
            out = []
            for path, rule, text, lang in zip(paths.to_pylist(), rules_.to_pylist(), contents.to_pylist(), langs.to_pylist()):
                if rule is None and (lang is not None or path is not None and path.rsplit("/", 1)[-1].lower() in LOCKFILES):
                    rule = path_reason(path) or (content_reason(text, lang in ("javascript", "typescript")) if text else None)
                out.append(rule)
            yield pa.RecordBatch.from_arrays([ks, paths, pa.array(out, pa.string())], names=["k", "path", "reason"])

    return rows.mapInArrow(run, f"k {files.schema[key].dataType.simpleString()}, path string, reason string").withColumnRenamed("k", key)


def found(files: DataFrame, config: DataFrame) -> DataFrame:
    return classify(files, config).where("reason is not null").select("file_id")


def classify_paths(rows: DataFrame, *, repo: str = "repo_id", path: str = "path") -> DataFrame:
    """(repo_id, path, reason) of every row by path rules alone, for tables that hold no contents."""
    slim = rows.select(F.col(repo), F.col(path))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([path_reason(p) for p in batch.column(1).to_pylist()], pa.string())], names=["repo_id", "path", "reason"])

    return slim.mapInArrow(run, "repo_id long, path string, reason string")
