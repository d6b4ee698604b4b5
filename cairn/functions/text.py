"""Column functions over names, paths and texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.schema import BUSINESS_LABELS, NOISY_LABELS

# Path fragments and folders that lower a hit's weight.
LOW_FRAGMENTS = (".min.js", ".min.css", ".min.map", "-min.js", "-min.css", "-vsdoc.js", ".vsdoc.js", ".designer.cs", ".g.cs", ".g.i.cs", "scripts/jquery", "scripts/knockout", "scripts/kendo", "scripts/telerik", "scripts/angular", "scripts/bootstrap", "scripts/modernizr", "scripts/moment", "scripts/history")
LOW_FOLDERS = ("packages", "node_modules", "bower_components", "vendor", "obj", "bin")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def path_weight(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    hit = F.lit(False)
    for x in LOW_FRAGMENTS:
        hit = hit | low.contains(x)
    folders = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in LOW_FOLDERS]))
    return F.when(hit | folders | low.contains("wwwroot/lib/"), 0.1).otherwise(1.0)


def label_weight(label: Column) -> Column:
    return F.when(label.isin(*BUSINESS_LABELS), 1.5).when(label.isin(*NOISY_LABELS), 0.4).otherwise(1.0)


def module_of(path: Column) -> Column:
    """First segment, with the second unless that has a dot; ``(root)`` for an empty path."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    second = F.try_element_at(parts, F.lit(2))
    return F.when(path.isNull(), None).when(second.isNotNull() & ~F.contains(second, F.lit(".")), F.concat_ws("/", F.get(parts, F.lit(0)), second)).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("(root)")))


def clean_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != ".")), "/")


def under(path: Column, folder: str) -> Column:
    """The path is the folder or lies in it."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def source_lines(content: Column, start: int, end: int) -> Column:
    """Lines start to end, counted from 1; null for an inverted or negative range."""
    if start < 1 or end < start:
        return F.lit(None).cast("string")
    return F.array_join(F.slice(F.split(content, "\n"), start, end - start + 1), "\n")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot / n).otherwise(0.0)


# Scores of names that start, handle or merely help.
ENTRY_SCORES = {"main": 1.0, "init": 0.8, "bootstrap": 0.9, "start": 0.85, "run": 0.8, "setup": 0.7, "configure": 0.7, "register": 0.6, "mount": 0.6, "listen": 0.7, "serve": 0.7, "execute": 0.6, "launch": 0.8, "create_app": 0.9, "create_server": 0.9}
HANDLER_SCORES = {"handle": 0.7, "on": 0.5, "process": 0.6, "dispatch": 0.6, "route": 0.6, "middleware": 0.5}
HELPER_SCORES = {"is": 0.1, "has": 0.1, "get": 0.15, "set": 0.15, "to": 0.1, "from": 0.15, "parse": 0.15, "format": 0.1, "validate": 0.15, "normalize": 0.1, "convert": 0.1, "transform": 0.1}


def entry_score(name: Column) -> Column:
    """How likely a name is an entry point: whole names, then handler prefixes, then helper prefixes; null for none."""
    low = F.lower(name)
    out = F.when(name.isNull(), None)
    for word, score in ENTRY_SCORES.items():
        out = out.when(low == word, score)
    for group in (HANDLER_SCORES, HELPER_SCORES):
        for word, score in group.items():
            out = out.when(low.startswith(word) & F.substring(name, len(word) + 1, 1).rlike(r"[_\p{Lu}]"), score)
    return out


def embedding_text(name: Column, path: Column, description: Column, content: Column, limit: int = 1000) -> Column:
    """What a model embeds of a node: its name, path, description and the head of its content."""
    return F.concat_ws(" ", name, path, description, F.substring(F.trim(content), 1, limit))


def build_artifact(path: Column) -> Column:
    """Whether a path lies in a folder that builds fill."""
    return F.lower(F.translate(path, "\\", "/")).rlike(r"target/(?:debug|release)/|node_modules/|dist/")
