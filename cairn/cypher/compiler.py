"""Statement trees to DataFrame plans; Catalyst prunes, pushes down and orders the joins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.cypher.parser import CypherError, Node, Rel, Statement, parse
from cairn.graph import PropertyGraph
from cairn.schema import EDGE_TYPES, STAR_TYPES
from cairn.operators import search


class CypherEngine:
    """Runs reading statements over a property graph.

    dialect "std": two-valued predicates (a comparison with null is false), bags of rows, nulls left out of aggregates,
    grouping by the plain items beside an aggregate. "A": values compare and sort as strings, numbers first. "B": null
    equals null, bindings are distinct after each hop, aggregates count nulls, sums are doubles. An unknown label or
    relationship type matches nothing; an unknown property is null.
    """

    def __init__(self, graph: PropertyGraph, dialect: str = "std", *, max_hops: int = 5):
        if dialect not in ("std", "A", "B"):
            raise ValueError("dialect is std, A or B")
        self.graph, self.dialect, self.max_hops = graph, dialect, max_hops
        self.procedures: dict[str, Callable[..., DataFrame]] = {"QUERY_FTS_INDEX": self._fts}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.columns = {c.lower().replace("_", ""): c for c in graph.nodes.columns}

    def run(self, text: str) -> DataFrame:
        s = parse(text)
        if s.call:
            name, args = s.call
            if name.upper() not in self.procedures:
                raise CypherError(f"no procedure {name}")
            return self.procedures[name.upper()](*[a[1] if a[0] == "lit" else None for a in args])
        return self._project(self._match(s), s)

    # -- patterns

    def _nodes(self, n: Node) -> DataFrame:
        df = self.graph.nodes
        if n.label is not None:
            df = df.where(F.col("label") == n.label)
        for k, v in n.props.items():
            c = self.columns.get(k.lower().replace("_", ""))
            df = df.where(F.col(c).eqNullSafe(F.lit(v[1])) if c and v[0] == "lit" else F.lit(False))
        return df.select(*[F.col(c).alias(f"{n.var}__{c}") for c in df.columns])

    def _edges(self, r: Rel, a: str, b: str) -> DataFrame:
        types = (r.type,) if r.type else ()
        if self.dialect == "A" and r.type and r.type not in EDGE_TYPES + STAR_TYPES:
            types = ()  # that dialect takes a type outside the closed set for no restriction
        e = self.graph.both_ways(*types) if r.direction == "both" else self.graph.typed(*types)
        src, dst = ("target_id", "source_id") if r.direction == "in" else ("source_id", "target_id")
        s, t = f"_s_{a}_{b}", f"_t_{a}_{b}"
        if (r.low, r.high) == (1, 1):
            return e.select(F.col(src).alias(s), F.col(dst).alias(t), *([F.struct("type", "confidence", "reason", "step").alias(f"{r.var}__rel")] if r.var else []))
        if not 1 <= r.low <= r.high <= 10:
            raise CypherError("path lengths run from 1 to 10")
        # one row a path, which passes no edge twice
        e = e.select(F.col(src).alias(s), F.col(dst).alias(t), "id")
        nxt = e.select(F.col(s).alias("_m"), F.col(t).alias("_n"), F.col("id").alias("_e"))
        step = e.select(s, t, F.array("id").alias("_path"))
        out = step if r.low == 1 else None
        for k in range(2, r.high + 1):
            on = (F.col(t) == F.col("_m")) & ~F.array_contains("_path", F.col("_e"))
            step = step.join(nxt, on).select(s, F.col("_n").alias(t), F.concat("_path", F.array("_e")).alias("_path"))
            if k >= r.low:
                out = step if out is None else out.unionByName(step)
        return out.select(s, t)

    def _match(self, s: Statement) -> DataFrame:
        rows: DataFrame | None = None
        bound: set[str] = set()
        for p in s.patterns:
            first = p[0]
            if rows is None:
                rows = self._nodes(first)
            elif first.var in bound:
                rows = self._refine(rows, first)
            else:
                rows = rows.crossJoin(self._nodes(first)) if len(p) == 1 and not self._linked(p, bound) else self._attach(rows, p, bound)
            bound.add(first.var)
            prev = first
            for r, n in zip(p[1::2], p[2::2]):
                e = self._edges(r, prev.var, n.var)
                rows = rows.join(e, rows[f"{prev.var}__id"] == e[f"_s_{prev.var}_{n.var}"])
                if n.var in bound:
                    rows = self._refine(rows.where(F.col(f"{n.var}__id") == F.col(f"_t_{prev.var}_{n.var}")), n)
                else:
                    t = self._nodes(n)
                    rows = rows.join(t, rows[f"_t_{prev.var}_{n.var}"] == t[f"{n.var}__id"])
                    bound.add(n.var)
                rows = rows.drop(f"_s_{prev.var}_{n.var}", f"_t_{prev.var}_{n.var}")
                if self.dialect == "B":
                    rows = rows.dropDuplicates([f"{v}__id" for v in sorted(bound)])
                prev = n
        return rows if s.where is None else rows.where(self._truth(self._expr(s.where)))

    def _linked(self, p: list, bound: set[str]) -> bool:
        return any(isinstance(x, Node) and x.var in bound for x in p)

    def _attach(self, rows: DataFrame, p: list, bound: set[str]) -> DataFrame:
        """A further pattern whose start is new: joined by a product that its later shared variable narrows to a join."""
        return rows.crossJoin(self._nodes(p[0]))

    def _refine(self, rows: DataFrame, n: Node) -> DataFrame:
        if n.label is not None:
            rows = rows.where(F.col(f"{n.var}__label") == n.label)
        for k, v in n.props.items():
            c = self.columns.get(k.lower().replace("_", ""))
            rows = rows.where(F.col(f"{n.var}__{c}").eqNullSafe(F.lit(v[1])) if c and v[0] == "lit" else F.lit(False))
        return rows

    # -- expressions

    def _truth(self, c: Column) -> Column:
        return F.coalesce(c.cast("boolean"), F.lit(False))

    def _prop(self, var: str, name: str) -> Column:
        if name.lower().lstrip("_") in ("id", "label"):
            return F.col(f"{var}__{name.lower().lstrip('_')}")
        c = self.columns.get(name.lower().replace("_", ""))
        return F.col(f"{var}__{c}") if c else F.lit(None).cast("string")

    def _equal(self, a: Column, b: Column, x: tuple, y: tuple) -> Column:
        if self.dialect == "A":
            return F.coalesce(a.cast("string") == b.cast("string"), F.lit(False))
        if ("lit", None) in (x, y):
            return a.isNull() & b.isNull() if self.dialect == "B" else F.lit(False)
        return a.eqNullSafe(b) if self.dialect == "B" else F.coalesce(a == b, F.lit(False))

    def _expr(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "list":
            return F.array(*[self._expr(x) for x in e[1]])
        if kind == "prop":
            return self._prop(e[1], e[2])
        if kind == "var":
            return F.col(f"{e[1]}__id")
        if kind == "not":
            return ~self._truth(self._expr(e[1]))
        if kind in ("and", "or"):
            a, b = self._truth(self._expr(e[1])), self._truth(self._expr(e[2]))
            return a & b if kind == "and" else a | b
        if kind == "call":
            return self._call(e[1], [self._expr(x) for x in e[2]], e[2])
        if kind == "agg":
            raise CypherError(f"{e[1]} only stands alone in RETURN")
        a, b = self._expr(e[1]), self._expr(e[2])
        if kind == "=":
            return self._equal(a, b, e[1], e[2])
        if kind == "<>":
            if self.dialect == "A":
                return F.coalesce(a.cast("string") != b.cast("string"), F.lit(False))
            return ~self._equal(a, b, e[1], e[2]) if self.dialect == "B" else F.coalesce(a != b, F.lit(False))
        if kind in ("<", ">", "<=", ">="):
            c = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[kind]
            return F.coalesce(c, F.lit(False))
        if kind == "in":
            return F.coalesce(F.array_contains(b, a), F.lit(False)) if e[2][0] == "list" and e[2][1] else F.lit(False)
        if kind in ("contains", "starts", "ends"):
            f = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[kind]
            return F.coalesce(f(a.cast("string"), b.cast("string")), F.lit(False))
        if kind == "=~":
            if e[2][0] != "lit":
                raise CypherError("=~ takes a literal pattern")
            try:
                self.graph.nodes.sparkSession._jvm.java.util.regex.Pattern.compile(str(e[2][1]))
            except Exception:  # no pattern: no row matches it
                return F.lit(False)
            return F.coalesce(a.cast("string").rlike(str(e[2][1])), F.lit(False))
        if kind in ("+", "-"):
            if kind == "+" and any(x[0] == "lit" and isinstance(x[1], str) for x in (e[1], e[2])):
                return F.concat(a.cast("string"), b.cast("string"))
            exact = F.try_add(a, b) if kind == "+" else F.try_subtract(a, b)
            wide = a.cast("double") + b.cast("double") if kind == "+" else a.cast("double") - b.cast("double")
            return F.coalesce(exact.cast("double"), wide) if any(x[0] == "lit" and isinstance(x[1], float) for x in (e[1], e[2])) else F.coalesce(exact, wide)
        raise CypherError(f"no operator {kind}")

    def _call(self, name: str, args: list[Column], trees: list[tuple]) -> Column:
        low = name.lower()
        if low in ("size", "length"):
            return F.size(args[0]) if trees[0][0] == "list" else F.octet_length(args[0].cast("string"))
        if low == "tostring":
            return F.coalesce(args[0].cast("string"), F.lit("null"))
        if low in ("toupper", "tolower"):
            return (F.upper if low == "toupper" else F.lower)(args[0])
        if low == "coalesce":
            return F.coalesce(*args)
        if low in self.functions:
            return self.functions[low](*args)
        raise CypherError(f"no function {name}")

    def _aggregate(self, e: tuple) -> Column:
        name, args, distinct = e[1].lower(), e[2], e[3]
        if name == "count" and (not args or args[0][0] == "star"):
            return F.count(F.lit(1))
        c, b = self._expr(args[0]), self.dialect == "B"
        if name == "count":
            if distinct:
                return F.count_distinct(F.coalesce(c.cast("string"), F.lit("null"))) if b else F.count_distinct(c)
            return F.count(F.lit(1)) if b else F.count(c)
        if name == "collect":
            if b:
                return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])
            return F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
        if name == "sum":
            return F.coalesce(F.sum(c.cast("double") if b else c), F.lit(0.0))
        if name == "avg":
            return F.sum(F.coalesce(c.cast("double"), F.lit(0.0))) / F.count(F.lit(1)) if b else F.avg(c)
        return F.min(c) if name == "min" else F.max(c)

    # -- results

    def _title(self, e: tuple) -> str:
        if e[0] == "prop":
            return f"{e[1]}.{e[2]}"
        return {"var": lambda: e[1], "agg": lambda: e[1].lower(), "call": lambda: e[1]}.get(e[0], lambda: "expr")()

    def _project(self, rows: DataFrame, s: Statement) -> DataFrame:
        titles = [alias or self._title(e) for e, alias in s.items]
        aggregate = any(e[0] == "agg" for e, _ in s.items)
        if aggregate:
            plain = [(self._expr(e), t) for (e, _), t in zip(s.items, titles) if e[0] != "agg"]
            made = [self._aggregate(e).alias(f"o{i}") for i, (e, _) in enumerate(s.items) if e[0] == "agg"]
            grouped = rows.groupBy(*[c.alias(f"g{i}") for i, (c, _) in enumerate(plain)]).agg(*made) if plain else rows.agg(*made)
            at = iter(range(len(plain)))
            out = grouped.select(*[F.col(f"o{i}" if e[0] == "agg" else f"g{next(at)}").alias(f"c{i}") for i, (e, _) in enumerate(s.items)])
            keys = []
        else:
            keys = [k for k, _ in s.order if self._place(k, s, titles) is None]
            out = rows.select(*[self._value(e).alias(f"c{i}") for i, (e, _) in enumerate(s.items)], *[self._expr(k).alias(f"k{i}") for i, k in enumerate(keys)])
        if s.distinct:
            out = out.dropDuplicates([f"c{i}" for i in range(len(titles))])
        order = []
        for e, down in s.order:
            place = self._place(e, s, titles)
            if place is None and aggregate:
                raise CypherError("ORDER BY names no returned column")
            c = F.col(f"c{place}") if place is not None else F.col(f"k{keys.index(e)}")
            if self.dialect == "A":  # numbers first, by value; then text; a missing value is an empty text
                text = F.coalesce(c.cast("string"), F.lit(""))
                num = text.try_cast("double")
                for k in (F.when(num.isNotNull(), 0).otherwise(1), num, text):
                    order.append(k.desc() if down else k.asc())
            else:
                order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        if order:
            out = out.orderBy(*order)
        if s.limit is not None:
            out = out.limit(s.limit)
        return out.select(*[F.col(f"c{i}").alias(t) for i, t in enumerate(titles)])

    def _value(self, e: tuple) -> Column:
        if e[0] == "var" and self.dialect == "A":
            return F.to_json(F.struct(F.col(f"{e[1]}__id").alias("_id"), F.col(f"{e[1]}__label").alias("_label"), *[F.col(f"{e[1]}__{c}").alias(re.sub(r"_(\w)", lambda m: m[1].upper(), c)) for c in self.graph.nodes.columns if c not in ("id", "label")]))
        return self._expr(e)

    def _place(self, e: tuple, s: Statement, titles: list[str]) -> int | None:
        for i, (x, alias) in enumerate(s.items):
            if e == x or e == ("var", alias) or self._title(e) == titles[i] and e[0] != "lit" and e[0] not in ("+", "-"):
                return i
        return None

    def _fts(self, index: str, text: str, limit: int = 100) -> DataFrame:
        if self.dialect == "B":
            low = F.lower("name").contains((text or "").lower())
            return self.graph.nodes.where(low).select(F.col("id").alias("nodeId"), "name", F.col("file_path").alias("filePath"), "label")
        label = index[4:] if index.startswith("fts_") else None
        return search.bm25_nodes(self.graph, text or "", label=label, limit=limit)
