"""A small object query language, lowered to DataFrame operations.

    SELECT [DISTINCT] items FROM [OBJECTS] [INSTANCEOF] class | "pattern" | ids | 0xaddresses | ${expression} | (query) [alias] [WHERE condition] [UNION (query)]

Items are `*`, paths (`o.field.other`, `o.@retainedHeapSize`), `toString(o)`, `classof(o)`, `outbounds(o)`, `inbounds(o)`, `dominators(o)`,
`dominatorof(o)`, literals, sums and products, and the aggregates count, sum, min and max. Conditions are comparisons, LIKE (a whole match), IN, AND, OR and
NOT. Classes stand for their instances, after OBJECTS for the class objects themselves. Expressions are `snapshot.getClassesByName("name", subclasses too)` and
`snapshot.getClasses()`. A field path is a chain of left joins over all objects at once, never a call per object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commands import classes_named, of_class
from .graph import Graph

REGISTERED = {
    "oql_select_instances": "SELECT o.@objectId AS object_id, o.@usedHeapSize AS used_size FROM db.sales.Customer o",
    "oql_instanceof_where": "SELECT o.@objectAddress AS address, o.@retainedHeapSize AS retained FROM INSTANCEOF db.Shared o WHERE o.@retainedHeapSize >= 24 AND NOT o.@usedHeapSize = 16",
    "oql_aggregates": "SELECT count(*) AS n, max(o.@retainedHeapSize) AS biggest, min(o.@retainedHeapSize) AS smallest, sum(o.@usedHeapSize) AS used FROM \"db\\.(sales|geo)\\..*\" o",
    "oql_classof": "SELECT DISTINCT classof(o).@name AS name, o.@usedHeapSize AS used_size FROM \"db\\..*\" o WHERE classof(o).@name LIKE \".*S.*\"",
    "oql_reference_lists": "SELECT o.@objectId AS object_id, outbounds(o).@length AS n_out, inbounds(o).@length AS n_in, dominators(o).@length AS n_dominated, dominatorof(o) AS dominator FROM db.geo.Nation o",
    "oql_class_objects": "SELECT c.@name AS name, c.@classLoaderAddress AS loader_address FROM java.lang.Class c WHERE c.@name LIKE \"db\\..*\"",
    "oql_field_path": "SELECT l.@objectId AS object_id, l.shipDay.value AS day FROM db.sales.LineItem l WHERE l.shipDay.value < 9600 AND l.shipDay != null",
    "oql_field_like": "SELECT c.name AS name, c.balance AS balance FROM db.sales.Customer c WHERE c.name LIKE \".*[05]\" AND c.balance >= 100",
    "oql_gc_roots": "SELECT o.@objectAddress AS address, o.@GCRoots AS n_roots FROM db.geo.Region o",
    "oql_union": "SELECT o.@objectAddress AS address FROM db.geo.Region o UNION (SELECT o.@objectAddress AS address FROM db.geo.Nation o WHERE o.@objectAddress > 2199023255562)",
}

_TOKEN = re.compile(r'\s*(?:(?P<expr>\$\{[^}]*\})|(?P<num>0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)|(?P<str>"[^"]*"|\'[^\']*\')|(?P<name>@?[A-Za-z_$][\w$]*)|(?P<op><=|>=|!=|<>|[=<>(),.*+\-/\[\]]))')
_BY_NAME = re.compile(r"""\$\{\s*snapshot\s*\.\s*getClassesByName\s*\(\s*(["'])(?P<name>[^"']+)\1\s*,\s*(?P<below>true|false)\s*\)\s*\}""")
_ALL_CLASSES = re.compile(r"\$\{\s*snapshot\s*\.\s*getClasses\s*\(\s*\)\s*\}")
_RESERVED = {"select", "distinct", "from", "where", "union", "and", "or", "not", "like", "in", "as", "instanceof", "objects", "null", "true", "false"}


class OqlError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    value: object = None
    parts: tuple = ()


@dataclass
class Query:
    items: list[tuple[Node, str | None]] | None
    distinct: bool
    instance_of: bool
    source: tuple[str, object]
    alias: str
    where: Node | None
    union: Query | None = None
    class_objects: bool = False


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise OqlError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            if not text[at:].strip():
                break
        self.at = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1].lower() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise OqlError(f"expected {word!r} before {self.tokens[self.at:self.at + 3]}")

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise OqlError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def query(self) -> Query:
        self.expect("select")
        distinct = self.take("distinct")
        items = None
        if not self.take("*"):
            items = [self.item()]
            while self.take(","):
                items.append(self.item())
        self.expect("from")
        class_objects = self.take("objects")
        instance_of = self.take("instanceof")
        source = self.source()
        if source[0] == "below":
            source, instance_of = ("class", source[1]), True
        alias = "o"
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1].lower() not in _RESERVED:
            alias = self.next()[1]
        where = self.condition() if self.take("where") else None
        union = None
        if self.take("union"):
            self.expect("(")
            union = self.query()
            self.expect(")")
        return Query(items, distinct, instance_of, source, alias, where, union, class_objects)

    def source(self) -> tuple[str, object]:
        if self.take("("):
            inner = self.query()
            self.expect(")")
            return "query", inner
        kind, text = self.next()
        if kind == "str":
            return "pattern", text[1:-1]
        if kind == "expr":
            if _ALL_CLASSES.fullmatch(text):
                return "pattern", ".*"
            m = _BY_NAME.fullmatch(text)
            if not m:
                raise OqlError(f"unknown expression {text}")
            return "below" if m["below"] == "true" else "class", m["name"]
        if kind == "num":
            texts = [text]
            while self.take(","):
                texts.append(self.next()[1])
            hexed = {t[:2].lower() == "0x" for t in texts}
            if len(hexed) > 1 or any("." in t for t in texts):
                raise OqlError(f"{', '.join(texts)} are not all ids or all addresses")
            return ("addresses" if hexed.pop() else "ids"), [int(t, 0) if t[:2].lower() == "0x" else int(t) for t in texts]
        while self.take("."):
            text += "." + self.next()[1]
        while self.take("["):
            self.expect("]")
            text += "[]"
        return "class", text

    def item(self) -> tuple[Node, str | None]:
        node = self.sum()
        return (node, self.next()[1].strip("\"'")) if self.take("as") else (node, None)

    def condition(self) -> Node:
        left = self.conjunction()
        while self.take("or"):
            left = Node("or", None, (left, self.conjunction()))
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("and"):
            left = Node("and", None, (left, self.negation()))
        return left

    def negation(self) -> Node:
        if self.take("not"):
            return Node("not", None, (self.negation(),))
        if self.peek("("):
            mark = self.at
            self.at += 1
            try:
                inner = self.condition()
                self.expect(")")
                return inner
            except OqlError:
                self.at = mark  # a bracketed operand of a comparison
        left = self.sum()
        negated = self.take("not")
        for op in ("<=", ">=", "!=", "<>", "=", "<", ">", "like", "in", "instanceof"):
            if self.take(op):
                if op == "in":
                    self.expect("(")
                    values = [self.sum()]
                    while self.take(","):
                        values.append(self.sum())
                    self.expect(")")
                    node = Node("in", None, (left, *values))
                else:
                    node = Node("compare", "!=" if op == "<>" else op, (left, self.sum()))
                return Node("not", None, (node,)) if negated else node
        return Node("compare", "=", (left, Node("literal", True)))

    def sum(self) -> Node:
        left = self.product()
        while self.peek("+", "-"):
            left = Node("arithmetic", self.next()[1], (left, self.product()))
        return left

    def product(self) -> Node:
        left = self.operand()
        while self.peek("*", "/"):
            left = Node("arithmetic", self.next()[1], (left, self.operand()))
        return left

    def operand(self) -> Node:
        if self.take("("):
            inner = self.sum()
            self.expect(")")
            return inner
        if self.take("-"):
            return Node("arithmetic", "-", (Node("literal", 0), self.operand()))
        kind, text = self.next()
        if kind == "num":
            return Node("literal", int(text, 16) if text[:2].lower() == "0x" else float(text) if "." in text else int(text))
        if kind == "str":
            return Node("literal", text[1:-1])
        if kind != "name":
            raise OqlError(f"unexpected {text!r}")
        if text.lower() in ("null", "true", "false"):
            return Node("literal", {"null": None, "true": True, "false": False}[text.lower()])
        node = Node("name", text)
        if self.take("("):
            arguments = [Node("star")] if self.take("*") else [self.sum()]
            self.expect(")")
            node = Node("call", text.lower(), tuple(arguments))
        while self.take("."):
            node = Node("step", self.next()[1], (node,))
        return node


@dataclass
class Value:
    """A column of the table under construction and what it holds: a plain value, an object id or a list of ids."""

    column: Column
    kind: str = "plain"


class Lowering:
    """Adds to a table of objects (`__o`) the columns that expressions need."""

    def __init__(self, graph: Graph, objects: DataFrame, alias: str):
        self.graph, self.alias, self.made = graph, alias, {}
        self.df = objects.select(F.col("object_id").alias("__o"))

    def attach(self, at: Column, table: DataFrame, key: str, value: str) -> Column:
        """A left join with a table that has one row a key."""
        n = f"__c{len(self.df.columns)}"
        self.df = self.df.withColumn(f"{n}k", at).join(table.select(F.col(key).alias(f"{n}j"), F.col(value).alias(n)), F.col(f"{n}k") == F.col(f"{n}j"), "left").drop(f"{n}j", f"{n}k")
        return F.col(n)

    def lists(self, source: str, value: Value) -> Value:
        g = self.graph
        if source == "outbounds":
            edges, key, other = g.read_edges, "src", F.struct("seq", F.col("dst").alias("id"))
        elif source == "inbounds":
            edges, key, other = g.edges, "dst", F.struct((F.col("seq") > 0).cast("bigint").alias("seq"), F.col("src").alias("id"))
        else:
            edges, key, other = g.dominators.where("idom >= 0"), "idom", F.struct((-F.col("retained")).alias("seq"), F.col("object_id").alias("id"))
        gathered = edges.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(other)), lambda x: x["id"]).alias("ids"))
        found = self.attach(value.column, gathered, key, "ids")
        return Value(F.coalesce(found, F.array().cast("array<bigint>")), "list")

    def attribute(self, of: Value, name: str) -> Value:
        g, attribute = self.graph, name[1:]
        if of.kind == "list" and attribute == "length":
            return Value(F.size(of.column).cast("bigint"))
        if attribute == "objectId":
            return Value(of.column)
        if attribute in ("objectAddress", "usedHeapSize", "isArray"):
            return Value(self.attach(of.column, g.objects, "object_id", {"objectAddress": "address", "usedHeapSize": "used_size", "isArray": "is_array"}[attribute]))
        if attribute == "retainedHeapSize":
            return Value(self.attach(of.column, g.dominators, "object_id", "retained"))
        if attribute == "clazz":
            return Value(self.attach(of.column, g.objects, "object_id", "class_id"), "object")
        if attribute == "name":
            return Value(self.attach(of.column, g.classes, "object_id", "name"))
        if attribute == "classLoaderAddress":
            return Value(self.attach(of.column, g.classes, "object_id", "loader_address"))
        if attribute == "GCRoots":
            counted = g.roots.groupBy("object_id").agg(F.count("*").alias("n"))
            return Value(F.coalesce(self.attach(of.column, counted, "object_id", "n"), F.lit(0)))
        if attribute == "length":
            return Value(self.attach(of.column, self.lengths(), "object_id", "length"))
        if attribute in ("displayName", "toString", "technicalName", "classSpecificName"):
            return {"displayName": self.display, "toString": self.text, "technicalName": self.technical, "classSpecificName": self.specific}[attribute](of)
        raise OqlError(f"unknown attribute {name}")

    def lengths(self) -> DataFrame:
        if getattr(self.graph, "lengths", None) is None:
            raise OqlError("this heap has no array lengths")
        return self.graph.lengths

    def technical(self, of: Value) -> Value:
        """`class @ 0xaddress`."""
        g = self.graph
        named = g.objects.join(g.classes.select(F.col("object_id").alias("class_id"), "name"), "class_id")
        return Value(self.attach(of.column, named.select("object_id", F.concat("name", F.lit(" @ 0x"), F.lower(F.hex("address"))).alias("shown")), "object_id", "shown"))

    def specific(self, of: Value) -> Value:
        """What an object of some library classes stands for as text (views.shown), null for others."""
        for table, column in (("shown", "shown"), ("strings", "value")):
            if getattr(self.graph, table, None) is not None:
                return Value(self.attach(of.column, getattr(self.graph, table), "object_id", column))
        return Value(F.lit(None).cast("string"))

    def text(self, of: Value) -> Value:
        return Value(F.coalesce(self.specific(of).column, self.technical(of).column))

    def display(self, of: Value) -> Value:
        """The technical name and, where there is one, two spaces and the specific name, cut after 256 characters."""
        specific = self.specific(of).column
        cut = F.when(F.length(specific) > 256, F.concat(F.substring(specific, 1, 256), F.lit("..."))).otherwise(specific)
        return Value(F.concat(self.technical(of).column, F.coalesce(F.concat(F.lit("  "), cut), F.lit(""))))

    def field(self, of: Value, name: str) -> Value:
        """A field's value; references lead to objects, so paths go on from there. Each kind of value has its column."""
        fields = getattr(self.graph, "fields", None)
        if fields is None:
            raise OqlError("this heap has no field values")
        if "hidden" in fields.columns:
            fields = fields.where("not hidden")
        if name == "length" and fields.where(F.col("field") == name).isEmpty():
            return self.attribute(of, "@length")
        own = fields.where(F.col("field") == name)
        kinds = {r["kind"] for r in own.select("kind").distinct().collect()}
        if not kinds:
            raise OqlError(f"no object has a field {name}")
        if len(kinds) > 1:  # classes declare the name with several types: what counts is the objects that the path leads to
            here = self.df.select(of.column.alias("object_id")).where("object_id is not null").distinct()
            own = own.join(here, "object_id", "left_semi")
            kinds = {r["kind"] for r in own.select("kind").distinct().collect()} or {"object"}
        if kinds == {"object"}:
            return Value(self.attach(of.column, own, "object_id", "ref_id"), "object")
        if len(kinds) > 1:  # still several: their values as text
            own = own.withColumn("text", F.coalesce("text", *(F.col(c).cast("string") for c in ("i", "f", "b", "ref_id"))))
            return Value(self.attach(of.column, own, "object_id", "text"))
        column = {"integer": "i", "real": "f", "boolean": "b"}.get(next(iter(kinds)), "text")
        return Value(self.attach(of.column, own, "object_id", column))

    def value(self, node: Node) -> Value:
        if node.kind == "literal":
            return Value(F.lit(node.value))
        if node.kind == "name":
            if node.value == self.alias:
                return Value(F.col("__o"), "object")
            of = Value(F.col("__o"), "object")
            return self.attribute(of, node.value) if node.value.startswith("@") else self.field(of, node.value)
        key = repr(node)
        if key not in self.made:
            self.made[key] = self._value(node)
        return self.made[key]

    def _value(self, node: Node) -> Value:
        if node.kind == "step":
            of = self.value(node.parts[0])
            return self.attribute(of, node.value) if node.value.startswith("@") else self.field(of, node.value)
        if node.kind == "call":
            of = self.value(node.parts[0])
            if node.value == "classof":
                return Value(self.attach(of.column, self.graph.objects, "object_id", "class_id"), "object")
            if node.value in ("outbounds", "inbounds", "dominators"):
                return self.lists(node.value, of)
            if node.value == "dominatorof":
                return Value(self.attach(of.column, self.graph.dominators, "object_id", "idom"), "object")
            if node.value == "tostring":
                return self.text(of)
            raise OqlError(f"unknown function {node.value}")
        if node.kind == "arithmetic":
            a, b = (self.value(p).column for p in node.parts)
            return Value({"+": a + b, "-": a - b, "*": a * b, "/": a / b}[node.value])
        if node.kind == "and":
            a, b = (self.value(p).column for p in node.parts)
            return Value(a & b)
        if node.kind == "or":
            a, b = (self.value(p).column for p in node.parts)
            return Value(a | b)
        if node.kind == "not":
            return Value(~self.value(node.parts[0]).column)
        if node.kind == "in":
            return Value(self.value(node.parts[0]).column.isin(*[p.value for p in node.parts[1:]]))
        if node.kind == "compare":
            return self.compared(node)
        raise OqlError(f"{node.kind} cannot stand here")

    def compared(self, node: Node) -> Value:
        left, right = node.parts
        op = node.value
        if op == "instanceof":
            name = right.value if right.kind == "name" else str(right.value)
            found = of_class(self.graph, name, subclasses=True).select("object_id", F.lit(True).alias("is"))
            return Value(F.coalesce(self.attach(self.value(left).column, found, "object_id", "is"), F.lit(False)))
        a = self.value(left).column
        if right.kind == "literal" and right.value is None:
            return Value(a.isNull() if op == "=" else a.isNotNull())
        if op == "like":
            return Value(a.cast("string").rlike(f"^(?:{right.value})$"))
        b = self.value(right).column
        return Value({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])


AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def source_of(graph: Graph, q: Query) -> DataFrame:
    kind, what = q.source
    if kind in ("class", "pattern"):
        if q.class_objects:
            return graph.objects.join(classes_named(graph, what, q.instance_of, kind == "pattern").select("object_id"), "object_id", "left_semi")
        return of_class(graph, what, q.instance_of, kind == "pattern")
    if kind in ("ids", "addresses"):
        return graph.objects.where(F.col("object_id" if kind == "ids" else "address").isin(what))
    inner = lower(graph, what)
    return graph.objects.join(inner.select(F.col(f"`{inner.columns[0]}`").alias("object_id")).distinct(), "object_id", "left_semi")


def lower(graph: Graph, q: Query) -> DataFrame:
    low = Lowering(graph, source_of(graph, q), q.alias)
    if q.where is not None:
        condition = low.value(q.where).column
        low.df = low.df.where(condition)
    items = q.items if q.items is not None else [(Node("name", q.alias), "object_id")]
    if any(node.kind == "call" and node.value in AGGREGATES for node, _ in items):
        columns = []
        for i, (node, name) in enumerate(items):
            if node.kind != "call" or node.value not in AGGREGATES:
                raise OqlError("aggregates cannot stand beside other items")
            of = F.lit(1) if node.parts[0].kind == "star" else low.value(node.parts[0]).column
            columns.append(AGGREGATES[node.value](of).alias(name or f"{node.value}_{i}"))
        out = low.df.agg(*columns)
    else:
        columns = [low.value(node).column.alias(name or default_name(node, i)) for i, (node, name) in enumerate(items)]
        out = low.df.select(*columns)
    if q.distinct:
        out = out.distinct()
    if q.union is not None:
        out = out.union(lower(graph, q.union)).distinct()
    return out


def default_name(node: Node, i: int) -> str:
    if node.kind == "step":
        return f"{default_name(node.parts[0], i)}.{node.value}"
    if node.kind == "name":
        return str(node.value)
    return node.value if node.kind == "call" else f"item_{i}"


def run(graph: Graph, text: str) -> DataFrame:
    parser = Parser(text)
    q = parser.query()
    if parser.at != len(parser.tokens):
        raise OqlError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return lower(graph, q)


def answered(graph: Graph, text: str) -> DataFrame:
    """run(), or one row with the column `error` if the query cannot be answered."""
    try:
        return run(graph, text)
    except OqlError as e:
        return graph.objects.sparkSession.createDataFrame([(str(e),)], "error string")
