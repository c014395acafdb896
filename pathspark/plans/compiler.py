"""Compiles path expressions to DataFrame plans: one plan answers a path for all patients and all questions at once.

Inside a row, a collection is a Column: a value that may be null (`single`), or an array without nulls. Across resources it is
rows, grouped by question. Filters and projections stay in the row; resolve() is an equi-join; sort() with first() or last() is
one aggregate per question (min_by, max_by); %context inside a filter is computed once per question and joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StringType, StructType, TimestampType

from ..operators.intervals import interval_join
from ..schema import CHOICES, TARGETS, element
from .parser import Binary, Call, Items, Literal, Name, Param, PathError, parse


@dataclass(frozen=True)
class Coll:
    """A collection in a row: a nullable value, or an array without nulls whose elements are of `type`."""

    col: Column
    type: DataType | None
    single: bool

    def array(self) -> Column:
        return F.when(self.col.isNotNull(), F.array(self.col)).otherwise(F.array().cast(ArrayType(self.type or StringType()))) if self.single else self.col

    def size(self) -> Column:
        return self.col.isNotNull().cast("int") if self.single else F.coalesce(F.size(self.col), F.lit(0))

    def exists(self) -> Column:
        return self.col.isNotNull() if self.single else self.size() > 0

    def one(self) -> Column:
        """The only item; null for an empty collection and for several items, on which singleton operators have no value."""
        return self.col if self.single else F.when(F.size(self.col) == 1, F.get(self.col, 0))

    def map(self, f: Callable[[Coll], Coll]) -> Coll:
        if self.single:
            return f(self)
        probe: list[Coll] = []
        mapped = F.transform(self.col, lambda x: (probe.append(f(Coll(x, self.type, True))), probe[-1].col)[1])
        if probe[-1].single:
            return Coll(F.filter(mapped, lambda x: x.isNotNull()), probe[-1].type, False)
        return Coll(F.flatten(F.filter(mapped, lambda x: x.isNotNull())), probe[-1].type, False)


def instant(c: Column, kind: DataType | None) -> Column:
    """A dateTime with or without offset, or a date, as an instant; null where it is none."""
    return c if isinstance(kind, TimestampType) else F.try_to_timestamp(c.cast("string"))


def _comparable(a: Coll, b: Coll) -> tuple[Column, Column]:
    x, y = a.one(), b.one()
    if isinstance(a.type, TimestampType) or isinstance(b.type, TimestampType):
        return instant(x, a.type), instant(y, b.type)
    if isinstance(a.type, DoubleType) or isinstance(b.type, DoubleType):
        return x.cast("double"), y.cast("double")
    return x, y


@dataclass
class Scope:
    """What names mean in a row: the current item, resolved references by map column, parameters, %context sub-queries."""

    item: Coll
    resolved: dict[str, tuple[Column, DataType]] = field(default_factory=dict)
    params: dict[str, DataType] = field(default_factory=dict)
    contexts: dict[int, Coll] = field(default_factory=dict)

    def within(self, item: Coll) -> Scope:
        return replace(self, item=item)


def path_of(node) -> tuple[str, ...]:
    return (*(path_of(node.base) if node.base is not None else ()), node.name) if isinstance(node, Name) else ()


def _member(base: Coll, name: str) -> Coll:
    def one(x: Coll) -> Coll:
        kind = element(x.type, name)
        if kind is None and name in CHOICES:
            variants = [_member(x, v) for v in CHOICES[name] if element(x.type, v) is not None]
            kinds = {v.type.simpleString() for v in variants}
            if len(kinds) > 1:  # variants of different types: their JSON
                variants = [Coll(v.col if isinstance(v.type, StringType) else F.when(v.col.isNotNull(), F.to_json(v.col)), StringType(), True) for v in variants]
            return Coll(F.coalesce(*(v.col for v in variants)), variants[0].type, True)
        if kind is None:
            raise PathError(f"no element {name} in {x.type.simpleString() if x.type else 'an empty collection'}")
        value = x.col.getField(name)
        if isinstance(kind, ArrayType):
            return Coll(F.coalesce(F.filter(value, lambda e: e.isNotNull()), F.array().cast(kind)), kind.elementType, False)
        return Coll(value, kind, True)

    return base.map(one)


def evaluate(node, s: Scope) -> Coll:
    """A path expression in a row."""
    boolean = lambda c: Coll(c, BooleanType(), True)
    match node:
        case Literal(value, "datetime"):
            return Coll(F.try_to_timestamp(F.lit(value)), TimestampType(), True)
        case Literal(value, kind):
            return Coll(F.lit(value), {"string": StringType(), "number": DoubleType(), "boolean": BooleanType()}[kind], True)
        case Param(name):
            if name not in s.params:
                raise PathError(f"no parameter %{name}")
            return Coll(F.col(f"p_{name}"), s.params[name], True)
        case Name(None, "this"):
            return s.item
        case Name(base, name):
            return _member(s.item if base is None else evaluate(base, s), name)
        case Items(values):
            items = [evaluate(v, s) for v in values]
            return Coll(F.array(*(i.col for i in items)), items[0].type, False)
        case Binary(op, left, right):
            if id(node) in s.contexts:
                return s.contexts[id(node)]
            if op in ("and", "or", "implies", "xor"):
                a, b = truth(left, s), truth(right, s)
                return boolean({"and": lambda: a & b, "or": lambda: a | b, "implies": lambda: (~a) | b, "xor": lambda: a != b}[op]())
            a, b = evaluate(left, s), evaluate(right, s)
            if op == "in":
                return boolean(F.when(a.size() == 1, F.array_contains(b.array(), a.one())))
            if op == "|":
                if a.type != b.type and (a.type is None or b.type is None or a.type.simpleString() != b.type.simpleString()):
                    a, b = _texts(a), _texts(b)
                return Coll(F.array_distinct(F.concat(a.array(), b.array())), a.type, False)
            if op in ("=", "!="):
                if a.single and b.single or isinstance(a.type, TimestampType) or isinstance(b.type, TimestampType):
                    x, y = _comparable(a, b)
                    same = x == y
                else:
                    if a.type != b.type:
                        a, b = _texts(a), _texts(b)
                    # collections are equal when they have the same items in the same order; an empty one has no answer
                    same = F.when((a.size() > 0) & (b.size() > 0), a.array() == b.array())
                return boolean(same if op == "=" else ~same)
            x, y = _comparable(a, b)
            return boolean({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op])
        case Call(Name(owner, name), "resolve", _) if _split_resolve(owner) is not None:
            return _member(evaluate(owner, s), f"_{name}")  # put there by the join that found the owner
        case Call(base, name, args):
            if id(node) in s.contexts:
                return s.contexts[id(node)]
            return _call(s.item if base is None else evaluate(base, s), base, name, args, s)
    raise PathError(f"can't compile {node}")


def _text(v: Column, kind: DataType | None) -> Column:
    return F.to_json(v) if isinstance(kind, StructType) else v.cast("string")


def _texts(c: Coll) -> Coll:
    """Items of different types are compared, and given back, as text."""
    return c.map(lambda x: Coll(_text(x.col, x.type), StringType(), True))


def truth(node, s: Scope) -> Column:
    """A criterion: the boolean itself; null where it is empty."""
    c = evaluate(node, s)
    return c.one() if isinstance(c.type, BooleanType) else F.when(c.exists(), F.lit(True))


def _call(c: Coll, base, name: str, args: tuple, s: Scope) -> Coll:
    boolean = lambda x: Coll(x, BooleanType(), True)
    holds = lambda x: F.coalesce(truth(args[0], s.within(x)), F.lit(False))
    match name:
        case "where" | "exists" if args:
            kept = Coll(F.when(holds(c), c.col), c.type, True) if c.single else Coll(F.filter(c.col, lambda x: holds(Coll(x, c.type, True))), c.type, False)
            return kept if name == "where" else boolean(kept.exists())
        case "exists":
            return boolean(c.exists())
        case "empty":
            return boolean(~c.exists())
        case "not":
            return boolean(~c.one())
        case "count":
            return Coll(c.size().cast("double"), DoubleType(), True)
        case "select":
            return c.map(lambda x: evaluate(args[0], s.within(x)))
        case "distinct":
            return c if c.single else Coll(F.array_distinct(c.col), c.type, False)
        case "sort":
            return c if c.single else Coll(F.array_sort(c.col), c.type, False)
        case "first":
            return c if c.single else Coll(F.get(c.col, 0), c.type, True)
        case "last":
            return c if c.single else Coll(F.try_element_at(c.col, F.lit(-1)), c.type, True)
        case "toDateTime":
            return c.map(lambda x: Coll(instant(x.col, x.type), TimestampType(), True))
        case "highBoundary":
            return c  # of a literal with milliseconds: itself
        case "lower":
            return c.map(lambda x: Coll(F.lower(x.col), StringType(), True))
        case "convertsToQuantity":
            return boolean(F.when(c.size() == 1, c.one().cast("string").try_cast("double").isNotNull()))
        case "during":
            t = c.col.getField("_t")
            return boolean((F.col("p_lo").isNull() | (t >= F.col("p_lo"))) & (F.col("p_hi").isNull() | (t <= F.col("p_hi"))))
        case "resolve":
            key = ".".join(path_of(base))
            if key not in s.resolved:
                raise PathError(f"{key}.resolve() has no target here")
            table, kind = s.resolved[key]
            return c.map(lambda x: Coll(F.try_element_at(table, x.col.getField("reference")), kind, True))
    raise PathError(f"{name}() isn't supported inside an item")


def find_resolves(node, prefix: tuple[str, ...] = (), out: dict[str, str] | None = None) -> dict[str, str]:
    """The reference paths that a criterion resolves, as written there, and as seen from the item itself."""
    out = {} if out is None else out
    inside = prefix
    if isinstance(node, Call):
        if node.name == "resolve" and _split_resolve(node.base) is None:
            out[".".join(path_of(node.base))] = ".".join((*prefix, *path_of(node.base)))
        inside = (*prefix, *path_of(node.base)) if node.base is not None and node.args else prefix
        for arg in node.args:
            find_resolves(arg, inside, out)
        if node.base is not None:
            find_resolves(node.base, prefix, out)
        return out
    for child in _children(node):
        find_resolves(child, prefix, out)
    return out


def _split_resolve(node):
    while node is not None:
        if isinstance(node, Call) and node.name == "resolve":
            return node
        node = getattr(node, "base", None)
    return None


def _children(node) -> list:
    match node:
        case Name(base, _):
            return [base] if base is not None else []
        case Call(base, _, args):
            return ([base] if base is not None else []) + list(args)
        case Binary(_, a, b):
            return [a, b]
        case Items(values):
            return list(values)
    return []


def _conjuncts(node) -> list:
    return [*_conjuncts(node.left), *_conjuncts(node.right)] if isinstance(node, Binary) and node.op == "and" else [node]


def names_in(node, within: bool = False) -> set[str]:
    """All element names in a tree; within: in a step, without the steps before it."""
    own = {node.name} if isinstance(node, Name) else {"_t"} if isinstance(node, Call) and node.name == "during" else set()
    children = _children(node)[1:] if within and isinstance(node, (Name, Call)) and node.base is not None else _children(node)
    return own.union(*(names_in(c) for c in children))


#: Columns that every resource table has besides the resource's own.
KEYS = ("patient_id", "ord", "_t", "_sort_t")


class Resources:
    """Tables by resource type. Each has patient_id, ord (the place in the document), _t (event time), _sort_t, and the resource's elements."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def table(self, kind: str) -> DataFrame:
        if kind not in self.tables:
            raise PathError(f"no resources of type {kind}")
        return self.tables[kind]

    def struct(self, kind: str) -> StructType:
        return StructType([f for f in self.table(kind).schema if f.name not in ("patient_id", "ord")])

    def targets(self, kind: str) -> DataFrame:
        t = self.table(kind)
        names = [f.name for f in self.struct(kind)]
        return t.select(F.col("patient_id").alias("t_patient"), F.concat(F.lit(f"{kind}/"), F.col("id")).alias("t_ref"), F.struct(*(F.col(n) for n in names)).alias("t_item"))


@dataclass
class Plan:
    """A path, compiled: `run` gives question_id and values (array<string>: JSON of each item), or count, or flag."""

    text: str
    resources: Resources
    order: str = "event"  # or "spec": the sort keys of the path language's own rules
    windows: str = "filter"  # or "buckets": resources meet the questions whose window they are in by an interval join, not by patient alone

    def __post_init__(self):
        self.tree = parse(self.text)

    # -- the chain of steps of the outermost path
    def _steps(self, node) -> list:
        if isinstance(node, Name):
            return [*([] if node.base is None else self._steps(node.base)), node]
        if isinstance(node, Call):
            return [*([] if node.base is None else self._steps(node.base)), node]
        if isinstance(node, Param) and node.name == "context":
            return [node]
        raise PathError("the outermost expression has to be a path from Bundle")

    def run(self, questions: DataFrame) -> DataFrame:
        """questions: question_id, patient_id and the parameters, lo, hi and pick among them. All its rows are in the result,
        which has question_id, patient_id, answer (text) and, by kind, count, flag or values."""
        params = {f.name: f.dataType for f in questions.schema if f.name not in ("question_id", "patient_id")}
        asked = questions.select("question_id", "patient_id", *(F.col(p).alias(f"p_{p}") for p in params))
        for p in ("lo", "hi"):
            if p not in params:
                asked = asked.withColumn(f"p_{p}", F.lit(None).cast("timestamp"))
        if "pick" not in params:
            asked = asked.withColumn("p_pick", F.lit("first"))
        self.picks = "pick" in params
        kind, rows, when_empty = self._rows(self._steps(self.tree), asked, params)
        everyone = asked.select("question_id", "patient_id")
        out = everyone.join(rows, "question_id", "left")
        if kind == "count":
            out = out.withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
            return out.withColumn("answer", F.concat(F.lit("["), F.col("count").cast("string"), F.lit("]")))
        if kind == "flag":
            out = out.withColumn("flag", F.coalesce("flag", F.lit(when_empty)))
            return out.withColumn("answer", F.concat(F.lit("["), F.col("flag").cast("string"), F.lit("]")))
        out = out.withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
        quoted = F.transform("values", lambda v: v) if kind == "plain" else F.transform("values", lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        return out.withColumn("answer", F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")))

    def _rows(self, steps: list, asked: DataFrame, params: dict[str, DataType]) -> tuple[str, DataFrame, bool]:
        """The kind of result (count, flag, text or plain values), the result by question_id, and what a flag is without rows."""
        names = [s.name for s in steps if isinstance(s, (Name, Call))]
        if names[:3] != ["Bundle", "entry", "resource"]:
            raise PathError("a path begins with Bundle.entry.resource")
        steps = steps[[getattr(s, "name", None) for s in steps].index("resource") + 1 :]
        kind, steps = self._resource_type(steps)
        table = self.resources.table(kind)
        first = steps[0] if steps and isinstance(steps[0], Call) and steps[0].name == "where" else None
        maps: dict[str, tuple[Column, DataType]] = {}
        if first is not None:
            table, maps = self._attach(table, first.args[0], kind)
        item = self.resources.struct(kind)
        item = StructType(self._fields(item, steps, ("id", "period", "_t", "_sort_t"), within=True) or item.fields)
        extra = [c for c in table.columns if c.startswith("_map_")]
        table = table.select(F.col("patient_id").alias("r_patient"), F.col("ord").cast("long").alias("ord"), F.struct(*(F.col(f.name) for f in item)).alias("it"), *extra)
        if self.windows == "buckets" and first is not None and Call(None, "during", ()) in _conjuncts(first.args[0]):
            df = interval_join(asked, table.withColumn("r_time", F.col("it._t")), ("patient_id", "r_patient"), "p_lo", "p_hi", "r_time").drop("r_time")
        else:
            df = asked.join(table, F.col("patient_id") == F.col("r_patient"))
        df = df.drop("r_patient").withColumn("ords", F.array("ord"))
        it = Coll(F.col("it"), item, True)
        keep = [c for c in df.columns if c not in ("it", "ord", "ords", *extra)]
        key: Column | None = None
        dedup = False
        for n, step in enumerate(steps):
            scope = Scope(it, maps, params)
            match step:
                case Call(_, "where", (criterion,)):
                    df, scope.contexts = self._contexts(df, criterion, asked, params)
                    if n and (needed := find_resolves(criterion)):
                        df, scope.resolved = self._attach_rows(df, needed, it)
                    df = df.filter(truth(criterion, scope))  # drops null too; bare, so that what needs the table alone moves below the join and into the scan
                case Call(_, "sort", args):
                    c = evaluate(args[0], scope) if args else it
                    key = c.one()
                case Call(_, "first" | "last" | "pick" as how, _):
                    key = self._default_key(it, kind) if key is None and how == "pick" else key
                    how = "first" if how == "pick" and not self.picks else how
                    order = (F.struct(key.isNotNull().alias("some"), key.alias("key"), "ords") if key is not None else F.struct("ords")).alias("order")
                    df, it = self._pruned(df, it, steps[n + 1 :], keep, order)
                    df = df.select(*keep, F.struct("it", "ords").alias("held"), "order")
                    low, high = F.min_by("held", "order"), F.max_by("held", "order")
                    best = {"first": low, "last": high, "pick": F.when(F.first("p_pick") == "last", high).otherwise(low)}[how]
                    df = df.groupBy(*keep).agg(best.alias("best")).select(*keep, F.col("best.it").alias("it"), F.col("best.ords").alias("ords"))
                    key = None
                case Call(_, "extreme", _):
                    # resources of one time are put together first, by question and time; then one of these groups is chosen
                    df, it = self._pruned(df, it, steps[n + 1 :], keep, F.col("it._t").alias("_x"))
                    ties = df.filter(F.col("_x").isNotNull()).groupBy(*keep, "_x").agg(F.collect_list(F.struct("it", "ords")).alias("_all"))
                    order = F.when(F.col("p_pick") == "last", -F.unix_micros("_x")).otherwise(F.unix_micros("_x"))
                    df = ties.groupBy(*keep).agg(F.min_by("_all", order).alias("_all")).select(*keep, F.inline("_all"))
                case Call(_, "distinct", _):
                    dedup = True
                case Call(_, "count", _):
                    value = F.countDistinct("it") if dedup else F.count(F.lit(1))
                    return "count", df.groupBy("question_id").agg(value.alias("count")), False
                case Call(_, "exists" | "empty" as how, args):
                    if args:
                        df = df.filter(truth(args[0], scope))
                    return "flag", df.groupBy("question_id").agg((F.count(F.lit(1)) > 0 if how == "exists" else F.count(F.lit(1)) == 0).alias("flag")), how == "empty"
                case Call(_, "resolve", _):
                    df, it, kind = self._follow(df, kind, path[-1] if (path := self._last_names(steps[:n])) else "", keep)
                    key = None
                case Call(_, "select", (expression,)):
                    df, it = self._project(df, expression, it, keep, params)
                    key = None
                case Name(_, name):
                    df, it = self._project(df, Name(None, name), it, keep, params)
                    key = None
                case Call(_, name, args):
                    df, it = self._project(df, Call(None, name, args), it, keep, params)
        if dedup:
            df = df.groupBy(*keep, F.col("it")).agg(F.min("ords").alias("ords"))
        shown = F.to_json("it") if isinstance(it.type, StructType) else F.date_format("it", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") if isinstance(it.type, TimestampType) else F.col("it").cast("string")
        values = F.transform(F.array_sort(F.collect_list(F.struct("ords", shown.alias("v")))), lambda x: x["v"])
        plain = isinstance(it.type, (StructType, DoubleType, BooleanType))
        return "plain" if plain else "text", df.groupBy("question_id").agg(values.alias("values")), False

    def _pruned(self, df: DataFrame, it: Coll, steps: list, keep: list[str], more: Column) -> tuple[DataFrame, Coll]:
        """The question's columns, it, ords and `more`; of it the fields alone that the steps to come name, if they go on to something inside
        it: an aggregate carries no more."""
        fields = self._fields(it.type, steps, ("_t", "_sort_t"), within=True)
        if fields is None:
            return df.select(*keep, "it", "ords", more), it
        pruned = F.struct(*(F.col("it")[f.name].alias(f.name) for f in fields))  # items are never null
        return df.select(*keep, pruned.alias("it"), "ords", more), Coll(F.col("it"), StructType(fields), True)

    def _fields(self, kind: DataType | None, steps: list, always: tuple[str, ...], within: bool) -> list | None:
        """The fields of a resource that steps name; None for all, if the steps give back the resource itself."""
        if not isinstance(kind, StructType) or not any(isinstance(s, Name) or isinstance(s, Call) and s.name in ("select", "resolve", "count", "exists", "empty") for s in steps):
            return None
        named = {x for s in steps for x in names_in(s, within)}
        if "this" in named or any(isinstance(s, Call) and s.name == "distinct" for s in steps):
            return None
        named |= {v for x in named if x in CHOICES for v in CHOICES[x]}
        fields = [f for f in kind if f.name in named or f.name in always or f.name.startswith("_") and f.name[1:] in named]
        return fields if 0 < len(fields) < len(kind) else None

    def _last_names(self, steps: list) -> list[str]:
        return [s.name for s in steps if isinstance(s, Name)]

    def _default_key(self, it: Coll, kind: str) -> Column | None:
        if element(it.type, "_t") is not None:
            return it.col.getField("_t" if self.order == "event" else "_sort_t")
        if element(it.type, "period") is not None:
            return instant(it.col.getField("period").getField("start"), StringType())
        return None

    def _resource_type(self, steps: list) -> tuple[str, list]:
        """The type that the first where() asks for, and the steps without that test."""

        def without(node):
            if isinstance(node, Binary) and node.op == "and":
                a, b = without(node.left), without(node.right)
                return b if a is None else a if b is None else Binary("and", a, b)
            if isinstance(node, Binary) and node.op == "=" and node.left == Name(None, "resourceType"):
                found.append(node.right.value)
                return None
            return node

        found: list[str] = []
        if not steps or not (isinstance(steps[0], Call) and steps[0].name == "where"):
            raise PathError("the first step after Bundle.entry.resource is where(resourceType = ..)")
        rest = without(steps[0].args[0])
        if len(found) != 1:
            raise PathError("where() has to name one resourceType")
        return found[0], [*([Call(None, "where", (rest,))] if rest is not None else []), *steps[1:]]

    # -- references
    def _attach(self, table: DataFrame, criterion, kind: str) -> tuple[DataFrame, dict]:
        """Adds a map from reference to target for each reference path that the criterion resolves; one join each, before the questions."""
        maps: dict[str, tuple[Column, DataType]] = {}
        item = Coll(F.struct(*(F.col(f.name) for f in self.resources.struct(kind))), self.resources.struct(kind), True)
        for n, (key, whole) in enumerate(find_resolves(criterion).items()):
            target = TARGETS.get(key.split(".")[-1])
            if target is None:
                raise PathError(f"{key} is no reference")
            refs = evaluate(parse(f"{whole}.reference"), Scope(item))
            to, struct = self._nested(target, criterion, key)
            to = to.select("t_patient", "t_ref", "t_item")
            if refs.single:
                joined = table.join(to, (F.col("patient_id") == F.col("t_patient")) & (refs.col == F.col("t_ref")), "left")
                table = joined.withColumn(f"_map_{n}", F.when(F.col("t_ref").isNotNull(), F.create_map("t_ref", "t_item"))).drop("t_patient", "t_ref", "t_item")
            else:
                pairs = table.select("patient_id", "ord", F.explode(F.array_distinct(refs.col)).alias("ref"))
                found = pairs.join(to, (F.col("patient_id") == F.col("t_patient")) & (F.col("ref") == F.col("t_ref")))
                found = found.groupBy(F.col("patient_id").alias("m_patient"), F.col("ord").alias("m_ord")).agg(F.map_from_entries(F.collect_list(F.struct("ref", "t_item"))).alias(f"_map_{n}"))
                table = table.join(found, (F.col("patient_id") == F.col("m_patient")) & (F.col("ord") == F.col("m_ord")), "left").drop("m_patient", "m_ord")
            maps[key] = (F.col(f"_map_{n}"), struct)
        return table, maps

    def _nested(self, target: str, criterion, key: str) -> tuple[DataFrame, DataType]:
        """The targets, with the element that is resolved further replaced by what it points to."""
        to, struct = self.resources.targets(target), self.resources.struct(target)
        for inner in self._further(criterion, key):
            kind = TARGETS[inner]
            deeper, deep = self.resources.targets(kind), self.resources.struct(kind)
            deeper = deeper.select(F.col("t_patient").alias("d_patient"), F.col("t_ref").alias("d_ref"), F.col("t_item").alias("d_item"))
            to = to.join(deeper, (F.col("t_patient") == F.col("d_patient")) & (F.col(f"t_item.{inner}.reference") == F.col("d_ref")), "left")
            to = to.withColumn("t_item", F.col("t_item").withField(f"_{inner}", F.col("d_item"))).drop("d_patient", "d_ref", "d_item")
            struct = StructType([*struct.fields]).add(f"_{inner}", deep)
        return to, struct

    def _further(self, node, key: str) -> list[str]:
        """Elements that are resolved on a target of `key`: key.resolve().x.resolve()."""
        out = []
        if isinstance(node, Call) and node.name == "resolve" and isinstance(node.base, Name):
            outer = _split_resolve(node.base.base)
            if outer is not None and ".".join(path_of(outer.base)) == key:
                out.append(node.base.name)
        return [*out, *(x for c in _children(node) for x in self._further(c, key))]

    def _attach_rows(self, df: DataFrame, needed: dict[str, str], it: Coll) -> tuple[DataFrame, dict]:
        """Like _attach(), for rows of questions: after first() they are few."""
        maps = {}
        for n, (key, whole) in enumerate(needed.items()):
            target = TARGETS[key.split(".")[-1]]
            refs = evaluate(parse(f"{whole}.reference"), Scope(it))
            pairs = df.select(F.col("question_id").alias("q"), F.col("patient_id").alias("qp"), F.col("ords").alias("qo"), F.explode(F.array_distinct(refs.array())).alias("ref"))
            found = pairs.join(self.resources.targets(target), (F.col("qp") == F.col("t_patient")) & (F.col("ref") == F.col("t_ref")))
            found = found.groupBy("q", "qo").agg(F.map_from_entries(F.collect_list(F.struct("ref", "t_item"))).alias(f"_late_{n}"))
            df = df.join(found, (F.col("question_id") == F.col("q")) & (F.col("ords") == F.col("qo")), "left").drop("q", "qo")
            maps[key] = (F.col(f"_late_{n}"), self.resources.struct(target))
        return df, maps

    def _follow(self, df: DataFrame, kind: str, name: str, keep: list[str]) -> tuple[DataFrame, Coll, str]:
        """resolve() as a step: each reference becomes its target; dangling ones go."""
        target = TARGETS.get(name)
        if target is None:
            raise PathError(f"{name or 'the collection'} is no reference")
        joined = df.join(self.resources.targets(target), (F.col("patient_id") == F.col("t_patient")) & (F.col("it.reference") == F.col("t_ref")))
        return joined.select(*keep, F.col("t_item").alias("it"), "ords"), Coll(F.col("it"), self.resources.struct(target), True), target

    def _project(self, df: DataFrame, expression, it: Coll, keep: list[str], params) -> tuple[DataFrame, Coll]:
        scope = Scope(it, {}, params)
        if needed := find_resolves(expression):
            df, scope.resolved = self._attach_rows(df, needed, it)
        c = evaluate(expression, scope)
        if c.single:
            out = df.select(*keep, c.col.alias("it"), "ords").filter(F.col("it").isNotNull())
        else:
            out = df.select(*keep, "ords", F.posexplode(c.col).alias("pos", "it")).select(*keep, "it", F.concat("ords", F.array(F.col("pos").cast("long"))).alias("ords"))
        return out, Coll(F.col("it"), c.type, True)

    # -- correlated sub-queries
    def _contexts(self, df: DataFrame, criterion, asked: DataFrame, params) -> tuple[DataFrame, dict[int, Coll]]:
        """Each path from %context in a criterion is computed once per question, and joined."""
        found = {}
        for n, node in enumerate(self._context_paths(criterion)):
            kind, rows, _ = self._rows(self._steps(node), asked, params)
            column = {"count": "count", "flag": "flag"}.get(kind, "values")
            rows = rows.select(F.col("question_id").alias("c_q"), F.col(column).alias(f"_ctx_{n}"))
            df = df.join(rows, F.col("question_id") == F.col("c_q"), "left").drop("c_q")
            found[id(node)] = Coll(F.col(f"_ctx_{n}"), StringType(), False) if column == "values" else Coll(F.col(f"_ctx_{n}"), BooleanType() if kind == "flag" else DoubleType(), True)
        return df, found

    def _context_paths(self, node) -> list:
        if isinstance(node, (Name, Call)):
            base = node
            while isinstance(base, (Name, Call)) and base.base is not None:
                base = base.base
            if base == Param("context"):
                return [node]
        return [p for c in _children(node) for p in self._context_paths(c)]


def evaluate_path(resources: Resources, text: str, questions: DataFrame, windows: str = "filter") -> DataFrame:
    return Plan(text, resources, windows=windows).run(questions)


def values_by_type(resources: Resources, paths: dict[str, list[str]]) -> tuple[DataFrame | None, dict[str, list[str]]]:
    """(patient_id, slot, value) of all paths that need nothing but the resource itself, one scan for each resource type, and the other
    paths by slot."""
    by_type: dict[str, list[Column]] = {}
    others: dict[str, list[str]] = {}
    for slot, texts in paths.items():
        for text in texts:
            plan = Plan(text, resources)
            steps = plan._steps(plan.tree)
            kind, steps = plan._resource_type(steps[[getattr(s, "name", None) for s in steps].index("resource") + 1 :])
            if any(isinstance(s, Call) and s.name not in ("where", "select") or find_resolves(s) or plan._context_paths(s) for s in steps):
                others.setdefault(slot, []).append(text)
                continue
            item = resources.struct(kind)
            c = Coll(F.struct(*(F.col(f.name) for f in item)), item, True)
            for s in steps:
                match s:
                    case Name(_, name):
                        c = evaluate(Name(None, name), Scope(c))
                    case Call(_, name, args):
                        c = _call(c, None, name, args, Scope(c))
            found = F.transform(c.array(), lambda v, kind=c.type: F.to_json(v) if isinstance(kind, StructType) else v.cast("string"))
            by_type.setdefault(kind, []).append(F.struct(F.lit(slot).alias("slot"), found.alias("found")))
    out = None
    for kind, slots in by_type.items():
        rows = resources.table(kind).select("patient_id", F.explode(F.array(*slots)).alias("s")).select("patient_id", "s.slot", F.explode("s.found").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out, others
