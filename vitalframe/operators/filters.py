"""Source filters (nine comparison operators) as column predicates, an
expression language without calls, and a guard for read-only SQL."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _one(c: Column, op: str, want: Any, is_array: bool) -> Column:
    known = c.isNotNull()
    if op == "$exists":
        return known if want else ~known
    if op in ("$in", "$nin"):
        items = list(want)
        hit = (F.arrays_overlap(c, F.array(*map(F.lit, items))) if is_array else c.isin(*items)) if items else F.lit(False)
        hit = F.coalesce(hit, F.lit(None in items))
        return hit if op == "$in" else ~hit
    if op == "$eq":
        return c.eqNullSafe(F.lit(want))
    if op == "$ne":
        return ~c.eqNullSafe(F.lit(want))
    compare = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}.get(op)
    if compare is None:
        raise ValueError(f"unknown operator {op}")
    return known & compare(c, F.lit(want))


def predicate(query: Mapping[str, Any], schema: T.StructType | None = None) -> Column:
    """All conditions of ``{path: value | {$op: value}}`` together."""
    out = F.lit(True)
    for path, want in query.items():
        is_array = bool(schema) and path in schema.fieldNames() and isinstance(schema[path].dataType, T.ArrayType)
        c = F.col(path)
        for op, value in want.items() if isinstance(want, Mapping) else (("$eq", want),):
            out = out & _one(c, op, value, is_array)
    return out


# ---------------------------------------------------------------- expressions

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not,
}


class UnsafeExpression(ValueError):
    """The text holds something other than values, names and plain operators."""


def evaluate(text: str, names: Mapping[str, Any]) -> Any:
    """Value of an expression of literals, names, and/or/not, comparisons,
    arithmetic and containers. Anything else raises."""

    def value(n: ast.AST) -> Any:
        match n:
            case ast.Expression():
                return value(n.body)
            case ast.Constant():
                return n.value
            case ast.Name():
                if n.id not in names:
                    raise UnsafeExpression(f"unknown name {n.id}")
                return names[n.id]
            case ast.BoolOp(op=ast.And()):
                out: Any = True
                for v in n.values:
                    if not (out := value(v)):
                        return out
                return out
            case ast.BoolOp():
                out = False
                for v in n.values:
                    if out := value(v):
                        return out
                return out
            case ast.UnaryOp(op=ast.Not()):
                return not value(n.operand)
            case ast.UnaryOp(op=ast.USub()):
                return -value(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return +value(n.operand)
            case ast.BinOp() if type(n.op) in _BINARY:
                left, right = value(n.left), value(n.right)
                if isinstance(n.op, ast.Pow) and (abs(right) > 64 or abs(left) > 1e6):
                    raise UnsafeExpression("a power too large")
                if isinstance(n.op, ast.Mult) and not all(isinstance(x, (int, float)) for x in (left, right)):
                    raise UnsafeExpression("only numbers can be multiplied")
                return _BINARY[type(n.op)](left, right)
            case ast.Compare():
                left = value(n.left)
                for op, right in zip(n.ops, n.comparators, strict=True):
                    right = value(right)
                    if not _COMPARE[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.Tuple() | ast.List() | ast.Set():
                return [value(x) for x in n.elts]
        raise UnsafeExpression(type(n).__name__)

    if len(text) > 2000:
        raise UnsafeExpression("too long")
    try:
        return value(ast.parse(text.strip(), mode="eval"))
    except (SyntaxError, RecursionError) as e:
        raise UnsafeExpression(str(e)) from e


def holds(text: str, names: Mapping[str, Any]) -> bool:
    """Whether an expression is true; false if it cannot be evaluated."""
    try:
        return bool(evaluate(text, names))
    except Exception:
        return False


# ---------------------------------------------------------------- SQL

MAX_ROWS, DEADLINE_S = 200, 5.0
_FORBIDDEN_NODES = ("Command", "Insert", "Drop", "Create", "Set", "Cache", "Show", "Describe", "Alter", "Truncate", "Refresh", "AddJar", "AddFile", "Delete", "Update", "Merge", "Explain", "UnresolvedTableValuedFunction", "ScriptTransformation")
_FORBIDDEN_NAMES = ("reflect", "java_method", "try_reflect", "read_files", "input_file_name")
_PATH = "`"


class RejectedQuery(ValueError):
    """The statement is not a single read-only query."""


def check_query(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Allow one SELECT or WITH over the given views; raise otherwise."""
    if not sql.strip().lower().startswith(("select", "with")):
        raise RejectedQuery("only SELECT and WITH")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise RejectedQuery("the statement cannot be read") from e
    text = plan.treeString()
    for line in text.splitlines():
        node = line.lstrip(" :+-'").split(" ")[0].split("(")[0]
        if node.startswith(_FORBIDDEN_NODES) or "Command" in node:
            raise RejectedQuery(node)
    if any("," in m for m in re.findall(r"UnresolvedRelation \[([^\]]*)\]", text)):
        raise RejectedQuery("only the given views can be read")
    lower = sql.lower()
    if any(name in lower for name in _FORBIDDEN_NAMES) or _PATH + "." in lower or ".`" in lower and ":" in lower:
        raise RejectedQuery("a function or table that reads beyond the views")


def run_query(views: Mapping[str, DataFrame], sql: str, max_rows: int = MAX_ROWS, deadline_s: float = DEADLINE_S) -> dict:
    """Rows of a guarded query in a session of its own, capped and timed."""
    import threading

    spark = next(iter(views.values())).sparkSession
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        # A view of the other session's plan, under this session's own names.
        own._jsparkSession.catalog()  # the session is ready
        jdf = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan())
        jdf.createOrReplaceTempView(name)
    check_query(own, sql, set(views))
    group = f"guarded-{id(own)}"
    timer = threading.Timer(deadline_s, lambda: spark.sparkContext.cancelJobGroup(group))
    spark.sparkContext.setJobGroup(group, "guarded query", True)
    timer.start()
    try:
        got = own.sql(sql).limit(max_rows + 1).collect()
    except AnalysisException as e:
        raise RejectedQuery(str(e).splitlines()[0]) from e
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {"rows": [r.asDict() for r in got[:max_rows]], "truncated": len(got) > max_rows}


def flatten(df: DataFrame) -> DataFrame:
    """For SQL over nested data: dotted leaf columns, arrays as JSON text,
    booleans as 0 and 1, no ``_id``."""
    out: list[Column] = []

    def walk(prefix: str, fields: list[T.StructField], get) -> None:
        for f in fields:
            if f.name == "_id":
                continue
            name, c = f"{prefix}{f.name}", get(f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f"{name}.", f.dataType.fields, lambda n, c=c: c[n])
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(c).alias(name))
            else:
                out.append((c.cast("int") if isinstance(f.dataType, T.BooleanType) else c).alias(name))

    walk("", df.schema.fields, lambda n: F.col(f"`{n}`"))
    return df.select(*out)
