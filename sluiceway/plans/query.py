"""The typed query language and its JSON plans.

A query is a graph of flows: sources, and the operators map, filter, fold, segmented fold
and groups.  Scalar functions are Python lambdas over columns, or expressions of a plan
(literal, variable, lambda, application, scalar operator).  Building a graph makes a
DataFrame plan and nothing else: naming, code generation and evaluation are Spark's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import POS, Flow
from ..functions import scalars
from ..functions.formats import Field, ascii_default
from ..operators import segmented
from ..sources import files, store

V = "x"  # the column that holds a flow's values


# --- expressions of plans --------------------------------------------------------------
def literal(kind: str, value) -> Column:
    types = {"bool": "boolean", "int": "bigint", "word": "bigint", "float": "float", "double": "double", "string": "string"}
    return F.lit(value).cast(types[kind])


def evaluate(exp: dict, env: tuple = ()):
    """A column, or for a lambda a Python function of columns. Variables count binders outwards from 0, or are names."""
    tag = exp["_type"]
    if tag == "lit":
        return literal(exp["lit"], exp["value"])
    if tag == "var":
        return env[exp["var"]] if isinstance(exp["var"], int) else dict(x for x in env if isinstance(x, tuple))[exp["var"]]
    if tag == "lam":
        if isinstance(exp.get("bind"), str):
            return lambda x: evaluate(exp["body"], ((exp["bind"], x), *env))
        return lambda x: evaluate(exp["body"], (x, *env))
    if tag == "app":
        return evaluate(exp["fun"], env)(evaluate(exp["arg"], env))
    if tag == "sop":
        args = [evaluate(a, env) for a in exp["args"]]
        if exp["sop"] == "get":
            return scalars.get(exp["field"], *args)
        return scalars.OPERATORS[exp["sop"]](*args)
    raise ValueError(f"no expression {tag!r}")


def _curried(f, n: int) -> Callable:
    """A function of n columns from one that takes them one by one."""
    if n == 1:
        return lambda a: f(a)
    if n == 2:
        return lambda a, b: f(a)(b)

    def call(*xs):
        out = f
        for x in xs:
            out = out(x)
        return out

    return call


# --- the language ----------------------------------------------------------------------
@dataclass
class Q:
    """A builder of queries over a session and a root directory of data."""

    spark: SparkSession
    root: str = "."
    nodes: list[dict] = field(default_factory=list)

    # sources
    def from_frame(self, df: DataFrame, order: list[str], value: Column | None = None, bucket: str | None = None) -> Flow:
        """A flow of a DataFrame with a declared order; its values are ``value`` or a struct of all columns."""
        x = F.struct(*df.columns) if value is None else value
        keep = list(dict.fromkeys([*([bucket] if bucket else []), *order]))
        return Flow(df.select(*keep, x.alias(V)) if V not in keep else df, bucket, tuple(order))

    def from_file(self, path: str, sep: str, fields: list[Field]) -> Flow:
        """Whole rows of separated lines, as tuples ``_1 .. _n``."""
        rows = files.ordered_lines(self.spark, f"{self.root}/{path}")
        return Flow(rows.df.select("_bucket", POS, files.unpack_sep(sep, fields, F.col("value")).alias(V)).filter(F.col(V).isNotNull()), "_bucket")

    def from_store(self, logical: str) -> DataFrame:
        return store.scan(self.spark, self.root, logical)

    def from_store_columns(self, logical: str, columns: list[str]) -> Flow:
        fam = store.resolve(self.root, logical)[-1]
        z = store.family_columns(self.spark, fam, columns)
        return Flow(z.df.select("_bucket", POS, scalars.row(F.col("key"), *(F.col(c) for c in columns)).alias(V)), "_bucket")

    # operators
    @staticmethod
    def map(f: Callable[..., Column], *flows: Flow) -> Flow:
        """Per element; several flows are combined by position, the shortest decides."""
        if len(flows) == 1:
            return flows[0].map(**{V: f(F.col(V))})
        named = [Flow(g.df.withColumnRenamed(V, f"{V}{i}"), g.bucket, g.order) for i, g in enumerate(flows)]
        z = named[0].zip(*named[1:])
        return z.map(**{V: f(*(F.col(f"{V}{i}") for i in range(len(flows))))})

    @staticmethod
    def zip(*flows: Flow) -> Flow:
        return Q.map(scalars.row, *flows)

    @staticmethod
    def filter(p: Callable[[Column], Column], flow: Flow) -> Flow:
        return flow.filter(p(F.col(V)))

    @staticmethod
    def fold(flow: Flow, neutral: Column, aggregate: Callable[[Column], Column] | None = None, step: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """One element a stream. A known aggregate is partial before the shuffle; an opaque step folds each stream in order."""
        if aggregate is not None:
            return flow.fold(**{V: F.coalesce(aggregate(F.col(V)), neutral)})
        return flow.ordered_fold(V, neutral, step, V)

    @staticmethod
    def folds(aggregate: Callable[[Column], Column], neutral: Column, segments: Flow, values: Flow) -> DataFrame:
        """Segments are tuples (name, length); the result has tuples (name, value)."""
        s = segments.extend(__name=F.col(f"{V}._1"), __n=F.col(f"{V}._2")).select("__name", "__n")
        out = segmented.folds(s, values, "__name", "__n", __v=(aggregate(F.col(V)), neutral))
        return out.select(*s.keys, POS, scalars.row(F.col("__name"), F.col("__v")).alias(V))

    @staticmethod
    def groups(flow: Flow) -> Flow:
        g = segmented.groups(flow, V, "__n")
        return g.map(**{V: scalars.row(F.col(V), F.col("__n"))})

    @staticmethod
    def groups_by(same: Callable, flow: Flow, kind: str) -> DataFrame:
        return segmented.groups_by(flow, V, same, kind)


# --- JSON plans ------------------------------------------------------------------------
def load(plan: dict, q: Q, inputs: dict[str, Flow] | None = None) -> Flow | DataFrame:
    """Build the flow that a plan's ``out`` names.

    ``inputs`` gives flows for sources of type ``given``.  Nodes: ``file``, ``table``,
    ``table_column``, ``table_columns``, ``family_column``, ``given``; ``mapi``, ``filteri``,
    ``foldi``, ``foldsi``, ``groupsi``.
    """
    made: dict[str, Flow | DataFrame] = dict(inputs or {})
    for node in plan["nodes"]:
        tag, name = node["_type"], node["output"]
        ins = [made[i] for i in node.get("inputs", [])]
        if tag == "file":
            made[name] = q.from_file(node["path"], node["sep"], [Field.read(f) for f in node["fields"]])
        elif tag in ("table", "table_column", "family_column"):
            made[name] = q.from_store(node["path"])
        elif tag == "table_columns":
            t = q.from_store(node["path"])
            wanted = set(node["columns"])
            if not wanted <= set(t.columns):
                raise KeyError(f"no columns {sorted(wanted - set(t.columns))}")
            made[name] = t.select(*(c for c in t.columns if c in wanted))  # a mask: the table's order holds
        elif tag == "given":
            made[name] = made[node["name"]]
        elif tag == "mapi":
            made[name] = Q.map(_curried(evaluate(node["fun"]), len(ins)), *ins)
        elif tag == "filteri":
            made[name] = Q.filter(evaluate(node["fun"]), ins[0])
        elif tag == "foldi":
            made[name] = Q.fold(ins[0], evaluate(node["neutral"]), step=_curried(evaluate(node["fun"]), 2))
        elif tag == "foldsi":
            # the step is folded over each segment's values, in order
            step, z = _curried(evaluate(node["fun"]), 2), evaluate(node["neutral"])

            def aggregate(x, step=step, z=z):
                cells = F.sort_array(F.collect_list(F.struct(POS, x.alias("v"))))
                return F.aggregate(F.transform(cells, lambda c: c["v"]), z, step)

            made[name] = Q.folds(aggregate, z, *ins)
        elif tag == "groupsi":
            made[name] = Q.groups(ins[0])
        else:
            raise ValueError(f"no node {tag!r}")
    return made[plan["out"]]


# --- jobs ------------------------------------------------------------------------------
def ascii_rows(df: DataFrame, sep: str = "\t") -> DataFrame:
    """Rows in the default text format of their types; a struct's fields are separated."""
    parts = []
    for f in df.schema.fields:
        if hasattr(f.dataType, "fields"):
            parts += [ascii_default(F.col(f.name)[g.name], g.dataType) for g in f.dataType.fields]
        else:
            parts.append(ascii_default(F.col(f.name), f.dataType))
    return df.select(F.concat_ws(sep, *parts).alias("value"))


def run_query(out: Flow | DataFrame) -> list[str]:
    """The rows of a query as text, on the driver."""
    if isinstance(out, Flow):
        return [r[0] for r in ascii_rows(out.df.orderBy(*out.keys, *out.order).select(*out.values)).collect()]
    return [r[0] for r in ascii_rows(out).collect()]


def extract(out: Flow | DataFrame, path: str, files_: int | None = 1) -> None:
    """Rows to text files, one by default."""
    df = out.df.orderBy(*out.keys, *out.order).select(*out.values) if isinstance(out, Flow) else out
    rows = ascii_rows(df)
    (rows.coalesce(files_) if files_ else rows).write.mode("overwrite").text(path)


def sieve(out: Flow, path: str) -> None:
    """A flow of (file name, row) appended to one directory for each name."""
    rows = out.df.select(F.col(f"{V}._1").alias("file"), F.col(f"{V}._2").alias("row"))
    rows = rows.select("file", *( [F.concat_ws("\t", *(F.col(f"row.{f.name}").cast("string") for f in rows.schema["row"].dataType.fields))] if hasattr(rows.schema["row"].dataType, "fields") else [F.col("row").cast("string")]))
    files.sieve(rows.toDF("file", "value"), "file", "value", path)


def run_jobs(jobs: list[tuple[str, Flow | DataFrame, str | None]]) -> list:
    """Jobs (kind, query, target) one after another; kinds are query, extract and sieve."""
    done = []
    for kind, out, target in jobs:
        done.append(run_query(out) if kind == "query" else extract(out, target) if kind == "extract" else sieve(out, target))
    return done


def explain(out: Flow | DataFrame, mode: str = "formatted") -> str:
    df = out.df if isinstance(out, Flow) else out
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
