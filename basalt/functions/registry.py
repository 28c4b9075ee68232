"""Operators that SQL calls by name: a registry of scalar and table functions, installed in a session.

A name is taken once: a second function of a name, or one that the session has already, is an error. A
function says which others it needs, and none is installed without them.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: The session's setting that tells which functions of registries it has.
INSTALLED = "spark.basalt.functions"
SCHEMA = "name string, kind string, signature string, needs array<string>, description string"


@dataclass(frozen=True)
class Function:
    name: str
    #: ``sql``: the body of CREATE TEMPORARY FUNCTION; ``scalar``: a Spark user-defined function; ``table``: a class of a table function.
    kind: str
    body: Any
    signature: str
    needs: tuple[str, ...] = ()
    description: str = ""
    #: Views of the session that the body reads.
    reads: tuple[str, ...] = ()


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Function] = {}

    def add(self, function: Function) -> Function:
        """Takes a function in; names are compared without regard to case, as SQL does."""
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", function.name):
            raise ValueError(f"not a name for a function: {function.name!r}")
        if function.kind not in ("sql", "scalar", "table"):
            raise ValueError(f"not a kind of function: {function.kind!r}")
        if function.name.lower() in self.functions:
            raise ValueError(f"Function name collision: '{function.name}'")
        self.functions[function.name.lower()] = function
        return function

    def sql(self, name: str, signature: str, body: str, needs: Sequence[str] = (), description: str = "", reads: Sequence[str] = ()) -> Function:
        """A function by its SQL: ``signature`` as ``(a INT) RETURNS INT``, or ``... RETURNS TABLE (...)`` for a table function."""
        return self.add(Function(name, "sql", body, signature, tuple(needs), description, tuple(reads)))

    def scalar(self, name: str, signature: str, needs: Sequence[str] = ()) -> Callable:
        """Registers what it decorates: a function that ``F.udf``, ``F.arrow_udf`` or ``F.pandas_udf`` made."""
        return lambda f: (self.add(Function(name, "scalar", f, signature, tuple(needs), inspect.getdoc(getattr(f, "func", f)) or "")), f)[1]

    def table(self, name: str, signature: str, needs: Sequence[str] = ()) -> Callable:
        """Registers a class with ``eval`` (and ``analyze``, which says what it returns)."""
        return lambda c: (self.add(Function(name, "table", c, signature, tuple(needs), inspect.getdoc(c) or "")), c)[1]

    def needed(self, names: Sequence[str]) -> list[Function]:
        """The functions of the names and all that they need, each after its own needs; an unknown name or a circle is an error."""
        order: list[Function] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name.lower() in above:
                raise ValueError(f"Functions need each other: {' -> '.join((*above, name.lower()))}")
            f = self.functions.get(name.lower())
            if f is None:
                raise ValueError(f"Function '{name}' is not registered" + (f", and '{above[-1]}' needs it" if above else ""))
            if f not in order:
                for other in f.needs:
                    visit(other, (*above, name.lower()))
                order.append(f)

        for name in names:
            visit(name, ())
        return order

    def install(self, spark: SparkSession, names: Sequence[str] | None = None, replace: bool = False) -> list[str]:
        """Makes functions callable from the session's SQL and returns their names: those named, with their needs, or all whose views are there.

        Nothing is installed if one name is taken in the session, unless ``replace`` is set for functions of an earlier installation.
        """
        lacks = {k: [v for v in f.reads if not spark.catalog.tableExists(v)] for k, f in self.functions.items()}
        chosen = self.needed([k for k in self.functions if not lacks[k]] if names is None else names)
        if without := [f"'{f.name}' reads {', '.join(lacks[f.name.lower()])}" for f in chosen if lacks[f.name.lower()]]:
            raise ValueError(f"The session has no such views: {'; '.join(without)}")
        taken = [f.name for f in chosen if spark.catalog.functionExists(f.name)]
        ours = set(spark.conf.get(INSTALLED, "").split(",")) if replace else set()
        if refused := [n for n in taken if n.lower() not in ours]:
            raise ValueError(f"The session has functions of these names: {', '.join(sorted(refused))}")
        for f in chosen:
            if f.name in taken:
                spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {f.name}")
            if f.kind == "sql":
                comment = f.description.replace("\\", "\\\\").replace("'", "\\'")
                spark.sql(f"CREATE TEMPORARY FUNCTION {f.name}{f.signature} COMMENT '{comment}' RETURN {f.body}")
            elif f.kind == "scalar":
                spark.udf.register(f.name, f.body)
            else:
                from pyspark.sql import functions as F

                spark.udtf.register(f.name, F.udtf(f.body))
        ours = {*spark.conf.get(INSTALLED, "").split(","), *(f.name.lower() for f in chosen)} - {""}
        spark.conf.set(INSTALLED, ",".join(sorted(ours)))
        return [f.name for f in chosen]

    def described(self, spark: SparkSession) -> DataFrame:
        """The registry as rows: name, kind, signature, needs, description."""
        return spark.createDataFrame([(f.name, f.kind, f.signature, list(f.needs), f.description) for f in self.functions.values()], SCHEMA)


REGISTRY = Registry()

REGISTRY.sql("dot", "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x)", description="The sum of products of components.")
REGISTRY.sql("cosine", "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", "dot(a, b) / greatest(sqrt(dot(a, a)) * sqrt(dot(b, b)), 1e-10D)", ["dot"], "The cosine of two vectors of one dimension; 0 if one is zero.")
REGISTRY.sql("clipped", "(t STRING, n INT) RETURNS STRING", "CASE WHEN n <= 0 THEN '' WHEN length(t) <= n THEN t ELSE concat(left(t, n - 1), '…') END", description="A text of n characters at most; a longer one ends in an ellipsis.")
REGISTRY.sql(
    "reached",
    "(start STRING, hops INT) RETURNS TABLE (name STRING, hops INT)",
    """WITH RECURSIVE walk(name, hops) AS (
      SELECT reached.start, 0 UNION ALL
      SELECT l.other, walk.hops + 1 FROM walk JOIN links l ON l.name = walk.name WHERE walk.hops < reached.hops)
    SELECT name, min(hops) FROM walk GROUP BY name""",
    description="What a node reaches over the rows (name, other) of the session's view links, with the fewest hops. Walks are followed one by one, so it is for few hops; operators.graph.reach goes any number.",
    reads=["links"],
)


@REGISTRY.table("patch_lines", "(TABLE (patch_id, text) PARTITION BY patch_id) RETURNS TABLE (patch_id, path STRING, hunk INT, pos INT, line STRING)")
class PatchLines:
    """The lines of all hunks of unified diffs, with their file and hunk.

    The input has the columns patch_id, of any type, and text, and is partitioned by patch_id.
    """

    HEADER = re.compile(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")

    @staticmethod
    def analyze(patches: AnalyzeArgument) -> AnalyzeResult:
        if not patches.isTable:
            raise ValueError("patch_lines reads a table: patch_lines(TABLE(...))")
        kinds = {f.name.lower(): f.dataType for f in patches.dataType.fields}
        missing = [c for c in ("patch_id", "text") if c not in kinds]
        if missing:
            raise ValueError(f"patch_lines needs the columns: {', '.join(missing)}")
        schema = StructType().add("patch_id", kinds["patch_id"]).add("path", StringType()).add("hunk", IntegerType()).add("pos", IntegerType()).add("line", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("patch_id")], orderBy=[OrderingColumn("text")])

    def eval(self, patch: Row) -> Iterator[tuple]:
        was = path = None
        hunk, inside = 0, False
        for pos, line in enumerate((patch["text"] or "").split("\n")):
            if line.startswith(("--- ", "+++ ")):
                name = re.sub("^[ab]/", "", line[4:].strip())
                was, path, inside = (name, path, False) if line[0] == "-" else (was, was if name == "/dev/null" else name, False)
            elif self.HEADER.match(line):
                hunk, inside = hunk + 1, path is not None
            elif inside and line[:1] in (" ", "+", "-") and line:
                yield patch["patch_id"], path, hunk, pos, line
