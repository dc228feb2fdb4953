"""Sources: Parquet tables, header-typed CSV, strict CSV for Datalog, and the small employee data set."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.errors import RelError
from tessera.operators.rel import Rel

#: What a header's type name makes of a column; anything else is a string.
KINDS = {"int": "int", "bool": "boolean", "decimal": "float", "double": "float"}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, var: str | None = None) -> Rel:
    """A Parquet table as a bag of records."""
    return Rel.bag(parquet(spark, sf_dir, name), var or name)


def cell(text: Column, kind: str) -> Column:
    """A cell that is missing, NULL or unreadable is its type's zero. One pair of single quotes comes off a string."""
    text = F.coalesce(text, F.lit(""))
    if kind == "boolean":
        return F.lower(text).isin("true", "t", "1")
    if kind in ("int", "float"):
        return F.coalesce(F.trim(text).try_cast(kind), F.lit(0).cast(kind))
    return F.when(text == "NULL", "").otherwise(F.regexp_replace(text, r"(?s)^'(.*)'$", "$1"))


def header(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, type) of each column, from ``name[:type]`` cells."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise RelError(f"no header in {path}")
    pairs = (c.strip().partition(":") for c in first[0][0].split(","))
    return [(name, KINDS.get(kind, "string")) for name, _, kind in pairs]


def after_header(spark: SparkSession, path: str) -> DataFrame:
    """A file's lines but its first one, whatever the others say; blank ones are left out."""
    read = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("escape", "")
    return read.csv(path).where(F.trim("value") != "")


def browse(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file (plain or gzip) by its header: split at every comma, blank lines skipped, short rows filled with zeros."""
    columns = header(spark, path)
    lines, parts = after_header(spark, path), F.split("value", ",", -1)
    return lines.select(*(cell(F.get(parts, F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(columns)))


class Folder:
    """A folder as a record: a folder's or a file's name is a field, read when it is asked for. Names are listed by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)

    def names(self) -> list[str]:
        """What the fields are called: folders, and files without their endings."""
        found = (x.name if x.is_dir() and not x.name.endswith(".parquet") else next((x.name.removesuffix(e) for e in READERS if x.name.endswith(e)), None) for x in self.path.iterdir())
        return sorted({n for n in found if n})

    def member(self, name: str) -> Folder | DataFrame:
        for ending, read in READERS.items():
            if (at := self.path / (name + ending)).exists():
                return read(self.spark, str(at))
        if (self.path / name).is_dir():
            return Folder(self.spark, str(self.path / name))
        raise RelError(f"no file or folder '{name}' in {self.path}")


READERS = {".csv": browse, ".csv.gz": browse, ".parquet": lambda spark, path: spark.read.parquet(path)}


def strict(spark: SparkSession, path: str, schema: list[tuple[str, str]]) -> DataFrame:
    """A CSV file for a declared relation: columns by header name; a missing column, a short row or a bad int is an error."""
    names = [n for n, _ in header(spark, path)]
    if missing := [n for n, _ in schema if n not in names]:
        raise RelError(f"column '{missing[0]}' is not in {path}")
    lines, parts = after_header(spark, path), F.split("value", ",", -1)
    whole = F.when(F.size(parts) < len(names), F.raise_error(F.concat(F.lit("short row: "), F.col("value")))).otherwise(parts)

    def read(name: str, kind: str) -> Column:
        text = F.regexp_replace(F.trim(F.get(whole, F.lit(names.index(name)))), r"^'(.*)'$", "$1")
        if kind == "int":
            return F.coalesce(text.try_cast("int"), F.raise_error(F.concat(F.lit("not an int: "), text)).cast("int"))
        return text

    return lines.select(*(read(n, k).alias(n) for n, k in schema))


#: Fixed values of the well-known employee data set.
DEPTS = [(10, "ACCOUNTING", "NEW YORK"), (20, "RESEARCH", "DALLAS"), (30, "SALES", "CHICAGO"), (40, "OPERATIONS", "BOSTON")]
SALGRADES = [(1, 700.0, 1200.0), (2, 1201.0, 1400.0), (3, 1401.0, 2000.0), (4, 2001.0, 3000.0), (5, 3001.0, 9999.0)]
EMPS = [
    (7369, "SMITH", "CLERK", 7902, "1980-12-17", 800.0, 0.0, 20),
    (7499, "ALLEN", "SALESMAN", 7698, "1981-02-20", 1600.0, 300.0, 30),
    (7521, "WARD", "SALESMAN", 7698, "1981-02-22", 1250.0, 500.0, 30),
    (7566, "JONES", "MANAGER", 7839, "1981-02-04", 2975.0, 0.0, 20),
    (7654, "MARTIN", "SALESMAN", 7698, "1981-09-28", 1250.0, 1400.0, 30),
    (7698, "BLAKE", "MANAGER", 7839, "1981-01-05", 2850.0, 0.0, 30),
    (7782, "CLARK", "MANAGER", 7839, "1981-06-09", 2450.0, 0.0, 10),
    (7788, "SCOTT", "ANALYST", 7566, "1987-04-19", 3000.0, 0.0, 20),
    (7839, "KING", "PRESIDENT", 0, "1981-11-17", 5000.0, 0.0, 10),
    (7844, "TURNER", "SALESMAN", 7698, "1981-09-08", 1500.0, 0.0, 30),
    (7876, "ADAMS", "CLERK", 7788, "1987-05-23", 1100.0, 0.0, 20),
    (7900, "JAMES", "CLERK", 7698, "1981-12-03", 950.0, 0.0, 30),
    (7902, "FORD", "ANALYST", 7566, "1981-12-03", 3000.0, 0.0, 20),
    (7934, "MILLER", "CLERK", 7782, "1982-01-23", 1300.0, 0.0, 10),
]


def scott(spark: SparkSession) -> dict[str, Rel]:
    """The four small tables."""
    make = lambda rows, schema, name: Rel.bag(spark.createDataFrame(rows, schema), name)
    return {
        "depts": make(DEPTS, "deptno int, dname string, loc string", "dept"),
        "emps": make(EMPS, "empno int, ename string, job string, mgr int, hiredate string, sal float, comm float, deptno int", "emp"),
        "salgrades": make(SALGRADES, "grade int, losal float, hisal float", "grade"),
        "bonuses": make([], "ename string, job string, sal float, comm float", "bonus"),
    }
