"""Writers. Spark's commit makes a write whole or absent; an existing output is never replaced unasked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_csv(df: DataFrame, path: str, digits: int | None = None, overwrite: bool = False, sep: str = ",", encoding: str = "UTF-8", quote: str | None = '"') -> None:
    """Null as empty; with ``digits``, doubles with so many places. ``quote=None`` writes quotes as text."""
    if digits is not None:
        df = df.withColumns({c: F.format_string(f"%.{digits}f", F.col(c)) for c, kind in df.dtypes if kind == "double"})
    writer = df.write.mode(_mode(overwrite)).option("header", True).option("nullValue", "").option("emptyValue", "").option("sep", sep).option("encoding", encoding)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("quote", quote or "").option("escape", quote or "\\").csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    writer = df.write.mode(_mode(overwrite))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """JSON lines without null and empty fields."""
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, kind in df.dtypes if kind == "string"})
    df.write.mode("append").json(path)


def exported(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the named columns leave."""
    return df.select(*(c for c in allowed if c in df.columns))


def require_sidecar(path: str, canonical: Sequence[str]) -> str:
    """Refuse a path that is, or is inside, an output of record."""
    clean = path.rstrip("/")
    for c in canonical:
        if clean == c.rstrip("/") or clean.startswith(c.rstrip("/") + "/"):
            raise ValueError(f"{path} belongs to {c}")
    return path


def forbidden_columns(df: DataFrame, words: Sequence[str]) -> list[str]:
    """Names of columns and nested fields that contain a word which must not be published."""
    from pyspark.sql import types as T

    found = []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                name = f"{at}.{f.name}".strip(".")
                if any(w in f.name.lower() for w in words):
                    found.append(name)
                walk(f.dataType, name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, at)

    walk(df.schema, "")
    return found


#: What stands before, between and after cells, the escapes of their texts, and the lines around the rows.
STYLES = {
    "markdown": ("| ", " | ", " |", (("\\", "\\\\"), ("|", "\\|"), ("\n", " ")), ("", "| {head} |\n| {rule} |", "")),
    "latex": ("", " & ", " \\\\", (("\\", "\\textbackslash "), ("&", "\\&"), ("%", "\\%"), ("_", "\\_"), ("#", "\\#"), ("$", "\\$"), ("\n", " ")), ("\\begin{tabular}", "{head} \\\\ \\hline", "\\end{tabular}")),
    "html": ("<tr><td>", "</td><td>", "</td></tr>", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")), ("<table>", "<tr><th>{head}</th></tr>", "</table>")),
}


def table_lines(df: DataFrame, style: str, digits: int = 3) -> DataFrame:
    """Adds ``line``, the row as a line of a Markdown, LaTeX or HTML table: doubles with so many places, null as nothing, marks of the style escaped."""
    left, between, right, escapes, _ = STYLES[style]

    def cell(name: str, kind: str) -> Column:
        text = F.format_string(f"%.{digits}f", F.col(f"`{name}`").cast("double")) if kind in ("double", "float") else F.col(f"`{name}`").cast("string")
        text = F.when(F.col(f"`{name}`").isNotNull(), text).otherwise("")
        for old, new in escapes:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    return df.withColumn("line", F.concat(F.lit(left), F.concat_ws(between, *(cell(c, k) for c, k in df.dtypes)), F.lit(right)))


def rendered(df: DataFrame, style: str, digits: int = 3, most: int = 1_000) -> str:
    """A small sorted result as a whole table; a larger one than ``most`` rows is refused."""
    columns = df.columns
    lines = [r[0] for r in table_lines(df, style, digits).select("line").limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows are no table to read")
    _, between, _, escapes, (first, head, last) = STYLES[style]
    names = []
    for c in columns:
        for old, new in escapes:
            c = c.replace(old, new)
        names.append(c)
    top = head.replace("{head}", between.join(names) if style != "html" else "</th><th>".join(names)).replace("{rule}", " | ".join(["---"] * len(columns)))
    first = first + "{" + "l" * len(columns) + "}" if style == "latex" else first
    return "\n".join(x for x in (first, top, *lines, last) if x)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def merged_shards(shards: Sequence[DataFrame], key: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """Shards as one table; a key in two of them is an error, and so is one that ``expected`` lacks or has alone."""
    from ..operators.contracts import repeated_keys, require, uncovered

    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    require(repeated_keys(out, key), "shards overlap")
    if expected is not None:
        require(uncovered(out, expected, key), "shards don't cover what is expected")
    return out
