"""Predicates in the dialect of an embedded SQL store, as Spark expressions.

Translated: LIKE without case (ILIKE), "name" as an identifier if there is such a column, else as a text, ``==``,
``IS`` and ``IS NOT`` between values as null-safe comparison, and integer ``/`` as ``div`` where both sides are integer
columns or literals. Everything else is Spark SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\w+(?:\.\w+)*|==|!=|<>|<=|>=|\|\||.""", re.S)

#: What Spark SQL itself knows after IS and IS NOT.
KEPT = ("NULL", "TRUE", "FALSE", "UNKNOWN", "DISTINCT")


def translate(expression: str, integers: set[str] = frozenset(), texts: set[str] = frozenset(), columns: set[str] | None = None) -> str:
    """``integers`` and ``texts``: names of columns of such types, ``columns`` of all, in lower case; without ``columns``
    every "name" is an identifier."""
    tokens = _TOKEN.findall(expression)
    solid = [i for i, t in enumerate(tokens) if not t.isspace()]
    out = list(tokens)
    whole = lambda t: t.strip('"`').lower() in integers or t.isdigit()
    for k, i in enumerate(solid):
        t = tokens[i]
        before, after = tokens[solid[k - 1]] if k else "", tokens[solid[k + 1]] if k + 1 < len(solid) else ""
        if t[0] == '"':
            name = t[1:-1].replace('""', '"')
            known = columns is None or name.lower() in columns
            out[i] = "`" + name.replace("`", "``") + "`" if known else "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
        elif t[0] == "'":
            out[i] = "'" + t[1:-1].replace("''", "\\'").replace("\\", "\\\\").replace("\\\\'", "\\'") + "'"
        elif t.upper() == "LIKE":
            out[i] = "ILIKE"
        elif t == "==":
            out[i] = "="
        elif t == "/" and whole(before) and whole(after):
            out[i] = "div"
        elif t.upper() == "IS" and after.upper() == "NOT":
            if tokens[solid[k + 2]].upper() not in KEPT if k + 2 < len(solid) else False:
                out[i], out[solid[k + 1]] = "IS", "DISTINCT FROM"
        elif t.upper() == "IS" and after.upper() not in KEPT:
            out[i] = "<=>"
        elif t.isdigit() and before in ("=", "==", "<", ">", "<=", ">=", "<>", "!=") and k > 1 and tokens[solid[k - 2]].strip('"`').lower() in texts:
            out[i] = f"'{t}'"  # a text column compares with a number as text
    return "".join(out)


def predicate(df: DataFrame, expression: str) -> Column:
    integers = {f.name.lower() for f in df.schema if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    texts = {f.name.lower() for f in df.schema if f.dataType.simpleString() == "string"}
    return F.expr(translate(expression, integers, texts, {c.lower() for c in df.columns}))
