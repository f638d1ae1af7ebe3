"""String leaves of dynamic JSON: walking, selecting by path expression, reading and writing back."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..sources.rules import compile_path

STEPS = "ARRAY<STRUCT<key: STRING, idx: INT>>"
LEAVES = f"ARRAY<STRUCT<path: STRING, steps: {STEPS}, text: STRING>>"
SIGNED = ("thinking", "signature", "redacted_thinking")


def _walk(node, path: str, steps: list, out: list) -> None:
    stack = [(node, path, steps)]
    while stack:
        node, path, steps = stack.pop()
        if isinstance(node, str):
            out.append((path, steps, node))
        elif isinstance(node, dict):
            stack += [(v, f"{path}.{k}", [*steps, (k, None)]) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(v, f"{path}[{i}]", [*steps, (None, i)]) for i, v in reversed(list(enumerate(node)))]


def _leaves(body: str | None) -> list:
    out: list = []
    try:
        _walk(json.loads(body), "$", [], out)
    except (TypeError, ValueError, RecursionError):
        return []
    return out


_LEAF_TYPE = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("steps", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("idx", T.IntegerType())]))), T.StructField("text", T.StringType())]))


@pandas_udf(_LEAF_TYPE)
def _leaves_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [{"path": p, "steps": [{"key": k, "idx": i} for k, i in s], "text": t} for p, s, t in _leaves(b)])


def leaves(rows: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """A row for each string in a JSON body: keys, path, steps, text. Unparsable bodies have none; a missing path is no row.

    One Arrow pass; a recursive query would hold every level of every body in one table.
    """
    each = rows.select(*keys, F.explode(_leaves_of(F.col(body))).alias("l"))
    return each.select(*keys, "l.path", "l.steps", "l.text")


def under(steps: Column, expression: str) -> tuple[Column, list[str], str | None]:
    """Whether a leaf lies at or below a path expression; also its excluded types and last key (see compile_path)."""
    wanted, excluded, last = compile_path(expression)
    tests = [F.size(steps) >= len(wanted)]
    for i, step in enumerate(wanted):
        own = F.get(steps, F.lit(i))
        if step[0] == "key":
            tests.append(own["key"] == step[1])
        elif step[0] == "index":
            tests.append(own["idx"] == step[1])
        else:
            tests.append((own["idx"] >= step[1]) if step[2] is None else own["idx"].between(step[1], step[2] - 1))
    if last:
        tests.append(F.try_element_at(steps, F.lit(-1))["key"] == last)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)), excluded, last


def select_paths(found: DataFrame, expressions: list[str], *keys: str) -> DataFrame:
    """The leaves that any of the expressions selects, each once."""
    keep, unlike = F.lit(False), []
    for e in expressions:
        inside, excluded, _ = under(F.col("steps"), e)
        depth = len(compile_path(e)[0])
        if excluded:
            unlike.append((inside, depth, excluded))
        else:
            keep = keep | inside
    if not unlike:
        return found.where(keep)
    out = found.withColumn("__keep", keep)
    for n, (inside, depth, excluded) in enumerate(unlike):
        types = found.where((F.size("steps") == depth + 1) & (F.try_element_at("steps", F.lit(-1))["key"] == "type") & F.col("text").isin(*excluded))
        banned = types.select(*(F.col(k).alias(f"__{k}{n}") for k in keys), F.slice("steps", 1, depth).alias(f"__s{n}"), F.lit(True).alias(f"__ban{n}")).distinct()
        on = [F.col(k) == F.col(f"__{k}{n}") for k in keys] + [F.slice("steps", 1, depth) == F.col(f"__s{n}")]
        out = out.join(banned, reduce(lambda a, b: a & b, on), "left").withColumn("__keep", F.col("__keep") | (inside & F.col(f"__ban{n}").isNull())).drop(*(f"__{k}{n}" for k in keys), f"__s{n}", f"__ban{n}")
    return out.where("__keep").drop("__keep")


def is_image_payload(path: Column) -> Column:
    return F.endswith(path, F.lit(".source.data"))


def touches_signed(steps: Column) -> Column:
    """Whether a path goes through a signed block, which must stay byte for byte."""
    return F.arrays_overlap(F.transform(steps, lambda s: F.coalesce(s["key"], F.lit(""))), F.array(*map(F.lit, SIGNED)))


def _put(body: str | None, updates) -> str | None:
    try:
        tree = json.loads(body)
    except (TypeError, ValueError, RecursionError):
        return body
    changed = False
    for u in updates if updates is not None else []:
        node, steps = tree, [s["key"] if s["key"] is not None else int(s["idx"]) for s in u["steps"]]
        try:
            for s in steps[:-1]:
                node = node[s]
            if steps and isinstance(node[steps[-1]], str):
                node[steps[-1]] = u["text"]
                changed = True
        except (KeyError, IndexError, TypeError):
            continue
    return json.dumps(tree, ensure_ascii=False) if changed else body


def set_texts(body: Column, updates: Column) -> Column:
    """Writes texts back to string leaves that exist (``updates``: array of steps, text); the root and other values stay, and
    a body without change stays byte for byte. Built-in functions have no deep update, so this is an Arrow pass."""

    @pandas_udf(T.StringType())
    def put(bodies: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([_put(b, c) for b, c in zip(bodies, changes)], dtype=object)

    return put(body, updates)


def inject_prompt(body: Column, prompt: str, url: Column | None = None, pattern: str = ".*") -> Column:
    """Adds a prompt to ``system``, where the whole ``url`` matches ``pattern`` and the prompt is not empty: absent or empty, it is the prompt; a string gets it after a blank line; a list gets a text
    block. A body that ends with it already, or with another kind of ``system``, is unchanged."""

    def put(text: str | None) -> str | None:
        try:
            tree = json.loads(text)
        except (TypeError, ValueError):
            return text
        if not isinstance(tree, dict):
            return text
        own, block = tree.get("system"), {"type": "text", "text": prompt}
        if not own:
            tree["system"] = prompt
        elif isinstance(own, str) and not own.endswith(prompt):
            tree["system"] = f"{own}\n\n{prompt}"
        elif isinstance(own, list) and not (isinstance(own[-1], dict) and own[-1].get("type") == "text" and own[-1].get("text") == prompt):
            tree["system"] = [*own, block]
        else:
            return text
        return json.dumps(tree, ensure_ascii=False)

    @pandas_udf(T.StringType())
    def inject(bodies: pd.Series) -> pd.Series:
        return bodies.map(put)

    if not prompt:
        return body
    return inject(body) if url is None else F.when(F.regexp_like(url, F.lit(f"^(?:{pattern})$")), inject(body)).otherwise(body)
