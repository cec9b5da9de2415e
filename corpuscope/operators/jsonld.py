"""Structured-data blocks.

JSON is recursive, so this is the one place of the batch path that leaves the JVM: an Arrow UDF
over the script bodies only.  Pages without such scripts send a null.
"""

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from corpuscope.functions import html as h
from corpuscope.functions.lexicon import TRACKED_SCHEMA_PROPERTIES
from corpuscope.functions.sqltext import each, keep, let

# Executors need no installed copy of this package to run the UDF.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("properties", T.ArrayType(T.StringType())),
    T.StructField("valid", T.BooleanType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("values", T.MapType(T.StringType(), T.StringType())),
]))


LD_SCRIPT = r"""(?is)^<script\s(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*?(?<![^\s"'])type\s*=\s*["']?application/ld\+json["']?[\s/>]"""


def script_bodies(html: str) -> str:
    """Bodies of the page's ld+json scripts, null when there are none (comments do not count).

    No lambda in here may use the variable of another one: the text is the argument of an Arrow
    UDF, and Spark does not plan such an argument.
    """
    ld = keep(h.extract_all(html, h.SCRIPTS), lambda b: h.matches(b, LD_SCRIPT))
    bodies = each(ld, lambda b: h.trim_ws(h.replace(b, rf"(?is)^<script{h.ATTRS}>|</script\s*>$")))
    some = let(keep(bodies, lambda b: f"{b} <> ''"), lambda v: f"CASE WHEN size({v}) > 0 THEN {v} END")
    return f"CASE WHEN {h.matches(html, r'(?i)ld[+]json')} THEN {some} END"


def _walk(node):
    """Objects of a document in reading order, outer ones first."""
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            yield item
            children = item.values()
        elif isinstance(item, list):
            children = item
        else:
            continue
        stack.extend(c for c in reversed(list(children)) if isinstance(c, (dict, list)))


def _types(doc):
    seen = {}
    for obj in _walk(doc):
        declared = obj.get("@type")
        for t in declared if isinstance(declared, list) else [declared]:
            if isinstance(t, str):
                seen.setdefault(t)
    return list(seen)


def _text(value):
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "@id", "url") if value.get(k) is not None), None)
    return value.strip() if isinstance(value, str) else ""


def _values(doc):
    found = {}
    for obj in _walk(doc):
        for name in TRACKED_SCHEMA_PROPERTIES:
            if name not in found and name in obj:
                text = _text(obj[name])
                if text:
                    found[name] = text
    return found


def _properties(doc):
    names = {}
    for root in doc if isinstance(doc, list) else [doc]:
        if not isinstance(root, dict):
            continue
        graph = root.get("@graph")
        nodes = [root] + [n for n in (graph if isinstance(graph, list) else []) if isinstance(n, dict)]
        for node in nodes:
            for key in node:
                if not key.startswith("@"):
                    names.setdefault(key)
    return list(names)


def _reject(constant):
    raise ValueError(constant)


def read_block(body: str) -> dict:
    out = {"types": [], "properties": [], "valid": False, "excerpt": body, "values": {}}
    try:
        doc = json.loads(body, parse_constant=_reject)
    except (ValueError, RecursionError):
        return out
    return {**out, "types": _types(doc), "properties": _properties(doc), "valid": True, "values": _values(doc)}


def _read_pages(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda page: None if page is None else [read_block(b) for b in page])


def read_blocks(bodies) -> Column:
    return F.pandas_udf(_read_pages, BLOCK_SCHEMA)(bodies)
