"""Nested records into related flat tables by shared inlining (problem 2).

First the schema graph of all documents is gathered: which elements occur under which, and whether an element was ever
repeated. Then the graph decides on the tables: repeated elements, elements shared by several parents and recursive ones get
a table of their own, everything that occurs once is inlined into the nearest table above it. Last every document is cut
up accordingly; a row carries its own id, its parent's id and, where natural keys are named, its parent's key.

The same content may come in several shapes. An element counts as repeated if any document of its feed repeats it; in others
a lone object is a list of one. Objects whose names are all digits, and lists of [key, object], are lists of keyed elements.
A text that holds a JSON object or list stands for that. A byte order mark is dropped.

Documents are walked with a stack of their own, so their depth is bounded by memory alone. Paths are spelled out for DEEP levels; below,
an element of the name of one above it is that element, and rows are numbered instead of spelling out their place."""

from __future__ import annotations

import json
import json.decoder
import json.scanner
import sys
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More distinct paths than this in one feed are no schema (names that are data); it is an error, nothing is dropped.
MAX_PATHS = 100_000
ROOT = "$"
#: Levels down to which paths and row ids are spelled out.
DEEP = 64
#: Nested brackets that the fast reader surely reads.
PLAIN_DEPTH = 900


def read(text: str):
    """The JSON value of a text, however deeply nested."""
    try:
        return json.loads(text)
    except RecursionError:
        slow = json.JSONDecoder()
        slow.parse_object, slow.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
        slow.scan_once = json.scanner.py_make_scanner(slow)
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(usual + 4 * (text.count("[") + text.count("{") + PLAIN_DEPTH))
        try:
            return slow.decode(text)
        finally:
            sys.setrecursionlimit(usual)


def load(text: str | None):
    """The document, or None if the text is null or no complete JSON."""
    if text is None:
        return None
    try:
        return unwrap(read(text.lstrip("\ufeff")))
    except ValueError:
        return None


def unwrap(value):
    """Text that holds an object or a list becomes that; anything else stays."""
    while isinstance(value, str) and value.lstrip("\ufeff \t\r\n")[:1] in ("{", "["):
        try:
            value = read(value.lstrip("\ufeff"))
        except ValueError:
            break
    return value


def plain(value) -> str | None:
    """Scalars as text, numbers in plain digits."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e18:
        return str(int(value))
    return str(value)


def elements(value) -> list[tuple[str, int, object]] | None:
    """(key, position, element) if the value is a repeated element in any of its shapes, else None. Positions are those sent."""
    if isinstance(value, list):
        out = []
        for i, x in enumerate(value):
            x = unwrap(x)
            if isinstance(x, list) and len(x) == 2 and not isinstance(x[0], (list, dict)) and isinstance(pair := unwrap(x[1]), dict):
                out.append((plain(x[0]), i, pair))
            else:
                out.append((str(i), i, x))
        return out
    if isinstance(value, dict) and value and all(k.isdigit() for k in value):
        return [(k, i, unwrap(x)) for i, (k, x) in enumerate(value.items())]
    return None


def child(path: str, name: str) -> str:
    """The path of an element: below DEEP levels that of the nearest element of its name above it, if there is one."""
    if path.count(".") >= DEEP:
        if path.endswith("." + name):
            return path
        if (at := path.rfind(f".{name}.")) >= 0:
            return path[: at + 1 + len(name)]
    return f"{path}.{name}"


def paths(doc, root: str, seen: Counter) -> None:
    """Counts (path, kind) over one document; kinds: many, object, scalar, null."""
    open_ = [(doc, root)]
    while open_:
        value, path = open_.pop()
        value = unwrap(value)
        if (many := elements(value)) is not None:
            seen[path, "many"] += 1
            open_ += [(x, child(path, "[]") if elements(x) is not None else path) for _, _, x in many]
        elif isinstance(value, dict):
            seen[path, "object"] += 1
            open_ += [(x, child(path, k)) for k, x in value.items()]
        else:
            seen[path, "null" if value is None else "scalar"] += 1


@dataclass
class Plan:
    """tables: paths that have a table of their own. same: path -> the path under which a shared or recursive element is kept."""

    tables: set[str] = field(default_factory=set)
    same: dict[str, str] = field(default_factory=dict)


def schema_graph(docs: DataFrame, *, feed: str, body: str) -> DataFrame:
    """(feed, path, kind, n) over all documents; the size depends on the schema only."""

    def count(batches):
        for b in batches:
            seen: dict[str, Counter] = {}
            for f, t in zip(b["feed"], b["body"]):
                if (doc := load(t)) is not None:
                    paths(doc, ROOT, seen.setdefault(f, Counter()))
            rows = [(f, p, k, n) for f, c in seen.items() for (p, k), n in c.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["feed", "path", "kind", "n"])

    work = docs.select(F.col(feed).alias("feed"), F.col(body).alias("body")).where("feed IS NOT NULL AND body IS NOT NULL")
    return work.mapInPandas(count, "feed string, path string, kind string, n long").groupBy("feed", "path", "kind").agg(F.sum("n").alias("n"))


def plan_tables(graph: list[tuple[str, str, int]], declared: list[str] = ()) -> Plan:
    """Which elements of one feed (path, kind, n) become tables, besides those declared as repeated."""
    plan = Plan({ROOT, *declared})
    children: dict[str, set[str]] = {}
    for path, kind, _ in graph:
        if kind == "many":
            plan.tables.add(path)
        above, _, name = path.rpartition(".")
        if above:
            children.setdefault(above, set()).add(name)
    # shared and recursive elements: objects of one name and one set of children under different parents
    kept: dict[tuple[str, frozenset], str] = {}
    for path in sorted(children, key=lambda p: (p.count("."), p)):
        name = path.rpartition(".")[2]
        if path == ROOT or name == "[]":
            continue
        mark = name, frozenset(children[path])
        if mark in kept:
            plan.same[path] = kept[mark]
            plan.tables |= {path, kept[mark]}
        else:
            kept[mark] = path
        parts = path.split(".")
        for i in range(1, len(parts) - 1):
            if parts[i] == name and children[path] & children.get(".".join(parts[: i + 1]), set()):
                plan.same[path] = ".".join(parts[: i + 1])
                plan.tables |= {path, plan.same[path]}
                break
    return plan


def inlined(value: dict, path: str, plan: Plan, columns: dict) -> list[tuple[str, object]]:
    """Puts the scalars of an object and of the objects inlined in it into columns; returns the elements that have tables of their own."""
    below = []
    open_ = [(value, path, "")]
    while open_:
        value, path, prefix = open_.pop()
        inside = []
        for k, x in unwrap(value).items():
            p, x = child(path, k), unwrap(x)
            if p in plan.tables:
                below.append((p, x))
            elif isinstance(x, dict):
                inside.append((x, p, f"{prefix}{k}."))
            else:
                columns[prefix + k] = plain(x) if not isinstance(x, list) else json.dumps(x)
        open_ += inside[::-1]
    return below


def cut(doc, plan: Plan, keys: dict[str, str]) -> list[tuple]:
    """Rows (tab, row_id, parent_id, ordinal, parent_key, columns) of one document."""
    rows: list[tuple] = []
    whole = elements(doc)
    # value, path, row id, parent, key, ordinal, parent's key, depth
    open_ = [(e, ROOT, f"/{i}", None, k, i, None, 0) for k, i, e in whole] if whole is not None else [(doc, ROOT, "/0", None, None, 0, None, 0)]
    open_.reverse()
    while open_:
        value, path, rid, parent, key, ordinal, parent_key, depth = open_.pop()
        columns: dict = {}
        below: list = []
        if key is not None:
            columns["@key"] = key
        box = child(path, "[]")
        if box in plan.tables and box != path if isinstance(value, dict) else elements(value) is not None:
            below.append((box, value))
        elif isinstance(value, dict):
            below = inlined(value, path, plan, columns)
        elif value is not None:
            columns["@value"] = plain(value)
        rows.append((plan.same.get(path, path), rid, parent, ordinal, parent_key, columns))
        own = columns.get(keys[path]) if path in keys else parent_key
        if "+" + path in keys and own is not None:
            own = None if parent_key is None else f"{parent_key}/{own}"
        inside = []
        for p, x in below:
            if x is None:
                continue
            for k, i, e in elements(x) if elements(x) is not None else [("0", 0, x)]:
                # the open elements and the rows so far make the number unique
                at = f"{rid}/{p.rpartition('.')[2]}/{i}" if depth < DEEP else f"~{len(rows)}.{len(inside)}"
                inside.append((e, p, at, rid, k, i, own, depth + 1))
        open_ += inside[::-1]
    return rows


def shred(docs: DataFrame, *, ident: str, feed: str, body: str, keys: dict[str, dict[str, str]] | None = None, repeated: dict[str, list[str]] | None = None, carry: list[str] = ()) -> DataFrame:
    """All flat tables of the documents as one relation: ident, feed, tab (path of the table), row_id (unique within a
    document), parent_id, ordinal (position in the parent), parent_key, columns (name -> text; '@key' is the key of a keyed
    element, '@value' a scalar element). Table X of feed f is the rows with that feed and tab; (ident, parent_id) refers to
    (ident, row_id).

    keys: by feed and table path the column that is its natural key; with an entry '+path' the key of the parent and a
    slash are put before. repeated: by feed the paths that are repeated by contract, even if no document shows it. carry:
    columns of the input to keep on each row. parent_key of a child is that key; tables without one hand on their parent's.
    Null, empty and incomplete bodies give no rows, nor do rows without ident or feed; an element that is null in a list has a row without
    columns. Columns of the input other than the three named are ignored."""
    graph: dict[str, list] = {}
    for r in schema_graph(docs, feed=feed, body=body).limit(MAX_PATHS + 1).toLocalIterator():
        graph.setdefault(r["feed"], []).append((r["path"], r["kind"], r["n"]))
    if sum(map(len, graph.values())) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths: the names of these documents are data")
    plans = docs.sparkSession.sparkContext.broadcast({f: plan_tables(g, (repeated or {}).get(f, [])) for f, g in graph.items()})
    named = keys or {}
    kind = dict(docs.dtypes)[ident]

    def run(batches):
        for b in batches:
            out = []
            for i, f, t, *more in zip(b["ident"], b["feed"], b["body"], *(b[f"carry{j}"] for j in range(len(carry)))):
                if (doc := load(t)) is not None and not isinstance(doc, (str, int, float)):
                    out += [(i, f, *r, *more) for r in cut(doc, plans.value[f], named.get(f, {}))]
            if out:
                yield pd.DataFrame(out, columns=["ident", "feed", "tab", "row_id", "parent_id", "ordinal", "parent_key", "columns", *(f"carry{j}" for j in range(len(carry)))])

    work = docs.select(F.col(ident).alias("ident"), F.col(feed).alias("feed"), F.col(body).alias("body"), *[F.col(c).alias(f"carry{j}") for j, c in enumerate(carry)]).where("ident IS NOT NULL AND feed IS NOT NULL AND body IS NOT NULL")
    kept = "".join(f", carry{j} {dict(docs.dtypes)[c]}" for j, c in enumerate(carry))
    out = work.mapInPandas(run, f"ident {kind}, feed string, tab string, row_id string, parent_id string, ordinal int, parent_key string, columns map<string,string>{kept}")
    return out.withColumnsRenamed({"ident": ident, **{f"carry{j}": c for j, c in enumerate(carry)}})


def flat(rows: DataFrame, feed: str, tab: str, columns: list[str]) -> DataFrame:
    """One flat table with named columns (text) out of shred()'s relation."""
    return rows.where((F.col("feed") == feed) & (F.col("tab") == tab)).select(*[c for c in rows.columns if c not in ("feed", "tab", "columns")], *[F.col("columns")[c].alias(c) for c in columns])
