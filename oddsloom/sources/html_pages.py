"""Saved HTML pages as relations: cells of detail pages, hidden fields, partial-update responses."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walker(HTMLParser):
    """Texts of the elements whose class holds one of the wanted words, with the last title before them."""

    def __init__(self, title: str, cell: str):
        super().__init__(convert_charrefs=True)
        self.want, self.open, self.rows, self.last = {"title": title, "cell": cell}, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        words = (dict(attrs).get("class") or "").split()
        self.open.append((tag, next((k for k, w in self.want.items() if w in words), None), []))

    def handle_endtag(self, tag):
        while self.open:
            t, kind, text = self.open.pop()
            said = " ".join("".join(text).split())
            if kind == "title":
                self.last = said
            elif kind == "cell":
                self.rows.append((self.last, said))
            if t == tag:
                break

    def handle_data(self, data):
        for _, kind, text in self.open:
            if kind:
                text.append(data)


def detail_cells(pages: DataFrame, ident: str, html: str, *, title: str = "title", cell: str = "cell") -> DataFrame:
    """(ident, seq, section, text): the cells of each page in order with the title above them. Broken markup is read as far as it goes."""
    kind = dict(pages.dtypes)[ident]

    def run(batches):
        for b in batches:
            out = []
            for i, h in zip(b["i"], b["h"]):
                w = _Walker(title, cell)
                w.feed(h)
                w.close()
                out += [(i, n, s, t) for n, (s, t) in enumerate(w.rows)]
            if out:
                yield pd.DataFrame(out, columns=["i", "seq", "section", "text"])

    work = pages.select(F.col(ident).alias("i"), F.col(html).alias("h")).where("h IS NOT NULL")
    return work.mapInPandas(run, f"i {kind}, seq int, section string, text string").withColumnRenamed("i", ident)


def cell_prices(cells: DataFrame) -> DataFrame:
    """Adds side, line and price of cells such as '1 (-3.0) 1.85', 'Over 2.5 1.9', 'X 3.4' or '2/1 21': the away side's line is turned
    into the home side's. Cells of another form are left out."""
    t = F.col("text")
    form = r"^(?i)(1/1|1/X|1/2|X/1|X/X|X/2|2/1|2/X|2/2|1|X|2|over|under|und)\s*(?:\(?([+-]?\d+(?:\.\d+)?)\)?\s+)?(\d+(?:\.\d+)?)$"
    label = F.upper(F.regexp_extract(t, form, 1))
    line = F.regexp_extract(t, form, 2).try_cast("double")
    side = F.when(label == "1", "home").when(label == "2", "away").when(label == "X", "draw").when(label == "OVER", "over").when(label.isin("UNDER", "UND"), "under").otherwise(label)
    price = F.regexp_extract(t, form, 3).try_cast("double")
    return cells.where(t.rlike(form)).withColumns({"side": side, "line": F.when(label == "2", -line).otherwise(line), "price": F.when(price > 1, price)}).where("price IS NOT NULL")


def paired_cells(cells: DataFrame, *keep: str) -> DataFrame:
    """(keep, section, line, selections): of cell_prices() the lines of each section that have both sides (or all, of results with a draw and of
    half/full combos, of which six are enough). Of repeated cells the first by seq."""
    first = cells.groupBy(*keep, "section", "line", "side").agg(F.min_by("price", "seq").alias("price"))
    rows = first.groupBy(*keep, "section", "line").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", "price")))).alias("selections"))
    has = lambda *k: F.forall(F.array(*map(F.lit, k)), lambda x: F.map_contains_key("selections", x))
    return rows.where(has("home", "away") | has("over", "under") | (has("1/1", "2/2") & (F.size("selections") >= 6)))


def hidden_fields(html: Column) -> Column:
    """Map of the names and values of a page's hidden inputs (double-quoted, type before name before value); of repeated names the last value holds."""
    form = r'<input[^>]*type="hidden"[^>]*name="([^"]*)"[^>]*value="([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(form), 1).alias("k"), F.regexp_extract_all(html, F.lit(form), 2).alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def delta_parts(text: str) -> list[tuple[str, str, str]]:
    """(type, id, content) of a partial-update response, length|type|id|content|... ; a cut-off tail is left out."""
    out, at = [], 0
    while at < len(text):
        stop = text.find("|", at)
        if stop < 0 or not text[at:stop].isdigit():
            break
        n = int(text[at:stop])
        kind, _, rest = text[stop + 1 :].partition("|")
        start = stop + 1 + len(kind) + 1
        ident = text[start : text.find("|", start)]
        body = start + len(ident) + 1
        if body + n > len(text):
            break
        out.append((kind, ident, text[body : body + n]))
        at = body + n + 1
    return out
