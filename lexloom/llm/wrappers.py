"""HTML extraction by inferred wrappers: union-free regular expressions over the pages of a host.

A page is a token stream of tags, text and comments (dropped).  Tags that aren't closed are
closed where HTML implies it, so that a repeated group is a balanced stretch; elements nested deeper than
``DEPTH`` become siblings at that depth, as in browsers.  Repeats in one
page are folded first: neighbours of equal labels, and longer stretches that follow
themselves, become one repeated group whose inner mismatches are resolved by alignment.  The
folded streams of a host are then aligned one after another: tags that match stay, text
against text is a slot, and what only one side has is an optional group; this leaves no
unions.  Every page of the host matches the wrapper, so each text falls into one slot.

A slot that holds one text, the same on all pages with text of a host, is part of the template if
the host has at least two such pages that differ in their texts; the others are fields.  The main text is what lies in the innermost element that
holds at least ``SHARE`` of the host's field characters, the page's head aside; where that element
holds less than ``SHARE`` of a page's own field characters (another layout, a second column, many
comments), the main text of the page is all of its fields, its head aside.

Every page is parsed and folded once, into a stored table of items.  Equal folded streams of a host are one, so the
work of inference grows with the variety of pages; streams are aligned ``PART`` at a time, round after round, until a host has one
wrapper, so no task holds more.

Nulls: a page without url is of host ''; one without html has no fields and empty text, as
has an empty page.  Rows without page_id keep their row.  Repeated rows are one kind of stream and
each get a result.  Very long pages and very deep ones are parsed whole, without recursion over their elements.  Ties: of equal alignments
the earliest match counts, of equal containers the one that sorts first, of equally long streams the one that sorts first.  Only ``page_id``, ``url`` and ``html`` are read, so other columns never
clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import materialize

SHARE = 0.6
#: Streams of a host that one task aligns in a round.
PART = 32
#: Elements below this depth are siblings.
DEPTH = 200
#: Wrappers and slot statistics are broadcast up to so many characters; else joined.
BROADCAST_CHARS = 64 << 20

TEXT = "#"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(script|style|textarea|noscript)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|[^<]+|<",
    re.S | re.I,
)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "body": {"head"}, **{t: {"p"} for t in "div ul ol dl table article section nav footer header aside main h1 h2 h3 h4 h5 h6 pre blockquote form".split()},
}
_SCOPE = frozenset("html body div ul ol dl table article section nav footer header aside main blockquote form".split())

#: A node: (label, children), or (TEXT, text).  An item of a stream: [label, optional, repeated, content]
#: where content is a list of items (a wrapper) or a list of instances of lists of items (a page).


def parse(source: str) -> list[tuple]:
    """The balanced token stream of a page, as nested nodes."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    for m in _TOKEN.finditer(source):
        name = m.group(3)
        if name is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                text = " ".join(entities.unescape(token).split())
                if text:
                    stack[-1][1].append((TEXT, text))
            elif m.group(1):
                stack[-1][1].append((m.group(1).lower(), []))
            continue
        name = name.lower()
        if m.group(2):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in _CLOSES.get(name, ()):
                del stack[k:]
            elif stack[k][0] in _SCOPE:
                break
        kind = _CLASS.search(m.group(4))
        words = next((g for g in kind.groups() if g is not None), "").split() if kind else []
        children: list = []
        stack[-1][1].append((f"{name}.{words[0]}" if words else name, children))
        if name not in _VOID and not m.group(4).endswith("/") and len(stack) < DEPTH:
            stack.append((name, children))
    return root


def fold(nodes: list[tuple]) -> list[list]:
    """Items of a page: runs of equal labels, and stretches that repeat, become repeated items with instances."""
    items: list[list] = []
    for label, run in groupby(nodes, key=lambda n: n[0]):
        instances = [n[1] if label == TEXT else fold(n[1]) for n in run]
        items.append([label, False, len(instances) > 1, instances])
    return _fold_stretches(items)


#: Lists of up to so many items are folded without arrays, which gives the same.
_FEW = 24


def _fold_stretches(items: list[list]) -> list[list]:
    """Stretches of items that follow themselves become one; the shortest first, from the left."""
    labels = [i[0] for i in items]
    if len(set(labels)) == len(labels):
        return items
    numbers: dict[str, int] = {}
    width = 2
    while width <= len(items) // 2:
        runs = _runs_of(labels, width) if len(items) <= _FEW else _runs_in(np.array([numbers.setdefault(x, len(numbers)) for x in labels]), width)
        if runs:
            folded, at = [], 0
            for k, end in runs:
                folded += items[at:k]
                group = [items[j : j + width] for j in range(k, end, width)]
                folded.append(["(" + " ".join(labels[k : k + width]) + ")", False, True, group])
                at = end
            items = folded + items[at:]
            labels = [i[0] for i in items]
        width += 1
    return items


def _runs_of(labels: list[str], width: int) -> list[tuple[int, int]]:
    """(begin, end) of stretches of some width that follow themselves."""
    out, k = [], 0
    while k + 2 * width <= len(labels):
        end = k + width
        while labels[end : end + width] == labels[k : k + width]:
            end += width
        if end > k + width:
            out.append((k, end))
            k = end
        else:
            k += 1
    return out


def _runs_in(labels: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The same, of numbers."""
    differ = np.flatnonzero(labels[:-width] != labels[width:])
    edges = np.concatenate([[-1], differ, [len(labels) - width]])
    out = []
    # places that equal the one a width later, run by run
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = int(b - a - 1)
        if n >= width:
            k = max(int(a) + 1, out[-1][1] if out else 0)
            if (n := int(b) - k) >= width:
                out.append((k, k + (n // width + 1) * width))
    return out


def wrapper_of(items: list[list]) -> list[list]:
    """A page's items as a wrapper: the instances of an item are aligned to one."""
    out = []
    for label, optional, repeated, instances in items:
        content: list = []
        if label != TEXT:
            for k, i in enumerate(instances):
                content = wrapper_of(i) if k == 0 else align(content, wrapper_of(i))
        out.append([label, optional, repeated, content])
    return out


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of labels, as pairs of places; the earliest among equals."""
    n, m = len(a), len(b)
    lead = 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    out = [(k, k) for k in range(lead)]
    if lead == n or lead == m:
        return out
    if (n - lead) * (m - lead) > _TABLE:
        return out + [(lead + i, lead + j) for i, j in _matches_in_blocks(a[lead:], b[lead:])]
    best = [[0] * (m + 1) for _ in range(n - lead + 1)]
    for i in range(n - 1, lead - 1, -1):
        row, below = best[i - lead], best[i - lead + 1]
        for j in range(m - 1, lead - 1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = lead
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i - lead + 1][j] >= best[i - lead][j + 1]:
            i += 1
        else:
            j += 1
    return out


#: Cells of a table of longest common subsequences from which it is made by arrays, block by block, which gives the same.
_TABLE = 1 << 12


def _matches_in_blocks(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The same; every so many rows of the table are kept, and those between made again."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(t, len(numbers)) for t in side], np.int32) for side in (a, b))
    n, m = len(x), len(y)
    step = max(1, int(n**0.5))

    def above(i: int, below: np.ndarray) -> np.ndarray:
        row = below.copy()
        np.maximum(row[:-1], np.where(y == x[i], below[1:] + 1, 0), out=row[:-1])
        return np.maximum.accumulate(row[::-1])[::-1]

    kept = {n: np.zeros(m + 1, np.int32)}
    row = kept[n]
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    out, i, j = [], 0, 0
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        rows = [kept[hi]]
        for k in range(hi - 1, lo - 1, -1):
            rows.append(above(k, rows[-1]))
        rows.reverse()
        while i < hi and j < m:
            if x[i] == y[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif rows[i - lo + 1][j] >= rows[i - lo][j + 1]:
                i += 1
            else:
                j += 1
        if j == m:
            break
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of all that either wrapper matches."""
    out, i, j = [], 0, 0
    for x, y in [*_matches([t[0] for t in a], [t[0] for t in b]), (len(a), len(b))]:
        out += [[t[0], True, *t[2:]] for t in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append([a[x][0], a[x][1] or b[y][1], a[x][2] or b[y][2], align(a[x][3], b[y][3])])
        i, j = x + 1, y + 1
    return out


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression."""
    out = []
    for label, optional, repeated, content in wrapper:
        mark = ("*" if optional else "+") if repeated else "?" if optional else ""
        inner = expression(content)
        body = "#" if label == TEXT else inner if label[0] == "(" else f"<{label}>{inner}</{label.split('.')[0]}>"
        out.append(f"({body}){mark}" if mark else body)
    return "".join(out)


def slots(wrapper: list[list], items: list[list], path: str = "") -> Iterator[tuple[str, str]]:
    """(slot, text) of a page that the wrapper matches, in order."""
    for x, y in _matches([t[0] for t in wrapper], [t[0] for t in items]):
        label, at = wrapper[x][0], f"{path}/{x}:{wrapper[x][0]}"
        for instance in items[y][3]:
            if label == TEXT:
                yield at, instance
            else:
                yield from slots(wrapper[x][3], instance, at)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, items, streams = [], [], []
        for url, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            page = fold(parse(source.as_py() or ""))
            hosts.append(host_of(url))
            items.append(json.dumps(page, separators=(",", ":")))
            streams.append(json.dumps(wrapper_of(page), separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in (hosts, items, streams))], names=["page_id", "host", "items", "stream"])


def _infer(pdf: pd.DataFrame) -> pd.DataFrame:
    wrapper: list | None = None
    # the shortest stream first: most of it is common to all
    for stream in sorted(pdf["stream"], key=lambda s: (len(s), s)):
        wrapper = json.loads(stream) if wrapper is None else align(wrapper, json.loads(stream))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "stream": [json.dumps(wrapper, separators=(",", ":"))]})


def wrappers(folded: DataFrame, part: int = PART) -> DataFrame:
    """(host, stream): the wrapper of every host, as JSON, from stored ``FOLDED`` rows."""
    found = materialize(folded.select("host", "stream").distinct(), "html-streams")
    while True:
        # parts by a hash, so that a host of any variety is spread
        sizes = found.groupBy("host").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
        if sizes.where("parts > 1").isEmpty():
            break
        split = found.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")))
        found = materialize(split.groupBy("host", "part").applyInPandas(lambda pdf: _infer(pdf), "host string, stream string").distinct(), "html-streams")
    return found.groupBy("host").applyInPandas(lambda pdf: _infer(pdf), "host string, stream string")


FOLDED = "page_id long, host string, items string, stream string"


class _Held:
    """Wrapper and field slots by host, from a broadcast or from columns of the rows."""

    def __init__(self, broadcast):
        self._value = broadcast.value if broadcast is not None else None
        self._parsed: dict[str, list] = {}

    def wrapper(self, host: str, column: pa.Array | None, k: int) -> list:
        if host not in self._parsed:
            self._parsed[host] = json.loads(self._value[host][0] if self._value is not None else column[k].as_py())
        return self._parsed[host]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _statistics(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(broadcast)
        total: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            extra = batch.column(3) if batch.num_columns > 3 else None
            for k, (host, items) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                found = list(slots(held.wrapper(host, extra, k), json.loads(items.as_py())))
                seen: set[str] = set()
                # the whole page counts as slot ''
                for slot, text in [*found, ("", json.dumps(found))] if found else ():
                    h, first = _hash(text), slot not in seen
                    seen.add(slot)
                    have = total.get((host, slot))
                    if have is None:
                        total[host, slot] = [h, h, 1, len(text)]
                    else:
                        have[0], have[1], have[2], have[3] = min(have[0], h), max(have[1], h), have[2] + first, have[3] + len(text)
        if total:
            keys, values = zip(*total.items(), strict=True)
            host, slot = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(slot), *(pa.array(c, pa.int64()) for c in zip(*values, strict=True))], names=["host", "slot", "low", "high", "n", "chars"])

    return run


def main_container(fields: list[tuple[str, int]], share: float = SHARE) -> str:
    """The innermost element that holds a share of the characters of (slot, characters)."""
    at = ""
    body = [(s, n) for s, n in fields if ":head" not in s]
    total = sum(n for _, n in body)
    while True:
        below: dict[str, int] = {}
        for s, n in body:
            if s.startswith(at + "/"):
                step = s[len(at) + 1 :].split("/")[0]
                if not step.endswith(":" + TEXT):
                    below[f"{at}/{step}"] = below.get(f"{at}/{step}", 0) + n
        best = max(sorted(below), key=lambda p: below[p], default=None)
        if best is None or below[best] < share * total:
            return at
        at = best


def main_text(found: list[tuple[str, str]], at: str, share: float = SHARE) -> str:
    """The main text of a page with these fields on a host with this container."""
    body = [(s, t) for s, t in found if ":head" not in s]
    inside = [t for s, t in body if s.startswith(at + "/")]
    if sum(map(len, inside)) < share * sum(len(t) for _, t in body):
        inside = [t for _, t in body]
    return "\n".join(inside)


def _extract(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(broadcast)
        main: dict[str, tuple[frozenset, str]] = {}
        for batch in batches:
            texts, fields = [], []
            extra = batch.column(3) if batch.num_columns > 3 else None
            for k, (host, items) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if host not in main:
                    stats = held._value[host][1] if extra is None else [(x["slot"], x["chars"]) for x in batch.column(4)[k].as_py() or ()]
                    main[host] = frozenset(s for s, _ in stats), main_container(stats)
                slots_, at = main[host]
                found = [(s, t) for s, t in slots(held.wrapper(host, extra, k), json.loads(items.as_py())) if s in slots_]
                fields.append([{"slot": s, "text": t} for s, t in found])
                texts.append(main_text(found, at))
            kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(fields, kind)], names=["page_id", "host", "text", "fields"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, text, fields) of every page; fields are (slot, text) outside the template, in page order."""
    sc = pages.sparkSession.sparkContext
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    folded = materialize(rows.mapInArrow(_folded, FOLDED), "html-folded")
    found = materialize(wrappers(folded), "html-wrappers")
    items = folded.select("page_id", "host", "items")
    schema = "page_id long, host string, text string, fields array<struct<slot: string, text: string>>"
    small = (found.agg(F.coalesce(F.sum(F.length("stream") + F.length("host")), F.lit(0))).first()[0]) <= BROADCAST_CHARS
    if small:
        by_host = {r["host"]: r["stream"] for r in found.toLocalIterator()}
        counted = items.mapInArrow(_statistics(sc.broadcast({h: (s,) for h, s in by_host.items()})), _STATS)
    else:
        joined = items.join(found.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")
        counted = joined.select("page_id", "host", "items", "stream").mapInArrow(_statistics(None), _STATS)
    stats = materialize(counted.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("chars").alias("chars")), "html-slots")
    # one page alone, or with copies of itself, can't show what is template; copies have the same slots, so n needn't leave them out
    whole = stats.where("slot = ''").select(F.col("host").alias("site"), (F.col("low") < F.col("high")).alias("differ"), F.col("n").alias("pages"))
    slot_stats = stats.where("slot <> ''").join(whole, F.col("host") == F.col("site"))
    fields = materialize(slot_stats.where("NOT (differ AND low = high AND n = pages)").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "chars"))).alias("stats")), "html-fields")
    # slots are paths of the wrapper, so their size isn't bounded by its own
    if small and fields.agg(F.coalesce(F.sum(F.expr("aggregate(stats, 0L, (a, x) -> a + length(x.slot))")), F.lit(0))).first()[0] <= BROADCAST_CHARS:
        own = {r["host"]: [(x["slot"], x["chars"]) for x in r["stats"]] for r in fields.toLocalIterator()}
        return items.mapInArrow(_extract(sc.broadcast({h: (s, own.get(h, [])) for h, s in by_host.items()})), schema)
    joined = items.join(found.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left").join(fields.withColumnRenamed("host", "at"), F.col("of") == F.col("at"), "left")
    return joined.select("page_id", "host", "items", "stream", "stats").mapInArrow(_extract(None), schema)


_STATS = "host string, slot string, low long, high long, n long, chars long"


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
