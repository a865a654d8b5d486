"""HTML extraction by inferring union-free regular expressions.

Each page becomes a nested stream of tags and text.  Repeats within a page fold into repeated
groups first: neighbouring blocks with the same tags become one block under a plus.  The
pages of a host are then aligned one after another: what matches is kept, a text against another is a
slot, what only one side has becomes optional, a block against several of its kind repeated.  The
result, the host's wrapper, is a regular expression without unions, made of tags, text slots,
optional and repeated groups.  Every page is then read by its host's wrapper; slots whose text is
the same on all of a host's pages are template, the others are the page's fields.

Scale: tokenising and folding are a map; only distinct folded shapes go on to alignment, some
`FAN_IN` at a time, round after round until each host has one wrapper: a tree whose width follows the number of shapes, so that a host
with most of the pages is many tasks.  Wrappers and constant slots are memory-mapped digest arrays; the HTML
is never shuffled, and nothing is broadcast.

Defined results: null HTML, or HTML without text, has no fields (an empty list), also for an unknown
host; pages without a host share the wrapper of host ''; a repeated page is extracted in each row, but is one page
of those that tell what is template; on a host's only page all slots are fields.  As in browsers, elements nested deeper than
`MAX_DEPTH` are taken as one after another in the last one, so none of their text is lost.  Comments, scripts and styles aren't text.  Other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import json
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DigestArray, need, written

#: Shapes that are aligned by one task, on average.
FAN_IN = 32
#: Levels of elements in elements.
MAX_DEPTH = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:\-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends, if that is open in the same block.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in "div ul ol dl table section article aside nav header footer form pre blockquote h1 h2 h3 h4 h5 h6 figure main address hr fieldset".split()}
_BLOCK = frozenset("div ul ol dl table section article aside nav header footer form body html td th main figure blockquote".split())
TEXT = "#"

# An expression is a list: ["#"] a text slot, ["t", name, children] a tag, ["+", children] a repeated and ["?", children] an optional group.


def parse(text: str) -> list:
    """The nested stream of a page: tags ["t", name, children] and texts ["#", text]."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    deeper: list[str] = []  # open elements beyond the last level
    open_: Counter = Counter()
    written_: list[list] = []
    for m in _TOKEN.finditer(text):
        end, name, attributes, words = m.group(2), m.group(3), m.group(4), m.group(5)
        if words is not None:
            words = " ".join(_html.unescape(words).split())
            if words:
                here = stack[-1][1]
                if here and here[-1][0] == TEXT:
                    here[-1][1].append(words)
                else:
                    here.append([TEXT, [words]])
                    written_.append(here[-1])
        elif name is not None:
            name = name.lower()
            if end:
                if open_[name]:
                    while (x := deeper.pop()) != name:
                        open_[x] -= 1
                    open_[name] -= 1
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        deeper.clear()
                        open_.clear()
                        break
                    if stack[i][0] in _BLOCK and name not in _BLOCK:
                        break
            else:
                closes = _ENDS.get(name)
                if closes and not deeper:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in closes:
                            del stack[i:]
                            break
                        if stack[i][0] in _BLOCK:
                            break
                children: list = []
                stack[-1][1].append(["t", name, children])
                if name not in _VOID and not attributes.endswith("/"):
                    if len(stack) <= MAX_DEPTH:
                        stack.append((name, children))
                    else:
                        deeper.append(name)
                        open_[name] += 1
    for node in written_:
        node[1] = " ".join(node[1])
    return root


def label(e: list) -> str:
    """What an element is aligned by: its first tag or text."""
    return TEXT if e[0] == TEXT else e[1] if e[0] == "t" else "(" + " ".join(label(x) for x in e[1]) + ")" if len(e[1]) != 1 else label(e[1][0])


def shape(nodes: list) -> list:
    """The page's stream with slots for texts and repeats folded."""
    return fold([[TEXT] if e[0] == TEXT else ["t", e[1], shape(e[2])] for e in nodes])


def fold(seq: list) -> list:
    """Neighbouring blocks with the same labels become one repeated group; the shortest period first."""
    for period in (1, 2, 3, 4):
        out: list = []
        labels = [label(e) for e in seq]
        i = 0
        while i < len(seq):
            n = 1
            if labels[i] != TEXT or period > 1:
                while labels[i + n * period : i + (n + 1) * period] == labels[i : i + period] and i + (n + 1) * period <= len(seq):
                    n += 1
            if n > 1:
                if period == 1:
                    e = _plain(seq[i])
                    for y in seq[i + 1 : i + n]:
                        e = _unite(e, _plain(y))
                    group = ["+", e[1] if e[0] == "g" else [e]]
                    out.append(group if any(x[0] != "?" for x in seq[i : i + n]) else ["?", [group]])
                else:
                    block = seq[i : i + period]
                    for k in range(1, n):
                        block = [_unite(x, y) for x, y in zip(block, seq[i + k * period : i + (k + 1) * period])]
                    out.append(["+", [x for e in block for x in (e[1] if e[0] == "g" else [e])]])
                i += n * period
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def _plain(e: list) -> list:
    """The inside of a group of one."""
    while e[0] in "+?" and len(e[1]) == 1:
        e = e[1][0]
    return e


def _unite(x: list, y: list) -> list:
    """The expression of two elements with one label."""
    optional = x[0] == "?" or y[0] == "?"
    if x[0] == "?":
        x = x[1][0] if len(x[1]) == 1 else ["g", x[1]]
    if y[0] == "?":
        y = y[1][0] if len(y[1]) == 1 else ["g", y[1]]
    repeated = x[0] == "+" or y[0] == "+"
    a = x[1] if x[0] in "+g" else [x]
    b = y[1] if y[0] in "+g" else [y]
    if len(a) == 1 and len(b) == 1 and a[0][0] == b[0][0]:
        e = a[0]
        inner = [e if e[0] == TEXT else ["t", e[1], align(e[2], b[0][2])]] if e[0] in (TEXT, "t") else [_unite(e, b[0])]
    else:
        inner = align(a, b)
    out = ["+", inner] if repeated else inner[0] if len(inner) == 1 else ["g", inner]
    return ["?", [out] if out[0] != "g" else out[1]] if optional else out


def _common_lengths(a: list[str], b: list[str]):
    """best(i, j): the length of the longest common subsequence of a[i:] and b[j:].

    Rows of the table are kept as bits: a zero at k of a row tells that the value grows from k to k + 1 places of b's end.
    """
    n, m = len(a), len(b)
    where: dict[str, int] = {}
    for k, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << m) - 1
    rows = [full]
    for x in reversed(a):
        u = rows[-1] & where.get(x, 0)
        rows.append(((rows[-1] + u) | (rows[-1] - u)) & full)
    return lambda i, j: m - j - (rows[n - i] & ((1 << (m - j)) - 1)).bit_count()


def align(a: list, b: list) -> list:
    """The expression of two sequences: the longest common one by labels, the rest optional."""
    la, lb = [label(e) for e in a], [label(e) for e in b]
    n, m = len(a), len(b)
    best = _common_lengths(la, lb)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and la[i] == lb[j]:
            e = _unite(a[i], b[j])
            out += e[1] if e[0] == "g" else [e]
            i, j = i + 1, j + 1
        else:
            if j == m or i < n and best(i + 1, j) >= best(i, j + 1):
                e, i = a[i], i + 1
            else:
                e, j = b[j], j + 1
            out.append(e if e[0] == "?" else ["?", [e]])
    # an optional block beside another of its kind is a repeat
    tidy: list = []
    for e in out:
        if tidy and label(e) == label(tidy[-1]) and label(e) != TEXT and (e[0] in "+?" or tidy[-1][0] in "+?"):
            needed = e[0] != "?" or tidy[-1][0] != "?"
            x = _unite(tidy.pop(), e)
            x = x[1][0] if x[0] == "?" and len(x[1]) == 1 else x
            x = x if x[0] == "+" else ["+", [x]]
            tidy.append(x if needed else ["?", [x]])
        else:
            tidy.append(e)
    return tidy


def expression(seq: list) -> str:
    """The wrapper as text: <p>#</p>, (...)+ and (...)?."""
    return "".join(TEXT if e[0] == TEXT else f"<{e[1]}>{expression(e[2])}</{e[1]}>" if e[0] == "t" else f"({expression(e[1])}){e[0]}" for e in seq)


def read(seq: list, nodes: list, at: str = "") -> tuple[list[tuple[str, str]], bool]:
    """The (slot, text) pairs of a page read by a wrapper, in order, and whether it accepts the page."""
    flat_: list[tuple[list, bool]] = []

    def spread(es: list, many: bool) -> None:
        for e in es:
            if e[0] in "+?":
                spread(e[1], many or e[0] == "+")
            else:
                flat_.append((e, many))

    spread(seq, False)
    names: dict[str, int] = {}
    slots = []
    for e, many in flat_:
        name = TEXT if e[0] == TEXT else e[1]
        names[name] = names.get(name, 0) + 1
        slots.append((name, f"{at}/{name}" + (f"[{names[name]}]" if names[name] > 1 else ""), e, many))
    places, ok = _match(seq, nodes)
    index = {id(e): k for k, (e, _) in enumerate(flat_)}
    out: list[tuple[str, str]] = []
    for node, e in zip(nodes, places):
        if e is None:
            ok = False
            out += [(f"{at}/?", t) for t in texts(node)]
        elif node[0] == TEXT:
            out.append((slots[index[id(e)]][1], node[1]))
        else:
            inner, fine = read(e[2], node[2], slots[index[id(e)]][1])
            out += inner
            ok &= fine
    return out, ok


def texts(node: list) -> list[str]:
    return [node[1]] if node[0] == TEXT else [t for x in node[2] for t in texts(x)]


def _match(seq: list, nodes: list) -> tuple[list, bool]:
    """The wrapper's element for each node (None: none fits), by running the expression as an automaton."""
    atoms: list = []
    follow: list[set[int]] = []

    def build(es: list) -> tuple[set[int], set[int], bool]:
        """(first atoms, last atoms, can be empty) of a sequence"""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for e in es:
            if e[0] in "+?":
                f, z, n = build(e[1])
                if e[0] == "+":
                    for k in z:
                        follow[k] |= f
                n = n or e[0] == "?"
            else:
                atoms.append(e)
                follow.append(set())
                f = z = {len(atoms) - 1}
                n = False
            for k in last:
                follow[k] |= f
            if empty:
                first |= f
            last = last | z if n else set(z)
            empty &= n
        return first, last, empty

    first, last, empty = build(seq)
    names = [TEXT if e[0] == TEXT else e[1] for e in atoms]
    # for each node the states it can reach, with the one before
    steps: list[dict[int, int]] = []
    now, skipped = first, []
    for node in nodes:
        name = TEXT if node[0] == TEXT else node[1]
        here = {}
        if steps:
            for p in sorted(steps[-1]):
                for k in follow[p]:
                    if names[k] == name:
                        here.setdefault(k, p)
        else:
            here = {k: -1 for k in sorted(now) if names[k] == name}
        if not here:
            skipped.append(True)
            continue
        skipped.append(False)
        steps.append(here)
    places: list = []
    if steps:
        good = sorted(k for k in steps[-1] if k in last)
        k = good[0] if good else min(steps[-1])
        ok = bool(good) and not any(skipped)
        for here in reversed(steps):
            places.append(atoms[k])
            k = here[k]
        places.reverse()
    else:
        ok = empty and not nodes
    it = iter(places)
    return [None if s else next(it) for s in skipped], ok


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def _deep() -> None:
    """Each level of elements takes a few frames: align, _unite, groups."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50 * MAX_DEPTH))


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = need(pages, id_col, url_col, html_col).toDF("id", "url", "html")
    return rows.select("id", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"), "html")


def _align_all(shapes: list[str]) -> str:
    """One expression for all, aligned in order of length."""
    _deep()
    out = None
    for s in sorted(set(shapes), key=lambda x: (len(x), x)):
        out = json.loads(s) if out is None else fold(align(out, json.loads(s)))
    return json.dumps(out, separators=(",", ":"))


def wrappers(pages: DataFrame, *, fan_in: int = FAN_IN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, shapes): each host's wrapper as JSON and the number of distinct shapes aligned into it."""

    def shapes(batches):
        _deep()
        for batch in batches:
            seen: dict[tuple[str, str], None] = {}
            for host, text in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                seen[host, json.dumps(shape(parse(text)), separators=(",", ":"))] = None
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string())], ["host", "shape"])

    def part(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"host": [keys[0].as_py()], "shape": [_align_all(table["shape"].to_pylist())], "n": [sum(table["n"].to_pylist())]})

    rows = _pages(pages, id_col, url_col, html_col).where("html is not null").select("host", "html").mapInArrow(shapes, "host string, shape string").distinct()
    rows = written(rows.withColumn("n", F.lit(1).cast("long")), "shapes")
    done = None
    while True:
        counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("left"))
        rows = rows.join(counts.hint("merge"), "host")
        one = rows.where("left = 1").select("host", F.col("shape").alias("wrapper"), F.col("n").alias("shapes"))
        done = one if done is None else done.unionByName(one)
        rows = rows.where("left > 1").groupBy("host", F.pmod(F.xxhash64("shape"), F.ceil(F.col("left") / fan_in)).alias("k"))
        rows = written(rows.applyInArrow(part, "host string, shape string, n long"), "shapes")
        if rows.isEmpty():
            return done


def extract(pages: DataFrame, *, fan_in: int = FAN_IN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, accepted, fields, text) of every page.

    fields: slot and text of each slot that isn't template, in the page's order; text: their texts, one a line;
    accepted: whether the host's wrapper accepts the page as a whole.
    """
    inferred = written(wrappers(pages, fan_in=fan_in, id_col=id_col, url_col=url_col, html_col=html_col), "wrappers")
    known = DigestArray.store(inferred.select(F.xxhash64("host").alias("key"), F.to_json(F.struct("host", "wrapper")).alias("w")), "key", "w", "wrappers", per_file=1 << 12)
    rows = _pages(pages, id_col, url_col, html_col).withColumn("key", F.xxhash64("host")).withColumn("page", F.xxhash64("host", "html"))
    kind = rows.schema["id"].dataType.simpleString()
    pair = pa.struct([("slot", pa.string()), ("text", pa.string())])

    def read_pages(batches):
        _deep()
        cache: dict[str, list] = {}
        for batch in batches:
            if len(cache) > 1000:
                cache.clear()
            keys = batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            hosts = batch["host"].to_pylist()
            new = [i for i, h in enumerate(hosts) if h not in cache]
            if new:
                _, where = known.find(np.unique(keys[new]))
                for w in known.values(where).to_pylist():
                    w = json.loads(w)
                    cache[w["host"]] = json.loads(w["wrapper"])
            fields, fine = [], []
            for host, text in zip(hosts, batch["html"].to_pylist()):
                got, ok = read(cache.get(host, []), parse(text)) if text is not None else ([], True)
                fields.append([{"slot": s, "text": t} for s, t in got])
                fine.append(ok)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["page"], pa.array(fine), pa.array(fields, pa.list_(pair))], ["id", "host", "page", "accepted", "fields"])

    found = rows.mapInArrow(read_pages, f"id {kind}, host string, page long, accepted boolean, fields array<struct<slot:string,text:string>>")
    found = written(found.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "fields")
    # one row of each page, and one of equal texts of a slot in it
    first = DigestArray.store(found.where(F.size("fields") > 0).groupBy("page").agg(F.min("row").alias("row")), "row", None, "pages")

    def is_first(row: pa.Array) -> pa.Array:
        return pa.array(first.has(row.to_numpy(zero_copy_only=False).view(np.uint64)))

    once = found.where(F.arrow_udf(is_first, "boolean")("row"))
    each = once.select("host", F.explode(F.array_distinct(F.transform("fields", lambda f: F.struct(f["slot"].alias("slot"), F.xxhash64(f["text"]).alias("t"))))).alias("f")).select("host", "f.slot", "f.t")
    pages_of = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    same = each.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo = hi")
    constant = same.join(pages_of.hint("merge"), "host").where("pages > 1 and n >= pages")
    template = DigestArray.store(constant.select(F.xxhash64("host", "slot").alias("key")), "key", None, "template")
    found = found.withColumn("keys", F.transform("fields", lambda f: F.xxhash64("host", f["slot"])))

    def mark(keys: pa.Array) -> pa.Array:
        inner = keys.flatten()
        keep = ~template.has(inner.to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))), pa.int32()), pa.array(keep))

    kept = F.transform(F.filter(F.arrays_zip("fields", F.arrow_udf(mark, "array<boolean>")("keys").alias("keep")), lambda z: z["keep"]), lambda z: z["fields"])
    return found.withColumn("kept", kept).select(F.col("id").alias(id_col), "host", "accepted", F.col("kept").alias("fields"), F.array_join(F.transform("kept", lambda f: f["text"]), "\n").alias("text"))


__all__ = ["align", "expression", "extract", "fold", "parse", "read", "shape", "wrappers"]
