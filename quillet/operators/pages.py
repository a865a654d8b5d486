"""Page selections: a value class, and column expressions that resolve and filter."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = ("all", "none", "odd", "even", "current", "first", "last", "list", "range")


def parse_range(spec: str) -> list[tuple[int, int]]:
    """(first, last) of each part of a list such as '1-4, 7'; an error for pages below 1, other signs and reversed ranges."""
    out = []
    for token in spec.split(","):
        token = token.strip()
        if not token:
            continue
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", token)
        if not m:
            raise ValueError(f"not a page range: {token!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if a < 1 or b < a:
            raise ValueError(f"not a page range: {token!r}")
        out.append((a, b))
    return out


@dataclass(frozen=True)
class PageSelection:
    kind: str
    n: int = 0
    pages: tuple[int, ...] = ()
    spec: str = ""

    def __post_init__(self):
        if self.kind not in _KINDS:
            raise ValueError(f"no selection {self.kind!r}")
        if self.kind in ("current", "first", "last") and self.n < 1:
            raise ValueError("a page count or number is at least 1")
        if self.kind == "range":
            parse_range(self.spec)

    all = classmethod(lambda cls: cls("all"))
    none = classmethod(lambda cls: cls("none"))
    odd = classmethod(lambda cls: cls("odd"))
    even = classmethod(lambda cls: cls("even"))
    current = classmethod(lambda cls, page: cls("current", page))
    first = classmethod(lambda cls, n: cls("first", n))
    last = classmethod(lambda cls, n: cls("last", n))
    explicit = classmethod(lambda cls, *pages: cls("list", pages=tuple(pages)))
    range = classmethod(lambda cls, spec: cls("range", spec=spec))

    def holds(self, page: str | Column, count: str | Column) -> Column:
        """Whether a page (from 1) of a document with so many pages is selected."""
        p = F.col(page) if isinstance(page, str) else page
        n = F.col(count) if isinstance(count, str) else count
        inside = p.between(1, n)
        if self.kind == "range":
            parts = [p.between(a, b) for a, b in parse_range(self.spec)]
            chosen = F.lit(False)
            for x in parts:
                chosen = chosen | x
        else:
            chosen = {
                "all": lambda: F.lit(True),
                "none": lambda: F.lit(False),
                "odd": lambda: F.pmod(p, F.lit(2)) == 1,
                "even": lambda: F.pmod(p, F.lit(2)) == 0,
                "current": lambda: p == self.n,
                "first": lambda: p <= self.n,
                "last": lambda: p > n - self.n,
                "list": lambda: p.isin(*self.pages) if self.pages else F.lit(False),
            }[self.kind]()
        return inside & chosen

    def resolve(self, count: str | Column) -> Column:
        """The selected pages of a document, rising and distinct."""
        n = F.col(count) if isinstance(count, str) else count
        every = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda p: self.holds(p, n))

    def __str__(self) -> str:
        if self.kind in ("current", "first", "last"):
            return f"{self.kind}:{self.n}"
        if self.kind == "range":
            return f"range:{self.spec}"
        if self.kind == "list":
            return "list:" + ",".join(map(str, self.pages))
        return self.kind

    @classmethod
    def parse(cls, text: str) -> PageSelection:
        """The selection of its canonical text."""
        kind, _, rest = text.partition(":")
        if kind in ("current", "first", "last"):
            return cls(kind, int(rest))
        if kind == "range":
            return cls.range(rest)
        if kind == "list":
            return cls.explicit(*(int(x) for x in rest.split(",") if x))
        return cls(kind)


def pages_of_spec(spec: str | Column, count: str | Column) -> Column:
    """The pages of a range text in a column: rising, distinct, up to count; an error for a text that isn't one."""
    s = F.col(spec) if isinstance(spec, str) else spec
    n = F.col(count) if isinstance(count, str) else count
    tokens = F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != "")
    good = F.forall(tokens, lambda t: t.rlike(r"^\d+(\s*-\s*\d+)?$"))
    a = lambda t: F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")
    b = lambda t: F.regexp_extract(t, r"(\d+)$", 1).try_cast("int")
    sound = good & F.forall(tokens, lambda t: F.coalesce((a(t) >= 1) & (b(t) >= a(t)), F.lit(False)))
    inside = F.filter(tokens, lambda t: a(t) <= n)
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(inside, lambda t: F.sequence(a(t), F.least(b(t), n.cast("int")))))))
    return F.when(s.isNull(), F.lit(None).cast("array<int>")).when(sound, pages).otherwise(F.raise_error(F.concat(F.lit("not a page range: "), s)).cast("array<int>"))
