"""Search conditions: typed, or read from ``field:value|value + field:value`` text."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktrail.functions.keys import salt_of
from clicktrail.functions.text import CONTROL_AND_BLANK
from clicktrail.functions.times import normalize_time

Mode = Literal["substring", "like"]

_INTEGER = re.compile(r"[+-]?\d+")


@dataclass(frozen=True)
class SearchCondition:
    """Criteria that all must hold; within a list any value may. None means no criterion.

    ``time`` takes two ``HH:mm:ss`` bounds, both inclusive, brought into one day and compared as text with
    the stored time. ``users`` match whole; ``query``, ``domain`` and ``url`` are keywords; ``rank`` and
    ``click`` are inclusive integer bounds.
    """

    time: tuple[str, str] | None = None
    users: Sequence[str] | None = None
    query: Sequence[str] | None = None
    domain: Sequence[str] | None = None
    url: Sequence[str] | None = None
    rank: tuple[int, int] | None = None
    click: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        for name in ("users", "query", "domain", "url"):
            values = getattr(self, name)
            if isinstance(values, str):
                raise TypeError(f"{name} takes a list of texts")
            object.__setattr__(self, name, tuple(values) if values else None)
        if self.time is not None:
            start, end = self.time
            object.__setattr__(self, "time", (normalize_time(start), normalize_time(end)))

    def to_column(self, mode: Mode = "substring", salted: bool = False) -> Column:
        """One predicate over the stored columns.

        ``substring`` keywords ignore case. ``like`` keywords are LIKE patterns between ``%`` signs, with
        case. With ``salted`` the users also name their partitions, so the scan skips the others.
        """
        tests: list[Column] = []
        if self.time:
            tests.append(F.col("access_time").between(*self.time))
        if self.users:
            tests.append(F.col("user_id").isin(*self.users))
            if salted:
                tests.append(F.col("salt").isin(*sorted({salt_of(u) for u in self.users})))
        for name in ("query", "domain", "url"):
            keywords = getattr(self, name)
            if keywords:
                tests.append(reduce(or_, (_keyword(F.col(name), k, mode) for k in keywords)))
        for name, bounds in (("rank", self.rank), ("click_order", self.click)):
            if bounds:
                tests.append(F.col(name).between(*bounds))
        return reduce(and_, tests) if tests else F.lit(True)

    def identity(self) -> str:
        """An unambiguous text of all criteria: two conditions share it only if they are equal."""
        return json.dumps({name: getattr(self, name) for name in self.__dataclass_fields__}, ensure_ascii=False)

    def key(self) -> str:
        """The condition as typed text, for display.

        Values may hold the separators ``|`` and ``+``, so it need not parse back; ``identity`` tells
        conditions apart.
        """
        lists = (("user", self.users), ("query", self.query), ("domain", self.domain), ("url", self.url))
        ranges = (("rank", self.rank), ("click", self.click))
        parts = [f"time:{self.time[0]}|{self.time[1]}"] if self.time else []
        parts += [f"{name}:{'|'.join(values)}" for name, values in lists if values]
        parts += [f"{name}:{bounds[0]}-{bounds[1]}" for name, bounds in ranges if bounds]
        return "+".join(parts)

    @classmethod
    def parse(cls, text: str | None) -> SearchCondition:
        """Read a typed condition.

        Fields are separated by ``+``; unknown names are ignored and the last of equal names wins. Items of
        a list are taken as they stand, times and numbers are trimmed. A time needs two items, and wrong
        numbers in it raise ValueError; a range that does not read as numbers is ignored.
        """
        given: dict[str, list[str]] = {}
        time = None
        bounds: dict[str, int] = {}
        for part in _pieces(text or "", "+"):
            name, colon, value = part.strip(CONTROL_AND_BLANK).partition(":")
            if not colon:
                continue
            if name == "time":
                items = _pieces(value, "|")
                if len(items) == 2:
                    time = (normalize_time(items[0]), normalize_time(items[1]))
            elif name in ("user", "query", "domain", "url"):
                given[name] = _pieces(value, "|")
            elif name in ("rank", "click"):
                bounds.update(_range(name, value))
        return cls(
            time=time,
            users=given.get("user"),
            query=given.get("query"),
            domain=given.get("domain"),
            url=given.get("url"),
            rank=_both(bounds, "rank"),
            click=_both(bounds, "click"),
        )


def as_condition(condition: SearchCondition | str | None) -> SearchCondition:
    if isinstance(condition, SearchCondition):
        return condition
    return SearchCondition.parse(condition)


def _keyword(column: Column, keyword: str, mode: Mode) -> Column:
    if mode == "like":
        # A backslash is a letter of its own, as nothing escapes in a keyword.
        escaped = keyword.replace("\\", "\\\\")
        return column.like(f"%{escaped}%")
    return F.contains(F.lower(column), F.lower(F.lit(keyword)))


def _pieces(text: str, separator: str) -> list[str]:
    """Split, without the empty pieces at the end; a text that has no separator stays one piece."""
    if separator not in text:
        return [text]
    pieces = text.split(separator)
    while pieces and pieces[-1] == "":
        pieces.pop()
    return pieces


def _range(name: str, text: str) -> dict[str, int]:
    """Bounds that a range text sets. ``5`` sets both, ``5-x`` only the lower, ``5-`` none."""
    ends = _pieces(text, "-") if "-" in text else [text, text]
    found: dict[str, int] = {}
    if len(ends) == 2:
        for end, item in zip(("low", "high"), ends):
            item = item.strip(CONTROL_AND_BLANK)
            if not _INTEGER.fullmatch(item) or not -(2**31) <= int(item) < 2**31:
                break
            found[f"{name}.{end}"] = int(item)
    return found


def _both(bounds: dict[str, int], name: str) -> tuple[int, int] | None:
    low, high = bounds.get(f"{name}.low"), bounds.get(f"{name}.high")
    return None if low is None or high is None else (low, high)
