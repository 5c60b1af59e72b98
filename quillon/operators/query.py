"""The search language: text to terms.

Terms are separated by white space and all must hold; ``!`` negates one. ``field:value`` terms
are name, regex, ext, size, dm, dc, type, hidden, system, readonly, reparse, parent, path, skip.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from quillon.functions.globs import has_wildcards
from quillon.functions.paths import FLAGS, SEPARATORS

DAY = 86_400
MAX_LONG = (1 << 63) - 1
UNITS = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "b": 1}
TYPES = {"file": False, "f": False, "dir": True, "d": True, "folder": True}
TRUE, FALSE = {"1", "true", "yes"}, {"0", "false", "no"}


class QueryError(ValueError):
    """The query text has no meaning."""


@dataclass(frozen=True)
class Term:
    """kind: name, suffix, name_glob, path, path_glob, ext, size, mtime, ctime, type, flag, prefix, skip or regex."""

    kind: str
    value: object


@dataclass
class Query:
    raw: str
    include: list[Term] = field(default_factory=list)
    exclude: list[Term] = field(default_factory=list)


@dataclass(frozen=True)
class Clock:
    """Now, and where days begin."""

    now: int
    zone: str = "UTC"

    def midnight(self, d: date) -> int:
        """Epoch of the local midnight; 0 where the day has none or two."""
        zone = ZoneInfo(self.zone)
        first, second = (datetime(d.year, d.month, d.day, tzinfo=zone, fold=f) for f in (0, 1))
        at = int(first.timestamp())
        real = datetime.fromtimestamp(at, zone).replace(tzinfo=None) == datetime(d.year, d.month, d.day)
        return at if real and first.utcoffset() == second.utcoffset() else 0

    def today(self) -> date:
        return datetime.fromtimestamp(self.now, ZoneInfo(self.zone)).date()


def parse(text: str, clock: Clock | None = None) -> Query:
    clock = clock or Clock(int(datetime.now().timestamp()))
    out = Query(text)
    for token in text.split():
        negated = token.startswith("!")
        token = token[negated:]
        if not token:
            continue
        term = parse_term(token, clock)
        (out.exclude if negated or term.kind == "skip" else out.include).append(term)
    return out


def parse_term(token: str, clock: Clock) -> Term:
    name, colon, value = token.partition(":")
    name = name.lower()
    if not colon:
        return bare(token)
    if name not in _FIELDS:
        if any(c in token for c in SEPARATORS):
            return bare(token)  # a drive letter
        raise QueryError(f"unknown field {name!r}")
    if not value:
        raise QueryError(f"{name}: needs a value")
    return _FIELDS[name](name, value, clock)


def bare(pattern: str) -> Term:
    low, wild = pattern.lower(), has_wildcards(pattern)
    if any(c in pattern for c in SEPARATORS):
        return Term("path_glob" if wild else "path", low)
    if low.startswith("*") and len(low) > 1 and not has_wildcards(low[1:]):
        return Term("suffix", low[1:])
    return Term("name_glob" if wild else "name", low)


def parse_bytes(text: str) -> int:
    m = re.fullmatch(r"([0-9]+)(kb|mb|gb|b)?", text.strip().lower())
    if not m:
        raise QueryError(f"not a size: {text!r}")
    return min(int(m[1]) * UNITS[m[2] or "b"], MAX_LONG)


def parse_size(text: str) -> tuple[int | None, int | None]:
    """(least, below)."""
    if "-" in text:
        a, b = text.split("-", 1)
        return parse_bytes(a), parse_bytes(b)
    if text[0] == ">":
        return parse_bytes(text[1:]), None
    if text[0] == "<":
        return None, parse_bytes(text[1:])
    n = parse_bytes(text)
    return n, min(n + 1, MAX_LONG)


def _day(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", text):
        raise QueryError(f"not a date: {text!r}")
    try:
        return date(*map(int, text.split("-")))
    except ValueError as e:
        raise QueryError(str(e)) from None


def parse_date(text: str, clock: Clock) -> tuple[int | None, int | None]:
    """(least, below) in epoch seconds."""
    def days(a: date, b: date) -> tuple[int, int]:
        return clock.midnight(a), clock.midnight(b + timedelta(days=1))

    word = text.lower()
    if word == "today":
        return days(clock.today(), clock.today())
    if word == "yesterday":
        d = clock.today() - timedelta(days=1)
        return days(d, d)
    if word in ("thisweek", "thismonth"):
        return clock.now - (7 if word == "thisweek" else 30) * DAY, None
    if word[0] == ">":
        return clock.midnight(_day(word[1:])), None
    if word[0] == "<":
        return None, clock.midnight(_day(word[1:]))
    if ".." in word:
        a, b = word.split("..", 1)
        return days(_day(a), _day(b))
    return days(_day(word), _day(word))


def _list(value: str, strip: str) -> tuple[str, ...]:
    parts = tuple(p for p in (x.strip().strip(strip) for x in value.lower().split(",")) if p)
    if not parts:
        raise QueryError("an empty list")
    return parts


def _extensions(name: str, value: str, clock: Clock) -> Term:
    parts = tuple(p for p in (x.strip().lstrip(".") for x in value.lower().split(",")) if p)
    if not parts:
        raise QueryError("an empty list")
    return Term("ext", parts)


def _type(name: str, value: str, clock: Clock) -> Term:
    if value.lower() not in TYPES:
        raise QueryError(f"unknown type {value!r}")
    return Term("type", TYPES[value.lower()])


def _flag(name: str, value: str, clock: Clock) -> Term:
    if value.lower() not in TRUE | FALSE:
        raise QueryError(f"{name}: true or false, not {value!r}")
    return Term("flag", (name, value.lower() in TRUE))


def _regex(name: str, value: str, clock: Clock) -> Term:
    """Lower-cased whole, escapes too; names are in lower case."""
    try:
        re.compile(value.lower())
    except re.error as e:
        raise QueryError(f"regex: {e}") from None
    if re.search(r"\(\?p<|\\p\{han\}", value.lower()):
        raise QueryError("regex: named groups and script classes are not supported")
    return Term("regex", value.lower())


_FIELDS = {
    "name": lambda n, v, c: bare(v),
    "regex": _regex,
    "ext": _extensions,
    "size": lambda n, v, c: Term("size", parse_size(v)),
    "dm": lambda n, v, c: Term("mtime", parse_date(v, c)),
    "dc": lambda n, v, c: Term("ctime", parse_date(v, c)),
    "type": _type,
    "parent": lambda n, v, c: Term("prefix", v.lower()),
    "path": lambda n, v, c: Term("prefix", v.lower()),
    "skip": lambda n, v, c: Term("skip", _list(v, SEPARATORS)),
} | dict.fromkeys(FLAGS, _flag)
