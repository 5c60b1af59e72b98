"""Wildcards as columns: * any run, ? one UTF-8 byte.

A pattern may begin anywhere (an implicit leading *) and must end at the end unless it ends in *.
On names, a literal beginning of two bytes or more must also begin the name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.paths import bytes_text


def has_wildcards(s: str) -> bool:
    return "*" in s or "?" in s


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in s)


def regex(pattern: str) -> str:
    """Java regular expression to search with."""
    body = "".join(".*" if p == "*" else "." if p == "?" else _quoted(p) for p in re.split(r"(\*|\?)", pattern) if p)
    return "(?s)" + body + ("" if pattern.endswith("*") else r"\z")


def matches(folded: Column, pattern: str, names: bool) -> Column:
    """``folded``: the lower-case name or path; ``pattern``: lower case too."""
    pattern = re.sub(r"\*+", "*", pattern)
    if pattern == "*":
        return F.lit(True)
    literals = [p for p in pattern.split("*") if p]
    if "?" in pattern:
        raw = pattern.encode("utf-8").decode("latin-1")
        found = bytes_text(folded).rlike(regex(raw))
    elif len(literals) == 1:
        # no leading * needed: a match may begin anywhere
        found = folded.contains(literals[0]) if pattern.endswith("*") else folded.endswith(literals[0])
    else:
        found = folded.rlike(regex(pattern))
    head = re.split(r"[*?]", pattern, maxsplit=1)[0]
    if names and len(head.encode("utf-8")) >= 2:
        found = folded.startswith(head) if pattern == head + "*" else folded.startswith(head) & found
    return found
