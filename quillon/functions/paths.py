"""Columns over paths. Both \\ and / separate components; names fold by Unicode, paths by ASCII only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = "\\/"
FRN_MASK = 0xFFFFFFFFFFFF
#: Attribute bits of a catalogue entry (fixed values).
FLAGS = {"hidden": 1, "system": 2, "readonly": 4, "reparse": 8}
#: The same attributes as file systems report them (fixed values).
ATTRIBUTES = {"readonly": 0x1, "hidden": 0x2, "system": 0x4, "reparse": 0x400}
#: Seconds from 1601-01-01 to 1970-01-01 (fixed value).
FILETIME_EPOCH = 11_644_473_600


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    """What follows the last separator."""
    return F.substring_index(F.translate(as_col(path), "\\", "/"), "/", -1)


def dirname(path: Column | str) -> Column:
    """What precedes the last separator; empty without one."""
    p = as_col(path)
    return F.substring(p, F.lit(1), F.greatest(F.length(p) - F.length(basename(p)) - 1, F.lit(0)))


def fold_name(c: Column | str) -> Column:
    return F.lower(as_col(c))


def fold_path(c: Column | str) -> Column:
    """ASCII letters in lower case, all else as it is."""
    return F.translate(as_col(c), string.ascii_uppercase, string.ascii_lowercase)


def fold_path_text(s: str) -> str:
    return s.translate({ord(a): ord(b) for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)})


def lower_reversed(name: Column | str) -> Column:
    return F.reverse(F.lower(as_col(name)))


def trim_separators(s: str) -> str:
    return s.rstrip(SEPARATORS)


def starts_under(path_ci: Column, root_ci: str) -> Column:
    """Boundary-aware: the root itself or what is below it, never a sibling that begins alike."""
    return (path_ci == root_ci) | path_ci.startswith(root_ci + "\\") | path_ci.startswith(root_ci + "/")


def on_drive(path: Column, drive: str) -> Column:
    return fold_path(F.substring(path, 1, 2)) == f"{drive.lower()}:"


def drive_of(path: Column | str) -> Column:
    return F.upper(F.substring_index(as_col(path), ":", 1))


def ancestors(path: Column | str) -> Column:
    """All proper prefixes that end before a separator, separators kept as they are."""
    p = as_col(path)
    parts = F.split(p, r"[\\/]")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda i: F.substring(p, F.lit(1), F.length(F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>"))


def depth_below(path: Column, root: str) -> Column:
    """Separators after the root."""
    rest = F.substring(path, F.lit(len(root) + 1), F.length(path))
    return F.length(rest) - F.length(F.translate(rest, SEPARATORS, ""))


def rewrite_prefix(path: Column, old: Column | str, new: Column | str) -> Column:
    """``path`` moved from directory ``old`` to ``new``; null when it is not below ``old``."""
    old_c, new_c = (F.lit(x) if isinstance(x, str) else x for x in (old, new))
    head, rest = F.substring(path, F.lit(1), F.length(old_c)), F.substring(path, F.length(old_c) + 1, F.length(path))
    below = (fold_path(head) == fold_path(old_c)) & F.substring(rest, 1, 1).isin("\\", "/")
    return F.when(below, F.concat(new_c, rest))


def same_name(path: Column, name: Column) -> Column:
    return fold_path(basename(path)) == fold_path(name)


def has_component(path_ci: Column, part: str) -> Column:
    """Whether whole components of the path spell ``part``, which may hold separators itself."""
    quoted = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in part)
    return path_ci.rlike(rf"(^|[\\/]){quoted}([\\/]|$)")


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def flags_of_attributes(attributes: Column) -> Column:
    out = F.lit(0)
    for name, bit in ATTRIBUTES.items():
        out = out + F.when(attributes.bitwiseAND(bit) != 0, FLAGS[name]).otherwise(0)
    return out.cast("int")


def filetime_to_unix(ft: Column) -> Column:
    return F.greatest(F.floor(ft / 10_000_000) - FILETIME_EPOCH, F.lit(0)).cast("long")


def masked_frn(frn: Column) -> Column:
    """48 bits; zero means there is none."""
    return F.nullif(frn.bitwiseAND(FRN_MASK), F.lit(0))


def trigrams(name_l: Column) -> Column:
    """Distinct windows of three UTF-8 bytes, one character standing for one byte."""
    b = bytes_text(name_l)
    n = F.length(b)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(b, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>"))


def bytes_text(c: Column) -> Column:
    """The UTF-8 bytes as a string of as many characters."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def format_bytes(n: Column) -> Column:
    """1024-based with two decimals from KB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.2f {unit}", n / float(1024**k))).otherwise(out)
    return out
