"""Names, paths and hex: predicates as columns, and as Python for the driver."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_ok(name: Column) -> Column:
    """Not empty, not ``.`` or ``..``, without slashes; ``.tmp`` names are refused as they would look half-written."""
    return ~(name.isin("", ".", "..") | name.contains("/") | name.contains("\\") | name.endswith(".tmp"))


def valid_name(name: str) -> bool:
    return name not in ("", ".", "..") and not {"/", "\\"} & set(name) and not name.endswith(".tmp")


def path_ok(path: Column) -> Column:
    """Relative, and no component is ``..``."""
    return ~(path.startswith("/") | F.array_contains(F.split(path, "/", -1), ".."))


def safe_path(path: str) -> bool:
    return not path.startswith("/") and ".." not in path.split("/")


def digest_ok(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def from_hex(text: Column) -> Column:
    """32 bytes from 64 hex digits of either case; anything else is an error."""
    return F.when(digest_ok(text), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not a digest: "), F.coalesce(text, F.lit("null")))).cast("binary"))


def to_hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def pack_name(pack_id: Column) -> Column:
    return F.concat(F.lit("pack_"), F.lpad(pack_id.cast("string"), 6, "0"), F.lit(".pack"))


def pack_id(name: Column) -> Column:
    return F.regexp_extract(name, r"^pack_([0-9]{6,})\.pack$", 1).cast("bigint")


def human(n: int) -> str:
    """1024-based size with one decimal, whole bytes without."""
    size, unit = float(n), 0
    while size >= 1024 and unit < 4:
        size, unit = size / 1024, unit + 1
    return f"{n} B" if unit == 0 else f"{size:.1f} {'BKMGT'[unit]}B"
