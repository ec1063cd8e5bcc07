"""Identifiers: the shape of a UUID and UUIDs derived from what they stand for."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_LIKE = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_like = re.compile(UUID_LIKE)


def is_uuid_like(c: Column) -> Column:
    return c.rlike(UUID_LIKE)


def uuid_like(text: str) -> bool:
    return bool(_like.match(text))


def derived_uuid(*parts: Column) -> Column:
    """A lower-case v4-shaped UUID from the given parts, the same wherever and whenever it is computed."""
    return F.regexp_replace(
        F.md5(F.concat_ws(":", *parts)), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5"
    )


def uuid_of(*parts: str) -> str:
    h = hashlib.md5(":".join(parts).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:]}"
