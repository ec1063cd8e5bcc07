"""Names and file types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: media types by file extension
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "tif": "image/tiff",
    "tiff": "image/tiff", "webp": "image/webp", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html",
    "htm": "text/html", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4",
}
OTHER_MIME = "application/octet-stream"


def document_type_of(ext: str) -> str:
    kind = MIME.get(ext, "").partition("/")[0]
    return {"image": "photo", "audio": "audio", "video": "video"}.get(kind, "other")


def mime_type(filename: Column, form: Column) -> Column:
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(MIME.items())])
    return F.when(F.instr(form, "/") > 0, F.trim(form)).otherwise(F.coalesce(table[ext], F.lit(OTHER_MIME)))


def normalize_name(c: Column) -> Column:
    """Trimmed, lower case, white space runs as one blank; accents stay."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def name_display(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("/"), F.lit("")), r"(?U)\s+", " "))


def name_components(c: Column) -> Column:
    """array<struct<type, value, order>> of a name whose family part stands between slashes."""
    has = c.rlike("(?s)/.*/")
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("value"))
    split = F.array(
        part("given_name", F.regexp_extract(c, "(?s)^([^/]*)/", 1)),
        part("family_name", F.regexp_extract(c, "(?s)^[^/]*/(.*)/[^/]*$", 1)),
        part("suffix", F.regexp_extract(c, "(?s)/([^/]*)$", 1)),
    )
    parts = F.filter(F.when(has, split).otherwise(F.array(part("given_name", c))), lambda x: x["value"] != "")
    return F.transform(parts, lambda x, i: F.struct(x["type"].alias("type"), x["value"].alias("value"), (i + 1).alias("order")))


def components_of(raw: str) -> list[dict]:
    """As name_components, on one value."""
    a, b = raw.find("/"), raw.rfind("/")
    if b > a >= 0:
        parts = [("given_name", raw[:a]), ("family_name", raw[a + 1 : b]), ("suffix", raw[b + 1 :])]
    else:
        parts = [("given_name", raw)]
    kept = [(k, v.strip()) for k, v in parts if v.strip()]
    return [{"type": k, "value": v, "order": i} for i, (k, v) in enumerate(kept, 1)]
