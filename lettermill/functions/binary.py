"""File kinds by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes in hexadecimal, brands of HEIC files, and kinds by file extension.
MAGIC = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "474946383761": "image/gif", "474946383961": "image/gif", "25504446": "application/pdf"}
HEIC_BRANDS = ("heic", "heix", "hevc", "heim", "mif1", "msf1")
EXTENSIONS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf", "heic": "image/heic"}
READABLE_IMAGES = ("image/jpeg", "image/png", "image/gif", "image/webp")


def mime_of(content: Column) -> Column:
    """The kind of a file of twelve bytes or more, else null."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.octet_length(content) < 12, None)
    for magic, kind in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    out = out.when(head.startswith(b"RIFF".hex().upper()) & head.endswith(b"WEBP".hex().upper()), "image/webp")
    brand = F.substring(head, 17, 8)
    return out.when((F.substring(head, 9, 8) == b"ftyp".hex().upper()) & brand.isin([b.encode().hex().upper() for b in HEIC_BRANDS]), "image/heic")


def mime_or_extension(content: Column, path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v)])
    return F.coalesce(mime_of(content), kinds[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))])
