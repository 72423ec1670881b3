"""Names of contents: the URL-safe digest that a stored file goes by."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(content: Column) -> Column:
    """SHA-256 in URL-safe base64 without padding, of a binary or string column."""
    digest = F.base64(F.unhex(F.sha2(content.cast("binary"), 256)))
    return F.translate(F.rtrim(digest, F.lit("=")), "+/", "-_")


def content_id_of(content: bytes) -> str:
    """The same of bytes at hand."""
    return base64.urlsafe_b64encode(hashlib.sha256(content).digest()).rstrip(b"=").decode()
