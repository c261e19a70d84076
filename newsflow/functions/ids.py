"""Deterministic row ids.

Random ids defeat insert-if-absent: a replayed window would get a new id and be stored twice. An id made
from the row's own key is the same on every run, task retry and restart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_uuid(*parts: Column) -> Column:
    """A UUID-shaped id over the given parts. Each part is length-prefixed, so ('a','bc') != ('ab','c')."""
    framed = [
        F.concat(F.length(text).cast("string"), F.lit(":"), text)
        for text in (F.coalesce(p.cast("string"), F.lit("")) for p in parts)
    ]
    digest = F.md5(F.concat(*framed))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )
