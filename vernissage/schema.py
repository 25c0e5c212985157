"""Schemas, fixed values and parameter objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Record layout, id and URL templates, defaults.
RAW_SCHEMA = T.StructType(
    [T.StructField("idx", T.LongType())]
    + _strings("title", "artist", "date", "genre", "style", "description", "filename").fields
    + [T.StructField("image", T.BinaryType())]
)
META_SCHEMA = _strings("id", "title", "artist", "url", "genre", "style", "date")
AUTHORITY_SCHEMA = _strings("name")
RESULT_COLUMNS = (
    "artwork_id", "title", "artist", "source_url", "confidence",
    "latency_ms", "fallback_triggered", "genre", "style", "date",
)
SOURCE = "wikiart"
SOURCE_URL = "https://www.wikiart.org"
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_ARTIST = "Unknown"
UNKNOWN_LABEL = "Unknown"
UNKNOWN_ID = "unknown"
INGEST_THRESHOLD = 92
ARTIST_THRESHOLD = 90
TITLE_THRESHOLD = 85
SCALING_SIZES = (10, 50, 100, 250, 500)


@dataclass(frozen=True)
class SearchConfig:
    """Search parameters; the defaults suit unit-length vectors in a few dozen cells.

    ``confidence_threshold`` is a cosine, ``max_hamming`` counts differing bits
    of a signature of 64 components.
    """

    nprobe_fast: int = 2
    nprobe_deep: int = 8
    max_hamming: int = 11
    confidence_threshold: float = 0.55
