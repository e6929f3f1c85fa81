"""Paper table schema and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the catalogue contract) -----------------------
# Paper fields, in table order.
PAPER_FIELDS = (
    "doi",
    "title",
    "authors",
    "abstract",
    "date",
    "category",
    "version",
    "type",
    "license",
    "published",
    "author_corresponding",
    "author_corresponding_institution",
    "jatsxml",
    "server",
)
# Indexed text fields; the position in this tuple is the field id in postings.
INDEX_FIELDS = ("title", "abstract", "authors", "author_corresponding_institution")
# Columns of a compact search result.
COMPACT_FIELDS = ("doi", "title", "authors", "date", "category", "server")
# Source collections, in lookup priority order.
SERVERS = ("biorxiv", "medrxiv")
DEFAULT_SERVER = "biorxiv"
# Relevance: BM25 with k1 = 1.2, b = 0.75, idf floor 1e-6.
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
# Search limits: default 50 rows, clamp to [1, 100000].
DEFAULT_LIMIT = 50
MAX_LIMIT = 100_000
# Synonyms per search term; synonym length window; default expand size.
SEARCH_SYNONYMS = 3
EXPAND_DEFAULT = 5
SYN_MIN_LEN = 3
SYN_MAX_LEN = 60
MAX_PHRASE_WORDS = 3
# NEAR default distance.
NEAR_DEFAULT = 10
# Sync: first day, window length in days, page size.
SYNC_EPOCH = "2013-01-01"
WINDOW_DAYS = 30
PAGE_SIZE = 100
# DOI pattern.
DOI_PATTERN = r"^10\.\d{4,9}/[A-Za-z0-9._\-;()/:]+$"
# PDF checks: size cap and magic bytes; public PDF URL format.
MAX_PDF_BYTES = 100 * 1024 * 1024
PDF_MAGIC = b"%PDF"
PDF_URL_FORMAT = "https://www.%s.org/content/%sv%s.full.pdf"
# Access control: open paths, per-key rate (tokens/s) and burst.
OPEN_PATHS = ("/", "/health")
KEY_ID_LEN = 8
# Sync state keys.
STATE_LAST_SYNC = "last_sync_date"
STATE_BULK_CURSOR = "bulk_sync_cursor"
# ---------------------------------------------------------------------------

PAPER_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in PAPER_FIELDS])

STATE_SCHEMA = T.StructType(
    [T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), True)]
)
