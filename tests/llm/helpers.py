import random
import tempfile
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def odd_documents():
    """Nulls in every column, empty and very long texts, repeated rows, ids that
    occur twice, accents and other scripts."""
    rng = random.Random(5)
    base = words(rng, 300)
    rows = [
        (None, words(rng, 80), "en", None, None),
        (1, None, None, "a", 1),
        (2, "", "en", "a", 0),
        (3, "  \n ", "en", "b", 4),
        (4, base, "en", "a", 9),
        (4, base, "en", "a", 9),
        (5, base, "fr", "b", 9),
        (6, base + " plus", None, "b", 9),
        (6, words(rng, 60), "en", None, 9),
        (7, "été œuvre 東京 hello " * 30, "fr", "c", 9),
        (8, words(rng, 40_000), "en", "c", 9),
        (9, "one two", "en", "c", 7),
        (10, "!!! ... 123   \x85", "en", "c", 9),
        (None, words(rng, 80), "en", None, None),
    ]
    return rows


def write(spark, **tables):
    """A folder with the given tables ((schema, rows)) as Parquet."""
    folder = tempfile.mkdtemp(prefix="quire-llm-")
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def with_clashes(df):
    """Extra columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["score", "id", "k1", "k2", "least", "class", "spans", "doc", "pos", "n", "root", "chunk", "epoch", "length"]
    return df.withColumns({c: F.lit("x") for c in names})
