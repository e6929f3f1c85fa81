"""Access-log analysis: keys, authentication outcome, bursts of requests.

The request log is a table; the key table is a dimension joined to it by the
hash of the token a request shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schema as S


def hash_token(col: Column) -> Column:
    return F.sha2(col, 256)


def key_id(hash_col: Column) -> Column:
    return F.substring(hash_col, 1, S.KEY_ID_LEN)


def bearer_token(auth: Column) -> Column:
    """Token of an ``Authorization: Bearer`` header (null if not bearer)."""
    a = F.coalesce(auth, F.lit(""))
    return F.when(F.lower(a).startswith("bearer "), F.regexp_replace(F.substring(a, 8, 1 << 30), r"^\s+|\s+$", ""))


def with_key(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Join each request to its key by token hash (left join; the key table
    is a dimension and is broadcast only when small - AQE measures it)."""
    req = requests.withColumn("_hash", hash_token(bearer_token(F.col("authorization"))))
    k = keys.select(F.col("hash").alias("_hash"), "label", "unlimited")
    return req.join(k, "_hash", "left").withColumn("key_id", key_id(F.col("_hash")))


def outcomes(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """(event_id, key_id, status): what the key check answers each request:
    200, 401 (no bearer) or 403 (unknown key). Requests that need no key or
    show none are never joined; they would all meet under one null key."""
    token = bearer_token(F.col("authorization"))
    is_open = F.col("path").isin(*S.OPEN_PATHS)
    bare = requests.where(token.isNull()).select(
        "event_id", F.lit(None).cast("string").alias("key_id"), F.when(is_open, 200).otherwise(401).alias("status")
    )
    keyed = with_key(requests.where(token.isNotNull()), keys).select(
        "event_id",
        F.when(F.col("label").isNotNull(), F.col("key_id")).alias("key_id"),
        F.when(is_open | F.col("label").isNotNull(), 200).otherwise(403).alias("status"),
    )
    return bare.unionByName(keyed)


def request_bursts(requests: DataFrame, keys: DataFrame, window: str, least: int) -> DataFrame:
    """(key_id, unlimited, window_start, requests, busiest_path): time
    windows in which a known key sent ``least`` requests or more."""
    known = with_key(requests.where(bearer_token(F.col("authorization")).isNotNull()), keys).where(F.col("label").isNotNull())
    by_path = known.groupBy("key_id", "unlimited", F.window(F.col("ts").cast("timestamp"), window).alias("w"), "path").agg(
        F.count(F.lit(1)).alias("n")
    )
    sums = by_path.groupBy("key_id", "unlimited", "w").agg(
        F.sum("n").alias("requests"), F.min_by("path", F.struct(-F.col("n"), F.col("path"))).alias("busiest_path")
    )
    return sums.where(F.col("requests") >= least).select(
        "key_id", "unlimited", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "busiest_path"
    )


def prefix_lookup(prefixes: DataFrame, keys: DataFrame) -> DataFrame:
    """Resolve logged key-id prefixes to keys: (prefix, matches, label or
    null, state in resolved / ambiguous / unknown). Prefix lengths are few,
    so each length is an equi-join on the hash's leading characters."""
    p = prefixes.select("prefix").distinct().withColumn("_len", F.length("prefix"))
    lengths = sorted(r[0] for r in p.select("_len").distinct().collect())
    parts = []
    for n in lengths:
        k = keys.select(F.substring("hash", 1, n).alias("prefix"), "label")
        parts.append(p.where(F.col("_len") == n).join(k, "prefix", "left"))
    if not parts:
        from quire.session import literal_table

        return literal_table(prefixes.sparkSession, [], "prefix string, matches long, label string, state string")
    from functools import reduce

    joined = reduce(DataFrame.unionByName, parts)
    agg = joined.groupBy("prefix").agg(F.count("label").alias("matches"), F.min("label").alias("_l"))
    return agg.select(
        "prefix",
        "matches",
        F.when(F.col("matches") == 1, F.col("_l")).alias("label"),
        F.when(F.col("matches") == 0, "unknown").when(F.col("matches") == 1, "resolved").otherwise("ambiguous").alias("state"),
    )


# -- request typing ----------------------------------------------------------------

_TRUE_WORDS = ("1", "true", "yes")


def _clamped(number: Column) -> Column:
    """An integer text of any length, clamped to 1..the largest limit."""
    digits = F.regexp_replace(number, r"^[+-]?0*", "")
    negative = number.startswith("-")
    long = F.length(digits) > len(str(S.MAX_LIMIT))
    value = F.when(long, F.lit(S.MAX_LIMIT)).otherwise(F.coalesce(digits.try_cast("int"), F.lit(0)))
    return F.when(negative, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(value, F.lit(S.MAX_LIMIT)))).cast("int")


def typed_requests(raw: DataFrame) -> DataFrame:
    """Typed search parameters of raw request strings, with a code for the
    first reason to reject them (limit, then after, then before)."""
    from quire.functions.normalize import valid_doi, valid_iso_date

    lim = F.trim(F.col("limit_raw"))
    lim_ok = F.col("limit_raw").isNull() | (F.col("limit_raw") == "") | lim.rlike(r"^[+-]?\d+$")
    lim_v = F.when(
        F.col("limit_raw").isNull() | (F.col("limit_raw") == ""), F.lit(S.DEFAULT_LIMIT)
    ).otherwise(_clamped(lim))

    def date_check(c: str, field: str) -> tuple[Column, Column]:
        blank = F.col(c).isNull() | (F.col(c) == "")
        ok = blank | valid_iso_date(F.col(c))
        return ok, F.concat(F.lit(f"bad_{field}:"), F.col(c))

    after_ok, after_msg = date_check("after_raw", "after")
    before_ok, before_msg = date_check("before_raw", "before")
    cats = F.filter(F.transform(F.split(F.coalesce(F.col("category_raw"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    reason = (
        F.when(~lim_ok, F.concat(F.lit("bad_limit:"), F.col("limit_raw")))
        .when(~after_ok, after_msg)
        .when(~before_ok, before_msg)
    )
    doi_ok = F.col("doi_raw").isNull() | valid_doi(F.col("doi_raw"))
    return raw.select(
        "event_id",
        F.when(lim_ok, lim_v).alias("limit"),
        F.when(after_ok & (F.col("after_raw") != ""), F.col("after_raw")).alias("after"),
        F.when(before_ok & (F.col("before_raw") != ""), F.col("before_raw")).alias("before"),
        F.coalesce(F.lower(F.col("detail_raw")).isin(*_TRUE_WORDS), F.lit(False)).alias("detail"),
        F.when(F.size(cats) == 0, F.lit(None)).otherwise(F.array_join(cats, ",")).alias("category"),
        (F.size(cats) > 1).alias("category_is_list"),
        reason.alias("reject"),
        F.when(~doi_ok, F.concat(F.lit("bad_doi:"), F.col("doi_raw"))).alias("doi_reject"),
    )
