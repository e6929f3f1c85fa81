"""Auth outcomes, bursts, request typing."""

import datetime as dt

from quire.operators import access as AC


def _keys(spark, rows):
    return spark.createDataFrame(
        [(h, label, unl, "2024-01-01") for h, label, unl in rows], "hash string, label string, unlimited boolean, created_at string"
    )


def _hash(s):
    import hashlib

    return hashlib.sha256(s.encode()).hexdigest()


def _requests(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, base + dt.timedelta(seconds=t), path, auth) for i, (t, path, auth) in enumerate(rows)],
        "event_id long, ts timestamp_ntz, path string, authorization string",
    )


def test_key_outcomes(spark):
    keys = _keys(spark, [(_hash("good"), "k1", False)])
    req = _requests(
        spark,
        [
            (0, "/api/search", None),
            (1, "/api/search", "Basic abc"),
            (2, "/api/search", "Bearer wrong"),
            (3, "/api/search", "Bearer good"),
            (4, "/health", None),
            (5, "/api/search", "bearer   good "),
        ],
    )
    got = {r.event_id: r.status for r in AC.outcomes(req, keys).collect()}
    assert got == {0: 401, 1: 401, 2: 403, 3: 200, 4: 200, 5: 200}
    deleted = AC.outcomes(req, _keys(spark, [(_hash("other"), "k2", False)])).collect()
    assert {r.event_id: r.status for r in deleted}[3] == 403


def test_bursts(spark):
    keys = _keys(spark, [(_hash("a"), "k1", False), (_hash("b"), "k2", True)])
    hour = 3600
    req = _requests(
        spark,
        [(0, "/api/search", "Bearer a"), (5, "/api/pdf", "Bearer a"), (9, "/api/pdf", "Bearer a"), (hour, "/api/pdf", "Bearer a"),
         (1, "/api/search", "Bearer b"), (2, "/api/search", "Bearer b"), (3, "/api/search", "Bearer no"), (4, "/api/search", None)],
    )
    got = sorted(tuple(r) for r in AC.request_bursts(req, keys, "1 hour", 2).collect())
    day = "2024-01-01 00:00:00"
    assert got == sorted([(_hash("a")[:8], False, day, 3, "/api/pdf"), (_hash("b")[:8], True, day, 2, "/api/search")])


def test_limits_of_any_length_are_clamped(spark):
    cols = ["limit_raw", "after_raw", "before_raw", "detail_raw", "category_raw", "doi_raw"]
    limits = ["9" * 60, "-" + "9" * 60, "+00012", "0", "100001", "", None, "ten", "1e3"]
    rows = [(i, v, None, None, None, None, None) for i, v in enumerate(limits)]
    raw = spark.createDataFrame(rows, "event_id long, " + ", ".join(f"{c} string" for c in cols))
    got = {r.event_id: (r["limit"], r.reject) for r in AC.typed_requests(raw).collect()}
    assert [got[i][0] for i in range(9)] == [100000, 1, 12, 1, 100000, 50, 50, None, None]
    assert got[7][1] == "bad_limit:ten"
