"""The gate before every request: which credential is looked up where, and who may pass."""

import hashlib

from pyspark.sql import functions as F

from shiftlens.operators.accounts import request_gate


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_request_gate(spark):
    users = spark.createDataFrame([("1", "admin", False), ("2", "member", False), ("3", "admin", True)], "id string, role string, disabled boolean")
    keys = spark.createDataFrame(
        [(sha("pk_a"), "1", False), (sha("pk_b"), "2", True), (sha("pk_c"), "3", False), (sha("pk_d"), "9", False), (sha("x"), "1", False)],
        "key_hash string, user_id string, revoked boolean",
    )
    claims = spark.createDataFrame(
        [(sha(t), u, p, e) for t, u, p, e in [
            ("good", "2", None, "2024-01-02"), ("boss", "1", "access", "2024-01-02"), ("late", "1", None, "2024-01-01"), ("state", "1", "oauth-state", "2024-01-02"),
            ("gone", "9", None, "2024-01-02"), ("off", "3", None, "2024-01-02"), ("pk_jwt", "1", None, "2024-01-02"), ("never", "1", None, None),
        ]],
        "token_hash string, user_id string, purpose string, expires_at string",
    ).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    cases = [
        (None, False, 401, "no_token", None), ("", False, 401, "no_token", None), ("Bearer", False, 401, "no_token", None), ("Bearer \t ", False, 401, "no_token", None),
        ("Basic good", False, 401, "no_token", None), ("bearer good", False, 401, "no_token", None),
        ("Bearer pk_a", True, 200, "passed", "1"), ("Bearer  pk_a\n", False, 200, "passed", "1"), ("Bearer pk_b", False, 401, "bad_key", None),
        ("Bearer pk_c", False, 401, "bad_key", None), ("Bearer pk_d", False, 401, "bad_key", None), ("Bearer pk_none", False, 401, "bad_key", None),
        ("Bearer pk_jwt", False, 401, "bad_key", None), ("Bearer x", False, 401, "bad_token", None),
        ("Bearer good", False, 200, "passed", "2"), ("Bearer good", True, 403, "not_admin", "2"), ("Bearer boss", True, 200, "passed", "1"),
        ("Bearer late", False, 401, "bad_token", None), ("Bearer never", False, 401, "bad_token", None), ("Bearer state", False, 401, "bad_token", None),
        ("Bearer gone", False, 401, "bad_user", None), ("Bearer off", True, 401, "bad_user", None),
    ]
    requests = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "request_id long, header string, admin_only boolean")
    got = request_gate(requests, keys, claims, users, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r["request_id"], r["status"], r["reason"], r["user_id"]) for r in got) == [(i, *c[2:]) for i, c in enumerate(cases)]
    assert request_gate(requests.limit(0), keys, claims, users, F.lit("2024-01-01").cast("timestamp")).count() == 0
