"""Windows by failure class, on invented series."""

from datetime import datetime, timedelta

from evidra.operators import series

T0 = datetime(2026, 4, 1, 9, 0)


def at(minute):
    return T0 + timedelta(minutes=minute)


def table(spark):
    """(class, name, entity) -> values by minute, with one change at minute 4 and, for one case, a hole from minute 6 to 9."""
    error, slow = "http.server.error_rate", "http.server.duration_p95_ms"
    return {
        ("deploy", error, "service:a"): [0.001, 0.002, 0.003, 0.002, 0.002, 0.002, 0.3, 0.3, 0.3, 0.002],
        ("deploy", slow, "db:a"): [10, 10, 10, 10, 10, 90, 90, 90, 90, 90],
        ("traffic-shift", "queue.depth", "shard:q"): [1, 1, 1, 1, 1, 1, 1, 1, 9, 9],
        ("traffic-shift", slow, "service:q"): [1, 1, 1, 1, 1, 1, 1, 9, 9, 9],
        ("dependency-degradation", "db.query.duration_p95_ms", "db:d"): [20, 20, 50, 20, 100, 30, 200, 200, 20, 20],
        ("recurring-incident", "db.locks.waiting", "db:r"): [0, 0, 0, 6, 6, 6, 0, 0, 0, 0],
        ("missing-data", error, "service:m"): [0.01, 0.01, 0.01, 0.2, 0.2, 0.2, None, None, None, 0.2],
        ("missing-data", "db.query.error_rate", "db:m"): [0.01, 0.01, 0.01, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2],
        ("resource-exhaustion", "pod.restarts.count", "pod:x"): [0, 0, 0, 0, 0, 1, 1, 2, 2, 2],
        ("resource-exhaustion", error, "service:x"): [0.01, 0.01, 0.01, 0.01, 0.01, 0.4, 0.4, 0.01, 0.01, 0.01],
        ("entity-ambiguity", error, "service:p@canary"): [0.01, 0.01, 0.01, 0.01, 0.01, 0.4, 0.4, 0.4, 0.4, 0.4],
        ("entity-ambiguity", error, "service:p@stable"): [0.01] * 10,
        ("entity-ambiguity", error, "service:other"): [0.01, 0.01, 0.01, 0.01, 0.01, 0.4, 0.4, 0.4, 0.4, 0.4],
        ("unheard-of", slow, "service:u"): [10, 10, 10, 10, 10, 90, 90, 10, 10, 10],
    }


def test_windows(spark):
    data = table(spark)
    points = [(c, n, e, at(k), float(v), k) for (c, n, e), vs in data.items() for k, v in enumerate(vs) if v is not None]
    p = spark.createDataFrame(points, "incident_id string, name string, entity string, t timestamp, v double, ord long")
    classes = sorted({c for c, _, _ in data})
    cases = spark.createDataFrame([(c, c, at(0), at(12)) for c in classes], "incident_id string, failure_class string, start timestamp, end timestamp")
    changes = spark.createDataFrame([(c, at(4) + timedelta(seconds=20)) for c in classes], "incident_id string, t timestamp")
    gaps = spark.createDataFrame([("missing-data", "http.server.error_rate", "service:m", at(6), at(9))], "incident_id string, name string, entity string, start timestamp, end timestamp")
    got = {(r.incident_id, r.name, r.entity): r for r in series.class_windows(p, cases, changes, gaps).collect()}
    minute = lambda t: None if t is None else (t - T0).total_seconds() / 60
    ends = {k: (minute(r.start), minute(r.end), round(r.baseline, 4)) for k, r in got.items()}
    error = "http.server.error_rate"
    assert ends == {
        ("deploy", error, "service:a"): (4, 8, 0.002),  # the change's minute; the mean before it
        ("traffic-shift", "queue.depth", "shard:q"): (6, 12, 1),  # no change within three minutes: two earlier; the case's end
        ("dependency-degradation", "db.query.duration_p95_ms", "db:d"): (3, 4, 25),  # one earlier; blended
        ("recurring-incident", "db.locks.waiting", "db:r"): (2, 4, 0),  # one earlier; two before the recovery
        ("missing-data", error, "service:m"): (3, 9, 0.01),  # the first point after the hole
        ("resource-exhaustion", "pod.restarts.count", "pod:x"): (5, 12, 0),
        ("resource-exhaustion", error, "service:x"): (5, 7, 0.01),
        ("entity-ambiguity", error, "service:p@canary"): (3, 12, 0.01),
        ("entity-ambiguity", error, "service:p@stable"): (None, None, 0.01),
        ("unheard-of", "http.server.duration_p95_ms", "service:u"): (5, 6, 10),
    }
    sure = {k: r.detector_confidence for k, r in got.items()}
    assert sure["missing-data", error, "service:m"] == 0.35 and sure["entity-ambiguity", error, "service:p@stable"] == 0.10 and sure["deploy", error, "service:a"] == 0.90
    assert got["entity-ambiguity", error, "service:p@stable"].note == series.STABLE_NOTE and "09:06-09:09" in got["missing-data", error, "service:m"].note
