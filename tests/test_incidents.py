"""Incident details and user actions on small fixtures."""

from shelfwatch.operators import incidents


def test_details(spark):
    some = spark.createDataFrame([("a", "open"), ("b", "open")], "incident_id string, status string")
    events = spark.createDataFrame([("a", 2, "e2", "x", "m", '{"reason": "r", "deep": [{"apiKey": 1, "k": "é"}], "user_email": 2}'), ("a", 1, "e1", "x", "m", None), ("a", 3, "e3", "x", "m", "[1]"), ("a", 4, "e4", "x", "m", "{")],
                                   "incident_id string, at int, event_id string, event_type string, message string, metadata_json string")
    signals = spark.createDataFrame([("a", "feed", "n", 1, 2, '[{"title": "t"}]'), ("a", "category", "n", 1, 2, None)], "incident_id string, source string, metric string, before_value long, after_value long, sample_items_json string")
    sent = spark.createDataFrame([("a", 1, "email", "failed", "smtp_down: secret@x.org"), ("a", 2, "email", "sent", None)], "incident_id string, at int, channel string, status string, error string")
    a, b = incidents.details(some, events, signals, sent).orderBy("incident_id").collect()
    assert [(e.event_id, e.metadata, e.reason) for e in a.timeline] == [("e1", None, None), ("e2", '{"reason":"r","deep":[{"k":"é"}]}', "r"), ("e3", None, None), ("e4", None, None)]
    assert [s.source for s in a.signals] == ["category", "feed"] and [s.title for s in a.samples] == ["t"] and [d.error for d in a.deliveries] == ["smtp_down", None]
    assert (b.timeline, b.signals, b.samples, b.deliveries) == ([], [], [], [])


def test_user_actions(spark):
    some = spark.createDataFrame([("a", "open"), ("b", "resolved"), ("c", "recovering")], "incident_id string, status string")
    asked = [("a", "acknowledge"), ("a", "acknowledge"), ("a", "comment"), ("a", "ignore"), ("a", "acknowledge"), ("b", "ignore"), ("b", "comment"), ("c", "acknowledge"), ("c", "ignore"), ("c", "ignore"), ("z", "comment")]
    df = spark.createDataFrame([(i, n, n, a) for n, (i, a) in enumerate(asked)], "incident_id string, at int, action_id int, action string")
    got = [(r.before, r.after, r.outcome) for r in incidents.user_actions(some, df).orderBy("at").collect()]
    assert got == [("open", "acknowledged", "done"), ("acknowledged", "acknowledged", "repeated"), ("acknowledged", "acknowledged", "done"), ("acknowledged", "ignored", "done"), ("ignored", "ignored", "refused"),
                   ("resolved", "resolved", "refused"), ("resolved", "resolved", "done"), ("recovering", "recovering", "refused"), ("recovering", "ignored", "done"), ("ignored", "ignored", "repeated"), (None, None, "refused")]
