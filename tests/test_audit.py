"""L-series and V-series on literal audit rows."""

import datetime as dt

from sitelens.operators import audit, views

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
TR = "work_item_id string, from_state string, to_state string, created_at timestamp_ntz"
EV = "id string, run_id string, name string, system string, started_at timestamp_ntz, completed_at timestamp_ntz, metadata string"


def test_transitions_legal_and_gauge(spark):
    rows = [
        ("w1", None, "queued", T0), ("w1", "queued", "processing", T0), ("w1", "processing", "completed", T0),
        ("w2", None, "queued", T0), ("w2", "queued", "failed", T0),
        ("w3", None, "queued", T0), ("w3", "completed", "processing", T0), ("w3", "queued", "completed", T0),
    ]
    t = spark.createDataFrame(rows, TR)
    bad = sorted((r.work_item_id, r.from_state, r.to_state) for r in audit.transition_violations(t).collect())
    assert bad == [("w3", "completed", "processing"), ("w3", "queued", "completed")]
    g = {r.state: r.items for r in audit.state_gauge(t).collect()}
    assert g["completed"] == 1 and g["failed"] == 1 and g["queued"] == 0


def test_event_duration_and_views(spark):
    ev = spark.createDataFrame(
        [
            ("e1", "r", "stage.discovery", "discovery", T0, T0 + dt.timedelta(seconds=2.5), '{"outcome": "success"}'),
            ("e2", "r", "stage.extraction", "extraction", T0 + dt.timedelta(seconds=3), None, "{}"),
            ("e3", "r", "stage.scoring", "scoring", T0 + dt.timedelta(seconds=4), T0 + dt.timedelta(seconds=4, milliseconds=250),
             '{"error": "' + "x" * 70 + '", "outcome": "failure"}'),
        ],
        EV,
    )
    d = {r.id: r.duration for r in audit.event_durations(ev).collect()}
    assert d == {"e1": 2.5, "e2": None, "e3": 0.25}
    recent = {r.id: r for r in views.recent_events(ev).collect()}
    assert recent["e3"].recent_rank == 1 and recent["e3"].duration_label == "250ms"
    assert recent["e1"].duration_label == "2.5s" and recent["e2"].duration_label == ""
    assert recent["e3"].meta == "error=" + "x" * 57 + "... outcome=failure"
    outcomes = {(r.stage, r.outcome): r.executions for r in audit.stage_outcomes(ev).collect()}
    assert outcomes == {("discovery", "success"): 1, ("scoring", "failure"): 1}
    last = views.last_stage_events(ev).orderBy("from_end").collect()
    assert [r.duration_label for r in last] == ["250ms", "--", "2500ms"]


def test_stage_states_and_timeline(spark):
    runs = spark.createDataFrame([("r", "h", "running", None, T0, None)],
                                 "run_id string, hostname string, status string, score double, created_at timestamp_ntz, completed_at timestamp_ntz")
    items = spark.createDataFrame(
        [
            ("q", "r", "discovery", "queued", T0, T0, None),
            ("a", "r", "discovery", "completed", T0 + dt.timedelta(seconds=1), T0 + dt.timedelta(seconds=2, milliseconds=340), None),
            ("b", "r", "extraction", "processing", T0 + dt.timedelta(seconds=3), T0 + dt.timedelta(seconds=3), None),
        ],
        "id string, run_id string, stage string, state string, created_at timestamp_ntz, updated_at timestamp_ntz, last_error string",
    )
    st = {r.stage: r.state for r in views.stage_states(runs, items).collect()}
    assert st == {"discovery": "done", "extraction": "active", "canonicalization": "pending", "scoring": "pending", "generation": "pending"}
    assert views.current_stage(views.stage_states(runs, items)).first().label == "▶ Extraction"
    tl = {r.stage: (r.item_id, r.duration_label) for r in views.timeline(items).collect()}
    assert tl == {"discovery": ("a", "1.3s"), "extraction": ("b", "0ms")}
