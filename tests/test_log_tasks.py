"""Logs are dealt to tasks by bytes and by number."""

from folio.sources import event_logs


def test_logs_are_dealt_by_number():
    r = event_logs._Reader("x")
    parts = r.partitions({"logs": {}}, {"logs": {f"s{k}": 10 for k in range(2 * event_logs.TASK_LOGS + 1)}})
    assert [len(p.logs) for p in parts] == [event_logs.TASK_LOGS, event_logs.TASK_LOGS, 1]
