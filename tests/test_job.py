"""Log folders to report, end to end."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from tests.test_sources import assistant, context, meta, spent, user, write
from usagelens.job import run
from usagelens.operators import billing as B, trends as T
from usagelens.sources.tables import read_usage


def test_logs_to_report(spark, tmp_path):
    write(tmp_path / "a" / "-w-proj" / "S.jsonl", [
        user("u1", None, "fix the build"),
        assistant("a1", "u1", "m1", "2024-05-15T10:00:00Z"), assistant("a2", "a1", "m1", "2024-05-15T10:00:00Z"),
        assistant("a3", "a2", "m2", "2024-05-15T11:30:00Z", out=20),
        user("r", "a3", [{"type": "tool_result", "is_error": True, "content": "Permission denied"}], "2024-05-15T11:31:00Z"),
    ])
    write(tmp_path / "a2" / "-w-proj" / "S.jsonl", [assistant("a1", "u1", "m1", "2024-05-15T10:00:00Z"), assistant("z", None, "m9", "2024-05-14T10:00:00Z")])
    old = {**spent("00:00:00", 80, 20, 50), "timestamp": "2024-05-15T11:50:00Z"}
    write(tmp_path / "b" / "rollout-1.jsonl", [meta(id="B"), context("T1"), old])
    os.utime(tmp_path / "b" / "rollout-1.jsonl", (1_600_000_000, 1_600_000_000))  # an old file still counts
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "local_1.json").write_text('{"cliSessionId": "S", "title": "Build", "titleSource": "auto"}')
    out = str(tmp_path / "out")
    run(
        spark, agent_a=[(str(tmp_path / "a"), "mac"), (str(tmp_path / "a2"), "pc")], agent_b=[(str(tmp_path / "b"), "mac")],
        as_of=str(datetime(2024, 5, 15, 12)), out=out, titles=str(tmp_path / "t"),
        sections=("totals", "by_session", "by_device", "errors_by_category", "current_window", "block_eta", "daily", "baseline", "recent_turns"), per_source=True,
    )
    u = read_usage(spark, f"{out}/usage")
    assert sorted((r.message_id, r.device, r.turn_id) for r in u.collect()) == [("B:0", "mac", "T1"), ("m1", "mac", "u1"), ("m2", "mac", "u1"), ("m9", "pc", "z")]
    plan = u.where(F.col("date") >= "2024-05-15")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan

    def section(name):
        return spark.read.parquet(f"{out}/report/{name}").collect()

    assert section("totals")[0].messages == 4
    s = {r.session_id: r for r in section("by_session")}
    assert s["S"].intent == "fix the build" and s["S"].chat == "Build" and s["B"].chat is None
    assert section("errors_by_category")[0].category == "permission_denied"
    assert section("current_window")[0].active
    assert {r.device for r in section("by_device")} == {"mac", "pc"}
    assert section("ingest_quality")[0].parse_errors == 0
    assert section("current_window") == B.current_window(u, as_of="2024-05-15 12:00:00").collect()
    assert section("baseline") == T.baseline(u, as_of="2024-05-15 12:00:00").collect()
    assert [r.messages for r in section("daily")] == [1, 3]
    meta_row = section("meta")[0]
    assert (meta_row.record_count, meta_row.files_scanned, meta_row.as_of) == (4, 3, "2024-05-15 12:00:00")
    alone = spark.read.parquet(f"{out}/sources/agent_b/totals").collect()
    assert [r.messages for r in alone] == [1] and spark.read.parquet(f"{out}/sources/agent_a/meta").first().record_count == 3


def fingerprint(spark, out):
    """Usage and side tables of a job, as text."""
    from usagelens.sources.tables import read_usage as usage_of

    columns = [c for c in usage_of(spark, f"{out}/usage").columns if c != "date"]
    return [
        sorted(str(tuple(r)) for r in usage_of(spark, f"{out}/usage").select(*columns).collect()),
        sorted(str(tuple(r)) for r in spark.read.parquet(f"{out}/quarantine").collect()),
        sorted(str(tuple(r)) for r in spark.read.parquet(f"{out}/report/ingest_quality").collect()),
        sorted(str(tuple(r)) for r in spark.read.parquet(f"{out}/report/by_session").collect()),
    ]


def touch(path, second):
    os.utime(path, (1_715_000_000 + second, 1_715_000_000 + second))


def test_increments_equal_one_run(spark, tmp_path, monkeypatch):
    """Files that grow, shrink, are written anew, break off inside a line, appear and go; a small range makes several per file."""
    from usagelens.sources import ranges

    monkeypatch.setattr(ranges.read_ranges, "__defaults__", ((), 300))
    a, b = tmp_path / "a" / "-w-proj", tmp_path / "b"
    first = [user("u1", None, "fix it"), assistant("a1", "u1", "m1", "2024-05-15T10:00:00Z"), "{broken", assistant("a2", "later", "m2", "2024-05-15T10:05:00Z")]
    write(a / "grows.jsonl", first)
    write(a / "stays.jsonl", [user("u9", None, "other"), assistant("s1", "u9", "m20", "2024-05-15T09:00:00Z")])
    write(a / "shrinks.jsonl", [assistant(f"k{i}", None, f"k{i}", "2024-05-15T08:00:00Z") for i in range(5)])
    write(a / "anew.jsonl", [assistant("n1", None, "n1", "2024-05-15T08:00:00Z")])
    write(a / "goes.jsonl", [assistant("g1", None, "g1", "2024-05-15T08:00:00Z")])
    write(b / "rollout-1.jsonl", [meta(id="B"), context("T1"), spent("10:00:00", 80, 20, 50), spent("10:01:00", 80, 20, 50)])
    for f in [*a.iterdir(), *b.iterdir()]:
        touch(f, 0)
    sections = ("by_session",)
    roots = dict(agent_a=[(str(tmp_path / "a"), "mac", "me")], agent_b=[(str(b), "pc", "you")])

    def job(out):
        return run(spark, **roots, as_of="2024-05-15 12:00:00", out=str(tmp_path / out), sections=sections, keys=("account",))

    assert job("inc") == {"agent_a": {"new": 5, "skip": 0}, "agent_b": {"new": 1, "skip": 0}}
    assert job("inc") == {"agent_a": {"skip": 5}, "agent_b": {"skip": 1}}

    # Grown, with a missing parent that comes later and a line that breaks off; agent B goes on in the same turn with the same usage.
    import json

    cut = json.dumps(assistant("a4", "a3", "m4", "2024-05-15T10:20:00Z"))
    with open(a / "grows.jsonl", "a") as f:
        f.write(json.dumps(user("later", None, "and this")) + "\n" + json.dumps(assistant("a3", "later", "m3", "2024-05-15T10:10:00Z")) + "\n" + cut[:40])
    with open(b / "rollout-1.jsonl", "a") as f:
        f.write(json.dumps(spent("10:02:00", 80, 20, 50)) + "\n" + json.dumps(spent("10:03:00", 7, 2, 5)) + "\n")
    write(a / "shrinks.jsonl", [assistant("k9", None, "k9", "2024-05-15T08:30:00Z")])
    write(a / "anew.jsonl", [assistant("n2", None, "n2", "2024-05-15T08:00:00Z"), assistant("n3", None, "n3", "2024-05-15T08:10:00Z")])
    (a / "goes.jsonl").unlink()
    for f in (a / "grows.jsonl", a / "shrinks.jsonl", a / "anew.jsonl", b / "rollout-1.jsonl"):
        touch(f, 10)
    assert job("inc") == {"agent_a": {"append": 1, "reload": 2, "skip": 1}, "agent_b": {"append": 1, "skip": 0}}
    job("whole1")
    assert fingerprint(spark, tmp_path / "inc") == fingerprint(spark, tmp_path / "whole1")

    with open(a / "grows.jsonl", "a") as f:
        f.write(cut[40:] + "\n" + json.dumps(assistant("a5", "a4", "m5", "2024-05-15T10:30:00Z")))
    write(b / "rollout-2.jsonl", [meta(id="B2"), spent("11:00:00", 5, 0, 5), '{"token_count" broken'])
    touch(a / "grows.jsonl", 20)
    assert job("inc") == {"agent_a": {"append": 1, "skip": 3}, "agent_b": {"new": 1, "skip": 1}}
    job("whole2")
    assert fingerprint(spark, tmp_path / "inc") == fingerprint(spark, tmp_path / "whole2")
    u = read_usage(spark, str(tmp_path / "inc" / "usage"))
    assert {(r.account, r.device) for r in u.select("account", "device").distinct().collect()} == {("me", "mac"), ("you", "pc")}
    assert {r.message_id for r in u.where("turn_id = 'later'").collect()} == {"m2", "m3", "m4", "m5"}


def test_only_new_bytes_are_read(spark, tmp_path):
    """What lies before the end of the last run is not read again: it is made unreadable without changing the bytes that mark it."""
    from usagelens.plans.ingest import load_increment

    f = tmp_path / "a" / "-w-p" / "x.jsonl"
    write(f, [assistant(f"a{i}", None, f"m{i}", "2024-05-15T10:00:00Z") for i in range(50)])
    touch(f, 0)
    load_increment(spark, str(tmp_path / "store"), "agent_a", [(str(tmp_path / "a"), "mac")])
    old = f.read_bytes()
    import json

    f.write_bytes(b"#" * (len(old) - 300) + old[-300:] + json.dumps(assistant("z", None, "z", "2024-05-15T11:00:00Z")).encode() + b"\n")
    touch(f, 5)
    loaded, counts = load_increment(spark, str(tmp_path / "store"), "agent_a", [(str(tmp_path / "a"), "mac")])
    assert counts == {"append": 1, "skip": 0}
    assert sorted(r.message_id for r in loaded.usage.collect()) == sorted([*(f"m{i}" for i in range(50)), "z"])
    assert loaded.quarantine.count() == 0
