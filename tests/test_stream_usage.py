"""Growing logs of both agents as streams give what the batch job gives."""

import json


from tests.test_sources import assistant, context, meta, spent, user, write
from usagelens.plans.ingest import load_agent_a, load_agent_b
from usagelens.sources import agent_b as SB
from usagelens.sources.tail import LogTailReader
from usagelens.streaming import usage_stream as RU

COLUMNS = ("timestamp", "source", "account", "device", "session_id", "project_dir", "model", "message_id", "input_tokens", "output_tokens", "cache_read_tokens", "turn_id")


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def add(path, lines):
    with open(path, "a") as f:
        f.write("".join(json.dumps(x) + "\n" for x in lines))


def test_agent_b(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    one, two = logs / "rollout-1.jsonl", logs / "rollout-2.jsonl"

    def step():
        RU.run_usage_stream(RU.tail_lines(spark, str(logs), pattern=SB.FILE_PATTERN, wanted=SB.INTEREST), out, f"{out}/check", source="agent_b", device="pc", account="me")

    write(one, [meta(id="S1"), context("T1"), spent("10:00:00", 80, 20, 50)])
    write(two, [meta(id="S2"), spent("10:00:30", 1, 0, 1)])
    step()
    # The same usage again is a repeat also across batches; the turn and model go on; a replay in another file is the same record.
    add(one, [spent("10:00:05", 80, 20, 50), spent("10:01:00", 5, 1, 2)])
    write(logs / "rollout-3.jsonl", [meta(id="S3"), context("T1"), spent("12:00:00", 80, 20, 50)])
    step()
    with open(two, "a") as f:
        f.write(json.dumps(spent("10:02:00", 9, 0, 9)) + "\n" + '{"type": "event')  # breaks off
    step()
    with open(two, "a") as f:
        f.write("_msg\"}\n" + json.dumps(context("T9")) + "\n" + json.dumps(spent("10:03:00", 9, 0, 9)) + "\n" + json.dumps(spent("10:04:00", 3, 0, 9)) + "\n")
    step()
    step()
    want = load_agent_b(spark, [(str(logs), "pc")], account="me").usage
    got = RU.read_usage_stream(spark, out, "agent_b")
    assert rows(got) == rows(want) and got.count() == 5
    assert {r.message_id for r in got.where("session_id = 'S2'").collect()} == {"S2:0", "S2:1", "S2:2"}


def test_agent_a(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    f = logs / "-w-p" / "S.jsonl"

    def step():
        RU.run_usage_stream(RU.tail_lines(spark, str(logs)), out, f"{out}/check", source="agent_a", device="mac", account="me")

    write(f, [user("u1", None, "fix"), assistant("a1", "u1", "m1", "2024-05-15T10:00:00Z")])
    step()
    add(f, [assistant("a2", "a1", "m1", "2024-05-15T10:00:00Z"), assistant("a3", "a2", "m2", "2024-05-15T10:01:00Z"), user("u2", "a3", "more")])
    step()
    add(f, [assistant("a4", "u2", "m3", "2024-05-15T10:02:00Z")])
    write(logs / "-w-p" / "T.jsonl", [assistant("x1", None, "m9", "2024-05-15T10:02:00Z")])
    step()
    got = RU.read_usage_stream(spark, out, "agent_a")
    assert rows(got) == rows(load_agent_a(spark, [(str(logs), "mac")], account="me").usage)
    assert sorted((r.message_id, r.turn_id) for r in got.collect()) == [("m1", "u1"), ("m2", "u1"), ("m3", "u2"), ("m9", "x1")]


def test_small_files_share_tasks(tmp_path):
    """Tasks grow with the bytes, not with the number of files; a large file is still cut, and every line is read once."""
    want = []
    for i in range(300):
        (tmp_path / f"{i:03}.jsonl").write_text(f"{i}-a\n{i}-b\n")
        want += [f"{i}-a", f"{i}-b"]
    (tmp_path / "zz.jsonl").write_text("".join(f"long-{i}\n" for i in range(100_000)))
    want += [f"long-{i}" for i in range(100_000)]
    reader = LogTailReader({"root": str(tmp_path), "range": str(1 << 18), "tasks": "4"})
    alone = reader.partitions({}, reader.latestOffset())
    assert len([p for p in alone if any(r.path.endswith("zz.jsonl") for r in p.ranges)]) == 5
    reader = LogTailReader({"root": str(tmp_path), "tasks": "4"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert 4 <= len(parts) <= 8
    assert sorted(v for p in parts for v, _, _ in reader.read(p)) == sorted(want)
    # What one file grew by is one task.
    with open(tmp_path / "007.jsonl", "a") as f:
        f.write("more\n")
    assert [v for p in reader.partitions(end, reader.latestOffset()) for v, _, _ in reader.read(p)] == ["more"]
