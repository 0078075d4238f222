"""Hand-written usage rows."""

from datetime import datetime, timedelta

from usagelens.schema import USAGE_SCHEMA

NOW = datetime(2024, 5, 15, 12, 0, 0)
DEFAULTS = {
    "timestamp": NOW,
    "source": "agent_a", "account": "a", "device": "mac", "session_id": "s", "project_dir": "/p", "project_label": "proj", "git_branch": "main",
    "model": "claude-opus-4-8", "input_tokens": 0, "output_tokens": 0, "cache_creation_tokens": 0, "cache_read_tokens": 0, "tool_names": [],
    "source_file": "f", "uuid": "", "parent_uuid": "",
}


def usage(spark, rows):
    """Rows as dicts; `ago` (timedelta) may stand for a timestamp."""
    out = []
    for i, r in enumerate(rows):
        r = {**DEFAULTS, "line_no": i, "message_id": f"m{i}", "turn_id": f"t{i}", **r}
        if "ago" in r:
            r["timestamp"] = NOW - r.pop("ago")
        out.append(tuple(r[f.name] for f in USAGE_SCHEMA))
    return spark.createDataFrame(out, USAGE_SCHEMA)


def minutes(n):
    return timedelta(minutes=n)
