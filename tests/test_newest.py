"""The newest sessions and turns, found in the newest days only."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import NOW, usage
from usagelens.operators import aggregates as A
from usagelens.plans import newest
from usagelens.schema import enrich
from usagelens.sources.tables import read_usage, write_usage


def _history(spark, tmp_path):
    rng = random.Random(6)
    rows = [
        {"ago": timedelta(minutes=rng.randrange(0, 90 * 1440, 30)), "session_id": f"s{rng.randrange(300)}", "turn_id": f"t{rng.randrange(900)}", "input_tokens": rng.choice((0, 0, 7))}
        for _ in range(2500)
    ]
    # Seen last without tokens, long ago with some; never with tokens; after as_of; ties.
    rows += [{"ago": timedelta(days=80), "session_id": "old", "turn_id": "told", "input_tokens": 5}, {"ago": timedelta(minutes=1), "session_id": "old", "turn_id": "told"}]
    rows += [{"ago": timedelta(minutes=2), "session_id": "never", "turn_id": "x"}, {"ago": -timedelta(days=2), "session_id": "later", "turn_id": "y", "input_tokens": 5}]
    rows += [{"ago": timedelta(hours=9), "session_id": f"tie{i}", "turn_id": f"tie{i}", "input_tokens": 1} for i in range(6)]
    u = usage(spark, rows)
    write_usage(u, str(tmp_path / "usage"))
    return u, read_usage(spark, str(tmp_path / "usage"))


def test_newest_equal_the_plain_cut(spark, tmp_path):
    plain, table = _history(spark, tmp_path)
    for limit in (1, 4, 25, 10_000):
        for op in (A.by_session, A.recent_turns):
            want = sorted(map(str, op(plain, as_of=NOW, limit=limit).collect()))
            got = op(table, as_of=NOW, limit=limit)
            assert sorted(map(str, got.select(*op(plain, as_of=NOW, limit=1).columns).collect())) == want, (op.__name__, limit)
    sessions = {r.session_id for r in A.by_session(table, as_of=NOW, limit=4).collect()}
    assert "old" in sessions and not {"never", "later"} & sessions


def test_search_leaves_old_partitions_closed(spark, tmp_path):
    _, table = _history(spark, tmp_path)
    found = newest.newest_groups(table.where(F.col("timestamp") <= NOW), "session_id", as_of=NOW, limit=10, certain=F.sum("total_tokens") > 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = NOW.date() - timedelta(days=newest.FIRST_DAYS)
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all(f">= {first}" in line for line in filters)
    assert newest.newest_groups(table, "session_id", as_of=NOW, limit=100_000) is None
    assert A.by_session(enrich(table.limit(0)), as_of=NOW).count() == 0
