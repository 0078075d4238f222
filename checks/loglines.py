"""Log lines in the shape the agents write, made by Spark from the test tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from checks import views as V

ISO = "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
FILE_A = "concat('/logs/-work-', project_label, '/', session_id, '.jsonl')"

# Every 97th line is cut off, every 89th is no object; errors are tool results (text or
# list), signups are prompts, the rest are assistant turns with usage.
AGENT_A = f"""CASE
 WHEN event_id % 97 = 0 THEN '{{"uuid": "cut'
 WHEN event_id % 89 = 0 THEN '[1, 2]'
 WHEN event_type = 'error' AND event_id % 2 = 0 THEN to_json(named_struct('uuid', uid, 'parentUuid', pid, 'sessionId', session_id, 'cwd', project_dir, 'timestamp', iso, 'type', 'user',
   'message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'is_error', true, 'content', err)))))
 WHEN event_type = 'error' THEN to_json(named_struct('uuid', uid, 'parentUuid', pid, 'sessionId', session_id, 'cwd', project_dir, 'timestamp', iso, 'type', 'user',
   'message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'is_error', event_id % 3 <> 0, 'content', array(named_struct('type', 'text', 'text', err)))))))
 WHEN event_type = 'signup' THEN to_json(named_struct('uuid', uid, 'sessionId', session_id, 'cwd', project_dir, 'timestamp', iso, 'type', 'user',
   'message', named_struct('role', 'user', 'content', concat('please do ', uid))))
 ELSE to_json(named_struct('uuid', uid, 'parentUuid', pid, 'sessionId', session_id, 'cwd', CASE WHEN event_id % 5 <> 0 THEN project_dir END, 'gitBranch', git_branch, 'timestamp', iso, 'type', 'assistant',
   'message', named_struct('id', CASE WHEN event_id % 7 <> 0 THEN message_id END, 'role', 'assistant', 'model', model,
     'content', transform(split(tools, ','), t -> named_struct('type', 'tool_use', 'name', t)),
     'usage', named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens, 'cache_creation_input_tokens', cache_creation_tokens, 'cache_read_input_tokens', cache_read_tokens)))) END"""


def agent_a(spark, sf) -> DataFrame:
    errors = V.view(spark, sf, "error_texts").select("event_id", F.col("text").alias("err"))
    base = V.view(spark, sf, "usage_all").join(errors, "event_id", "left")
    base = base.selectExpr("*", "concat('e', event_id) AS uid", "concat('e', event_id - 1) AS pid", f"{ISO} AS iso")
    return base.selectExpr(f"{AGENT_A} AS value", f"{FILE_A} AS source_file", "event_id AS line_no")


# Four lines per token event: noise, maybe a context, the event; a file starts with its meta.
AGENT_B = f"""filter(array(
 CASE WHEN line_no = 1 THEN to_json(named_struct('timestamp', iso, 'type', 'session_meta', 'payload', named_struct('id', concat('s-', file), 'cwd', concat('/repo/', file), 'git', named_struct('branch', 'main')))) END,
 to_json(named_struct('timestamp', iso, 'type', 'response_item', 'payload', named_struct('text', 'noise'))),
 CASE WHEN ctx_model IS NOT NULL OR ctx_turn_id IS NOT NULL THEN to_json(named_struct('timestamp', iso, 'type', 'turn_context', 'payload', named_struct('model', ctx_model, 'turn_id', ctx_turn_id))) END,
 to_json(named_struct('timestamp', iso, 'type', 'event_msg', 'payload', named_struct('type', 'token_count',
   'rate_limits', named_struct('primary', named_struct('used_percent', line_no % 101), 'secondary', named_struct('used_percent', line_no % 97)),
   'info', named_struct('last_token_usage', named_struct('input_tokens', input_tokens, 'cached_input_tokens', cached_tokens, 'output_tokens', output_tokens),
     'total_token_usage', named_struct('input_tokens', input_tokens + 99999))))),
 CASE WHEN line_no % 4 = 2 THEN to_json(named_struct('timestamp', iso, 'type', 'event_msg', 'payload', named_struct('type', 'user_message', 'message', concat('  ask ', line_no, ' ')))) END
 ), x -> x IS NOT NULL)"""


def agent_b(spark, sf) -> DataFrame:
    base = V.view(spark, sf, "token_count_events").selectExpr("*", f"{ISO} AS iso")
    lines = base.selectExpr("file", "line_no", f"posexplode({AGENT_B}) AS (i, value)")
    return lines.selectExpr("value", "concat('/logs/rollout-', file, '.jsonl') AS source_file", "line_no * 8 + i AS line_no")


def write_files(lines: DataFrame, root: str) -> None:
    """One file per log under `root`, as an agent writes it: its lines in order. A task writes its logs one after another through
    pyarrow's file systems; Spark's writer takes some 30 ms for each small file of a partitioned table. A retry writes the same files."""
    # Defined here, so that tasks get it by value and need not import this package.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where = urlparse(root)
        system, folder = (fs.LocalFileSystem(), unquote(where.path)) if where.scheme in ("", "file") else fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        log, out, files = None, None, 0
        for batch in batches:
            rows = zip(batch.column("log").to_pylist(), batch.column("value").to_pylist(), strict=True)
            for name, some in groupby(rows, itemgetter(0)):
                if name != log:
                    if out:
                        out.close()
                    log, out, files = name, system.open_output_stream(f"{folder}/{name}.txt"), files + 1
                out.write("".join(f"{value}\n" for _, value in some).encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    logs = lines.withColumn("log", F.expr("substring_index(substring_index(source_file, '/', -1), '.', 1)"))
    ordered = logs.repartition("log").sortWithinPartitions("log", "line_no").select("log", "value")
    ordered.mapInArrow(run, "files long").agg(F.sum("files")).collect()
