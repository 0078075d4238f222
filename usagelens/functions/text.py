"""String, path and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from usagelens.functions.exact import _col

EPOCH = "1970-01-01 00:00:00"


def or_unknown(c, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def parse_ts(raw) -> Column:
    """ISO-8601 text to TIMESTAMP_NTZ in UTC; missing or malformed text gives the epoch.

    Needs the session time zone to be UTC (naive text is read as UTC).
    """
    raw = _col(raw)
    shaped = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), raw)
    return F.coalesce(F.try_to_timestamp(shaped).cast("timestamp_ntz"), F.lit(EPOCH).cast("timestamp_ntz"))


def whole_number(c: Column) -> Column:
    """A count given as a number or as text, as BIGINT; 0 for anything else."""
    whole = F.coalesce(c.try_cast("bigint"), F.floor(c.try_cast("double")).cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ holding UTC."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(_col(us).cast("bigint")).cast("timestamp_ntz")


def decode_project_dir(encoded) -> Column:
    """Directory name with separators written as dashes, back to a path (lossy)."""
    return F.regexp_replace(F.coalesce(_col(encoded), F.lit("")), "-", "/")


def last_segment(path) -> Column:
    return F.element_at(F.split(F.regexp_replace(_col(path), "/+$", ""), "/"), -1)


def project_label(cwd) -> Column:
    return F.coalesce(F.nullif(last_segment(cwd), F.lit("")), F.nullif(_col(cwd), F.lit("")), F.lit("unknown"))


def _title(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def model_display(model) -> Column:
    """Short display name of a model id."""
    raw = F.coalesce(_col(model), F.lit(""))
    m = F.lower(raw)
    two, one = r"(opus|sonnet|haiku)-(\d+)-(\d+)", r"(opus|sonnet|haiku)-(\d+)"
    flag = r"(fable|mythos)-?(\d+)"
    gpt = r"gpt-?(\d+(?:\.\d+)?)(?:-?(codex|mini))?"

    def g(pattern, i):
        return F.regexp_extract(m, pattern, i)

    suffix = F.when(g(gpt, 2) == "codex", " Codex").when(g(gpt, 2) == "mini", " mini").otherwise("")
    return (
        F.when(raw == "", "—")
        .when(F.startswith(raw, F.lit("<")), F.translate(raw, "<>", ""))
        .when(m.rlike(two), F.concat(_title(g(two, 1)), F.lit(" "), g(two, 2), F.lit("."), g(two, 3)))
        .when(m.rlike(one), F.concat(_title(g(one, 1)), F.lit(" "), g(one, 2)))
        .when(m.rlike(flag), F.concat(_title(g(flag, 1)), F.lit(" "), g(flag, 2)))
        .when(m.rlike(gpt), F.concat(F.lit("GPT-"), g(gpt, 1), suffix))
        .otherwise(raw)
    )


def active_model_name(model) -> Column:
    """Status-line name: versioned families get a display name, placeholders a dash."""
    raw = F.coalesce(_col(model), F.lit(""))
    two = r"(opus|sonnet|haiku)-(\d+)-(\d+)"
    return (
        F.when((raw == "") | F.startswith(raw, F.lit("<")), "—")
        .when(F.lower(raw).rlike(two), model_display(raw))
        .otherwise(raw)
    )


def path_parts(directory, label) -> Column:
    """Struct of name, the last two parent segments, and the full path."""
    raw = F.trim(F.coalesce(_col(directory), F.lit("")))
    segs = F.filter(F.split(F.translate(raw, "\\", "/"), "/"), lambda s: s != "")
    # The name of a path keeps only trailing separators out, so "a//" still names "a".
    name = F.coalesce(
        F.nullif(_col(label), F.lit("")), F.try_element_at(segs, F.lit(-1)), F.lit("unknown")
    )
    parents = F.when(F.try_element_at(segs, F.lit(-1)) == name, F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))).otherwise(segs)
    n = F.size(parents)
    tail = F.array_join(F.slice(parents, F.greatest(n - 1, F.lit(1)), F.lit(2)), "/")
    sub = F.when(n > 2, F.concat(F.lit("…/"), tail)).when(n > 0, tail).otherwise("")
    return F.struct(
        name.alias("name"),
        F.when(raw == "", "").otherwise(sub).alias("sub"),
        raw.alias("full"),
    )


def tool_label(tool) -> Column:
    return F.substring(F.replace(F.regexp_replace(_col(tool), "^mcp__", ""), F.lit("__"), F.lit(":")), 1, 28)


def is_mcp_tool(tool) -> Column:
    return _col(tool).rlike("^mcp__|Chrome|chrome")


# Error categories and the texts that select them, tested in this order.
ERROR_RULES = (
    ("file_not_found", ("no such file", "file not found", "no file at")),
    ("permission_denied", ("permission denied",)),
    ("command_not_found", ("command not found",)),
    ("timeout", ("timeout", "timed out")),
    ("python_error", ("syntaxerror", "traceback")),
    ("bash_failure", ("exit code", "exit status")),
    ("stale_reference", ("no longer exists", "not found in")),
    ("output_too_large", ("exceeds maximum", "too large")),
    ("rate_limited", ("rate limit", "rate_limit")),
)


def classify_error(text) -> Column:
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    out = F
    for category, needles in ERROR_RULES:
        cond = F.lit(False)
        for n in needles:
            cond = cond | F.contains(t, F.lit(n))
        out = out.when(cond, category)
    return out.otherwise("other_error")


def error_snippet(text) -> Column:
    return F.translate(F.substring(F.coalesce(_col(text), F.lit("")), 1, 160), "\n", " ")


def intent_text(text) -> Column:
    """Trimmed user text, NULL for blanks, slash commands and markup wrappers."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"^\s+|\s+$", "")
    skip = (t == "") | F.startswith(t, F.lit("/")) | (F.startswith(t, F.lit("<")) & F.contains(t, F.lit("</")))
    return F.when(~skip, F.substring(t, 1, 240))
