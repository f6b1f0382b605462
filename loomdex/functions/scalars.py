"""Small scalar functions: labels, formats, name comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blast_radius(callers: Column) -> Column:
    return F.when(callers <= 4, "low").when(callers <= 20, "medium").otherwise("high")


def relative_time(now: Column, then: Column) -> Column:
    """An age as text, in the largest whole unit; the future counts as 0s."""
    age = F.greatest(now - then, F.lit(0))
    text = lambda n, unit: F.concat(F.floor(age / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(age < 60, text(1, "s")).when(age < 3600, text(60, "m")).when(age < 86400, text(3600, "h")).otherwise(text(86400, "d"))


def local_time(then: Column) -> Column:
    """Seconds since the epoch as date and time in the session's time zone."""
    return F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd HH:mm:ss")


def human_bytes(size: Column) -> Column:
    """A byte count in binary units with one decimal, ties to the even one as in C (whole bytes below 1 KiB)."""
    scaled = lambda power: F.format_string(f"%.1f {'KMG'[power - 1]}iB", F.bround(size / F.lit(float(1 << 10 * power)), 1))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, scaled(1)).when(size < 1 << 30, scaled(2)).otherwise(scaled(3))


def short_name(fqn: Column) -> Column:
    return F.substring_index(fqn, "::", -1)


def file_of(fqn: Column) -> Column:
    return F.substring_index(fqn, "::", 1)


def visibility(exported: Column) -> Column:
    return F.when(exported, "exported").otherwise("private")


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def is_rename(old: Column, new: Column, most: int = 3) -> Column:
    """Names of nearly the same length (a fifth, rounded up) at a distance of at most ``most`` edits."""
    a, b = F.octet_length(old), F.octet_length(new)
    longest = F.greatest(a, b)
    return (longest > 0) & (F.abs(a - b) <= F.ceil(longest * 0.2)) & (F.levenshtein(old, new, most) >= 0)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest start of a text of at most ``most`` UTF-8 bytes that ends between characters."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    # drop a character that the cut left incomplete
    whole = F.regexp_replace(F.hex(raw), "(?:(?:C[2-9A-F]|D[0-9A-F])|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def query_of(content: Column) -> Column:
    """The query noted in an automatic observation; null if there is none."""
    found = F.trim(F.regexp_extract(content, "(?s)Query: (.*?)(?:\\. |$)", 1))
    return F.when(F.contains(content, F.lit("Query: ")) & (found != ""), found)


def capture_headline(tool: Column, intent: Column, query: Column, result: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in (("get_skeleton", "Skeleton"), ("get_impact_graph", "Impact"), ("search_logic_flow", "Logic flow"), ("get_session_context", "Session context")) for x in pair])
    return (
        F.when(tool == "run_pipeline", F.concat(F.lit("Pipeline: "), F.coalesce(intent, F.lit("explore")), F.lit(" -> "), result))
        .when(tool == "get_context_capsule", F.concat(F.lit("Capsule: '"), truncate_bytes(F.coalesce(query, F.lit("")), 30), F.lit("' -> "), result))
        .otherwise(F.concat(F.coalesce(named[tool], tool), F.lit(": "), result))
    )


def capture_content(tool: Column, intent: Column, query: Column, result: Column, pivots: Column) -> Column:
    """The searchable text of an automatic observation; fields that are null are left out."""
    few = F.transform(F.slice(pivots, 1, 5), lambda f: truncate_bytes(f, 120))
    return F.concat_ws(
        ". ",
        F.concat(F.lit("Tool: "), tool),
        F.concat(F.lit("Intent: "), intent),
        F.concat(F.lit("Query: "), truncate_bytes(query, 200)),
        F.concat(F.lit("Result: "), result),
        F.when(F.size(pivots) > 0, F.concat(F.lit("Pivots: "), F.array_join(few, ", "))),
    )


#: Tools whose calls are not captured.
UNCAPTURED = ("index_status", "reindex", "save_observation", "search_memory")
