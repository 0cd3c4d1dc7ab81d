"""Scalar functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9][a-z0-9-]*$"
#: What a tool's name says about the kind of its source, kinds, and labels' limits.
TOOL_KINDS = {
    "files": ["Read", "Write", "Edit", "MultiEdit", "NotebookEdit", "NotebookRead"],
    "commands": ["Bash", "PowerShell", "BashOutput", "Monitor", "KillShell"],
    "web": ["WebFetch", "WebSearch"],
    "searches": ["Grep", "Glob", "LS", "ToolSearch"],
    "skills": ["Skill"],
}
SOURCE_KEYS = ["file_path", "notebook_path", "command", "url", "pattern", "query", "path", "description"]
KINDS = ["files", "prompts", "web", "commands", "searches", "skills", "context", "tools"]
LABEL, SHOWN_NAMES, JSON_LIMIT = 100, 12, 2_000_000


def is_slug(c: Column) -> Column:
    return c.rlike(SLUG)


def source_label(c: Column) -> Column:
    """White space flattened; more than 100 characters are cut and end in an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.char_length(flat) <= LABEL, flat).otherwise(F.concat(F.substring(flat, 1, LABEL - 3), F.lit("...")))


def path_key(c: Column) -> Column:
    return F.lower(F.translate(c, "\\", "/"))


def kind_of_tool(c: Column) -> Column:
    out = F
    for kind, names in TOOL_KINDS.items():
        out = out.when(c.isin(*names), kind)
    return out.otherwise("tools")


def tool_source(tool: Column, payload: Column) -> Column:
    """The tool and the first non-blank of the inputs that say what it was about."""
    found = F.coalesce(*[F.when(F.trim(F.get_json_object(payload, f"$.{k}")) != "", F.get_json_object(payload, f"$.{k}")) for k in SOURCE_KEYS])
    return F.concat_ws(" ", tool, found)


def plural(n: Column, noun: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def first_sentence(c: Column) -> Column:
    hit = F.regexp_extract(c, r"(?s)^.*?[.?!](?=\s|$)", 0)
    return F.when(hit == "", c).otherwise(hit)


def cell(c: Column) -> Column:
    """A text inside a markdown table's cell."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def version_of(d: Column) -> Column:
    return F.date_format(d, "yyyy.MM.dd")


def cache_key(*parts: Column) -> Column:
    """Content address of a request: the first 40 hex digits of the SHA-256 of its parts as a JSON array."""
    joined = parts[0] if len(parts) == 1 else F.to_json(F.array(*parts))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 40)


def is_encoded(c: Column) -> Column:
    """Image or file bytes as text."""
    return (c.startswith("data:") & F.contains(F.substring(c, 1, 100), F.lit(";base64,"))) | ((F.char_length(c) >= 256) & c.rlike("^[A-Za-z0-9+/=_-]+$"))


def looks_like_json(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return F.char_length(t).between(2, JSON_LIMIT) & ends.isin("{}", "[]")


def niceness(c: Column) -> Column:
    """Accented letters first, then capitals."""
    return F.struct(F.regexp_count(c, F.lit(r"[\p{L}&&[^\x00-\x7F]]")).alias("accents"), F.regexp_count(c, F.lit(r"\p{Lu}")).alias("capitals"))


def near_name(name: Column, other: Column) -> Column:
    """Distance for suggestions: 0 where either begins with the other, else the edit distance; null beyond the limit."""
    limit = F.greatest(F.lit(2), F.floor(F.char_length(name) / 3))
    d = F.when(name.startswith(other) | other.startswith(name), 0).otherwise(F.levenshtein(name, other))
    return F.when(d <= limit, d)
