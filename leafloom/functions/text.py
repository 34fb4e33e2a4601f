"""Column expressions over texts: length caps, chunks, bins, messages, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Caps in code points, chunk geometry in tokens and the characters that stand for one.
CAPS = {"content": 50_000, "schema": 10_000, "response": 10_000}
CHUNK_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 4096, 128, 3.5
SCORE_EDGES = (0, 50, 100, 200, 500, 1000)
MISSING_WORDS = ("", "na", "n/a", "none", "null", "unknown", "-")
MISSING_STARTS = (
    "not specified", "not provided", "not disclosed", "not available", "not mentioned", "not applicable",
    "not found", "not given", "not listed", "no information",
)


def within_cap(col: Column, cap: int) -> Column:
    """not null and at most ``cap`` code points."""
    return F.coalesce(F.char_length(col) <= cap, F.lit(False))


def first_reason(caps: dict[str, int] = CAPS) -> Column:
    """The first column, in order, that is null or above its cap; ``kept`` if none is."""
    out = F.lit("kept")
    for name, cap in reversed(list(caps.items())):
        out = F.when(within_cap(F.col(name), cap), out).otherwise(F.lit(name))
    return out


def chunk_geometry(tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, ratio: float = CHARS_PER_TOKEN) -> tuple[int, int]:
    """Chunk size and overlap in characters, rounded towards zero."""
    return int(tokens * ratio), int(overlap * ratio)


def chunks(df: DataFrame, text: str, size: int, overlap: int, keep_short: bool = False) -> DataFrame:
    """One row per chunk with ``chunk_no`` and ``chunk_start`` from 0 and ``chunk``; other columns stay.

    Starts are 0, step, 2 step, ... below the length, step = size - overlap. Null and empty texts give no row. With
    ``keep_short`` (X4) a text of at most ``size`` is one chunk at 0, an empty one included.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    n = F.char_length(text)
    last = F.floor((n - 1) / step).cast("int")
    if keep_short:
        last = F.when(n <= size, F.lit(0)).otherwise(last)
        df = df.filter(F.col(text).isNotNull())
    else:
        df = df.filter(n > 0)
    out = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("chunk_no") * step).cast("int")
    return out.withColumn("chunk_start", start).withColumn("chunk", F.substring(F.col(text), start + 1, F.lit(size)))


def estimated_tokens(chars: Column, ratio: float = CHARS_PER_TOKEN) -> Column:
    """tokens of a text of so many characters where no tokenizer is at hand."""
    return F.ceil(chars / F.lit(ratio))


# The wording of the prompt, and in ``normalized_error`` the patterns of the messages.
def extraction_prompt(schema: Column, content: Column) -> Column:
    """the prompt for one page and schema; null if either is."""
    return F.concat(
        F.lit("Extract data from the content according to the JSON schema.\nSchema: "), schema, F.lit("\nContent: "), content,
        F.lit("\nReturn ONLY valid JSON matching the schema."),
    )


def long_page(content: Column, size: int = chunk_geometry()[0]) -> Column:
    """Whether the page is longer than one chunk; null content is not."""
    return F.coalesce(F.char_length(content) > size, F.lit(False))


def chat_messages(prompt: Column, answer: Column) -> Column:
    """the two turns of a training example."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", prompt), turn("assistant", answer))


def score_bucket(score: Column, edges: tuple[int, ...] = SCORE_EDGES) -> Column:
    """Left-closed bins; null is ``unknown``, below the first edge falls through to the last."""
    out = F.when(score.isNull(), "unknown")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when((score >= lo) & (score < hi), f"{lo}-{hi}")
    return out.otherwise(f"{edges[-1]}+")


def right_closed_bin(value: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """Right-closed bins; values outside (the first edge included) and nulls have none."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label for each bin")
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (value > lo) & (value <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """A5: 1-based bin between ``lo`` and ``hi``; the last is closed. All equal values lie in bin 1."""
    return F.when(value.isNull(), None).when(hi <= lo, F.lit(1)).otherwise(F.least(F.floor((value - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(bins)))


def is_missing_text(value: Column) -> Column:
    """N7 on texts: null, a word for nothing, or a phrase that says so."""
    s = F.lower(F.trim(value))
    starts = F.lit(False)
    for p in MISSING_STARTS:
        starts = starts | s.startswith(p)
    return value.isNull() | s.isin(*MISSING_WORDS) | starts


def is_rate_limit(error: Column) -> Column:
    """F12"""
    e = F.lower(error)
    return F.coalesce(e.contains("rate limit") | e.contains("try again later"), F.lit(False))


def normalized_error(error: Column) -> Column:
    """An error message without what differs from request to request, at most 220 characters."""
    s = F.regexp_replace(F.coalesce(error, F.lit("")), "^schema_rejected: ", "")
    s = F.replace(F.replace(F.replace(s, F.lit("\\\\"), F.lit("\\")), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    cause = F.coalesce(
        F.nullif(F.regexp_extract(s, r'output_format\.schema: ([^"]+)', 1), F.lit("")),
        F.nullif(F.regexp_extract(s, r'"invalid_request_error","message":"([^"]+)"', 1), F.lit("")),
    )
    rest = F.regexp_replace(F.regexp_replace(s, r"(?i)req(?:uest)?[_ ]?id[\"':=\s]+\S+", ""), r"['\"][^'\"]{40,}['\"]", "'<snip>'")
    out = F.regexp_replace(F.coalesce(cause, rest), r"[0-9]{4,}", "<n>")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, 220)


def clipped(value: Column, most: int, mark: str = "") -> Column:
    """The text cut to ``most`` characters, with ``mark`` after a cut."""
    return F.when(F.char_length(value) > most, F.concat(F.substring(value, 1, most), F.lit(mark))).otherwise(value)


def file_name(value: Column) -> Column:
    """N27"""
    return F.regexp_replace(value, r"[^A-Za-z0-9._-]", "_")


def request_options(mode: str, schema: Column) -> Column:
    """The structured-output options of a request as JSON; an empty object for mode ``none``."""
    if mode == "json_schema":
        return F.concat(F.lit('{"type":"json_schema","json_schema":{"name":"extraction","schema":'), schema, F.lit(',"strict":false}}'))
    if mode == "json_object":
        return F.lit('{"type":"json_object"}')
    if mode == "none":
        return F.lit("{}")
    raise ValueError(f"unknown mode {mode}")
