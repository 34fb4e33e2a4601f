"""Problem 6: texts above a limit into pieces below it, cut at natural boundaries, with overlap.

All in SQL functions: one regular expression of bounded quantifiers consumes the text. Its alternatives stand in the
order of boundary strength, each takes as many characters as the limit allows, the last takes any characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak: blank line, line end, sentence end, clause end, white space.
#: Each takes at most ``_WIDEST`` characters.
BOUNDARIES = (r"\n[ \t\r]{0,4}\n\s{0,8}", r"\n\s{0,8}", r"[.!?…][\"'”’»)\]]{0,4}\s{1,8}|[。！？]", r"[,;:]\s{1,8}|[、，；]", r"\s{1,8}")
_WIDEST = 16


def piece_pattern(room: int, least: int) -> str:
    """Consumes up to ``room`` code points; a boundary counts if it leaves a piece of ``least`` or more."""
    parts = [rf".{{{least},{room - _WIDEST}}}(?:{b})" for b in BOUNDARIES]
    return "(?s)" + rf".{{1,{room}}}\z|" + "|".join(parts) + rf"|.{{1,{room}}}"


def split_pieces(df: DataFrame, key: list[str], text: str, limit: int = 4096, overlap: int = 128) -> DataFrame:
    """``key..., piece_no, piece_start, overlap, piece`` for every text longer than ``limit`` code points.

    Pieces count from 1; ``piece_start`` counts code points from 0 and includes the ``overlap`` characters that repeat
    the end of the piece before: ``overlap`` of them, or fewer so that they start at a white space if one lies closer.
    Without the repeated characters the pieces join to the text exactly. Null texts and texts within the limit give no
    row. Works on whole texts; one task needs memory for a few copies of its longest text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if limit - overlap < 4 * _WIDEST:
        raise ValueError("the limit is too small")
    room = limit - overlap
    long = df.filter(F.length(text) > limit).select(*key, F.col(text).alias("t"))
    cut = long.withColumn("parts", F.regexp_extract_all("t", F.lit(piece_pattern(room, room // 4)), F.lit(0)))
    ends = F.aggregate(
        F.transform("parts", lambda p: F.length(p)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    cut = cut.withColumn("ends", ends)
    rows = cut.select(*key, "t", "ends", F.posexplode("parts").alias("i", "part"))
    start = F.expr("ends[i]")
    rows = rows.withColumn("new_start", start).withColumn(
        "tail", F.when(F.col("i") == 0, F.lit("")).otherwise(F.expr(f"substring(t, greatest(new_start - {overlap}, ends[i - 1]) + 1, least({overlap}, new_start - ends[i - 1]))"))
    )
    # drop a word that the tail would begin within, when a boundary lies closer
    before = F.expr("substring(t, new_start - length(tail), 1)")
    inside = before.rlike(r"^\w$") & F.col("tail").rlike(r"^\w") & F.col("tail").rlike(r"\s\S")
    rows = rows.withColumn("tail", F.when(inside, F.regexp_replace("tail", r"^\S+\s+", "")).otherwise(F.col("tail")))
    return rows.select(
        *key, (F.col("i") + 1).alias("piece_no"), (F.col("new_start") - F.length("tail")).alias("piece_start"),
        F.length("tail").alias("overlap"), F.concat("tail", "part").alias("piece"),
    )


def oversized(df: DataFrame, key: str, text: str, limit: int = 4096, overlap: int = 128) -> DataFrame:
    """The keys of the texts that the splitter cuts into more than one piece."""
    return split_pieces(df, [key], text, limit, overlap).filter("piece_no = 2").select(key)
