"""Problem 1: the main body of web pages, by deducing each site's template from its pages.

No wording is known beforehand. Markdown has no tag paths, so the unit of deduction is the line token: a line without
decoration, with the site's own name and digits masked and the free slots of nested lists (titles of other articles,
trails, page numbers) left out; a bar of links has one token for each item.

*Support.* Tokens met on one page only are content. *Nesting.* The template lies around the content: a line stands at the
page's edge if no content lies between it and the top or the bottom. A token is part of a template if a good share of its
occurrences stand at an edge, if it isn't always the line next to the content there, as titles are, and if the sites that
have it have it again; tokens that occur
mostly between lines of content are content too, and edges are found again without them. *Equivalence classes.* Tokens
of a site with equal occurrence vectors (the set of its pages that hold them, folded into an order-free fingerprint) are
a class; a token without enough evidence of its own follows its class, and a token that most pages of a site have at
their edges is part of its template. What remains in the slots is the body. A token with evidence counts on all sites, so
sites with few pages profit from the others.

Cost: one pass over the text, then shuffles of narrow rows (one for each recurring token of a page). Counts are combined
before they are shuffled, copies of a page are one page until the end, and no group larger than a page is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions.urls import last_two_labels
from leafloom.operators.joining import first_of_each, join_counted
from leafloom.session import cut_lineage

#: Kinds of tokens: with a free slot in it; without a letter.
SLOT, WORDLESS = 1, 2

_LEAD = re.compile(r"(?:>+\s*|\*\*|#+\s+|\[[xX]\]\s*)")
_COUNTER = re.compile(r"\s*\(\d+\)$")
_DIGITS = re.compile(r"\d+")
_LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)\)")
_LETTER = re.compile(r"[^\W\d_]")
_BAR = re.compile(r"\s+[|·]\s+")
_PAGES = re.compile(r"^[^\w]*\d+(?: \d+){2,}\b[^.]*$")
_COPY = re.compile(r"^©\s*\d{4}\b\s*(\w+)?")
_LOGO = re.compile(r"!\[logo\]\(https?://(?:[\w-]+\.)*([\w-]+)\.\w+/")
_URL_END = re.compile(r"[\s→]*https?://\S+$")


def _pictogram(ch: str) -> bool:
    o = ord(ch)
    return o > 0xFFFF or 0x2600 <= o <= 0x27BF or o in (0xFE0F, 0x200D)


def bare(line: str, site: str) -> str:
    """The line without decoration: quote and emphasis marks, heading signs, pictograms, counters, the site as speaker."""
    s = line.strip()
    while s:
        if s[0] in ">*#[" and (m := _LEAD.match(s)):
            s = s[m.end() :]
        elif _pictogram(s[0]):
            s = s[1:].lstrip()
        else:
            break
    while s:
        if _pictogram(s[-1]):
            s = s[:-1].rstrip()
        elif s[-1] == "*" and s.endswith("**"):
            s = s[:-2].rstrip()
        elif s[-1] == ")" and (m := _COUNTER.search(s, max(0, len(s) - 16))):
            s = s[: m.start()]
        elif "http" in s and "](" not in s and (m := _URL_END.search(s)):
            s = s[: m.start()]
        else:
            break
    if site and s[: len(site)].casefold() == site and s[len(site) : len(site) + 1] == ":":
        return bare(s[len(site) + 1 :], "")
    return s.strip()


def site_of(content: str, host: str | None) -> str:
    """The site's own name: the second last label of its host, else the name in the page's copyright line or logo."""
    if host:
        return host.split(".")[-2] if "." in host else host
    for line in reversed(content.split("\n")):
        m = _COPY.match(bare(line, "")) if "©" in line else None
        if m and m.group(1):
            return m.group(1).casefold()
    m = _LOGO.search(content)
    return m.group(1).casefold() if m else ""


def line_tokens(line: str, site: str) -> tuple[list[str], int]:
    """The tokens of one non-blank line and their kind."""
    s = bare(line, site).casefold()
    if site:
        s = s.replace(site, "§")
    s = _DIGITS.sub("0", s)
    first = line.lstrip()[:1]
    links = _LINK.findall(s) if "](" in s else []
    rest = _LINK.sub("", s) if links else s
    if not s:
        return ["(decoration)"], SLOT
    if first in "|`":
        return [s], 0 if _LETTER.search(s) else WORDLESS
    if len(links) > 1 and not _LETTER.search(rest):
        return [x.strip() for x, _ in links if x.strip()] or ["(links)"], 0
    if not links and (" | " in s or " · " in s):
        return [x.strip() for x in _BAR.split(s) if x.strip()] or [s], 0
    if len(links) == 1 and not _LETTER.search(rest):
        text, target = links[0]
        if "![" in s:
            return ["!" + text], SLOT
        if len(text.split()) <= 3:
            return [text], 0
        # a list that leads to other pages of the site, or one of the page's own results
        return (["[…](http…)"], 0) if target.startswith("http") else (["[…](/…)"], SLOT)
    if " > " in s:
        return [s.split(" > ")[0] + " > …"], SLOT
    if _PAGES.match(bare(line, site)):
        return ["0 0 0 …"], SLOT
    if s.endswith("»"):
        return ["… »"], SLOT
    if "→" in s and (tail := s.rsplit("→", 1)[1].strip()) and "](" not in tail:
        return ["… → " + tail], SLOT
    if s.startswith("§ ") and len(s.split()) > 4:
        return [" ".join(s.split()[:2]) + " …"], SLOT
    return [s.rstrip(": ")], 0 if _LETTER.search(s) else WORDLESS


_OTHERS = frozenset(["[…](/…)", "… »"])


def page_tokens(content: str, site: str) -> list[tuple[int, int, int, str, int, bool]]:
    """(place among the non-blank lines, line number from 1, tokens in the line, token, kind, first time on the page)."""
    said = [(no, line) for no, line in enumerate(content.split("\n"), 1) if line.strip()]
    found = [line_tokens(line, site) for _, line in said]
    out, met = [], set()
    for at, ((no, _), (tokens, kind)) in enumerate(zip(said, found)):
        if len(tokens) == 1 and not kind and at + 1 < len(found) and found[at + 1][0][0] in _OTHERS:
            tokens, kind = [tokens[0] + " ↴"], SLOT  # the heading of a nested list
        for t in tokens:
            out.append((at, no, len(tokens), t, kind, t not in met))
            met.add(t)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_ITEM = [("at", pa.int32()), ("line_no", pa.int32()), ("k", pa.int32()), ("token", pa.int64()), ("kind", pa.int32()), ("first", pa.int32())]
_ITEMS = "array<struct<at:int,line_no:int,k:int,token:bigint,kind:int,first:int>>"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sites, pages, sizes, starts = [], [], [], [0]
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for host, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            site = site_of(content, host)
            sites.append(_hash(site) if site else 0)
            pages.append(_hash(site + "\n" + content))
            for at, no, k, token, kind, new in page_tokens(content, site):
                for c, x in zip(cols, (at, no, k, _hash(token), kind, int(new))):
                    c.append(x)
            starts.append(len(cols[0]))
            sizes.append(cols[0][-1] + 1 if len(cols[0]) > starts[-2] else 0)
        items = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _ITEM)], names=[n for n, _ in _ITEM])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sites, pa.int64()), pa.array(pages, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items)],
            names=["id", "site", "page", "lines", "items"],
        )


def _with_edges(rows: DataFrame, content: Column) -> DataFrame:
    """Of each recurring token of a page whether it stands at an edge and whether next to the content.

    ``content`` says whether a token is known as content. Rows are spread by page once; both groupings keep to that.
    """
    item = F.struct("at", "line_no", "k", "token", "kind", "first", content.alias("content"))
    rows = rows.select("page", "site", "lines", "at", "k", item.alias("i"), (content | (F.col("kind") == WORDLESS)).alias("solid")).repartition("page")
    lines = rows.groupBy("page", "site", "lines", "at", "k").agg(F.count_if(~F.col("solid")).alias("loose"), F.collect_list("i").alias("of_line"))
    open_ = F.when(F.col("k") > 2, F.col("loose") * 2 >= F.col("k")).otherwise(F.col("loose") >= F.col("k"))
    whole = lines.groupBy("page", "site", "lines").agg(F.collect_list(F.when(open_, F.col("at"))).alias("open"), F.flatten(F.collect_list("of_line")).alias("items"))
    between = F.array_except(F.sequence(F.lit(0), F.col("lines") - 1), "open")
    top, bottom = F.coalesce(F.array_min(between), F.col("lines")), F.coalesce(F.array_max(between), F.lit(-1))
    at = F.col("i.at")
    return whole.select("page", "site", top.alias("top"), bottom.alias("bottom"), "lines", F.explode("items").alias("i")).select(
        "page", "site", "lines", "i.*", ((at < F.col("top")) | (at > F.col("bottom"))).alias("edge"),
        ((at == F.col("top") - 1) | (at == F.col("bottom") + 1)).alias("next_to"),
    )


def template_lines(
    pages: DataFrame, at_edge: float = 0.3, away: float = 0.03, least_away: int = 2, repeated: float = 0.01, share: float = 0.5, least_pages: int = 3,
) -> DataFrame:
    """``id, line_no``: the non-blank lines of ``content`` that belong to the template of their site.

    ``pages`` needs ``id, source, content``; other columns are ignored. Ids delivered twice count once; null ids and null
    contents give no row. Pages without host are placed by the name in their own copyright line or logo.

    A token met on two or more pages is part of templates if ``at_edge`` of its occurrences stand at an edge and
    ``away`` of these, ``least_away`` or more, not next to the content (slots of nested lists needn't). If it is fewer than
    half of these, ``repeated`` of the other pages of its sites must have it again, as titles met by chance don't. On its site alone
    a token is if it stands at edges on ``share`` of the site's pages, ``least_pages`` or more, or if half or more of its
    class, two tokens at least, are.
    """
    read = cut_lineage(
        pages.select("id", last_two_labels(F.col("source")).alias("host"), "content").filter("id is not null and content is not null")
        .mapInArrow(_emit, f"id string, site bigint, page bigint, lines int, items {_ITEMS}")
    )
    once = read.dropDuplicates(["page"]).select("page", "site", "lines", F.explode("items").alias("i")).select("page", "site", "lines", "i.*")
    recurring = once.groupBy("token").agg(F.sum("first").alias("pages")).filter("pages > 1").select("token")
    known = cut_lineage(_with_edges(join_counted(once, recurring, ["token"]), F.lit(False)))
    inner = known.groupBy("token").agg((F.count_if("edge") < F.count("*") * at_edge).alias("content"))
    known = cut_lineage(_with_edges(join_counted(known.drop("content", "edge", "next_to"), inner, ["token"]), F.col("content")))

    sizes = read.select("page", "site").distinct().groupBy("site").agg(F.count("*").alias("of"))
    vectors = known.groupBy("site", "token").agg(
        F.bit_xor(F.when(F.col("first") == 1, F.col("page"))).alias("vector"), F.sum("first").alias("n"),
        F.sum(F.when(F.col("edge"), F.col("first")).otherwise(0)).alias("n_edge"), F.count("*").alias("occurs"), F.count_if("edge").alias("edges"),
        F.count_if(F.col("edge") & ~F.col("next_to")).alias("away"), F.min("kind").alias("kind"), F.bool_or("content").alias("inner"),
    ).join(sizes, "site")
    vectors = cut_lineage(vectors)
    named = F.col("site") != 0
    again = F.try_divide(F.sum(F.when(named, F.col("n") - 1)), F.sum(F.when(named, F.col("of") - 1)))
    evidence = vectors.groupBy("token").agg(
        (F.sum("edges") >= F.sum("occurs") * at_edge).alias("outer"), F.bool_or("inner").alias("inner_"), F.sum("away").alias("far"), F.sum("edges").alias("all_edges"),
        F.min("kind").alias("kind_"), F.coalesce(again, F.lit(0.0)).alias("again"),
    )
    enough = (F.col("far") >= F.greatest(F.lit(least_away), F.col("all_edges") * away)) & ((F.col("far") * 2 >= F.col("all_edges")) | (F.col("again") >= repeated))
    evidence = evidence.select(
        "token", "outer", (F.col("outer") & ~F.col("inner_") & (F.col("kind_") != WORDLESS) & ((F.col("kind_") == SLOT) | enough)).alias("template")
    )
    own = named & (F.col("n_edge") >= least_pages) & (F.col("n_edge") >= F.col("of") * share) & (F.col("kind") != WORDLESS)
    vectors = vectors.join(evidence, "token").withColumn("sure", F.col("template") | own)
    classes = vectors.groupBy("site", "vector", "n").agg(F.count("*").alias("size"), F.count_if("sure").alias("known"))
    follows = named & (F.col("n") >= least_pages) & F.col("outer") & (F.col("known") >= 2) & (F.col("known") * 2 >= F.col("size"))
    template = vectors.join(classes, ["site", "vector", "n"]).filter(F.col("sure") | follows).select("site", "token")

    hits = join_counted(known.select("page", "site", "token", "line_no", "k"), template, ["site", "token"]).groupBy("page", "line_no", "k").agg(F.count("*").alias("hits"))
    lines = hits.filter(F.when(F.col("k") > 2, F.col("hits") * 2 >= F.col("k")).otherwise(F.col("hits") >= F.col("k"))).select("page", "line_no")
    ids = read.select("id", "page").dropDuplicates(["id"])
    return ids.join(lines, "page").select("id", "line_no")


def main_body(pages: DataFrame, place: list[str] | None = None) -> DataFrame:
    """``id, body``: each page's content without its template lines; pages with null content keep null.

    An id counts once. With ``place``, columns that tell the rows of ``pages`` apart, no text is moved as long as repeated
    ids and the pages with template lines are few enough to be broadcast; else the texts are shuffled by id.
    """
    wide = pages.select("id", "content", *(place or [])).filter("id is not null")
    once = first_of_each(wide, "id", place) if place else wide.dropDuplicates(["id"])
    drop = template_lines(pages).groupBy("id").agg(F.collect_set("line_no").alias("out"))
    kept = F.expr("array_join(transform(filter(transform(split(content, '\n'), (x, i) -> struct(x as l, i + 1 as n)), s -> out is null or not array_contains(out, s.n)), s -> s.l), '\n')")
    return join_counted(once, drop, ["id"], "left").select("id", kept.alias("body"))
