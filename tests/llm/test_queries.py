"""The pN_ queries over the smallest tables, where these are at hand: against SQL if there is any, else that they run."""

import glob
import os

import pytest

from leafloom.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, FOLDER)
    got = sorted(tuple(r) for r in df.collect()) if name in Q.SQL else df.count()
    if name in Q.SQL:
        import duckdb

        c = duckdb.connect()
        for f in glob.glob(f"{FOLDER}/*.parquet"):
            c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = c.sql(Q.SQL[name])
        assert got == sorted(want.select(*[f'"{x}"' for x in df.columns]).fetchall())


def _read(name, *columns, folder=FOLDER):
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pylist()


def test_pieces_join_to_the_texts(spark):
    texts = {("raw_rows", r["id"]): r["content"] for r in _read("raw_rows", "id", "content") if r["id"] and r["content"] and len(r["content"]) > 4096}
    texts |= {("finetune", str(r["ft_id"])): r["content"] for r in _read("finetune", "ft_id", "content") if r["content"] and len(r["content"]) > 4096}
    pieces: dict = {}
    for r in sorted(Q.QUERIES["p6_pieces"](spark, FOLDER).collect(), key=lambda r: (r.origin, r.item_key, r.piece_no)):
        assert 0 < len(r.piece) <= 4096 and 0 <= r.overlap <= 128
        pieces.setdefault((r.origin, r.item_key), []).append(r)
    assert pieces.keys() == texts.keys()
    for k, ps in pieces.items():
        assert "".join(p.piece[p.overlap :] for p in ps) == texts[k] and [p.piece_no for p in ps] == list(range(1, len(ps) + 1))
        assert all(texts[k][p.piece_start : p.piece_start + len(p.piece)] == p.piece for p in ps)


def test_containers_hold_each_document_once(spark):
    texts = {r["doc_id"]: r["text"] for r in _read("documents", "doc_id", "text") if r["text"] is not None}
    parts: dict = {}
    load: dict = {}
    for r in Q.QUERIES["p8_containers"](spark, FOLDER).collect():
        parts.setdefault(r.doc_id, []).append(r)
        load.setdefault(r.container_no, []).append(r)
    assert parts.keys() == texts.keys()
    for k, ps in parts.items():
        ps.sort(key=lambda p: p.piece_no)
        assert "".join(texts[k][p.piece_start : p.piece_start + p.piece_chars] for p in ps) == texts[k]
        assert len(ps) == 1 or len(texts[k].encode()) + 1 > 8192
    for ps in load.values():
        assert sum(p.tokens for p in ps) <= 8192 and sorted(p.position for p in ps) == list(range(1, len(ps) + 1))


def test_null_and_blank_answers_are_empty(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables hold no such pair
    want = {r["id"] for r in _read("raw_rows", "id", "prompt", "response", folder=folder) if r["id"] and (r["prompt"] or "").strip() and (r["response"] or "").strip().casefold() in ("", "null", "n/a", "na", "[]", "{}", '""')}
    found = {r.id: r.defect for r in Q.QUERIES["p2_found"](spark, folder).collect()}
    assert want and all(found.get(i) == "empty" for i in want)


def test_redaction_keeps_what_is_no_item(spark):
    from leafloom.llm.pii import FIELDS

    rows = {r["id"]: r for r in _read("raw_rows", "id", *FIELDS) if r["id"]}
    items: dict = {}
    for r in Q.QUERIES["p4_found"](spark, FOLDER).collect():
        items.setdefault((r.id, r.field), []).append((r.span_start, r.span_end, r.label))
    for r in Q.QUERIES["p4_redacted"](spark, FOLDER).collect():
        for f in FIELDS:
            text = rows[r.id][f]
            for a, z, label in sorted(items.get((r.id, f), []), reverse=True):
                text = text[:a] + f"[{label.upper()}]" + text[z:]
            assert r[f] == text
