"""The registered queries against their SQL on the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest

from envsense.llm import pieces
from envsense.llm.common import vocabulary
from envsense.llm.queries import oracle_sql, queries
from tests.conftest import SF
from tests.llm import test_decontamination, test_line_dedup


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    listed = ", ".join(f'"{x}"' for x in columns)
    want = c.sql(f"SELECT {listed} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_queries_against_the_library(spark, texts):
    library = pieces.library(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    got = {r.doc_id: r for r in queries()["op4_token_counts"](spark, SF).collect()}
    assert got.keys() == ids.keys()
    for d, r in got.items():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[d] or "").encode()), len(ids[d]), len(ids[d]) > 512)
    start = 0
    for r in sorted(queries()["op1_token_output"](spark, SF).collect(), key=lambda r: r.doc_id):
        mine = np.array([*ids.pop(r.doc_id), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(mine), zlib.crc32(mine.tobytes()))
        start += len(mine)
    assert not ids


def test_line_query_against_all_pairs(spark, texts):
    removed = {r.doc_id: {int(k) for k in r.removed.split(",") if k} for r in queries()["op9_line_dedup"](spark, SF).collect()}
    assert removed.keys() == texts.keys()
    found = missed = 0
    for first, places in test_line_dedup.brute(list(texts.items())):
        gone = {p for p in places if p[1] in removed[p[0]]}
        assert len(gone) < len(places)  # one line of each component stays
        found, missed = found + len(gone), missed + len(places) - 1 - len(gone)
    short = sum(len(p) for p in removed.values()) - found
    assert found > 20 and missed <= 0.02 * found and short >= 0


def test_leak_query_against_all_alignments(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in queries()["op10_decontamination"](spark, SF).collect()}
    size = {d: len((t or "").split()) for d, t in texts.items()}
    some = {d for d in texts if size[d] < 100} | {d for d, _ in got if size[d] < 400}
    want = {(d, i) for d, i, *_ in test_decontamination.brute([(d, texts[d]) for d in sorted(some)], items)}
    assert {p for p in got if p[0] in some} == want and want
