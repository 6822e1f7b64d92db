"""The registered queries of this subpackage: against their SQL, and what their plans must not hold."""

from __future__ import annotations

import os
import re

import pytest

from bomdrift.llm.queries import ORACLE, QUERIES, table
from checks.compare import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_on_a_sound_plan(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan, operator
    for window in re.findall(r"\+- Window .*", plan):  # a window needs a partition key
        assert re.search(r"\], \[[^\]]+\], \[", window), window
    if name in ORACLE:
        assert compare(spark, con, lambda *_: frame, ORACLE[name], SF_DIR) is None
    else:
        assert frame.count() > 0


def test_token_files_number_documents_in_order(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from bomdrift.llm import queries

    docs = table(spark, SF_DIR, "documents")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op4_token_output(spark, SF_DIR).collect()}
    encoder, start = Tokenizer.from_file(queries.TOKENIZER), 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == docs.count()
