"""Packing of many rows that share a doc_id, or none, or are the same row: each row is packed once, in time linear in the rows."""

import collections
import time
import zlib

import numpy as np
import pytest

from dealspark.llm import packing


def packed(spark, rows):
    began = time.time()
    pieces = packing.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return pieces, time.time() - began


@pytest.mark.parametrize("kind", ["null", "one", "same"])
def test_rows_of_one_id(spark, kind):
    n = 5000
    text = (lambda i: "a text that many rows are copies of") if kind == "same" else (lambda i: f"row {i} has {i % 97} words " * (i % 5 + 1))
    rows = [(None if kind == "null" else 7, text(i)) for i in range(n)] + [(None, None), (None, "")]
    _, distinct = packed(spark, [(i, text(i)) for i in range(n)])
    pieces, took = packed(spark, rows)
    assert took < 2.5 * distinct + 10
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [packing.encode(t, path) for _, t in rows]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    # the pieces are those of the rows: every id of every row once
    want, got = collections.Counter(), collections.Counter()
    for (d, _), x in zip(rows, ids):
        want[d, len(x), zlib.crc32(x.tobytes())] += 1
    whole = {(d, len(x), zlib.crc32(x.tobytes())): x for (d, _), x in zip(rows, ids)}
    parts = collections.Counter((p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32) for p in pieces)
    for (d, size, start, length, crc), times in parts.items():
        if (start, length) == (0, size):
            got[d, size, crc] += times
        else:  # one at a window's border
            fits = [k for k, x in whole.items() if k[:2] == (d, size) and zlib.crc32(x[start : start + length].tobytes()) == crc]
            assert fits
    cut = sum((want - got).values())
    assert not got - want and cut <= len({p.sequence_id for p in pieces})
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == np.concatenate([[0], np.cumsum([x for _, x in spans])[:-1]]).tolist() and sum(x for _, x in spans) <= 1024
