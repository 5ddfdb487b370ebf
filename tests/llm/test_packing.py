import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.packing import op12_bounded_packing, pack
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(rows, docs, width):
    """rows give every document's ids once and fill sequences without holes; returns the sequences' lengths."""
    lib = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in docs:
        want[i].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) == 1:
            at, ids = 0, want[i][0]
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
                piece = np.array(ids[at : at + p.length], "<u4").tobytes()
                assert (p.ids == piece) if "ids" in p else (p.ids_crc32 == zlib.crc32(piece))
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, want[i]))
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= width
    return [sum(p.length for p in pieces) for pieces in by_seq.values()]


def test_query_packs_all(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = held(op12_bounded_packing(spark, SF).collect(), docs, 2048)
    assert sum(n < 2048 - packing.MOST_GAP for n in sizes) <= 1


def test_merging_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    docs = [(i, "word " * (i * 7 % 90)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    sizes = held(pack(df, PATH, width=64, n_open=4, most_gap=2).collect(), docs, 64)
    assert sum(n < 62 for n in sizes) <= 1


def test_cases(spark):
    rows = [(None, "no id"), (3, None), (4, ""), (7, "word " * 60_000), (9, "same row"), (9, "same row")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, sequence_id long").repartition(3)
    sizes = held(pack(df, PATH).collect(), rows, 2048)
    assert sorted(sizes)[1:] == [2048] * (len(sizes) - 1)
    assert pack(df.limit(0), PATH).count() == 0


def test_best_fit_and_bounds():
    p = packing.Packer(0, 100, 2, 5)
    piece = lambda i, n: (i, 0, n, bytes(4 * n))
    p.place(piece(1, 60))
    p.place(piece(2, 70))
    p.place(piece(3, 30))  # fills the second to the brim
    assert [(r[0], r[5], r[6], r[7]) for r in p.rows] == [(2, 0, 1, 0), (3, 0, 1, 70)] and len(p.windows) == 1
    p.place(piece(4, 96))
    p.place(piece(5, 50))  # fits nowhere: the fullest goes with a gap of 4, within bounds
    assert [r[0] for r in p.rows] == [2, 3, 4] and len(p.windows) == 2
    p.place(piece(6, 80))  # the gap of 40 is filled with its head, the rest goes where it fits best
    assert [(r[0], r[2]) for r in p.rows][3:] == [(1, 60), (6, 40)] and len(p.windows) == 1
