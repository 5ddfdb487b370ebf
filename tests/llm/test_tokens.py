import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_fst, token_ids
from quarry.llm.token_fst import count_tokens, op8_token_counts, token_counts
from quarry.llm.token_ids import Encoder, encoder, op2_wavelet_tokens, read_rows, write_files
from quarry.llm.wavelet import WaveletMatrix
from tests.conftest import SF

PIECES = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\r", "1", "23", "!", "?", "the", "ing", "é", "é", "ß", "İ", "Σ", "日", "🙂", "\xa0", "\x1c", "\x85", "A", "Z", "m", "d", "v", "e", "<|endoftext|>", "<|startoftext|>"]


def odd(n=1500):
    rnd = random.Random(1)
    return ["", " ", "\n\n", "x" * 3000 + " y", "aaa" * 700, *("".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(n))]


@pytest.mark.parametrize("chunk", [7, 512])
def test_counts_match_the_library(chunk, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_fst.Transducer.changes, "__defaults__", (chunk,))
    texts = odd()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert count_tokens(texts, path) == want


def test_states_can_be_dropped(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_fst, "MOST_STATES", 50)
    lib = Tokenizer.from_file(path)
    for t in odd(40):
        assert count_tokens([t], path) == [len(lib.encode(t, add_special_tokens=False).ids)]


def test_encoder_matches_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = encoder(path)
    texts = odd()
    assert enc.by_word
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert not encoder(public_tokenizers.path("byte_bpe_50k.json")).by_word


@pytest.mark.parametrize("n", [1, 256, 257])
def test_few_new_words(n):
    """A block whose new words leave one over."""
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(n))
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n, planes in ((0, 3), (1, 1), (63, 4), (64, 4), (65, 9), (1000, 16), (3000, 17)):
        x = rng.integers(0, min(1 << planes, 200), n)
        w = WaveletMatrix.read(WaveletMatrix.write(x, [5], [n], planes))
        assert w.decode().tolist() == x.tolist() and w.lengths.tolist() == [n]
        for i in rng.integers(0, max(n, 1), 30 if n else 0).tolist():
            assert w.access(i) == x[i]
            places = np.flatnonzero(x == x[i]).tolist()
            assert w.count(int(x[i])) == len(places) and w.count(int(x[i]), i) == sum(p >= i for p in places) and w.count(int(x[i]), 0, i) == sum(p < i for p in places)
            assert [w.find(int(x[i]), k) for k in range(len(places) + 1)] == [*places, -1]
        assert w.count(1 << planes) == 0 and w.find(1 << planes, 0) == -1


def brute_rows(texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, op2_wavelet_tokens(spark, SF).collect())) == brute_rows(texts)


def test_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "no id"), (3, None), (4, ""), (7, "word " * 60_000), (9, "Équal"), (9, "Équal"), (12, "<|endoftext|> x")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, file string").repartition(3)
    got = sorted(map(tuple, read_rows(write_files(df, path, shard_tokens=100)).collect()), key=lambda r: r[1])
    assert got == brute_rows(rows)
    assert read_rows(write_files(df.limit(0), path)).count() == 0
    byte_path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(byte_path)
    want = sorted((i or 0, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    counted = token_counts(df, byte_path).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in counted)
    assert token_counts(df.limit(0), byte_path).count() == 0


def test_files_answer_from_their_planes(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [(i, "the cat " * (i % 4) + f"word{i} the") for i in range(30)] + [(40, None), (None, "the end")]
    files = write_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), path, shard_tokens=25).cache()
    lib = Tokenizer.from_file(path)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    the, cat = lib.token_to_id("the</w>"), lib.token_to_id("cat</w>")
    asked = [the, cat, 1, 48_000, 1 << 20]
    want = {t: sum(x.count(t) for x in ids.values()) for t in asked}
    assert {r.token: r.n for r in token_ids.frequencies(files, asked).collect()} == want and want[the] > 50
    assert sorted((r.token, r.doc_id or -1, r.at) for r in token_ids.occurrences(files, asked).collect()) == sorted((t, i or -1, k) for i, x in ids.items() for k, t in enumerate(x) if t in asked)
    places = [(i, k) for i in (0, 7, 29, 40, 99) for k in range(-1, 9)]
    got = token_ids.tokens_at(files, spark.createDataFrame(places, "doc_id int, at int")).collect()
    assert sorted(map(tuple, got)) == sorted((i, k, ids[i][k]) for i, k in places if i in ids and 0 <= k < len(ids[i]))


def test_long_texts_go_piece_by_piece(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(token_fst, "LONG", 40)
    monkeypatch.setattr(token_fst.pieces, "__defaults__", (40,))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(200))) for _ in range(300)] + ["x" * 500, "日" * 200, "a\nb" * 90, " \n a" * 50]
    assert all("".join(token_fst.pieces(t)) == t for t in texts)
    assert count_tokens(texts, path) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_a_very_long_text_needs_little_memory():
    import subprocess
    import sys

    code = "import resource, public_tokenizers as P; from quarry.llm.token_fst import count_tokens; p = P.path('byte_bpe_50k.json'); n = count_tokens(['word and more, ' * 10], p)[0]; m = count_tokens(['word and more, ' * 2_000_000], p)[0]; print(n, m, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000)"
    n, m, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, text=True).stdout.split())
    assert m == (n - 1) // 10 * 2_000_000 + 1 and mb < 700


def test_count_query(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op8_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
