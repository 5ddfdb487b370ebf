import hashlib
import os
import random
from collections import Counter
from functools import partial

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment
from quarry.llm.alignment import aligned, byte_values, op11_token_alignment, tokenizers
from tests.conftest import SF

PATHS = [public_tokenizers.path(n) for n in (alignment.BYTE_LEVEL, alignment.PIECES)]
PIECES = ["a", "b", "'s", " ", " ", "  ", "\n", "\t", "\r", "12", "!", "the", "ing", "é", "ß", "日本", "🙂", "\xa0", "\x1c", "\x85", "A", "▁", "<s>", "<0x0A>", "<|endoftext|>", "\u3000"]


def brute(docs):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    values, found, counts = byte_values(), [], Counter()
    for doc_id, text in docs:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(values[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((doc_id, None))
            continue
        groups, links, i, j, end_a, end_b, start_a, start_b = [([], [])], [], 0, 0, len(bytes_a[0]), len(bytes_b[0]), 0, 0
        while True:
            links.append((ids_a[i], ids_b[j]))
            done_a, done_b = end_a <= end_b, end_b <= end_a
            if done_a:
                groups[-1][0].append(ids_a[i])
                i += 1
            if done_b:
                groups[-1][1].append(ids_b[j])
                j += 1
            if done_a and done_b:
                if i == len(ids_a):
                    break
                groups.append(([], []))
            end_a += len(bytes_a[i]) if done_a else 0
            end_b += len(bytes_b[j]) if done_b else 0
        counts.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc_id, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text.encode()).hexdigest())))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return sorted(
        ((i, *(none if f is None else (*f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]))) for i, f in found), key=str
    )


def rows(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def odd(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 30))) for _ in range(n)]


def test_words_give_what_whole_texts_give():
    both = tokenizers(*PATHS)
    texts = [*odd(3000), "x" * 5000 + " y", "foo\n \nbar", "foo\n bar", "foo \nbar"]
    assert both.by_word and both.encode(texts) == both.whole(texts)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    assert rows(op11_token_alignment(spark, SF)) == want and sum(r[1] for r in want) > 100_000


def test_cases(spark, monkeypatch):
    docs = [(None, "no id"), (None, "no id"), (None, "other"), (1, None), (2, ""), (3, "two  spaces"), (4, " lead"), (5, "tail "), (6, "u▁v"), (7, "same row"), (7, "same row"), (7, "same id"), (8, "long " * 30_000 + "end"), (9, "日" * 9000), (0, "no id")]
    docs += list(enumerate(odd(200), 100))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, p string").repartition(3)
    want = brute(docs)
    assert rows(aligned(df, *PATHS)) == want
    monkeypatch.setattr(alignment, "MOST_PAIRS", 10)  # the other join
    assert rows(aligned(df, *PATHS)) == want
    assert aligned(df.limit(0), *PATHS).count() == 0


def test_words_have_their_tokens_once_a_block(spark):
    texts = ["some words, some more words", "more words again"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    parts = df.mapInArrow(partial(alignment.block_batches, path_a=PATHS[0], path_b=PATHS[1]), alignment.PARTS_DDL)
    both = tokenizers(*PATHS)
    distinct = {w for t in texts for w in t.split(" ")}
    want = sum((len(f) - alignment.HEAD) // 2 for f in both.ids(distinct))
    assert parts.where("NOT document").selectExpr("sum(size(ids)) AS n").first().n == want
    runs = alignment.links(parts.where("NOT document").select("p", "k", "n_a", "ids"), *PATHS)
    assert runs.count() < want


def test_blocks_and_runs_are_small_and_many(spark):
    docs = [(i, t) for i, t in enumerate([*odd(60), "\u2581 x", "", "a b c " * 40 + "d"])]
    want = brute(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    kept = alignment.BLOCK, alignment.RUN
    names = [f.name for f in alignment.PARTS]

    def small(batches):
        alignment.BLOCK, alignment.RUN = 200, 3
        try:
            yield from alignment.block_batches(batches, *PATHS)
        finally:
            alignment.BLOCK, alignment.RUN = kept

    parts = spark.createDataFrame(pa.Table.from_batches([batch]).to_pandas()).coalesce(1).mapInArrow(small, alignment.PARTS_DDL).select(names).cache()
    again, n = alignment.dealt(parts)
    blocks = parts.select("p").distinct().count()
    assert blocks > 5 and again.select("p").distinct().count() == blocks and n >= blocks
    assert again.selectExpr(f"pmod(hash(p), {n}) AS slot").distinct().count() == blocks
    docs_of = again.where("document").selectExpr("p AS p", "k AS k", "doc_id AS doc_id", "numbers AS numbers")
    rows_of = alignment.links(again.where("NOT document"), *PATHS).selectExpr("p", "k", "end", "a", "b", "int(a_ends) + 2 * int(b_ends) AS ends")
    found = docs_of.groupBy("p").cogroup(rows_of.groupBy("p")).applyInArrow(alignment.digests, alignment.DOCUMENTS_DDL).collect()
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    assert sorted((tuple(r[c] for c in cols) for r in found), key=str) == sorted(((*r[:5], r[7]) for r in want), key=str)
