import random
import re
import zlib
from collections import Counter

from quarry.llm import spelling
from quarry.llm.spelling import deletion_keys, op13_spelling_variants, variants, word_counts
from tests.conftest import SF


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        forms[w] = (best and best[1], len(others), best and -best[0])
    for w, n in counts.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out[w] = (forms[w][0], root, n, *forms[w][1:])
    return out


def brute_counts(docs, least=7, slip=31):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return total


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_match_brute_force(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abÀ") for _ in range(rnd.randrange(1, 7))): rnd.choice([1, 2, 3, 20, 30, 400, 5000]) for _ in range(500)}
    words |= {"aaaaaaaa": 5, "aaaaaaa": 50, "aaaaaaaaa": 5, "a" * 3000: 7, "a" * 2999 + "b": 70, "": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n int").repartition(3)
    assert as_dict(variants(df)) == brute_forms(words)


def test_collisions_change_nothing(spark, monkeypatch):
    words = {"abcdefg": 2, "abcdefh": 30, "xxcdefg": 50, "abcdef": 3, "zzzzzzz": 1, "zzzzzz": 10}
    keys = deletion_keys(list(words))
    rows = sorted(zip([0] * len(keys[0]), *(k.tolist() for k in keys[1:]), strict=True))
    import pyarrow as pa

    names = list(words)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([names[r[3]] for r in rows]), pa.array([words[names[r[3]]] for r in rows])], schema=spelling.KEYS)
    got = Counter()
    for out in spelling.near_batches(iter([batch.slice(0, 9), batch.slice(9)])):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            got[w] += n
    assert got == {w: v[3] for w, v in brute_forms(words).items() if v[3]}


def test_keys_of_deletions():
    words = ["banana", "bananas", "aé", "x"]
    key, place, first, owner = deletion_keys(words)
    strings = {}
    for k, p, o in zip(key.tolist(), place.tolist(), owner.tolist(), strict=True):
        w = words[o] if p < 0 else words[o][:p] + words[o][p + 1 :]
        assert strings.setdefault(w, k) == k
    assert len(set(strings.values())) == len(strings)


def test_counts_and_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_COUNTED", 5)
    docs = [(None, "Nullable nullable NULLABLE"), (1, None), (2, ""), (3, "Straße Überraschung ÜBERRASCHUNG überraschung x1yyyyyyyy×÷À"), (3, "words " * 9), (4, "letters letterss lettters " * 40), (4, "letters letterss lettters " * 40)]
    docs += [(i, "running runing runningg jumpings") for i in range(60)]
    df = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, word string").repartition(2)
    counts = brute_counts(docs)
    assert {r.word: r.n for r in word_counts(df, slip=31).collect()} == counts
    assert {r.word: r.n for r in word_counts(df).collect()} == brute_counts(docs, slip=None)
    assert as_dict(variants(word_counts(df, slip=31))) == brute_forms(counts)
    assert variants(word_counts(df.limit(0))).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = {w: n for w, n in brute_counts(docs).items() if n >= 2}
    got = as_dict(op13_spelling_variants(spark, SF))
    assert {w: v[2] for w, v in got.items()} == counts
    some = dict(sorted(counts.items(), key=lambda x: zlib.crc32(x[0].encode()))[:150])
    for w, n in some.items():
        others = sorted((-m, v) for v, m in counts.items() if abs(len(v) - len(w)) < 2 and near(w, v))
        best = others[0] if others and -others[0][0] >= 10 * n else (None, None)
        assert got[w][0] == best[1] and got[w][3] == len(others)
