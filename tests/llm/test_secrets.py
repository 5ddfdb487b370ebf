import hashlib
import re

from pyspark.sql import functions as F

from quarry.llm.secrets import fit, labelled, op3_secret_spans, scan
from tests.conftest import SF

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    t = text or ""
    a = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    k = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    h = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    s = sorted(a + k + h, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
    return {"n_assign": len(a), "n_access": len(k), "n_hex": len(h), "base_sha256": hashlib.sha256(",".join(f"{x}:{p}:{q}" for x, p, q in s).encode()).hexdigest()}, {f"{x}:{p}:{q}" for x, p, q in s}


def check(rows, texts):
    for r in rows:
        want, spans = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        got = [x for x in r.spans.split(",") if x]
        assert spans <= set(got) and all(x in spans or x.startswith("markov:") for x in got)


def test_spans_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op3_secret_spans(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    check(rows, texts)


def test_edges_and_models(spark):
    texts = {
        1: None, 2: "", 3: "token: password: abcdefghijklmnop", 4: "é🙂 Api_Key='ABCdef123456.=' x", 5: "AKIA" + "AKIA" * 4 + " AKIA1234", 6: "0123456789abcdef" * 3 + " " + "f" * 15,
        7: "key Zx9Kq2LmV7bT4wRj8NcY1pHs end", 8: "some_ordinary_identifier_name getUserNameListItem/config/path/reader", 9: "secret=" + "a" * 11, 10: ("word " * 3000 + "token = 24be64439e3e49cf46b2d7c90f36 ") * 3,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("other", F.lit(None).cast("int"))
    ratio = fit(labelled(df))
    rows = scan(df, ratio).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    by = {r.doc_id: r for r in rows}
    assert by[7].n_markov == 1 and by[7].secrets == ["Zx9Kq2LmV7bT4wRj8NcY1pHs"]
    assert by[8].n_markov == 0
    assert scan(df.limit(0), fit(labelled(df.limit(0)))).count() == 0


def test_held_out_accuracy(spark):
    """Models fitted on one half of the labelled sample tell the other half apart."""
    import secrets as rnd
    import string

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratio = fit(labelled(docs))
    random = ["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(200)]
    plain = [f"{a}_{b}_{c}" for a in ("compute", "validate", "render", "average") for b in ("average", "document", "template", "position") for c in ("statistics", "parameters", "controller", "repository")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(random + plain)], "doc_id long, text string")
    got = {r.doc_id: r.n_markov for r in scan(df, ratio).collect()}
    assert sum(got[i] for i in range(200)) >= 190
    assert sum(got[i] for i in range(200, 200 + len(plain))) <= 3


def test_short_and_partly_covered_tokens(spark):
    texts = ["pw: Zx9Kq2LmV7bT4wRj", "key Qz7Rk2XvW9pLmZx9Kq2L0123456789abcdefZx9Kq2LmV7bT4wRj8NcY end", "call +49-171-2345678 on 2026-01-02 or 202601021234", "internationalization getUserNameList Verantwortung config/default", "my_password=Zx9Kq2LmV7bT4wRj"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fit(labelled(docs))).collect()}
    check(got.values(), dict(enumerate(texts)))
    assert got[0].secrets == ["Zx9Kq2LmV7bT4wRj"]
    assert got[1].secrets == ["Qz7Rk2XvW9pLmZx9Kq2L", "0123456789abcdef", "Zx9Kq2LmV7bT4wRj8NcY"]
    assert [got[i].n_markov for i in (2, 3, 4)] == [0, 0, 0]


def test_long_texts_with_many_tokens(spark):
    import random
    import time

    rnd = random.Random(4)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n: "".join(rnd.choice(abc) for _ in range(n))
    texts = {1: " ".join(token(24) for _ in range(40_000)), 2: token(1_000_000), 3: " ".join(f"secret={token(14)} {token(30)}" for _ in range(5_000)), 4: "ab " * 300_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4, "doc_id")
    ratio = fit(labelled(df.where("doc_id = 4")))
    began = time.time()
    rows = {r.doc_id: r for r in scan(df, ratio).collect()}
    assert time.time() - began < 120
    check(rows.values(), texts)
    assert rows[1].n_markov > 38_000 and rows[2].spans == "markov:0:1000000" and rows[3].n_assign == 5_000 and rows[4].spans == ""
    for x, m in zip(rows[1].spans.split(","), rows[1].secrets, strict=True):
        _, a, b = x.split(":")
        assert texts[1][int(a) : int(b)] == m
