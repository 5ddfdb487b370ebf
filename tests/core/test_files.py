from quarry.sources.files import blocks, decode, delimiter, discover, line_blocks


def test_decode():
    assert decode("é奖".encode("utf-16-le").join([b"\xff\xfe", b""])) == "é奖"
    assert decode(b"\xef\xbb\xbfx\x00y") == "xy" and decode("奖励".encode("gb18030")) == "奖励"


def test_line_blocks():
    assert line_blocks("a\r\nb\n\n\nc") == [(1, 2, "a\nb"), (5, 5, "c")]
    assert [b[:2] for b in line_blocks("\n".join("x" * 5), 2)] == [(1, 2), (3, 4), (5, 5)] and line_blocks(" \n") == []


def test_delimiter():
    assert delimiter("a;b;c\n1,5;2;3") == ";" and delimiter("a\tb\n1\t2") == "\t" and delimiter("plain") == ","


def test_discover(spark, tmp_path):
    for name, text in (("a/x.md", "one\n\ntwo"), ("a/~$x.md", "no"), ("a/y.bak", "no"), ("skip/z.md", "no"), ("big.md", "n" * 99), ("q.exe", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = discover(spark, str(tmp_path), [".md", ".bak"], max_bytes=50, exclude=("Skip",))
    assert [r.relative_path for r in found.collect()] == ["a/x.md"]
    assert [(r.ordinal, r.first_line, r.text) for r in blocks(found).orderBy("ordinal").collect()] == [(0, 1, "one"), (1, 3, "two")]
