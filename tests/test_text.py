import random

import pytest
from pyspark.sql import functions as F

from tests import models
from ziplore.functions import text
from ziplore.functions.binary import looks_binary

ALPHABET = list("aZ#.!?… \n\t\r") + ["\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "é", "😀", "\u200b"]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        body = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 10, 170, 340])))
        if rng.random() < 0.3:
            body = "x" * rng.randrange(150, 165) + body
        if rng.random() < 0.3:
            body = "#" * rng.randrange(1, 9) + rng.choice([" ", "", "\n", "\u2003"]) + body
        texts.append(body)
    return texts


EDGE_TEXTS = [
    "", " \n", "# ", "#", "####### x", "###### x", "# a\nb", "#\n\nb", "x" * 159 + ". y", "x" * 160 + ". y",
    "End.", "End. ", "A.\u2003B", "x" * 160, "x" * 161, "😀" * 161, "a.b c! d", "1\r\n2. 3", "# t  \n",
]


def test_summary_equals_model(spark):
    texts = EDGE_TEXTS + random_texts(3000)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = dict(df.select("id", text.summarise_text(F.col("t")).alias("s")).collect())
    wrong = [(t, got[i], models.one_line(t)) for i, t in enumerate(texts) if got[i] != models.one_line(t)]
    assert not wrong[:3]


def test_strip_equals_python(spark):
    texts = random_texts(1000, seed=3)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", text.strip(F.col("t")).alias("s"), text.strip_right(F.col("t")).alias("r")).collect()
    assert all(r.s == texts[r.id].strip() and r.r == texts[r.id].rstrip() for r in rows)


def random_bytes(n):
    rng = random.Random(5)
    out = [None, b"", b"\x00", b"a" * 7 + b"\x01" * 3, b"a" * 69 + b"\x01" * 31, b"a" * 1024 + b"\x02" * 900]
    out += ["é".encode() * 32_000, b"a" + "é".encode() * 32_000, b"\xef\xbb\xbfhi", b"\xed\xa0\x80", b"\xc0\x80", b"a\r\nb\rc\xff"]
    for _ in range(n):
        pool = rng.choice([range(256), range(32), range(9, 127), list(range(12, 34))])
        out.append(bytes(rng.choice(pool) for _ in range(rng.choice([1, 5, 50, 1500]))))
    return out


def test_bytes_equal_model(spark):
    blobs = random_bytes(400)
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "id int, b binary")
    rows = df.select(
        "id", looks_binary(F.col("b")).alias("binary"), text.decode_text(F.col("b")).alias("t")
    ).collect()
    for r in rows:
        assert r.binary == models.mostly_control(blobs[r.id])
        assert r.t == models.text_of(blobs[r.id])


def test_boundary_safe_drops_cut_character(spark):
    cut = b"a" + "é".encode() * 32_000
    df = spark.createDataFrame([(cut,), (b"\xff" * 70_000,)], "b binary")
    rows = [r[0] for r in df.select(text.decode_text(F.col("b"), 64_000, boundary_safe=True)).collect()]
    assert rows[0] == cut[:63_999].decode()
    assert rows[1] == "ÿ" * 70_000


@pytest.mark.parametrize("body,lines", [(b"", 0), (b"a", 1), (b"a\n", 1), (b"a\nb", 2), (b"\n\n", 2), (b"\xff\n\xfe", 2), (None, 0)])
def test_line_count(spark, body, lines):
    df = spark.createDataFrame([(body,)], "b binary")
    assert df.select(text.line_count(F.col("b"))).first()[0] == lines
