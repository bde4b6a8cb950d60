"""Fill-in-middle by relational units against plain Python, on nulls, empty and long texts, markers, repeats and blocks."""

import hashlib
import random
import re

from platehouse.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _expected(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _rows():
    rng = random.Random(11)
    letters = "abcXYZ  \n\t.,1<>PSM<é日𝄞́\x00\x0b "
    texts = [None, "", " ", "a", "word", "<P>", "a <S> b", "<", "<<P", "P>", "é" * 40, "a1" * 16, "a1" * 16 + "b", " " * 32, " " * 64, "\r\n\r\n"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [" ".join(rng.choice(("alpha", "b", "𝄞", "x,y")) for _ in range(60_000)), "q" * 500_000]
    rows = list(enumerate(texts)) + [(None, "no number"), (None, "no number"), (None, None), (5, "a <S> b"), (-3, "minus three words"), (2**62, "a long number")]
    return rows + rows[:3]


def _made(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2, "x", None) for d, t in rows], "doc_id long, text string, _row int, n int, form string, _at long")
    return infill.transform(df)


def test_outputs_are_brute_force(spark):
    rows = _rows()
    made = _made(spark, rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, made), key=key) == sorted((_expected(d, t) for d, t in rows), key=key)


def test_texts_come_back(spark):
    rows = _rows()
    found = infill.digests(_made(spark, rows)).collect()
    assert sorted((r["output_sha256"], r["restored_sha256"]) for r in found) == sorted((_sha(_expected(d, t)[5]), _sha(t or "")) for d, t in rows)


def test_empty_table_and_one_shuffle_of_texts(spark, tmp_path):
    assert _made(spark, []).count() == 0
    spark.createDataFrame([(i, f"some words {i} " * 50) for i in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    made = infill.digests(infill.transform(spark.read.parquet(str(tmp_path / "d"))))
    assert made.count() == 300
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2
