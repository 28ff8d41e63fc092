"""Steps that must not grow with the size of a batch or a table."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from contentsec import patterns
from contentsec.functions import html as H
from contentsec.functions import text as T
from contentsec.functions.batches import BYTES, VALUES, in_parts
from contentsec.functions.likeness import ratio
from contentsec.operators import asymmetry
from contentsec.operators.signals import long_table
from contentsec.plans import fixtures


def test_pages_are_parsed_in_parts(spark):
    parse = H._function(H.page_features, *H._kinds(("images",)))
    pages = [f'<p>{i}<img src="{i}.png">' for i in range(VALUES * 3 + 1)]
    out = list(parse.func(iter([pa.array(pages[:100]), pa.array([], pa.string()), pa.array(pages[100:])])))
    assert [v["images"] for part in out for v in part.to_pylist()] == [[f"{i}.png"] for i in range(len(pages))]
    assert max(map(len, out)) <= VALUES


def test_long_pages_make_parts_of_their_own(spark):
    parse = H._function(H.page_features, *H._kinds(("visible_text",)))
    pages = ["a" * (BYTES + 1), "b" * (BYTES // 2), "c" * (BYTES // 2), "d", None]
    out = list(parse.func(iter([pa.array(pages)])))
    assert [len(part) for part in out] == [1, 2, 2]
    assert [v and v["visible_text"] for part in out for v in part.to_pylist()] == pages


def test_files_are_made_in_parts():
    class Texts:
        def mapInArrow(self, run, schema):  # noqa: N802
            n = VALUES * 2 + 1
            return list(run(iter([pa.record_batch([pa.array(range(n)), pa.array(["a"] * n)], ["content_id", "body"]), pa.record_batch([pa.array([n, n + 1]), pa.array(["b" * BYTES, "c"])], ["content_id", "body"])])))

    out = fixtures.files(Texts())
    assert [len(part) for part in out] == [VALUES, VALUES, 1, 1, 1]
    rows = [r for part in out for r in part.to_pylist()]
    assert [r["content_id"] for r in rows] == list(range(VALUES * 2 + 3))
    assert rows[2] == {"content_id": 2, "filename": "f2.ics", "data": fixtures.calendar("a")}


def test_parts_are_cut_by_the_bytes_of_all_columns():
    left, right = pa.array(["a"] * 8 + [None]), pa.array(["b" * (BYTES // 2)] * 8 + ["c"])
    out = list(in_parts(iter([(left, right), (left[:0], right[:0])]), lambda a, b: [len(a)] * len(b), pa.int64()))
    assert [len(part) for part in out] == [1] * 7 + [2, 0]


def test_pairs_of_texts_share_one_python_step(spark, data):
    import __spark_entry__

    plan = __spark_entry__.queries()["asymmetry_flags"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 4  # three parse the pages


def test_a_scan_of_pages_has_one_python_step(spark, data):
    import __spark_entry__

    plan = __spark_entry__.queries()["page_reports"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_composed_pages_are_normalized_texts(spark):
    pages = ["", "<p>a</p>", None, "<p>ｉｇｎｏｒｅ ﬁ</p>", "".join(patterns.LOOKALIKES), "<i>А\u0301 e\u0301 𝐛 \u200b</i>", *(chr(c) * 2 for c in range(0x80, 0x3000))]
    rows = spark.createDataFrame([(p,) for p in pages], "x string").select("x", H.parse_composed(F.col("x")).alias("p"), T.normalize(F.col("x")).alias("n"))
    for r in rows.select("x", "p.composed", "n").collect():
        assert r.composed == (None if (r.x or "").isascii() else r.n)


def test_likeness_of_more_pairs_is_the_least(spark):
    some = ["", None, "abcd", "abce", "xyz" * 100, "xyz" * 90 + "a"]
    rows = [(a, b, c, d) for a in some for b in some for c in some for d in some]
    frame = spark.createDataFrame(rows, "a string, b string, c string, d string").select(asymmetry.similarity(*map(F.col, "abcd")).alias("s"))
    like = lambda x, y: SequenceMatcher(None, x or "", y or "").ratio()
    assert [r.s for r in frame.collect()] == [min(like(a, b), like(c, d)) for a, b, c, d in rows]


def test_only_named_fields_of_a_page(spark):
    rows = spark.createDataFrame([('<a class="x"><img src="a.png">t',), (None,)], "x string").select(H.parse(F.col("x"), "images", "visible_text").alias("p"))
    assert rows.schema["p"].dataType.fieldNames() == ["images", "visible_text"]
    assert [(r.p.images, r.p.visible_text) for r in rows.collect()] == [(["a.png"], "t"), ([], "")]
    assert rows.select("p.images").columns == ["images"]


def test_signals_are_worked_out_once_for_a_long_table(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "content_id int, x string").withColumn("signals", F.transform(F.split(F.regexp_replace("x", "zz", ""), " "), lambda v: F.struct(v.alias("signal_name"))))
    rows = rows.withColumn("signals", F.filter("signals", lambda s: s["signal_name"] != ""))
    table = long_table(rows)
    assert sorted(tuple(r) for r in table.collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert table._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_likeness_is_that_of_difflib():
    some = random.Random(7)
    for _ in range(400):
        letters = [chr(some.choice([32, 97, 0x4E00]) + i) for i in range(some.choice([2, 20, 90]))]
        text = lambda n: "".join(some.choices(letters, [some.random() ** 3 for _ in letters], k=n))  # noqa: E731, B023
        a = b = text(some.choice([0, 1, 50, 199, 260, 600]))
        for _ in range(some.choice([0, 1, 6])):
            at, stop = sorted(some.randrange(len(b) + 1) for _ in range(2))
            b = some.choice([b[:at] + b[stop:], b[:at] + text(9) + b[at:], b + b[at:stop]])
        for x, y in ((a, b), (b, a), (a, text(250))):
            assert ratio(x, y) == SequenceMatcher(None, x, y).ratio()


def test_content_hash_takes_runs_of_any_white_space_for_one_space(spark):
    white = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() and c not in range(0x1C, 0x20))]
    texts = [f"{a}x{a}{b}Y{a}" for a in white for b in (" ", "", a, " \t ")] + ["", " ", "  ", "a\x1cb", "a\u200bb", "a\u180eb", "\t", " a  b "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    before = F.sha2(F.lower(F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), "^ | $", "")), 256)
    assert rows.filter(asymmetry.content_hash(F.col("t")) != before).collect() == []


def test_pages_of_both_sides_are_parsed_once(spark, data):
    import __spark_entry__

    rows = __spark_entry__.queries()["archive_compare"](spark, data)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_likeness_of_long_texts_takes_no_square_of_their_length():
    some = random.Random(1)
    a = "".join(some.choices([chr(0x4E00 + i) for i in range(95)], [2.0] * 15 + [0.875] * 80, k=200_000))
    began = time.monotonic()
    assert ratio(a, a[:1000] + "zz" + a[1000:]) > 0.99999
    assert time.monotonic() - began < 5


def test_requests_are_judged_once(spark):
    from contentsec.config import Config
    from contentsec.operators import exfiltration

    rows = spark.createDataFrame([("http://a.example.xyz/x", "mail bob@example.com"), ("https://api.trusted.com/x", "hello"), (None, None)], "url string, body string")
    found = exfiltration.check(rows, Config(allowed_domains=("api.trusted.com",)))
    assert [(r.safe, r.codes) for r in found.collect()][:2] == [(False, ["domain", "personal"]), (True, [])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("as DNS tunnels have") == 3
