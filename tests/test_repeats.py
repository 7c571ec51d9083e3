"""Repeated lines of pages that come as a stream are those of all pages at once."""

import json
import random

from pyspark.sql import functions as F

from foliant.operators import layout
from foliant.streaming import repeats

PAGE = "source_file string, page_pos int, page_number int, width double, height double, unit string, lines array<struct<content:string,polygon:array<double>>>"


def pages(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        line = lambda text, y: {"content": text, "polygon": [1.0, y, 5.0, y, 5.0, y + 0.2, 1.0, y + 0.2]}
        lines = [line(rnd.choice(["Header A", "HEADER a", "Header B", f"Only {k}"]), 0.2), line("Body", 5.0), line(rnd.choice(["Foot", "Header A", ""]), 10.7)]
        out.append({"source_file": rnd.choice(["a.pdf", "b.pdf", "c.pdf", None]) if k % 9 else f"single{k}.pdf", "page_pos": k, "page_number": k + 1, "width": 8.5, "height": 11.0, "unit": "inch", "lines": lines})
    return out


def rows(df):
    return sorted(((r.source_file, r.normalized_text, r.text, r.page_occurrence_count, tuple(r.margin_positions), r.min_repeat_pages) for r in df.collect()), key=str)


def test_stream_of_pages(spark, tmp_path):
    made = pages(4)
    whole = spark.createDataFrame(made, PAGE)
    filled = whole.withColumn("source_file", F.coalesce("source_file", F.lit("none")))
    want = rows(layout.repeated_lines(layout.page_lines(filled), filled))
    state, told = repeats.Repeats(spark, str(tmp_path / "state"), folders=5), {}
    (tmp_path / "in").mkdir()
    for batch, part in enumerate((made[:20], made[15:35], [], made[35:])):  # some pages come twice
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(json.dumps(p) for p in part))

        def changed(df):
            for r in df.collect():
                told[r.source_file, r.normalized_text] = r.repeated

        repeats.add_available(spark.readStream.schema(PAGE).json(str(tmp_path / "in")), state, str(tmp_path / "cp"), changed)
    got = state.read()
    assert rows(got.withColumn("source_file", F.coalesce("source_file", F.lit("none")))) == want and want
    assert {k for k, r in told.items() if r} == {(r.source_file, r.normalized_text) for r in got.collect()}
    before = rows(got)
    assert state.add(whole).count() == 0 and rows(state.read()) == before  # a batch that is run again
    assert state.add(whole.limit(0)).count() == 0


def test_lines_cease_to_be_repeated(spark, tmp_path):
    one = lambda k, text: {"source_file": "a", "page_pos": k, "page_number": k, "width": 8.5, "height": 11.0, "unit": "inch", "lines": [{"content": text, "polygon": [1.0, 0.1, 2.0, 0.1, 2.0, 0.2, 1.0, 0.2]}]}
    state = repeats.Repeats(spark, str(tmp_path / "s"))
    assert [r.repeated for r in state.add(spark.createDataFrame([one(0, "H"), one(1, "H")], PAGE)).collect()] == [True]
    assert [(r.normalized_text, r.repeated) for r in state.add(spark.createDataFrame([one(2, "x"), one(3, "y")], PAGE)).collect()] == [("h", False)]
    assert [(r.normalized_text, r.repeated) for r in state.add(spark.createDataFrame([one(k, "H") for k in (4, 5, 6)], PAGE)).collect()] == [("h", True)]
