"""Rows that share or lack an id in the pipeline's stages, and pages that no browser would write."""
import time

import pytest

from tests.llm.test_text_operators import AWKWARD, frame
from tidewatch.llm import decontaminate, dedup, pages


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_each_row_is_judged_by_its_own_text(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    item = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"so {item} it is"), (1, "clean"), (None, f"a {item}"), (None, "clean too"), (None, None), (2, item), (2, item), (3, "clean"), (3, "clean")]
    bench = spark.createDataFrame([(1, item), (2, "some other words " * 5), (3, "and again " * 9)], "item_id long, text string")
    got = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert got.columns == frame(spark, rows).columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, ((1, "clean"), (None, "clean too"), (None, None), (3, "clean"), (3, "clean"))))


def test_one_row_of_each_group_stays(spark):
    text = lambda *changed: " ".join(f"x{k}" if k in changed else f"w{k}" for k in range(100))
    alone = " ".join(f"n{k}" for k in range(30))
    rows = [(1, "same four rows of five words"), (1, "same four rows of five words"), (None, "same four rows of five words"), (None, "Same four rows  of five words"),
            (9, text()), (None, text(50)), (7, text(50, 20)), (30, text(50, 20, 80)),                       # a chain over a row without id
            (None, alone), (None, alone), (None, alone + " end"), (None, "only once and without any id here"),
            (3, "one id with a first text here"), (3, "one id but quite another second text"), (4, "Case and  space differ in these two"), (4, "case AND space differ in these two"),
            (5, ""), (5, " "), (5, None), (None, ""), (None, None)]
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in dedup.components(frame(spark, rows)).collect()}
    assert found[7, 96] == found[9, 96] == found[30, 96] == found[None, 96] == 7 and found[None, 2] == 1 and found[None, 26] is None and found[None, 27] is None
    got = sorted(map(repr, ((r["doc_id"], (r["text"] or "").lower().split()[:3]) for r in dedup.keep_one(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, ((1, ["same", "four", "rows"]), (7, ["w0", "w1", "w2"]), (None, ["n0", "n1", "n2"]), (None, ["only", "once", "and"]), (3, ["one", "id", "with"]), (3, ["one", "id", "but"]),
                                    (4, ["case", "and", "space"]), (5, []), (None, []), (None, []))))
    assert dedup.keep_one(frame(spark, [])).count() == 0
    assert dedup.keep_one(frame(spark, AWKWARD)).count() == 11


@pytest.mark.parametrize("html", ["<a " * 350_000, "<div>" * 80_000 + "</p>" * 80_000, "<a " * 300_000 + '"' + ">" * 99_999, "<a" * 400_000 + ' " > ', "<!" * 500_000, "<script>" + "</script" * 120_000,
                                  "&#" + "9" * 10**6, "<div>" * 80_000 + "x" + "</div>" * 80_000, "<a '" * 200_000 + '<b "' * 100_000, "<p>" * 300_000, "<!-- " * 200_000, "<select><option>" * 60_000])
def test_long_malformed_pages_are_read_in_linear_time(html):
    start = time.process_time()
    page = pages.Page(html, False)
    assert time.process_time() - start < 3
    assert len(page.features()) == len(page.text)


def test_a_tag_that_never_ends_is_text():
    def read(html):
        return [t for t in pages.Page(html, False).text if t]
    assert read("<p>a < b <c") == ["a < b <c"]
    assert read("<p>a <b x='1>2' y=\">\">bold</b> <i title='open><p>next") == ["a bold <i title='open>", "next"]
    assert read("<p>x<!-- open <p>y") == ["x"] and read("<p>x<!y") == ["x<!y"] and read("<p>x<!y<!-- z") == ["x<!y"]
    assert read("<script>if (a<b) </script><p>t</p><script>open <p>u") == ["t"]
