import time

import pytest

from tableprobe.llm.html_text import extract, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b <b>c</b></div>", "a\nb c"),
    ("a<br>b", "a\nb"),
    ("<ul><li>x<li>y<ol><li>q<li>r</ol></ul>z", "- x\n- y\n  1. q\n  2. r\n\nz"),
    ("<table><tr><th>Name<th>N<tr><td>Long name<td>1</table>", "Name      | N\nLong name | 1"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>aa<td>b<td>d</table>", "wide   | c\naa | b | d"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("x<div hidden>no</div><span style='color:red; display: none'>no</span><script>var a='<p>';</script>y", "xy"),
    ("<head><title>t</title><style>p{}</style></head><body>seen</body>", "seen"),
    ("a<!-- <p>no</p> -->b<!DOCTYPE html>", "ab"),
    ("a < b", "a < b"),
    ("</p>a</div></td>", "a"),
    ("<blockquote>deep<blockquote>deeper</blockquote></blockquote>", "  deep\n\n    deeper"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_render(page, text):
    assert render(page) == text


def test_nesting_of_any_depth_and_unclosed_markup():
    assert render("<div>" * 50_000 + "deep") == "deep"
    assert render("<script>never closed") == ""
    assert render("<p title='a>b'>c") == "c"


@pytest.mark.parametrize("unit", ['<a "', "<a '", "<a", "<a \"'", "<a b='c' \"", '<a "\'\'', "<"])
def test_tags_that_never_end_take_time_in_proportion(unit):
    start = time.process_time()
    assert render(unit * 50_000).startswith("<")
    assert render(unit * 50_000 + "<p>seen</p>") is not None
    assert time.process_time() - start < 10


@pytest.mark.parametrize("span", [2, 25, 1000, 5000])
def test_wide_spans_cover_the_columns_that_exist(span):
    page = f"<table><tr><td colspan={span}>all<tr><td>aa<td>b</table>"
    assert render(page) == "all\naa | b"
    many = f"<table><tr><td colspan=30>head<td>end<tr>{'<td>x' * 30}<td>last</table>".strip()
    head, row = render(many).split("\n")
    assert head.index("end") == row.index("last")


def test_wide_cells_do_not_blow_up():
    page = "<table>" + f"<tr><td>{'w' * 20_000}<td>x" + "<tr><td>a<td>b" * 2_000 + "</table>"
    assert len(render(page)) < 100_000


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "<p>a", "k"), (1, "<p>a", "k"), (None, None, "k"), (2**60, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.key_ or -1, r.text) for r in extract(pages).collect())
    assert got == [(-1, ""), (1, "a"), (1, "a"), (2**60, "")]
    assert extract(pages.limit(0)).count() == 0
