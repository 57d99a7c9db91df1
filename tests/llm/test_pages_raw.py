"""Nothing of a page is lost behind scripts and elements without end tags."""

import time

import numpy as np
import pytest

from worksight.llm import pages


def text_of(source: str) -> str:
    page = pages.Page(source)
    return page.text(np.ones(len(page.tag), bool))


ARTICLE = "<article><p>The whole article stands here.</p></article>"


@pytest.mark.parametrize(
    "head, before",
    [
        ("<script>for(i=0;i<n;i++)x[i]=1;</script>", ""), ("<script>if(a<b)document.write('<!');</script>", ""), ("<script>var a='<!--';</script>", ""), ("<STYLE>a<b{}</Style >", ""),
        ("<title>a <b</title>", ""), ("<datalist><option value=a><option value=b></datalist>", ""), ("<select><option>one<option>two</select>", ""), ("<iframe src=x>", ""), ("<object data=x>", ""),
        ("<video src=x>", ""), ("<svg><path d='M0'>", ""), ("<noscript>", ""), ("<option>word", "word\n"), ("<p>İİİİ</p><script>x</script>", "İİİİ\n"), ("<noscript><p>off</p></noscript>", ""),
    ],
)
def test_what_follows_a_raw_element_stays(head, before):
    got = text_of(head + ARTICLE)
    assert got.endswith("The whole article stands here.") and (got == before + "The whole article stands here." or head.startswith("<option"))


def test_an_option_does_not_reach_to_a_later_one():
    assert "The whole article stands here." in text_of("<datalist><option value=a></datalist>" + ARTICLE + "<select><option>x</option></select>")


def test_many_elements_without_end_tags_are_read_in_linear_time():
    assert text_of("<svg>" * 50_000 + ARTICLE) == "The whole article stands here."


def test_quotes_without_end_leave_no_markup():
    for n in (1, 3, 15, 16, 17, 40, 41):
        page = "<body><article>" + "".join(f'<p title="it>broken {k}</p><p>Part {k} of the text.</p>' for k in range(n)) + "</article></body>"
        text = "\n".join("".join(x) for _, x in pages.Page(page).runs)
        assert "<" not in text and "title" not in text and f"Part {n - 1} of the text." in text, n
    assert ["".join(x) for _, x in pages.Page("<p>kept</p><p class='no end").runs] == ["kept"]
    assert ["".join(x) for _, x in pages.Page("<p title='a > b' id=\"it's\">kept</p>").runs] == ["kept"]


def test_many_quotes_take_time_in_proportion():
    page = "".join(f"<p a=\"{k}' b='>x" for k in range(60_000)) + "'"
    began = time.process_time()
    pages.Page(page)
    assert time.process_time() - began < 20
