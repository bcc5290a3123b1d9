import pytest

from groundwork.llm import html_text
from groundwork.llm.html_blocks import blocks, families

ARTICLE = "<article><h1>A heading</h1><p>First words of the text.</p><p>Second words of the text.</p></article>"
HEADS = ["<title>t</title></head><body>", "<title>t</title><body>", "<title>t</title>", "<title>t</title><noscript><img src=x></noscript><body>", "<template><p>no</p></template><style>p{}</style>", ""]


@pytest.mark.parametrize("head", HEADS)
def test_an_open_head_ends_where_the_body_begins(head):
    page = f"<html><head><meta charset=utf-8>{head}{ARTICLE}</html>"
    want = ["A heading", "First words of the text.", "Second words of the text."]
    assert [b.text for b in blocks(page)] == want
    assert html_text.main_blocks(page, html_text.trained(html_text.Pages())) == want


def test_text_closes_a_head():
    assert [b.text for b in blocks("<head><title>t</title>\n plain words")] == ["plain words"]


def test_generated_pages_leave_out_end_tags():
    assert any("</head>" not in html for html, _ in html_text.labelled(40, 3))


def test_whole_class_lists_are_read():
    assert "talk" in families([("class", "x1 " * 300 + "comment")])
