"""Elements far down keep their end tags, roles and article."""

import pytest

from evidra.llm import html_tree


@pytest.mark.parametrize("depth", [3, 70, 5000])
def test_depth(depth):
    deep = "<div>" * depth + "deep" + "<nav>menu</nav><form>box</form>" + "</div>" * depth
    page = f"<body><div class=page><article><p>first</p>{deep}<p>last</p></article></div><div>outside</div></body>"
    assert html_tree.main_text(page, set()) == "first deep last"
    comments = "<body><p>text</p><div class=comments>" + "<div>" * depth + "reply" + "</div>" * depth + "more</div></body>"
    assert html_tree.main_text(comments, set()) == "text"
