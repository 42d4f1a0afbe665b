"""Pages read by their brackets, and records as columns."""

import pytest

from stellwerk.functions import html as H


def test_records_become_columns():
    lists = [[{"a": "x", "b": None}], None, [], [{"a": "y", "b": "z"}, {"a": None, "b": "w"}]]
    assert H.structs(lists, ("a", "b")).to_pylist() == lists
    assert H.structs([], ("a",)).to_pylist() == [] and H.structs([None], ("a",)).to_pylist() == [None]


def test_kept_tags_are_bounded(monkeypatch):
    monkeypatch.setattr(H, "KEPT_TAGS", 3)
    monkeypatch.setattr(H, "_KNOWN_TAGS", {})
    page = "".join(f'<a href="/{i}">{i}</a>' for i in range(20))
    assert [e["attrs"]["href"] for e in H._Page(page).elements] == [f"/{i}" for i in range(20)]
    assert len(H._KNOWN_TAGS) <= 3


@pytest.mark.parametrize("page", ["<b", "a<", "<b>x<b", "<b><", "<", "<>", "<b>x</b>y<b", "a>b", "<b>></b>", "<br>&amp;<br/> <pre> \n</pre>"])
def test_open_brackets_are_read_as_the_parser_reads_them(page, monkeypatch):
    fast = H._Page("<b>" + page), H._Page(page)  # the second time some tags are known
    monkeypatch.setattr(H._Page, "_read_plain", lambda self, markup: False)
    for read, markup in zip(fast, ("<b>" + page, page)):
        slow = H._Page(markup)
        assert (read.pieces, read.elements) == (slow.pieces, slow.elements)
