import time

import pytest

from stellwerk.functions.html import _Page, find_listings, find_table_rows


@pytest.mark.parametrize("n", [3, 20_000])
def test_descendants_cost_time_by_length(n):
    start = time.monotonic()
    page = "<body>" + "".join(f'<article><a href="/j-{i}">T{i}</a><p>C{i}<br>O{i}</article>' for i in range(n)) + "</body>"
    found = find_listings(page)
    assert len(found) == n and found[-1] == {"title": f"T{n - 1}", "href": f"/j-{n - 1}", "company": f"C{n - 1}", "location": f"O{n - 1}"}
    row = '<tr class="ia-e-table__row"><td data-field="StellenangebotId"><i></i><span>{0}</span></td><td data-field="Behoerde">B{0}</td></tr>'
    rows = find_table_rows("<table>" + "".join(row.format(i) for i in range(n)) + "</table>")
    assert [(r["row_id"], r["company"]) for r in rows] == [(str(i), f"B{i}") for i in range(n)]
    # With a scan of the page per container this took minutes.
    assert time.monotonic() - start < 60


def test_descendants_are_what_stands_inside():
    # The unclosed first container holds the second one; an empty element behind a container isn't inside.
    page = '<article><p>x</p><article><p>y</p></article><a href="/1"></a></article><a href="/2">t</a><article></article><a href="/3"></a>'
    assert [(f["href"], f["company"]) for f in find_listings(page)] == [("/1", "x")]
    page = '<body><article><a href="/1">t</a><p>c'
    assert find_listings(page) == [{"title": "t", "href": "/1", "company": "c", "location": None}]


PLAIN = [
    "", "a &amp; b", "<p>a<br/>b <i/>c</p>", '<TR Class="x y"><td data-field=\'A "b"\'> 1 </td><td>2</tr>', "<pre> \n </pre> \n <b>",
    '<!DOCTYPE html><body><!-- c --><a rel href="/s?a=1&amp;b=%40">x</a></p></body>', "&lt;p&gt;&copy 1",
]
OTHER = [
    "<script>a < b</script>c", "a < b > c", "<a href=x>y</a>", '<a b=">">c', "<!-- a --- b -->c", '<a href="?x=1&copy=2">t', "<p", "<a b='1'c='2'>",
    "<title><b>x</title>", "<textarea><p></textarea>", "</ p>q", "<?x y>z",
]


@pytest.mark.parametrize("page", PLAIN + OTHER)
def test_plain_pages_read_as_the_parser_reads_them(page, monkeypatch):
    fast = _Page(page)
    monkeypatch.setattr(_Page, "_read_plain", lambda self, markup: False)
    slow = _Page(page)
    assert (fast.pieces, fast.elements) == (slow.pieces, slow.elements)


def test_plain_pages_need_no_parser(monkeypatch):
    def fail(self, markup):
        raise AssertionError(markup)

    monkeypatch.setattr(_Page, "feed", fail)
    for page in PLAIN:
        _Page(page)
