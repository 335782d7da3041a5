"""Cells that span columns and rows, against a grid filled cell by cell; and visible parts of invisible ones."""

import random

from lociframe.llm.html_text import page_text


def test_spans_by_hand():
    page = "<table><tr><td rowspan=2>A<td>b1<td>c1<tr><td>b2<td>c2<tr><td colspan=2>wide cell here<td>c3</table>"
    assert page_text(page) == 'A  b1           c1\n   b2           c2\nwide cell here  c3'
    lines = page_text(page).split("\n")
    assert lines[0].index("b1") == lines[1].index("b2") and lines[0].index("c1") == lines[1].index("c2") == lines[2].index("c3")
    assert lines[2].index("c3") >= len("wide cell here") + 2
    # To the end of the group, not beyond it.
    lines = page_text("<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</tbody></table>").split("\n")
    assert lines == ["A  b", "   c", "d  e"]
    assert page_text("<table><tr><td colspan=1000>x<td>y<tr><td>z</table>") == "x  y\nz"
    assert page_text("<table><tr><td colspan=x rowspan=-1>x<td>y<tr><td>z</table>") == "x  y\nz"
    assert page_text("<table><tr><td rowspan=2><td>a<tr><td>b<tr><td>c<td>d</table>") == "   a\n   b\nc  d"


def test_random_tables():
    rng = random.Random(5)
    for _ in range(200):
        taken, rows, want = set(), [], {}
        for r in range(rng.randint(1, 6)):
            cells, c = [], 0
            for k in range(rng.randint(1, 4)):
                while (r, c) in taken:
                    c += 1
                across, down = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3])
                name = f"r{r}k{k}" + "x" * rng.randint(0, 9)
                want[name] = (r, c)
                taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
                cells.append(f"<td colspan={across} rowspan={down}>{name}")
                c += across
            rows.append("<tr>" + "".join(cells))
        lines = page_text("<table>" + "".join(rows) + "</table>").split("\n")
        place = {name: next((i, x.index(name)) for i, x in enumerate(lines) if name in x.split()) for name in want}
        for a, (ra, ca) in want.items():
            assert place[a][0] == ra
            for b, (rb, cb) in want.items():
                assert (place[a][1] == place[b][1]) == (ca == cb) and (place[a][1] < place[b][1]) == (ca < cb), (a, b, lines)


def test_visible_inside_of_invisible():
    assert page_text('<div style="visibility: hidden">no<p style="visibility:visible">yes <b>all</b></p>no<img alt=no></div>') == "yes all"
    assert page_text('<div style="display:none">no<p style="visibility:visible">no</p></div>after') == "after"
    assert page_text('<ul><li>a<li style="visibility:hidden">b<li>c</ul>') == "- a\n- c"
    assert page_text('<ol><li>a<li style="visibility:collapse">b<li>c</ol>') == "1. a\n3. c"
    assert page_text('<p style="visibility:hidden; visibility: visible">yes') == "yes"
    assert page_text('<table style="visibility:hidden"><tr><td>a<td style="visibility:visible">b</table>') == '  b'
    assert page_text('<div hidden>x<b style="visibility:visible">y</b></div><input value=v style="visibility:hidden">') == ""
