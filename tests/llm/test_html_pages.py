"""Extraction against a second, recursive rendering of generated trees, and on deep and hostile pages."""

import random
import time

from lociframe.llm import html_text


def tree(rng, depth, kinds=("p", "div", "ul", "ol", "table", "text", "hidden", "b")):
    """(html, blocks) of a random well-formed piece of page; blocks: lines as they should come out, None for an empty line."""
    kind = rng.choice(kinds if depth else ("p", "text", "hidden", "div"))
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    if kind == "text":
        w = word()
        return f"<div>{w}</div>", [w]
    if kind == "hidden":
        return rng.choice((f"<script>{word()}</script>", f"<div hidden>{word()}<p>{word()}</p></div>", f"<p style='display:none'>{word()}</p>", f"<!-- {word()} -->")), []
    if kind == "p":
        a, b = word(), word()
        return f"<p>{a}\n  <b>{b}</b><br>{a}", [None, f"{a} {b}", a, None]
    if kind == "b":
        a, b = word(), word()
        return f"<div><i>{a}</i> &amp;&#32;<b>{b}</b></div>", [f"{a} & {b}"]
    if kind == "div":
        parts = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return f"<div>{''.join(h for h, _ in parts)}</div>", [x for _, b in parts for x in b]
    if kind in ("ul", "ol"):
        items, out = [], []
        for i in range(rng.randint(1, 3)):
            w, mark = word(), f"{i + 1}. " if kind == "ol" else "- "
            h, sub = tree(rng, depth - 1, ("ul", "ol", "text"))
            body = [w, *[x for x in sub if x]]
            items.append(f"<li>{w}{h}")
            out += [(mark if not j else " " * len(mark)) + x for j, x in enumerate(body)]
        return f"<{kind}>{''.join(items)}</{kind}>", [None, *out, None]
    rows = [[word() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
    wide = [max(len(r[c]) for r in rows if c < len(r)) for c in range(max(map(len, rows)))]
    out = ["  ".join(c.ljust(wide[i]) for i, c in enumerate(r)).rstrip() for r in rows]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>", [None, *out, None]


def test_generated_trees():
    rng = random.Random(21)
    for _ in range(400):
        parts = [tree(rng, 3) for _ in range(rng.randint(1, 4))]
        lines: list[str] = []
        gap = False
        for x in [x for _, b in parts for x in b]:
            if x is None:
                gap = True
                continue
            if gap and lines:
                lines.append("")
            gap = False
            lines.append(x)
        assert html_text.page_text("<body>" + "".join(h for h, _ in parts)) == "\n".join(lines)


def test_depth_changes_no_rule():
    for depth in (1, 39, 60, 150):
        text = html_text.page_text("<ul><li>" * depth + "x")
        assert text == "- " * depth + "x"
        text = html_text.page_text("<table><tr><td>" * depth + "<table><tr><td>ab<td>c<tr><td>d<td>e</table>")
        assert text == "ab  c\nd   e"


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    assert html_text.page_text("<div>" * 50_000 + "</b>" * 50_000 + "x") == "x"
    assert html_text.page_text("<div hidden>" * 50_000 + "x") == ""
    html_text.page_text("<ul><li>" * 20_000 + "x")
    html_text.page_text("<a =\"'" * 20_000)
    assert time.perf_counter() - began < 20
