"""Recall and precision of the main body on hand-written pages of layouts that no test table holds."""

import re
from pathlib import Path

from pagemill.llm.main_content import labelled

PAGES = [p.split("-->", 1) for p in Path(__file__).with_name("heldout_pages.html").read_text("utf-8").split("<!--page: ")[1:]]


def figures():
    hit, misses, extras = 0, [], []
    htmls = [html.replace(" data-m>", ">") for _, html in PAGES]
    for (name, html), (page, main) in zip(PAGES, labelled(htmls)):
        want = {i for i, m in enumerate(re.finditer(r"<(?:p|li)\b[^>]*>", html)) if "data-m" in m[0]}
        found = {b.no for b, y in zip(page, main) if y and b.no >= 0}
        text = {b.no: b.text[:50] for b in page}
        hit += len(want & found)
        misses += [(name, text[i]) for i in sorted(want - found)]
        extras += [(name, text[i]) for i in sorted(found - want)]
    return hit, misses, extras


def test_recall_and_precision():
    hit, misses, extras = figures()
    assert hit >= 0.9 * (hit + len(misses)), misses
    assert hit >= 0.9 * (hit + len(extras)), extras


if __name__ == "__main__":
    hit, misses, extras = figures()
    print(hit, len(misses), len(extras))
    print(*misses, "--", *extras, sep="\n")
