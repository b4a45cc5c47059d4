"""Recall and precision of residue on pages that no test table holds."""

from pathlib import Path

from pagemill.llm import residue
from pagemill.llm.main_content import labelled

LINES = [x for x in Path(__file__).with_name("heldout_residue.txt").read_text("utf-8").splitlines() if x and x[0] in "+-"]


def figures():
    rows = [(x[0] == "+", *(p.strip() for p in x[2:].split(" | ", 1))) for x in LINES]
    htmls = [residue.without_code(f"<html><body><main>{body.replace('<<', '&lt;&lt;').replace('>>', '&gt;&gt;')}</main></body></html>") for _, _, body in rows]
    found = [residue.is_residue(title, page, main) for (_, title, _), (page, main) in zip(rows, labelled(htmls))]
    misses = [r[1:] for r, f in zip(rows, found) if r[0] and not f]
    extras = [r[1:] for r, f in zip(rows, found) if f and not r[0]]
    return sum(r[0] for r in rows), sum(found), misses, extras


def test_recall_and_precision():
    want, got, misses, extras = figures()
    assert want - len(misses) >= 0.9 * want, misses
    assert got - len(extras) >= 0.9 * got, extras


if __name__ == "__main__":
    print(*figures(), sep="\n")
