"""Recall and precision of personal information on sentences that no test table holds."""

import re
from pathlib import Path

from pagemill.llm import personal

_MARK = re.compile(r"\{(\w+):([^}|]*)(?:\|([^}]*))?\}")


def read(path):
    """(text, items) of a file; an item after a bar is what counts of the text in the braces."""
    lines = [x for x in path.read_text("utf-8").splitlines() if not x.startswith("#")]
    text, items, at = [], set(), 0
    whole = "\n".join(lines) + "\n"
    size = 0
    for m in _MARK.finditer(whole):
        text.append(whole[at : m.start()])
        size += m.start() - at
        inner = m[2]
        place = inner.index(m[3]) if m[3] else 0
        items.add((size + place, size + len(inner), m[1]))
        text.append(inner)
        size += len(inner)
        at = m.end()
    return "".join(text) + whole[at:], items


def figures():
    want_all, got_all, misses, extras = 0, 0, [], []
    text, items = read(Path(__file__).with_name("heldout_personal.txt"))
    # Each line is a document of its own, but a closing and the name below it belong together.
    start = 0
    for line in re.findall(r"[^\n]*(?:regards|Grüßen|Cordialement|Saludos),?\n[^\n]*\n|[^\n]*\n", text):
        own = {(a - start, b - start, k) for a, b, k in items if start <= a < start + len(line)}
        found = set(personal.find(line))
        misses += [(line[a:b], k) for a, b, k in own - found]
        extras += [(line[a:b], k) for a, b, k in found - own]
        want_all += len(own)
        got_all += len(found)
        start += len(line)
    return want_all, got_all, misses, extras


def test_recall_and_precision():
    want, got, misses, extras = figures()
    assert want - len(misses) >= 0.9 * want, misses
    assert got - len(extras) >= 0.9 * got, extras


if __name__ == "__main__":
    print(*figures(), sep="\n")
