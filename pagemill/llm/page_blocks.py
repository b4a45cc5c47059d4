"""Leaf blocks of an HTML page, in order, with what a block labeller reads of each.

A page is scanned once by its tags.  A block is a stretch of text that no block or container tag interrupts; p and li
elements are numbered from 0 by their start tags and keep an entry even when they hold no text.  Scripts, styles and
comments hold no blocks.
"""

from __future__ import annotations

import html as entities
import re
from zlib import crc32

import numpy as np

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S | re.I
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]+)", re.I)
#: Class names with a digit are usually made by a build tool and say nothing.
_GENERATED = re.compile(r"\d")
_WORDS = re.compile(r"[^\W\d_]+|\d+")

#: Elements that hold blocks, that are blocks, and void ones that count as blocks without text.
CONTAINERS = frozenset("body div section article main header nav aside footer ul ol dl table tr td th form center figure blockquote".split())
LEAVES = {name: i for i, name in enumerate("p li h1 h2 h3 h4 h5 h6 button pre dt dd".split())}
VOID = {name: len(LEAVES) + i for i, name in enumerate("img input hr".split())}
OTHER = len(LEAVES) + len(VOID)
KINDS = OTHER + 1

WORD_BUCKETS = 8192
PATH_BUCKETS = 256
NUMBERS = 14


class Block:
    """One leaf: kind, number among p and li (or -1), distinct path tokens, container serial, raw text, link text and counts."""

    __slots__ = ("kind", "no", "path", "box", "text", "linked", "links", "raw")

    def __init__(self, kind: int, no: int, path: tuple[str, ...], box: int):
        self.kind, self.no, self.path, self.box = kind, no, path, box
        self.raw: list[str] = []
        self.text = ""
        self.linked = 0
        self.links = 0


def blocks(html: str | None) -> list[Block]:
    """All blocks of a page; a null or empty page has none."""
    if not html:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = [("", (), 0)]
    serial, number, at, in_link = 0, 0, 0, False
    block: Block | None = None
    start = html.lower().find("<body")
    if start < 0:
        end_of_head = html.lower().find("</head")
        start = max(end_of_head, 0)
    at = start
    for m in _TAG.finditer(html, start):
        if m.start() > at:
            piece = html[at : m.start()]
            if block is None and not piece.isspace():
                block = Block(OTHER, -1, stack[-1][1], stack[-1][2])
                out.append(block)
            if block is not None:
                block.raw.append(piece)
                if in_link:
                    block.linked += len(piece)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name == "a":
                in_link = False
            elif name in LEAVES:
                block = None
            elif name in CONTAINERS:
                block = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
        elif name in LEAVES:
            no = -1
            if name == "p" or name == "li":
                no, number = number, number + 1
            block = Block(LEAVES[name], no, stack[-1][1], stack[-1][2])
            out.append(block)
            in_link = False
        elif name in CONTAINERS:
            serial += 1
            own = _NAMES.findall(m[4]) if m[4] else []
            tokens = (name, *(f"{name}.{t}" for names in own for t in names.lower().split() if not _GENERATED.search(t)))
            above = stack[-1][1]
            stack.append((name, above + tuple(t for k, t in enumerate(tokens) if t not in above and t not in tokens[:k]), serial))
            block = None
        elif name == "a":
            in_link = True
            if block is None:
                block = Block(OTHER, -1, stack[-1][1], stack[-1][2])
                out.append(block)
            block.links += 1
        elif name in VOID:
            out.append(Block(VOID[name], -1, stack[-1][1], stack[-1][2]))
            if name != "img":
                block = None
    if at < len(html) and html[at:].strip():
        if block is None:
            block = Block(OTHER, -1, stack[-1][1], stack[-1][2])
            out.append(block)
        block.raw.append(html[at:])
    for b in out:
        text = "".join(b.raw)
        b.text = entities.unescape(text) if "&" in text else text
    return out


_word_ids: dict[str, int] = {}
_path_ids: dict[str, int] = {}
#: Hashes of the words that several sites use, set with the weights; all other words share one bucket.
_known: set[int] = set()


def know(hashes: np.ndarray) -> None:
    _known.clear()
    _known.update(map(int, hashes))
    _word_ids.clear()


def word_hash(word: str) -> int:
    return crc32(word.lower().encode())


def _word_id(word: str) -> int:
    """A bucket: 0 for numbers, 1 for words that few sites use.  The memo is bounded and only saves time."""
    if len(_word_ids) > 300_000:
        _word_ids.clear()
    h = word_hash(word)
    value = 0 if word[0].isdigit() else 2 + h % (WORD_BUCKETS - 2) if h in _known else 1
    _word_ids[word] = value
    return value


def path_id(token: str) -> int:
    found = _path_ids.get(token)
    if found is None:
        if len(_path_ids) > 100_000:
            _path_ids.clear()
        found = _path_ids[token] = crc32(token.encode()) % PATH_BUCKETS
    return found


def read(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers per block, and flat word and path buckets with the block each belongs to."""
    n = len(page)
    numbers = np.zeros((n, KINDS + NUMBERS), np.float32)
    words: list[int] = []
    of_word: list[int] = []
    paths: list[int] = []
    of_path: list[int] = []
    last_box, in_box = -1, 0
    get = _word_ids.get
    for i, b in enumerate(page):
        found = _WORDS.findall(b.text)
        count = len(found)
        ids = [get(w) for w in found]
        if None in ids:
            ids = [_word_id(w) if k is None else k for w, k in zip(found, ids)]
        words += ids
        of_word += [i] * count
        paths += map(path_id, b.path)
        of_path += [i] * len(b.path)
        same = b.box == last_box
        in_box = in_box + 1 if same else 0
        size = max(1, len(b.text))
        tail = b.text.rstrip()[-1:]
        row = numbers[i]
        row[b.kind] = 1
        row[KINDS:] = (
            not same, b.box < last_box, count == 0, min(3.0, np.log1p(count)) if count else 0, min(1.0, b.linked / size),
            b.links > 0, b.links > 1, tail in (".", "!", "?", "…"), min(2.0, in_box / 5), len(b.path) / 6,
            i / n, (n - i) / 40, i / 40, tail == ":",
        )
        last_box = b.box
    return numbers, np.array(words, np.int32), np.array(of_word, np.int32), np.array(paths, np.int32), np.array(of_path, np.int32)
