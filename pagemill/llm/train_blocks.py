"""python -m pagemill.llm.train_blocks FOLDER [PAGES [INVENTED]]: fit the block labeller and write its weights.

The labeller is fitted on INVENTED pages of many layouts, whose main body is known (page_layouts), and on a bounded
sample of the folder's pages (the PAGES lowest hashes of page_id), whose labels are made here from structure and a few
phrases.  Half of the latter lose all class names while fitting, so that the labeller reads words and layout too.  The
operator never uses these labels; it only reads the weights.
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter
from zlib import crc32

import numpy as np

from pagemill.llm import block_model as M
from pagemill.llm import page_blocks as B
from pagemill.llm import page_layouts

SAMPLE_PAGES, INVENTED_PAGES = 6_000, 8_000
#: Phrases of author boxes and cookie notices in the languages of the pages.
AUTHOR = re.compile(r"\b(writes for|schreibt für|écrit pour|escribe para)\b|^(By|Von|Par|Por) [A-Z]\S+ [A-Z]\S+$", re.I)
COOKIES = re.compile(r"\bcookies?\b", re.I)
LEGAL = re.compile(r"rights reserved|Rechte vorbehalten|droits réservés|derechos reservados|prices include|inklusive Steuer|taxes comprises|incluyen impuestos", re.I)
INSIDE = {"ul", "ol", "dl", "table", "tr", "td", "blockquote", "figure", "center"}
ASIDE = {"nav", "aside", "footer", "header", "form"}
BOX_NAMES = re.compile(r"\.(menu|sidebar|footer|share|newsletter|cookie|breadcrumb|author|related|teaser|nav)")


def teach(page: list[B.Block]) -> np.ndarray:
    """1 for blocks of the main body, by rules."""
    boxes: dict[int, list[B.Block]] = {}
    for b in page:
        boxes.setdefault(b.box, []).append(b)
    main = next((b.box for b in page if b.kind == B.LEAVES["h1"]), None)

    def is_box(path: tuple[str, ...]) -> bool:
        return any(t in ASIDE or BOX_NAMES.search(t) for t in path)

    if main is None:
        best = {
            k: sum(len(b.text) - 2 * b.linked for b in own if b.kind <= 1)
            + 5000 * any(re.search(r"^(article|main)$|\.content", t) for t in own[0].path)
            - 5000 * (own[0].kind == B.LEAVES["h3"] or own[0].path[-1:] == ("ul",))
            for k, own in boxes.items()
            if not is_box(own[0].path)
            and not any(COOKIES.search(b.text) or LEGAL.search(b.text) or b.kind == B.VOID["input"] for b in own)
        }
        main = max(best, key=best.get) if best else -1
    base = boxes[main][0].path if main in boxes else ()
    out = np.zeros(len(page), np.float32)
    for i, b in enumerate(page):
        rest = b.path[len(base) :] if b.path[: len(base)] == base else None
        if rest is None or is_box(b.path):
            continue
        own = boxes[b.box]
        if b.box != main and (not rest or any(t.split(".")[0] not in INSIDE for t in rest)):
            continue
        if b.box != main and own and all(x.links and x.linked >= len(x.text.strip()) and len(x.text.split()) <= 3 for x in own if x.text.strip()):
            continue
        if b.links and re.search("[›»>]", b.text) and b.linked > 0.4 * len(b.text):
            continue
        out[i] = not AUTHOR.search(b.text.strip())
    return out


def pages_of(folder: str, most: int) -> list[tuple[str, str]]:
    """(site_id, html) of the sampled pages; at most a twentieth of them is of one site."""
    import pyarrow.dataset as ds

    t = ds.dataset(f"{folder}/pages.parquet").to_table(columns=["page_id", "site_id", "html"])
    rows = {p: (s, h) for p, s, h in zip(*(t[c].to_pylist() for c in ("page_id", "site_id", "html"))) if h}
    taken: Counter = Counter()
    out = []
    for p in sorted(rows, key=lambda p: crc32(str(p).encode())):
        taken[rows[p][0]] += 1
        if len(out) < most and taken[rows[p][0]] <= max(3, most // 20):
            out.append(rows[p])
    return out


def shared_words(pages: list[tuple[str, list[B.Block]]], sites: int = 4) -> np.ndarray:
    """Hashes of the words that at least so many sites of the sample use."""
    users: dict[int, set[str]] = {}
    for site, page in pages:
        for b in page:
            for word in B._WORDS.findall(b.text):
                users.setdefault(B.word_hash(word), set()).add(site)
    return np.array(sorted(h for h, s in users.items() if len(s) >= sites), np.uint32)


def _nameless(page: list[B.Block]) -> list[B.Block]:
    out = []
    for b in page:
        c = B.Block(b.kind, b.no, tuple(t for t in b.path if "." not in t), b.box)
        c.text, c.linked, c.links = b.text, b.linked, b.links
        out.append(c)
    return out


def invented(seeds: range) -> list[tuple[list[B.Block], np.ndarray]]:
    """Blocks and labels of invented pages; the signs that carry the labels are taken out."""
    out = []
    for seed in seeds:
        page = B.blocks(page_layouts.page(seed))
        label = np.array(["\ue001" in b.text for b in page], np.float32)
        for b in page:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "")
        out.append((page, label))
    return out


def fit(pages: list[list[B.Block]], more: list[tuple[list[B.Block], np.ndarray]], epochs: int = 7, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    w = M.fresh()
    taught = [teach(p) for p in pages] + [y for _, y in more]
    read = [(B.read(p), B.read(_nameless(p))) for p in pages] + [(B.read(p),) * 2 for p, _ in more]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order, losses, t0 = rng.permutation(len(read)), [], time.time()
        for at in range(0, len(order), batch):
            group = order[at : at + batch]
            chosen = [read[k][int(rng.random() < 0.5)] for k in group]
            # Words are forgotten at random so that no single one decides.
            kept = [rng.random(len(c[1])) > 0.15 for c in chosen]
            sizes = [len(c[0]) for c in chosen]
            base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            n = sum(sizes)
            words = np.concatenate([c[1][k] for c, k in zip(chosen, kept)])
            of_word = np.concatenate([c[2][k] + b for c, k, b in zip(chosen, kept, base)])
            paths = np.concatenate([c[3] for c in chosen])
            of_path = np.concatenate([c[4] + b for c, b in zip(chosen, base)])
            flat = M.encode(w, np.concatenate([c[0] for c in chosen]), words, of_word, paths, of_path)
            x, mask = M.pad(np.split(flat, base[1:]))
            want = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(group):
                want[: sizes[j], j] = taught[k]
            logit, state = M.forward(w, x, mask, keep=True)
            p = 1 / (1 + np.exp(-logit))
            losses.append(float(-(np.log(np.where(want > 0.5, p, 1 - p) + 1e-7) * mask).sum() / n))
            grads, dx = M.backward(w, state, ((p - want) * mask / n).astype(np.float32), mask)
            dflat = np.concatenate([dx[: sizes[j], j] for j in range(len(group))])
            share = np.maximum(1, np.bincount(of_word, minlength=n))[of_word][:, None]
            grads["word"] = np.zeros_like(w["word"])
            np.add.at(grads["word"], words, dflat[of_word, : M.WORD_SIZE] / share)
            share = np.maximum(1, np.bincount(of_path, minlength=n))[of_path][:, None]
            grads["path"] = np.zeros_like(w["path"])
            np.add.at(grads["path"], paths, dflat[of_path, M.WORD_SIZE : M.WORD_SIZE + M.PATH_SIZE] / share)
            step += 1
            now = rate * min(1, step / 50) * 0.5 * (1 + np.cos(np.pi * step / (epochs * (len(order) // batch + 1))))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {np.mean(losses):.4f}, {time.time() - t0:.0f} s", flush=True)
    return w


def measure(pages: list[list[B.Block]], labels: list[np.ndarray]) -> tuple[int, int, int]:
    """Numbered blocks that agree with the labels, that are missed, that are too many."""
    hit = missed = extra = 0
    for page, logit, label in zip(pages, M.label([B.read(p) for p in pages]), labels):
        for b, x, y in zip(page, logit, label):
            if b.no >= 0:
                hit, missed, extra = hit + (x > 0 and y > 0), missed + (x <= 0 and y > 0), extra + (x > 0 and y <= 0)
    return hit, missed, extra


def main(folder: str, most: int = SAMPLE_PAGES, made: int = INVENTED_PAGES) -> None:
    sampled = [(s, p) for s, p in ((s, B.blocks(h)) for s, h in pages_of(folder, most)) if p]
    more = invented(range(made))
    # An invented page is a site of its own.
    known = shared_words(sampled + [(f"invented {i}", p) for i, (p, _) in enumerate(more)])
    B.know(known)
    print(len(sampled), "pages,", len(more), "invented,", len(known), "known words", flush=True)
    pages = [p for _, p in sampled]
    w = fit(pages, more)
    np.savez_compressed(M.WEIGHTS, known=known, **{k: v.astype(np.float16) for k, v in w.items()})
    held = invented(range(1_000_000, 1_000_500))
    print("pages: hit, missed, extra:", measure(pages[:1000], [teach(p) for p in pages[:1000]]))
    print("invented, other seeds: hit, missed, extra:", measure([p for p, _ in held], [y for _, y in held]))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
