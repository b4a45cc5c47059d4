"""Format copies, look-alikes, residue, main content, near copies and personal information."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import format_copies, lookalike, main_content, near_copies, page_blocks, personal, residue

PAGES = "page_id bigint, title string, meta_description string, h1s array<string>, html string"


def pages(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in ("page_id", "title", "meta_description", "h1s", "html")) for r in rows], PAGES)


def test_format_copies(spark):
    rows = [
        dict(page_id=5, title="Rugs 12 – Shop", meta_description="Fine rugs, by hand."),
        dict(page_id=7, title="SHOP | rugs\t12", meta_description="fine RUGS (by) hand"),
        dict(page_id=7, title="SHOP | rugs\t12", meta_description="fine RUGS (by) hand"),
        dict(page_id=8, title="Rugs-12 - Shop - !", meta_description="“Fine” rugs by hand…"),
        dict(page_id=9, title="Rugs 12–Shop", meta_description="Fine rugs, by hand."),  # no white space round the dash: one part
        dict(page_id=10, title="Rugs 12 – Shop", meta_description="Fine rugs by no hand."),
        dict(page_id=11, title="Meißel :: A", meta_description="Große Meißel"),
        dict(page_id=12, title="A » MEISSEL", meta_description="GROSSE MEISSEL"),
        dict(page_id=13, title=None, meta_description="x"), dict(page_id=14, title="...", meta_description="x"), dict(page_id=None, title="A", meta_description="x"),
    ]
    df = pages(spark, rows).withColumns({"key": F.lit(1), "cheap": F.lit("z"), "first_page_id": F.lit(0)})
    assert sorted(tuple(r) for r in format_copies.format_copies(df).collect()) == [(5, 7), (5, 8), (11, 12)]
    assert sorted(tuple(r) for r in format_copies.collapsed(df).collect()) == [(5, 3), (11, 2)]
    assert format_copies.format_copies(pages(spark, [])).count() == 0


def test_format_copies_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "Same – Site").otherwise(F.concat(F.lit("t"), "id")).alias("title"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("d"), "id")).alias("meta_description"),
    )
    assert format_copies.format_copies(df).count() == 999


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ｃｏｍｐａｒｅ　ｍｕｇｓ", "Compare mugs"), ("ba​g­s", "bags"), ("a b c", "a b c"), ("été", "été"), ("ﬁne", "fine"),
        ("bаskеts", "baskets"), ("Тhe tidy Κettle", "The tidy Kettle"),
    ],
)
def test_lookalikes_are_brought_to_one_form(text, want):
    assert lookalike.canonical(text, lookalike.Bigrams({})) == want


@pytest.mark.parametrize(
    "text", ["1\tb\nc", "“quoted” – it’s…", "Лучший лёгкий рюкзак", "Σκεύη για κάθε κουζίνα", "ẹ́kọ̀ọ́", "👨‍👩‍👧", "🏳️‍🌈", "1️⃣", "12 m² ½ × Ω-3 ‰", "", "می‌خواهم", "Øresund Łódka naïve"]
)
def test_what_must_stay(text):
    assert lookalike.canonical(text, lookalike.Bigrams({})) == text


def test_lookalike_rows(spark):
    rows = [dict(page_id=1, title="ok", h1s=["fi​ne", None, "ok"]), dict(page_id=1, title="ok", h1s=["fi​ne", None, "ok"]), dict(page_id=2, title=None, h1s=None), dict(page_id=3, title="x" * 20_000 + " ")]
    assert sorted(tuple(r) for r in lookalike.lookalike_found(pages(spark, rows)).collect()) == [(1, "h1", 0), (3, "title", 0)]
    assert lookalike.lookalike_found(pages(spark, [])).count() == 0


BODY = "".join(f"<p>The sturdy lamp number {i} carries gentle mugs near the window for small teams.</p>" for i in range(6))
PAGE = (
    '<html><body><header><nav><ul><li><a href="/shop">Shop</a></li><li><a href="/help">Help</a></li></ul></nav></header><main><div class="cookie-banner">'
    "<p>We use cookies to make this site work and to measure visits.</p><button>OK</button></div><article><h1>Lamps</h1>{}</article></main>"
    "<footer><p>All rights reserved.</p></footer></body></html>"
)


def test_blocks_are_numbered_by_start_tags():
    got = page_blocks.blocks("<body><P>one<ul><LI>two <b>x</b>y</ul><pre>p</pre><!-- <p>no --><script>'<p>'</script><p></p>tail")
    assert [(b.no, b.text.strip()) for b in got if b.no >= 0] == [(0, "one"), (1, "two xy"), (2, "")]
    assert page_blocks.blocks(None) == [] == page_blocks.blocks("")


def test_main_content(spark):
    rows = [dict(page_id=1, html=PAGE.format(BODY)), dict(page_id=1, html=PAGE.format(BODY)), dict(page_id=2, html=None), dict(page_id=3, html=""), dict(page_id=4, html="<!-- non-html -->"), dict(page_id=5, html="<p>" + "word " * 200_000)]
    got = {}
    for r in main_content.main_found(pages(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r.block_no)
    assert sorted(got[1]) == [3, 4, 5, 6, 7, 8] and 2 not in got and 3 not in got
    texts = {r.page_id: r.main_text for r in main_content.main_texts(pages(spark, rows)).collect()}
    assert "cookies" not in texts[1] and "lamp number 5" in texts[1] and texts[2] == ""


def test_labeller_gradients():
    import numpy as np

    from pagemill.llm import block_model as M

    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in M.fresh().items()}
    x, mask = M.pad([rng.normal(size=(n, M.INPUT)).astype(np.float32) for n in (4, 2)])
    want = rng.random(mask.shape)

    def loss():
        logit, state = M.forward(w, x, mask, keep=True)
        return float(((logit - want) ** 2 * mask).sum() / 2), state, (logit - want) * mask

    _, state, d = loss()
    grads, _ = M.backward(w, state, d.astype(np.float32), mask)
    for name in ("xf", "hb", "cf", "out"):
        at = tuple(int(rng.integers(s)) for s in w[name].shape)
        old = w[name][at]
        w[name][at] = old + 1e-2
        up = loss()[0]
        w[name][at] = old - 1e-2
        down = loss()[0]
        w[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 0.02 + 0.05 * abs(grads[name][at])


def test_residue(spark):
    rows = [
        dict(page_id=1, title="{{ page.title }}", html=PAGE.format(BODY)), dict(page_id=2, title="Lamps", html=PAGE.format(BODY)),
        dict(page_id=3, title="x", html="<body><h1>Page not found</h1>We could not find the page you asked for.</body>"),
        dict(page_id=4, title="x", html='<body><div id="root"></div><noscript>You need to enable JavaScript to run this app.</noscript></body>'),
        dict(page_id=5, title="x", html=PAGE.format("<noscript>You need to enable JavaScript to run this app.</noscript>" + BODY)),
        dict(page_id=6, title="Writing a good “page not found” text", html=PAGE.format(BODY + "<p>A text that says page not found helps.</p>")),
        dict(page_id=7, title="Templates", html=PAGE.format(BODY + "<pre><code>{{ title }} and &lt;%= x %&gt;</code></pre>")),
        dict(page_id=8, title="Lorem Lamps: our new range", html=PAGE.format(BODY)),
        dict(page_id=9, title="x", html=PAGE.format("<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor.</p>")),
        dict(page_id=10, title="undefined | Site", html=PAGE.format(BODY)), dict(page_id=11, title=None, html=None), dict(page_id=12, title="", html="<body></body>"),
        dict(page_id=13, title="x", html=PAGE.format(BODY + "<p>The gentle mugs fit lamps near the window. Hello %%first_name%%, your order is ready.</p>")),
    ]
    assert sorted(r.page_id for r in residue.residue_found(pages(spark, rows + rows[:1])).collect()) == [1, 3, 4, 9, 10, 13]
    assert residue.without_residue(pages(spark, rows)).count() == 7


def words(n, seed):
    rng = random.Random(seed)
    return ["the sturdy lamp carries gentle mugs near a window for small teams and plain rugs".split()[rng.randrange(15)] + str(rng.randrange(90)) for _ in range(n)]


def as_page(ws):
    return PAGE.format("".join(f"<p>{' '.join(ws[i : i + 12])}.</p>" for i in range(0, len(ws), 12)))


def test_near_copies_equal_brute_force(spark):
    texts = {}
    for group in range(6):
        base = words(90, group)
        for k in range(4):
            edited, rng = list(base), random.Random(group * 10 + k)
            for _ in range(rng.randrange(0, 9)):
                edited[rng.randrange(len(edited))] = f"edit{rng.randrange(9)}"
            texts[group * 10 + k + 1] = edited[rng.randrange(0, 10) :]
    texts[100], texts[101], texts[102] = texts[1], texts[1], ["short"]
    rows = [dict(page_id=i, html=as_page(w)) for i, w in texts.items()] + [dict(page_id=1, html=as_page(texts[1])), dict(page_id=500, html=None)]
    df = pages(spark, rows)
    runs = {}
    for i, (page, main) in zip([r["page_id"] for r in rows], main_content.labelled([r["html"] for r in rows])):
        ws = [w for b, y in zip(page, main) if y and b.no >= 0 for w in re.findall(r"[^\W_]+", b.text.casefold())]
        runs[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    ids = sorted(i for i in runs if runs[i])
    want = {(a, b) for a in ids for b in ids if a < b and 10 * len(runs[a] & runs[b]) >= 6 * len(runs[a] | runs[b])}
    got = {tuple(r) for r in near_copies.near_pairs(df).collect()}
    assert got == want and len(want) > 8
    groups = {r.page_id: r.class_id for r in near_copies.near_groups(df).collect()}
    assert groups[100] == groups[101] == groups[1] == 1
    assert near_copies.near_pairs(pages(spark, [])).count() == 0


def test_many_copies_stay_a_star(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "EXPANDED", 5)
    rows = [dict(page_id=i, html=as_page(words(60, 1))) for i in range(20)]
    assert sorted(tuple(r) for r in near_copies.near_pairs(pages(spark, rows)).collect()) == [(0, i) for i in range(1, 20)]


def test_no_join_of_runs_or_segments_is_broadcast(spark):
    reps = spark.range(4).selectExpr("id as page_id", "3 as n", "array(1L, 2L, 3L) as runs", "array(7L, 8L) as segments", "array(1, 2) as counts")
    vector = near_copies.vectors(reps)
    entered = spark.range(4).selectExpr("id as page_id", "3L << 32 as size", "0L as sum0", "0L as sum1", "array(id) as cells", "array(id + 1) as above")
    for df in (vector, near_copies.candidates(entered, 60), near_copies.similar_classes(reps, entered, 60)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_popcount_distance_is_a_lower_bound(spark):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 90))] for _ in range(10)]
    texts += [[w if rng.random() > 0.05 else "edit" for w in t] for t in texts]
    prints = [near_copies.fingerprint(t) for t in texts]
    rows = [(i, len(r), r.tolist(), s.tolist(), c.tolist()) for i, (r, s, c) in enumerate(prints)]
    df = spark.createDataFrame(rows, "page_id bigint, n int, runs array<bigint>, segments array<bigint>, counts array<int>")
    assert all(sum(c) == n for _, n, _, _, c in rows)
    # The whole vectors.
    for i, (r, s, c) in enumerate(prints):
        for q, t, d in prints[:i]:
            one, two = dict(zip(s.tolist(), c.tolist())), dict(zip(t.tolist(), d.tolist()))
            assert sum(abs(one.get(k, 0) - two.get(k, 0)) for k in one | two) <= len(set(r.tolist()) ^ set(q.tolist()))
    # What is tested inside a cell, for every pair that enters the grid at some low threshold.
    met = near_copies.posts(near_copies.vectors(df), 1).alias("l").join(near_copies.posts(near_copies.vectors(df), 1).alias("r"), F.col("l.page_id") < F.col("r.page_id"))
    alone = lambda x: F.col(f"{x}.size").bitwiseAND(F.lit((1 << 32) - 1))
    found = met.select(F.col("l.page_id").alias("a"), F.col("r.page_id").alias("b"), (alone("l") + alone("r") + near_copies._manhattan("l", "r")).alias("d")).collect()
    assert len(found) > 40
    for r in found:
        assert r.d <= len(set(prints[r.a][0].tolist()) ^ set(prints[r.b][0].tolist()))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to mara+seo@bebo.test now", [("email", "mara+seo@bebo.test")]), ("ping web-team (at) bilano [dot] example or", [("email", "web-team (at) bilano [dot] example")]),
        ("at quill90 at bedile [dot] invalid", [("email", "quill90 at bedile [dot] invalid")]), ("mаra@bеbo.test", [("email", "mаra@bеbo.test")]),
        ("call +44 (0)20 7946 0053 or (212) 555-0148", [("phone", "+44 (0)20 7946 0053"), ("phone", "(212) 555-0148")]), ("Tel.: (030) 23125 690", [("phone", "(030) 23125 690")]),
        ("call two one two five five five zero one four eight please", [("phone", "two one two five five five zero one four eight")]),
        ("social security number 987-65-4321", [("id_number", "987-65-4321")]), ("Documento: X-0000691-J", [("id_number", "X-0000691-J")]), ("noté : 1 73 13 99 760 920 35.", [("id_number", "1 73 13 99 760 920 35")]),
        ("at 130 Fennel Court, Nether Pell ZX1 4QZ.", [("address", "130 Fennel Court, Nether Pell ZX1 4QZ")]), ("wohnt Am Alten Kran 151a.", [("address", "Am Alten Kran 151a")]),
        ("vive en Calle del Olmo Gris, 160, 2.º B, 00210 Puerto Gris", [("address", "Calle del Olmo Gris, 160, 2.º B, 00210 Puerto Gris")]), ("20 rue des Tilleuls-Noirs, 00340 Bresque", [("address", "20 rue des Tilleuls-Noirs, 00340 Bresque")]),
        ("9 Fennel Court, Nether Pell Irene Wexdell wrote", [("address", "9 Fennel Court, Nether Pell"), ("name", "Irene Wexdell")]), ("Tel. 020 7946 0717 184 pages", [("phone", "020 7946 0717")]),
        ("Tel.: (030) 23125 980 68 Seiten", [("phone", "(030) 23125 980")]), ("+33 (0)6 39 98 70 40 205 plans", [("phone", "+33 (0)6 39 98 70 40")]), ("+34 555 044 144 98 rastreos", [("phone", "+34 555 044 144")]),
        ("with Ruth Wexlow today", [("name", "Ruth Wexlow")]), ("owner Thorpmere, Owen", [("name", "Thorpmere, Owen")]), ("asked Dr. Quilllow about", [("name", "Quilllow")]), ("M. Valcey habite ici", [("name", "Valcey")]),
        ("From: I. WEXLOW", [("name", "I. WEXLOW")]), ("f. H. Krosswald meldet", [("name", "H. Krosswald")]),
        ("Order 0040431126 has 31 lines. GTIN 010157610882 fails. The 404 Lane template. hero@2x.png audit-kit@3.26.1 192.0.2.18 Build 2025.22.35 #31715760", []), ("", []),
    ],
)
def test_personal(text, want):
    assert [(kind, text[a:b]) for a, b, kind in personal.find(text)] == want


def test_personal_rows(spark):
    long = "The lamps hold. " * 40_000 + "Ask mara@bebo.test."
    rows = [(1, "Mail mara@bebo.test\n"), (1, "Mail mara@bebo.test\n"), (2, None), (3, ""), (None, "a@b.test"), (4, long), (5, "👍 \U0001f680 a@b.test")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit(0))
    assert sorted(tuple(r) for r in personal.personal_found(df).collect()) == [(1, "email", 5), (4, "email", long.index("mara")), (5, "email", 4)]
    assert {r.text for r in personal.redacted(df).where("doc_id in (1, 3)").collect()} == {"Mail [EMAIL]\n", ""}
    assert personal.personal_found(df.where("doc_id < 0")).count() == 0


def test_normalisation_maps_back():
    text = "x​y (at) z"
    n = personal.normalise(text)
    assert n.text == "xy@z" and [n.back(i, i + 1) for i in range(4)] == [(0, 1), (2, 3), (8, 9), (9, 10)]
