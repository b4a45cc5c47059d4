"""Patches apply to the texts they are made against."""

import subprocess

import pytest

from pagemill.operators import fixes


@pytest.mark.parametrize("rule", sorted(fixes.LINES))
@pytest.mark.parametrize("framework", sorted(fixes.FILES))
def test_patch_applies(rule, framework, tmp_path):
    made = fixes.patch(rule, framework, "https://x.example")
    part = fixes.LINES[rule][0]
    name = fixes.FILES[framework][part]
    text = fixes.SKELETON if part in ("layout", "page") else fixes.ROBOTS if rule == "framework-robots-no-sitemap" else None
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    if text:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    subprocess.run(["git", "apply"], input=made.encode(), cwd=tmp_path, check=True)
    assert (tmp_path / name).read_text() == fixes.changed(rule, text, "https://x.example")


def test_places():
    assert fixes.changed("indexing-html-lang-missing", "<html class='a'>") == "<html lang=\"en\" class='a'>"
    assert fixes.changed("indexing-html-lang-missing", '<html lang="fr">') is None and fixes.changed("schema-missing", "no head") is None
    assert fixes.changed("framework-robots-no-sitemap", "User-agent: *\n", "https://x") == "User-agent: *\nSitemap: https://x/sitemap.xml\n"


def test_patched(spark):
    found = spark.createDataFrame([("s", "perf-viewport-missing"), ("s", "img-broken"), ("t", "framework-sitemap-missing")], "site_id string, rule_id string")
    files = spark.createDataFrame(
        [("s", "nuxt", "https://s", "app.vue", "<html><head>\n</head></html>\n"), ("s", "nuxt", "https://s", "other.vue", "<head>\n"), ("t", None, "https://t", "sitemap.xml", None)],
        "site_id string, framework string, origin string, file string, text string",
    )
    got = {(r.site_id, r.rule_id, r.file): r.patch for r in fixes.patched(found, files).collect()}
    assert set(got) == {("s", "perf-viewport-missing", "app.vue"), ("t", "framework-sitemap-missing", "sitemap.xml")}
    assert "+++ b/app.vue" in got["s", "perf-viewport-missing", "app.vue"] and "--- /dev/null" in got["t", "framework-sitemap-missing", "sitemap.xml"]
