"""SQL with the results of the core's queries, in the dialect of the engine that checks them."""

from pagemill.functions.robots import BOTS, KNOWN
from pagemill.functions.text import STOPWORDS
from pagemill.functions.urls import UTILITY_SEGMENTS
from pagemill.operators.rules import GENERIC_ANCHORS, MALFORMED, SCHEMA_REQUIRED
from pagemill.operators.scoring import CATEGORIES, EFFORT, IMPACT, PENALTY, RISK
from pagemill.operators.site_rules import LANGUAGES, REGIONS


def _texts(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _case(column: str, table: dict, default) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


# URL parts, over a column or expression.
def _origin(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*')), '')"


def _raw_path(u: str) -> str:
    found = f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"case when regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then case when {found} = '' then '/' else {found} end end"


def _path(u: str) -> str:
    found = f"rtrim(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"
    return f"case when regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then case when {found} = '' then '/' else {found} end end"


def _key(u: str) -> str:
    return f"({_origin(u)} || {_path(u)})"


def _host(u: str) -> str:
    return f"regexp_extract({_origin(u)}, '://(.*)$', 1)"


def _bare(u: str) -> str:
    return f"regexp_replace({_host(u)}, '^www\\.', '')"


def _resolve(h: str, b: str) -> str:
    folder = f"regexp_replace({_raw_path(b)}, '[^/]*$', '')"
    h = f"trim({h})"
    return (
        f"case when regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then {h} when {h} like '//%' then split_part({_origin(b)}, ':', 1) || ':' || {h} "
        f"when {h} like '/%' then {_origin(b)} || {h} when {h} = '' or {h} like '#%' then split_part({b}, '#', 1) when {h} like '?%' then {_origin(b)} || ({_raw_path(b)}) || {h} "
        f"else regexp_replace(regexp_replace({_origin(b)} || {folder} || {h}, '/\\./', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g') end"
    )


def _utility(p: str) -> str:
    return f"len(list_intersect(list_transform(string_split(lower({p}), '/'), lambda s: regexp_replace(s, '\\.(html?|php)$', '')), [{_texts(UTILITY_SEGMENTS)}])) > 0"


# Pages once each, with the populations of the rules.
_HEADER = """exists (select 1 from (
  select d, last_value(scope ignore nulls) over (order by i) as s from (
    select i, case when regexp_matches(p, '^[a-z0-9_-]+\\s*:') and not regexp_matches(p, '^(max-snippet|max-image-preview|max-video-preview|unavailable_after)\\s*:')
        then trim(regexp_replace(p, '^[a-z0-9_-]+\\s*:', '')) else p end as d,
      case when regexp_matches(p, '^[a-z0-9_-]+\\s*:') and not regexp_matches(p, '^(max-snippet|max-image-preview|max-video-preview|unavailable_after)\\s*:')
        then regexp_extract(p, '^([a-z0-9_-]+)\\s*:', 1) end as scope
    from (select unnest(list_transform(string_split(lower(x), ','), lambda v: trim(v))) as p, unnest(range(len(string_split(x, ',')))) as i))
  ) where d in ('noindex', 'none') and (s is null or s = 'googlebot'))"""

PAGES = f"""
hdr as (select x, {_HEADER} as hidden from (select distinct x_robots_tag as x from pages where x_robots_tag is not null) q),
pg as (
  select p.*, coalesce(status between 200 and 299, false) as ok, coalesce(status >= 400, false) as errored, coalesce({_path("url")}, url) as path, {_key("url")} as pkey,
    regexp_matches(coalesce(lower(meta_robots), ''), '\\b(noindex|none)\\b') or regexp_matches(coalesce(lower(meta_googlebot), ''), '\\b(noindex|none)\\b') as meta_noindex,
    coalesce(h.hidden, false) as header_noindex
  from (select * from pages qualify row_number() over (partition by site_id, page_id order by loaded_at) = 1) p left join hdr h on h.x = p.x_robots_tag),
f as (select *, meta_noindex or header_noindex as noindex, ok and not meta_noindex as indexable from pg)
"""


def _ease() -> str:
    ws = "list_filter(regexp_split_to_array(coalesce(text_content, ''), '[\\s\\p{Z}\\x{FEFF}\\x{85}]+'), lambda w: w <> '')"
    syl = (
        "list_sum(list_transform(ws, lambda w: case when len(regexp_replace(lower(w), '[^a-z]', '', 'g')) <= 3 then 1 else greatest(1, "
        "len(regexp_extract_all(regexp_replace(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'e$', ''), '[aeiouy]+'))) end))"
    )
    return (
        f"select site_id, page_id, case when n < 20 then 100 else cast(floor(round(206.835e0 - 1.015e0 * (n / s) - 84.6e0 * (y / n), 9) + 0.5) as bigint) end as ease from ("
        f"select site_id, page_id, cast(len(ws) as double) as n, greatest(1, len(regexp_extract_all(coalesce(text_content, ''), '[.!?]+')), floor(len(ws) / 25.0 + 0.5)) as s, {syl} as y "
        f"from (select site_id, page_id, text_content, {ws} as ws from f))"
    )


def _schema() -> str:
    cases = []
    for name, required in SCHEMA_REQUIRED.items():
        absent = lambda p: f"coalesce(json_extract_string(j, '$.{p}'), '') = ''"
        lacks = [
            f"case when {' and '.join(map(absent, r))} then 'one of {'/'.join(r)}' end" if isinstance(r, list) else f"case when {absent(r)} then '{r}' end"
            for r in required
        ]
        found = f"list_filter([{', '.join(lacks)}], lambda x: x is not null)"
        cases.append(f"case when json_extract_string(j, '$.@type') = '{name}' and len({found}) > 0 then '{name} missing ' || array_to_string({found}, ', ') end")
    return f"list_filter([{', '.join(cases)}], lambda x: x is not null)"


_SOFT = (
    "(?i)(^|[\\s|:–-])404([\\s|:–-]|$)|\\bpage (?:was )?not found\\b|\\b(?:could not|can[''’]?t|cannot) be found\\b|^\\s*not found\\s*$"
    "|page introuvable|page non trouv[ée]e|seite nicht gefunden|p[áa]gina no encontrada|pagina non trovata|pagina niet gevonden"
)
_HEAD = "case when regexp_matches(html, '(?i)</head>') then regexp_extract(html, '(?is)^(.*?)</head>', 1) else html[1:200000] end"


def _malformed() -> str:
    h = "trim(l.href)"
    tests = {
        "one slash": f"regexp_matches({h}, '(?i)^https?:/([^/]|$)')", "missing colon": f"regexp_matches({h}, '(?i)^https?//')",
        "misspelt scheme": f"regexp_matches({h}, '(?i)^(?:htp|htps|htt|hhtp|htttp|htttps|ttp|ttps):')", "backslash": f"contains({h}, chr(92))", "space inside": f"regexp_matches({h}, '^\\S*\\s+\\S')",
    }
    assert list(tests) == [name for _, name in MALFORMED]
    fault = "case " + " ".join(f"when {t} then '{n}'" for n, t in tests.items()) + " end"
    return f"list_filter(list_transform(coalesce(links, []), lambda l: case when {h} <> '' and not regexp_matches({h}, '(?i)^(mailto|tel|javascript|data|sms):') and {h} not like '#%' then {fault} end), lambda x: x is not null)"


def _page_rules() -> dict[str, tuple[str, str]]:
    """Predicate and note over the CTE f."""
    og = "og['og:image']"
    og_fault = (
        f"case when trim({og}) like '//%' then null when not regexp_matches(trim({og}), '^[a-zA-Z][a-zA-Z0-9+.-]*:') then 'relative URL' "
        f"when not regexp_matches(trim({og}), '(?i)^https?:') then lower(split_part(trim({og}), ':', 1)) || ' URL' "
        f"when coalesce({_host(f'trim({og})')}, '') = '' then 'malformed URL' when regexp_matches({_host(f'trim({og})')}, '^(localhost|127\\.\\d+\\.\\d+\\.\\d+|0\\.0\\.0\\.0)(:\\d+)?$') "
        f"and not regexp_matches({_host('url')}, '^(localhost|127\\.\\d+\\.\\d+\\.\\d+|0\\.0\\.0\\.0)(:\\d+)?$') then 'points at localhost' end"
    )
    title = "trim(coalesce(title, ''))"
    bare = "len(list_filter(coalesce(images, []), lambda i: trim(coalesce(i.alt, '')) = ''))"
    lazy = "len(list_filter(coalesce(images, []), lambda i: coalesce(lower(i.loading) = 'lazy', false)))"
    generic = f"len(list_filter(coalesce(links, []), lambda l: coalesce(l.internal and lower(trim(l.anchor)) in ({_texts(GENERIC_ANCHORS)}), false)))"
    blocking = "coalesce(render_blocking.scripts, 0) + coalesce(render_blocking.stylesheets, 0)"
    params = "case when contains(url, '?') then len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) else 0 end"
    shape = (
        f"list_filter([case when contains({_path('url')}, '_') then 'underscore' end, case when {params} > 2 then cast({params} as varchar) || ' parameters' end, "
        "case when length(url) > 200 then 'long' end], lambda x: x is not null)"
    )
    elsewhere = f"coalesce({_key(_resolve('nullif(canonical, chr(39) || chr(39))'.replace('chr(39) || chr(39)', repr('')), 'url'))} <> pkey, false)"
    canonicals = f"len(regexp_extract_all({_HEAD}, '(?i)<link\\b[^>]*\\brel=[\"'']?canonical\\b[^>]*>'))"
    steps = "len(list_filter(list_zip(list_transform(coalesce(headings, []), lambda h: h.level), list_transform(coalesce(headings, []), lambda h: h.level)[2:]), lambda z: coalesce(z[2] > z[1] + 1, false))) > 0"
    shell = "(?is)<div\\b[^>]*\\bid\\s*=\\s*[\"''](root|app|__next|__nuxt|svelte)[\"''][^>]*>\\s*</div>|<main\\b[^>]*\\bid\\s*=\\s*[\"''](root|app|__next|__nuxt|svelte)[\"''][^>]*>\\s*</main>|<app-root\\b[^>]*>\\s*</app-root>"
    text = lambda x: f"cast({x} as varchar)"
    none = "cast(null as varchar)"
    return {
        "meta-title-missing": (f"indexable and {title} = ''", none),
        "meta-title-length": (f"indexable and {title} <> '' and (length({title}) < 15 or length({title}) > 65)", text("length(title)")),
        "meta-description-missing": ("indexable and trim(coalesce(meta_description, '')) = ''", none),
        "meta-og-image-missing": (f"ok and coalesce({og}, '') = ''", none),
        "meta-og-image-url": (f"ok and coalesce({og}, '') <> '' and ({og_fault}) is not null", og_fault),
        "indexing-canonical-missing": ("indexable and coalesce(canonical, '') = ''", none),
        "indexing-html-lang-missing": ("ok and coalesce(lang, '') = ''", none),
        "indexing-broken-page": ("errored", text("status")),
        "indexing-soft-404": (f"ok and coalesce(word_count, 0) < 250 and (regexp_matches(coalesce(title, ''), '{_SOFT}') or regexp_matches(coalesce(h1s[1], ''), '{_SOFT}'))", none),
        "indexing-canonical-multiple": (f"ok and {canonicals} > 1", text(canonicals)),
        "indexing-meta-refresh": (f"ok and regexp_matches({_HEAD}, '(?i)<meta\\b[^>]*http-equiv=[\"'']?refresh[\"'']?[^>]*>')", none),
        "structure-h1-missing": ("indexable and len(coalesce(h1s, [])) = 0", none),
        "structure-h1-multiple": ("indexable and len(h1s) > 1", text("len(h1s)")),
        "structure-heading-skip": (f"indexable and {steps}", none),
        "structure-thin-content": ("indexable and coalesce(word_count, 0) < 120", text("coalesce(word_count, 0)")),
        "structure-url-format": (f"ok and not noindex and not {elsewhere} and len({shape}) > 0", f"array_to_string({shape}, '; ')"),
        "content-readability": ("indexable and word_count >= 200 and ease < 20", text("ease")),
        "img-alt-missing": (f"ok and {bare} > 0", text(bare)),
        "img-dimensions-missing": ("ok and images_missing_dims > 0", text("images_missing_dims")),
        "img-lazy-missing": (f"ok and len(images) >= 5 and {lazy} / len(images) < 0.3", text(f"len(images) - {lazy}")),
        "schema-missing": ("indexable and len(coalesce(json_ld, [])) = 0", none),
        "schema-invalid": (
            f"indexable and len(flatten(list_transform(coalesce(json_ld, []), lambda j: {_schema()}))) > 0",
            f"array_to_string(flatten(list_transform(coalesce(json_ld, []), lambda j: {_schema()}))[1:3], '; ')",
        ),
        "link-deep-pages": ("depth >= 4", text("depth")),
        "link-generic-anchors": (f"ok and {generic} > 0", text(generic)),
        "link-malformed": (f"ok and len({_malformed()}) > 0", f"cast(len({_malformed()}) as varchar) || ' ' || ({_malformed()})[1]"),
        "perf-slow-ttfb": ("ok and response_time_ms > 800", text("response_time_ms")),
        "perf-render-blocking": (f"ok and {blocking} >= 3", text(blocking)),
        "perf-heavy-html": ("ok and html_bytes > 250000", text("html_bytes")),
        "perf-viewport-missing": ("ok and coalesce(viewport, '') = ''", none),
        "perf-viewport-no-width": ("ok and viewport <> '' and not regexp_matches(lower(viewport), 'width\\s*=')", none),
        "framework-js-only-content": (f"indexable and coalesce(word_count, 0) < 50 and regexp_matches(html, '(?is)<script\\b[^>]*\\bsrc\\s*=') and regexp_matches(html, '{shell}')", none),
    }


def _page_findings(only: list[str] | None = None) -> str:
    rules = {k: v for k, v in _page_rules().items() if only is None or k in only}
    base = "f" if only is not None and "content-readability" not in only else f"(select f.*, e.ease from f join ({_ease()}) e using (site_id, page_id))"
    return " union all ".join(f"select site_id, '{k}' as rule_id, path as url, {note} as note, ord from {base} f where {when}" for k, (when, note) in rules.items())


def _shared(column: str, rule: str) -> str:
    return (
        f"with {PAGES} select site_id, '{rule}' as rule_id, path as url, {column} as note, ord from "
        f"(select *, count(*) over (partition by site_id, lower(trim({column}))) as c from f where indexable and trim({column}) <> '') where c > 1"
    )


_ISSUES = f"""iss as (
  select site_id, rule_id, count(*) as affected from fi group by 1, 2),
ok_pages as (select site_id, count(distinct page_id) as pages from pages where status between 200 and 299 group by 1)"""


def _catalog() -> str:
    from pagemill.operators.rules import CATALOG

    rows = ", ".join(f"('{r.id}', '{r.category}', '{r.impact}', '{r.effort}', '{r.risk}', {r.confidence})" for r in CATALOG)
    return f"cat as (select * from (values {rows}) v(rule_id, category, impact, effort, risk, confidence))"


def _scored(findings: str | None = None) -> str:
    """Issues of the page rules, or of other findings."""
    return f"with {PAGES}, fi as ({findings or _page_findings()}), {_ISSUES}, {_catalog()}"


#: The queries whose findings a whole audit is made of.
_AUDIT = (
    "page_findings rule_meta_title_duplicate rule_meta_description_duplicate site_findings rule_indexing_robots_format rule_robots_blocks probe_findings rule_canonical_targets rule_noindex rule_sitemap "
    "rule_hreflang rule_schema_website_missing link_findings content_findings rule_host_variants duplicate_findings"
).split()


def _audited(out: dict[str, str]) -> dict[str, str]:
    """Issues, scores and reports of the whole audit."""
    scored = _scored(" union all ".join(f"select site_id, rule_id, cast(url as varchar) as url, cast(note as varchar) as note from ({out[q]}) q{i}" for i, q in enumerate(_AUDIT)))
    return {
        "full_audit": f"{scored} select site_id, rule_id, category, impact, effort, risk, cast(confidence as integer) as confidence, affected from iss join cat using (rule_id)",
        "category_scores": f"{scored}, {_SCORES} select * from scores",
        "overall_score": (
            f"{scored}, {_SCORES} select site_id, overall, case when overall >= 90 then 'A' when overall >= 80 then 'B' when overall >= 70 then 'C' when overall >= 60 then 'D' when overall >= 50 then 'E' else 'F' end as grade from "
            f"(select site_id, cast(floor(round(sum(score * {_case('category', CATEGORIES, 0)}) / sum({_case('category', CATEGORIES, 0)}), 9) + 0.5) as bigint) as overall from scores group by 1)"
        ),
        "issue_priorities": (
            f"{scored} select site_id, rule_id, impact, cast(floor(round({_case('impact', IMPACT, 0)} * {_case('effort', EFFORT, 1)} * {_case('risk', RISK, 1)} * confidence / 100 / 12 * 100, 9) + 0.5) as bigint) as priority from iss join cat using (rule_id)"
        ),
        "report_markdown": (
            f"{scored}, ri as (select site_id, '| ' || impact || ' | ' || rule_id || ' | ' || affected || ' |' as line, row_number() over (partition by site_id order by {_case('impact', IMPACT, 0)} desc, affected desc, rule_id) as k from iss join cat using (rule_id)) "
            "select site_id, '| Impact | Rule | Pages |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) order by k) as body from ri where k <= 12 group by 1"
        ),
        "report_text": (
            f"{scored}, {_SCORES}, ov as (select site_id, cast(floor(round(sum(score * {_case('category', CATEGORIES, 0)}) / sum({_case('category', CATEGORIES, 0)}), 9) + 0.5) as bigint) as overall from scores group by 1), "
            f"ri as (select site_id, string_agg('  [' || impact || '] ' || rule_id || ': ' || affected, chr(10) order by {_case('impact', IMPACT, 0)} desc, affected desc, rule_id) as lines from iss join cat using (rule_id) group by 1) "
            "select site_id, 'Score ' || overall || ' (' || case when overall >= 90 then 'A' when overall >= 80 then 'B' when overall >= 70 then 'C' when overall >= 60 then 'D' when overall >= 50 then 'E' else 'F' end || ')' || coalesce(chr(10) || lines, '') as body from ov left join ri using (site_id)"
        ),
        "report_html": (
            f"{scored}, ri as (select site_id, '<li>' || rule_id || ' (' || impact || '): ' || affected || '</li>' as item from iss join cat using (rule_id)) "
            "select site_id, '<!doctype html><title>Site audit</title><ul>' || string_agg(item, '' order by item) || '</ul>' as body from ri group by 1"
        ),
    }


_SCORES = f"""cats as (select unnest([{_texts(CATEGORIES)}]) as category),
scores as (
  select o.site_id, c.category, cast(floor(greatest(0.0, round(100 - coalesce(sum(p), 0), 9)) + 0.5) as bigint) as score from ok_pages o cross join cats c left join (
    select i.site_id, k.category, {_case("k.impact", PENALTY, 0)} * (0.25 + 0.75 * least(1.0, affected / greatest(1, pages))) as p
    from iss i join cat k using (rule_id) join ok_pages using (site_id)) l on l.site_id = o.site_id and l.category = c.category group by 1, 2)"""

_LOOKUP = f"""look as (
  select site_id, key, arg_min(via, (via, o, page_id)) as via_redirect, arg_min(t, (via, o, page_id)) as t from (
    select site_id, pkey as key, false as via, coalesce(ord, {1 << 62}) as o, page_id, {{'url': url, 'status': status, 'noindex': noindex, 'canonical': canonical, 'path': path}} as t from f
    union all
    select site_id, {_key("h")} as key, true, coalesce(ord, {1 << 62}), page_id, {{'url': url, 'status': status, 'noindex': noindex, 'canonical': canonical, 'path': path}} from (select *, unnest(redirected_from) as h from f)
  ) where key is not null group by 1, 2)"""

_EDGES = f"""nd as (select site_id, path, arg_max(page_id, (coalesce(ord, -1), page_id)) as page_id, arg_max(status, (coalesce(ord, -1), page_id)) as status from f where url is not null group by 1, 2),
ed as (
  select distinct e.site_id, e.src, e.dst from (
    select site_id, src, {_path("t")} as dst from (
      select site_id, src, {_resolve("href", "url")} as t from (select site_id, path as src, url, unnest(links).href as href, unnest(links).internal as internal from f where url is not null) where internal and href is not null)
  ) e join nd n on n.site_id = e.site_id and n.path = e.dst where e.dst is not null and e.dst <> e.src)"""

_LINES = """ln as (
  select site_id, line, trim(regexp_replace(raw, '#.*$', '')) as text from (
    select site_id, unnest(regexp_split_to_array(robots_txt, '\\r?\\n')) as raw, unnest(range(1, len(regexp_split_to_array(robots_txt, '\\r?\\n')) + 1)) as line from site_files where robots_txt is not null)),
dr as (
  select site_id, line, case when instr(text, ':') > 1 then lower(trim(text[1:instr(text, ':') - 1])) end as name, case when instr(text, ':') > 0 then trim(text[instr(text, ':') + 1:]) end as value from ln where text <> '')"""
_GROUPS = (
    _LINES
    + """,
gr as (
  select site_id, name, value, sum(b) over (partition by site_id order by line) as grp from (
    select *, case when name = 'user-agent' and coalesce(lag(name) over (partition by site_id order by line), '') <> 'user-agent' then 1 else 0 end as b
    from dr where regexp_matches(name, '^[a-z-]+$'))),
bots as (select * from (values """
    + ", ".join(f"('{b}', '{p}', {'null' if f is None else repr(f)})" for b, _, p, f in BOTS)
    + """) v(bot, purpose, fallback)),
gov as (
  select distinct site_id, bot, grp from (
    select *, min(r) over (partition by site_id, bot) as best from (
      select site_id, grp, bot, case when value <> '*' and contains(lower(bot), lower(value)) then 1 when fallback is not null and value <> '*' and contains(lower(fallback), lower(value)) then 2 when value = '*' then 3 end as r
      from gr cross join bots where name = 'user-agent' and grp > 0) where r is not null) where r = best),
rl as (select site_id, grp, name = 'allow' as allow, value as pattern from gr where grp > 0 and name in ('allow', 'disallow') and value <> ''),
acc as (
  select s.site_id, b.bot, b.purpose, coalesce(v.allow, true) as allowed from (select distinct site_id from site_files) s cross join bots b left join (
    select site_id, bot, arg_max(allow, (length(pattern), allow)) as allow from gov join rl using (site_id, grp)
    where regexp_matches('/', '^' || regexp_replace(regexp_replace(rtrim(pattern, '$'), '([.+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '\\*', '.*', 'g') || case when pattern like '%$' then '$' else '' end)
    group by 1, 2) v on v.site_id = s.site_id and v.bot = b.bot)"""
)

_TOKENS = f"""tk as (
  select site_id, page_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text_content, '')), '[^a-z0-9]', ' ', 'g'), ' +'),
    lambda w: length(w) between 3 and 24 and w not in ({_texts(STOPWORDS)}) and not regexp_matches(w, '^[0-9]+$')) as t, word_count, path, title, h1s
  from f where indexable and word_count > 0),
tc as (
  select site_id, page_id, term, count(*) as n, min(pos) as first, any_value(total) as total from (
    select site_id, page_id, unnest(t) as term, unnest(range(len(t))) as pos, len(t) as total from tk) group by 1, 2, 3),
tw as (
  select tc.*, n / total * (ln((pages + 1) / (df + 1)) + 1) as weight from tc
  join (select site_id, term, count(*) as df from tc group by 1, 2) using (site_id, term) join (select site_id, count(*) as pages from tk group by 1) using (site_id)),
tr as (select *, row_number() over (partition by site_id, page_id order by round(weight, 9) desc, first) as rank from tw)"""

_CLUSTERS = """rd as (
  select site_id, page_id, path, row_number() over (partition by site_id order by coalesce(ord, 4611686018427387904), page_id) as k, runs from (
    select site_id, page_id, path, ord, case when len(w) = 0 then [] when len(w) < 8 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' '))) end as runs from (
      select site_id, page_id, path, ord, list_filter(string_split(regexp_replace(lower(coalesce(text_content, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') as w
      from f where indexable and word_count > 0)) where len(runs) > 0),
sh as (select site_id, k, len(runs) as n, unnest(runs) as run from rd),
nb as (
  select site_id, b as k, list(a) as before from (
    select x.site_id, x.k as a, y.k as b from sh x join sh y on x.site_id = y.site_id and x.run = y.run and x.k < y.k
    group by x.site_id, x.k, y.k, x.n, y.n having count(*) * 172 >= (x.n + y.n) * 72) group by 1, 2),
st as (select rd.site_id, rd.k, coalesce(nb.before, []) as before from rd left join nb using (site_id, k)),
ld(site_id, k, leads, leader) as (
  select site_id, k, [k], k from st where k = 1
  union all
  select st.site_id, st.k, case when len(list_intersect(ld.leads, st.before)) > 0 then ld.leads else list_append(ld.leads, st.k) end,
    case when len(list_intersect(ld.leads, st.before)) > 0 then list_min(list_intersect(ld.leads, st.before)) else st.k end
  from ld join st on st.site_id = ld.site_id and st.k = ld.k + 1),
cl as (select rd.site_id, rd.page_id, rd.path, lead.page_id as leader_id from ld join rd using (site_id, k) join rd lead on lead.site_id = ld.site_id and lead.k = ld.leader)"""

P5 = """
with snap as (
  select snapshot_id, arg_max(url, loaded_at) as url, arg_max(taken_at, loaded_at) as taken_at from site_snapshot group by snapshot_id),
pairs as (
  select lag(snapshot_id) over (partition by url order by taken_at, snapshot_id) as prev_id, snapshot_id from snap),
page as (
  select * from (
    select snapshot_id, path as k, row_number() over (partition by snapshot_id, path order by loaded_at desc) as rn,
      row(status, nullif(title, ''), nullif(description, ''), nullif(canonical, ''), noindex_meta, noindex_header, nullif(h1, ''), nullif(redirected_to, '')) as sig
    from page_state) where rn = 1),
issue as (
  select distinct snapshot_id, rule_id as k,
    row(nullif(impact, ''), nullif(category, ''), nullif(title, ''), list_sort(list_distinct(coalesce(paths, [])))) as sig
  from snapshot_issue),
rec as (
  select snapshot_id, 'page' as kind, k, cast(sig as varchar) as sig from page
  union all select snapshot_id, 'issue', k, cast(sig as varchar) from issue),
a as (select p.snapshot_id, kind, k, sig from rec r join pairs p on r.snapshot_id = p.prev_id),
b as (select p.snapshot_id, kind, k, sig from rec r join pairs p on r.snapshot_id = p.snapshot_id where p.prev_id is not null)
select coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.kind, b.kind) as record_kind, coalesce(a.k, b.k) as record_key,
  case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change
from a full join b on a.snapshot_id = b.snapshot_id and a.kind = b.kind and a.k = b.k
where a.k is null or b.k is null or a.sig is distinct from b.sig
"""

_STATES = """sn as (select snapshot_id, arg_max(url, loaded_at) as url, arg_max(taken_at, loaded_at) as taken_at, arg_max(overall, loaded_at) as overall, arg_max(robots, loaded_at) as robots, arg_max(sitemap, loaded_at) as sitemap
  from site_snapshot where snapshot_id is not null and url is not null and taken_at is not null group by 1),
pr as (select *, lag(snapshot_id) over w as prev_id, lag(overall) over w as p_overall, lag(robots) over w as p_robots, lag(sitemap) over w as p_sitemap from sn window w as (partition by url order by taken_at, snapshot_id)),
st as (select * from page_state where snapshot_id is not null and path is not null qualify row_number() over (partition by snapshot_id, path order by loaded_at desc) = 1)"""


def _regressions() -> str:
    fine = lambda x: f"coalesce({x}.status between 200 and 299 and coalesce({x}.redirected_to, '') = '', false)"
    hid = lambda x: f"(coalesce({x}.noindex_meta, false) or coalesce({x}.noindex_header, false))"
    t = lambda x, c: f"coalesce({x}.{c}, '')"
    both = f"{fine('a')} and {fine('b')}"
    target = f"rtrim(regexp_extract({t('b', 'canonical')}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/')"
    kinds = [
        (f"{fine('a')} and b.status >= 400", "page-error", "'critical'"),
        (f"{fine('a')} and not coalesce(b.status >= 400, false) and {t('b', 'redirected_to')} <> ''", "redirect-added", "'warning'"),
        (f"{both} and not {hid('a')} and {hid('b')}", "noindex-added", "'critical'"),
        (f"{both} and {hid('a')} and not {hid('b')}", "noindex-removed", "'info'"),
        (f"{both} and {t('a', 'canonical')} <> {t('b', 'canonical')}", "canonical-changed", f"case when {t('b', 'canonical')} <> '' and (case when {target} = '' then '/' else {target} end) <> b.path then 'warning' else 'info' end"),
        (f"{both} and {t('a', 'title')} <> {t('b', 'title')}", "titles-changed", "'info'"),
        (f"{both} and {t('a', 'h1')} <> '' and {t('b', 'h1')} = ''", "h1-removed", "'warning'"),
        (f"{both} and {t('a', 'description')} <> '' and {t('b', 'description')} = ''", "description-removed", "'warning'"),
    ]
    return " union all ".join(
        f"select b.snapshot_id, '{k}' as kind, {lv} as level, b.path from st b join pr on pr.snapshot_id = b.snapshot_id join st a on a.snapshot_id = pr.prev_id and a.path = b.path where {w}" for w, k, lv in kinds
    )


def _site_regressions() -> str:
    fail = lambda x: f"coalesce({x}.status >= 500 or {x}.status = 429, false)"
    opened = lambda x: f"coalesce({x}.googlebot_allowed, true)"
    newly = "len(list_filter(coalesce(robots.ai_search_blocked, []), lambda b: not list_contains(coalesce(p_robots.ai_search_blocked, []), b))) > 0"
    gone = "coalesce(p_sitemap.present, false) and not coalesce(sitemap.present, false)"
    kinds = [
        (f"{opened('p_robots')} and not {opened('robots')}", "googlebot-blocked", "critical"),
        (f"not {opened('p_robots')} and {opened('robots')}", "googlebot-unblocked", "info"),
        (newly, "ai-search-blocked", "warning"),
        (f"not {fail('p_robots')} and {fail('robots')}", "robots-unavailable", "critical"),
        (f"not (not {fail('p_robots')} and {fail('robots')}) and coalesce(p_robots.hash, '') <> coalesce(robots.hash, '') and {opened('p_robots')} = {opened('robots')} and not ({newly})", "robots-changed", "info"),
        (gone, "sitemap-gone", "warning"),
        (f"not ({gone}) and p_sitemap.urls >= 10 and sitemap.urls < p_sitemap.urls * 0.8", "sitemap-shrunk", "warning"),
        ("overall - p_overall <= -5", "score-drop", "warning"),
    ]
    return " union all ".join(f"select snapshot_id, '{k}' as kind, '{lv}' as level from pr where prev_id is not null and {w}" for w, k, lv in kinds)


def _page_rank_events() -> str:
    steps = []
    for k in range(1, 41):
        steps.append(
            f"r{k} as materialized (select v.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (1 - coalesce((select sum(r.rank / d.out) from ed join r{k - 1} r on r.node = ed.src join dg d on d.src = ed.src), 0)) / n) as rank "
            f"from vx v cross join sz left join (select ed.dst, sum(r.rank / d.out) as got from ed join r{k - 1} r on r.node = ed.src join dg d on d.src = ed.src group by 1) g on g.dst = v.node)"
        )
    return (
        "with ed as materialized (select distinct src, dst from (select user_id as src, lead(user_id) over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as dst from events) where dst is not null and src <> dst), "
        "vx as materialized (select src as node from ed union select dst from ed), dg as materialized (select src, count(*) as out from ed group by 1), sz as (select count(*) as n from vx), "
        "r0 as (select node, 1.0 / n as rank from vx cross join sz), " + ", ".join(steps) + " select node as user_id, round(rank, 6) as page_rank from r40"
    )


def _language() -> str:
    v = "lower(trim(h.lang))"
    form = "^([a-z]{2,3})(?:-([a-z]{4}))?(?:-([a-z0-9]{2,3}))?$"
    lang, region = f"regexp_extract({v}, '{form}', 1)", f"regexp_extract({v}, '{form}', 3)"
    known, regions = f"({_texts(LANGUAGES)})", f"({_texts(REGIONS)})"
    return (
        f"case when {v} = 'x-default' then null when contains({v}, '_') then 'underscore' when not regexp_matches({v}, '{form}') then 'not a code' "
        f"when {lang} not in {known} and {lang} in {regions} and {region} = '' then 'country' when {lang} not in {known} then 'unknown language' when {region} = '' then null "
        f"when {region} = 'uk' then 'uk' when regexp_matches({region}, '^[0-9]+$') then 'numeric region' when {region} not in {regions} then 'unknown region' end"
    )


def _decoded(x: str) -> str:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        x = f"regexp_replace({x}, '(?i){entity}', '{char}', 'g')"
    point = "case when regexp_matches(v, '^&#[xX]') then cast('0x' || v[4:-2] as bigint) when v like '&#%' then cast(v[3:-2] as bigint) end"
    return (
        f"trim(array_to_string(list_transform(regexp_extract_all({x}, '&#[xX][0-9a-fA-F]{{1,6}};|&#[0-9]{{1,7}};|[^&]+|&'), "
        f"lambda v: case when regexp_matches(v, '^&#([xX][0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});$') then chr(cast({point} as integer)) else v end), ''))"
    )


def _plain(x: str) -> str:
    return _decoded(f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[\\s\\p{{Z}}\\x{{FEFF}}]+', ' ', 'g'))")


def _attr(tag: str, name: str) -> str:
    return f"case when regexp_matches({tag}, '(?is){name}\\s*=\\s*\"') then {_decoded(f"regexp_extract({tag}, '(?is){name}\\s*=\\s*\"([^\"]*)\"', 1)")} end"


_ROWS = "(select distinct page_id, url, html from pages where html is not null)"
_VISIBLE = (
    "regexp_replace(case when regexp_matches(html, '(?is)<body[^>]*>.*</body>') then regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) else html end, "
    "'(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>|<template\\b.*?</template>', ' ', 'g')"
)


def _geo() -> str:
    from pagemill.operators.geo import ANSWER_TYPES

    js = "array_to_string(coalesce(json_ld, []), chr(10))"
    typed = lambda names: f"regexp_matches({js}, '\"@type\"\\s*:\\s*(\\[[^\\]]*)?\"({'|'.join(names)})\"')"
    html = "coalesce(html, '')"
    question = "(?i)\\?\\s*$|^(how|what|why|when|where|which|who|can|does|is|are|should|do)\\b"
    fact = "(?i)\\b\\d+(?:[.,]\\d+)?\\s?(%|percent|x\\b|ms\\b|kb\\b|€|\\$|users|customers)"
    page = (
        f"gp as (select site_id, coalesce(word_count, 0) < 80 and html_bytes > 15000 as shell, {typed(ANSWER_TYPES)} as answers, {typed(['Organization', 'Person'])} as entity, contains({js}, '\"sameAs\"') as same_as, "
        f"contains({js}, '\"author\"') or regexp_matches({html}, '(?i)<meta[^>]+name=[\"'']author[\"'']|rel=[\"'']author[\"'']') as author, "
        f"regexp_matches({js}, '\"date(Modified|Published)\"') or regexp_matches({html}, '(?i)article:(modified|published)_time|<time[^>]+datetime=') as dated, "
        f"len(list_filter(coalesce(headings, []), lambda h: h.level between 2 and 3 and regexp_matches(h.text, '{question}'))) as questions, len(regexp_extract_all(coalesce(text_content, ''), '{fact}')) >= 2 as facts, "
        "length(trim(coalesce(meta_description, ''))) >= 50 as described from f where ok and not noindex)"
    )
    names = "shell answers entity same_as author dated facts described".split()
    site = "gs as (select site_id, count(*) as n, " + ", ".join(f"count(*) filter (where {c}) as {c}" for c in names) + ", sum(questions) as questions from gp group by 1)"
    access = "ga as (select site_id, count(*) filter (where not allowed and purpose <> 'training') as search, count(*) filter (where not allowed and purpose = 'training') as training from acc group by 1)"
    files = (
        "gf as (select s.site_id, coalesce(has_llms_txt, false) and regexp_matches(coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(llms_txt, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1], ''), '^#\\s+\\S') "
        "and regexp_matches(coalesce(llms_txt, ''), '\\[[^\\]]+\\]\\([^)\\s]+\\)') as llms, coalesce(search, 0) as search, coalesce(training, 0) as training, coalesce(n, 0) as n, coalesce(questions, 0) as questions, "
        + ", ".join(f"coalesce({c}, 0) as {c}" for c in names) + " from site_files s left join ga using (site_id) left join gs using (site_id))"
    )
    rows = {
        "geo-ai-search-bots": "case when search = 0 then 'pass' else 'fail' end", "geo-ai-training-bots": "case when training = 0 then 'pass' else 'warn' end",
        "geo-llms-txt": "case when llms then 'pass' else 'warn' end", "geo-server-rendered": "case when shell = 0 then 'pass' when shell >= ceil(n / 2.0) then 'fail' else 'warn' end",
        "geo-answer-schema": "case when answers > 0 then 'pass' else 'warn' end", "geo-entity": "case when entity > 0 and same_as > 0 then 'pass' when entity > 0 then 'warn' else 'fail' end",
        "geo-authorship": "case when author > 0 then 'pass' else 'warn' end", "geo-freshness": "case when dated > 0 then 'pass' else 'warn' end",
        "geo-question-headings": "case when questions >= 2 then 'pass' else 'warn' end", "geo-facts": "case when facts > 0 then 'pass' else 'warn' end",
        "geo-summaries": "case when described = n and n > 0 then 'pass' when described > 0 then 'warn' else 'fail' end",
    }
    union = " union all ".join(f"select site_id, '{k}' as check_id, {v} as status from gf" for k, v in rows.items())
    return f"with {PAGES}, {_GROUPS}, {page}, {site}, {access}, {files}, gc as ({union})"


_PAIRS = (
    "oneof as (select snapshot_id, arg_max({'url': url, 'origin': origin, 'overall': overall, 'geo': geo_score, 'cat': category_scores}, loaded_at) as s from site_snapshot where snapshot_id is not null group by 1), "
    "pq as (select o.snapshot_id, o.s, pr.prev_id, b.s as p, b.s.origin is distinct from o.s.origin as crossed from oneof o join pr using (snapshot_id) join oneof b on b.snapshot_id = pr.prev_id)"
)


def _levels() -> str:
    """Rows of issue deltas with kind, impact and level."""
    from pagemill.operators.snapshot_diff import HOST_RULES

    return (
        "ii as (select snapshot_id, rule_id, max(impact) as impact, list_distinct(flatten(list(coalesce(paths, [])))) as paths from snapshot_issue where snapshot_id is not null and rule_id is not null group by 1, 2), "
        "b as (select ii.* from ii join pr using (snapshot_id) where prev_id is not null), a as (select pr.snapshot_id, ii.rule_id, ii.impact, ii.paths from ii join pr on pr.prev_id = ii.snapshot_id), "
        "m as (select coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.rule_id, b.rule_id) as rule_id, a.paths as pa, b.paths as pb, a.impact as was, b.impact as now from a full join b on a.snapshot_id = b.snapshot_id and a.rule_id = b.rule_id), "
        "lv as (select m.snapshot_id, m.rule_id, case when pa is null then 'new-issue' when pb is null then 'resolved' else 'worsened-issue' end as kind, case when pb is null then was else now end as impact, "
        "case when pb is null then 'info' when now = 'critical' then case when pa is null then 'critical' else 'warning' end when now = 'high' then 'warning' else 'info' end as level "
        f"from m join pq using (snapshot_id) where (pa is null or pb is null or len(list_filter(pb, lambda x: not list_contains(pa, x))) > 0) and not (crossed and rule_id in ({_texts(HOST_RULES)})))"
    )


def _changes() -> str:
    """Levels of every change of a snapshot, but resolved issues."""
    from pagemill.operators.diff_report import _HOST_KINDS

    return (
        f"{_levels()}, ch as (select r.snapshot_id, r.level from ({_regressions()}) r join pq using (snapshot_id) left join st b on b.snapshot_id = r.snapshot_id and b.path = r.path left join st a on a.snapshot_id = pq.prev_id and a.path = r.path "
        "where not (crossed and kind in ('noindex-added', 'noindex-removed') and not coalesce(a.noindex_meta, false) and not coalesce(b.noindex_meta, false)) "
        f"union all select r.snapshot_id, level from ({_site_regressions()}) r join pq using (snapshot_id) where not (crossed and kind in ({_texts(_HOST_KINDS)})) union all select snapshot_id, level from lv where kind <> 'resolved' "
        "union all select b.snapshot_id, 'info' from st b join pr using (snapshot_id) left join st a on a.snapshot_id = pr.prev_id and a.path = b.path where prev_id is not null and a.path is null and b.status between 200 and 299), "
        "ct as (select snapshot_id, max(case level when 'critical' then 3 when 'warning' then 2 else 1 end) as worst, count(*) filter (level = 'critical') as critical, count(*) filter (level = 'warning') as warnings from ch group by 1)"
    )


def oracle() -> dict[str, str]:
    pages = f"with {PAGES}"
    rules = _page_rules()
    out = {
        "p5_found": P5,
        "extract_lang": "select distinct page_id, nullif(regexp_extract(regexp_extract(html, '(?is)<html\\b[^>]*>'), '(?is)\\blang\\s*=\\s*\"([^\"]*)\"', 1), '') as lang from pages",
        "extract_html_bytes": "select distinct page_id, cast(strlen(html) as bigint) as html_bytes from pages",
        "extract_viewport": "select distinct page_id, nullif(regexp_extract(html, '(?is)<meta name=\"viewport\" content=\"([^\"]*)\"', 1), '') as viewport from pages",
        "extract_robots": "select distinct page_id, lower(nullif(regexp_extract(html, '(?is)<meta name=\"robots\" content=\"([^\"]*)\"', 1), '')) as meta_robots from pages",
        "extract_assets": (
            f"select distinct page_id, {_resolve('ref', 'url')} as url from (select page_id, url, unnest(list_distinct(list_concat("
            "regexp_extract_all(html, '(?is)<link rel=\"stylesheet\" href=\"([^\"]*)\"', 1), regexp_extract_all(html, '(?is)<script src=\"([^\"]*)\"', 1)))) as ref from pages)"
        ),
        "extract_title": f"select page_id, case when regexp_matches(html, '(?is)<title[^>]*>.*?</title>') then {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} end as title from {_ROWS}",
        "extract_description": f"select page_id, {_attr("regexp_extract(html, '(?is)<meta name=\"description\"[^>]*>')", 'content')} as meta_description from {_ROWS}",
        "extract_canonical": f"select page_id, {_attr("regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*\"canonical\"[^>]*>')", 'href')} as canonical from {_ROWS}",
        "extract_word_count": f"select page_id, cast(len(list_filter(regexp_split_to_array({_plain(_VISIBLE)}, '[\\s\\p{{Z}}\\x{{FEFF}}]+'), lambda w: w <> '')) as integer) as word_count from {_ROWS}",
        "extract_headings": (
            "select page_id, cast(row_number() over (partition by page_id order by i) - 1 as integer) as pos, level, text from (select page_id, i, cast(h[3:3] as integer) as level, " + _plain("h") + " as text from ("
            "select page_id, unnest(hs) as h, unnest(range(len(hs))) as i from (select page_id, regexp_extract_all(html, '(?is)<h1\\b[^>]*>.*?</h1>|<h2\\b[^>]*>.*?</h2>|<h3\\b[^>]*>.*?</h3>|<h4\\b[^>]*>.*?</h4>|<h5\\b[^>]*>.*?</h5>|<h6\\b[^>]*>.*?</h6>') as hs "
            f"from {_ROWS}))) where text <> ''"
        ),
        "extract_images": (
            f"select page_id, cast(i as integer) as pos, {_attr('g', 'src')} as src, {_attr('g', 'alt')} as alt, try_cast({_attr('g', 'width')} as integer) as width, try_cast({_attr('g', 'height')} as integer) as height from "
            f"(select page_id, unnest(gs) as g, unnest(range(len(gs))) as i from (select page_id, regexp_extract_all(html, '(?is)<img\\b[^>]*\\bsrc=[^>]*>') as gs from {_ROWS})) "
        ),
        "extract_links": (
            f"select page_id, cast(row_number() over (partition by page_id order by i) - 1 as integer) as pos, href, href like '/%' or starts_with(href, {_origin('url')}) as internal, anchor from ("
            f"select page_id, url, i, {_attr("regexp_extract(g, '(?is)^<a\\b[^>]*>')", 'href')} as href, {_plain('g')} as anchor from (select page_id, url, unnest(gs) as g, unnest(range(len(gs))) as i from "
            f"(select page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>') as gs from {_ROWS}))) where href <> '' and not regexp_matches(href, '(?i)^(#|mailto:|tel:|javascript:)')"
        ),
        "rule_robots_blocks": (
            f"{pages}, {_GROUPS}, tg as (select site_id, page_id, path, ({_raw_path('url')}) || regexp_extract(url, '(\\?[^#]*)', 1) as target from f where ok and not noindex), "
            "bl as (select site_id, page_id, path, arg_max(allow, (length(pattern), allow)) as allow from tg join (select distinct site_id, allow, pattern from gov join rl using (site_id, grp) where bot = 'Googlebot') using (site_id) "
            "where regexp_matches(target, '^' || regexp_replace(regexp_replace(rtrim(pattern, '$'), '([.+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '\\*', '.*', 'g') || case when pattern like '%$' then '$' else '' end) group by 1, 2, 3) "
            "select site_id, 'indexing-robots-blocks-google' as rule_id, '/robots.txt' as url, cast(null as varchar) as note from acc where bot = 'Googlebot' and not allowed union all "
            "select bl.site_id, 'indexing-robots-blocks-pages', path, null from bl join acc a on a.site_id = bl.site_id and a.bot = 'Googlebot' and a.allowed where not allow"
        ),
        "robots_signals": (
            f"with {_GROUPS}, sg as (select site_id, grp, unnest(string_split(value, ',')) as p, unnest(range(len(string_split(value, ',')))) as i from gr where name = 'content-signal' and grp > 0 and (site_id, grp) in (select site_id, grp from gr where name = 'user-agent' and value = '*')) "
            "select site_id, lower(regexp_extract(trim(p), '^([a-zA-Z-]+)\\s*=', 1)) as signal, lower(regexp_extract(trim(p), '=\\s*(yes|no)$', 1)) as value from sg where regexp_matches(trim(p), '(?i)^[a-z-]+\\s*=\\s*(yes|no)$') "
            "qualify row_number() over (partition by site_id, signal order by grp desc, i desc) = 1"
        ),
        "crawl_frontier": (
            f"with k as (select distinct site_id, {_key('t')} as url from (select site_id, url, split_part({_resolve('href', 'url')}, '#', 1) as t from (select distinct site_id, url, unnest(links).href as href from pages) where href is not null and href not like '#%') "
            f"where {_bare('t')} = {_bare('url')} and not regexp_matches(t, '(?i)\\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|txt|pdf|zip|gz|mp4|webm|mp3|woff2?|ttf|eot|map)(\\?|#|$)')) "
            f"select site_id, url from k where url is not null and (site_id, url) not in (select site_id, {_key('url')} from pages where url is not null)"
        ),
        "geo_checks": f"{_geo()} select * from gc",
        "geo_score": (
            f"{_geo()} select site_id, cast(floor(sum(w * v) / sum(w) * 100 + 0.5) as bigint) as score from (select site_id, case check_id when 'geo-ai-search-bots' then 3 when 'geo-server-rendered' then 2 else 1 end as w, "
            "case status when 'pass' then 1.0 when 'warn' then 0.5 else 0 end as v from gc where check_id <> 'geo-ai-training-bots') group by 1"
        ),
        "url_parts": f"select distinct page_id, {_host('url')} as host, {_path('url')} as path, {_key('url')} as page_key, split_part(url, '#', 1) as no_fragment, {_utility(_path('url'))} as utility from pages",
        "reading_ease": f"{pages} select page_id, ease from ({_ease()})",
        "fnv_hash": "select distinct page_id, cast(list_reduce(list_prepend(2166136261, list_transform(string_split(regexp_replace(url, '[^ -~]', '', 'g'), ''), lambda c: ord(c))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) as bigint) as fnv from pages",
        "page_findings": f"{pages} {_page_findings()}",
        "rule_meta_title_duplicate": _shared("title", "meta-title-duplicate"),
        "rule_meta_description_duplicate": _shared("meta_description", "meta-description-duplicate"),
        "heading_steps": (
            "select page_id, pos, level, lag(level) over (partition by page_id order by pos) as before from (select distinct page_id, cast(pos as integer) as pos, level from "
            "(select page_id, unnest(range(len(headings))) as pos, unnest(headings).level as level from pages))"
        ),
        "site_findings": " union all ".join(
            f"select site_id, '{r}' as rule_id, start_url as url, {n} as note from site_files where {w}"
            for r, w, n in (
                ("framework-sitemap-missing", "not coalesce(has_sitemap, false)", "cast(null as varchar)"),
                ("framework-robots-missing", "not coalesce(has_robots, false)", "null"),
                ("framework-robots-no-sitemap", "has_sitemap and has_robots and not coalesce(robots_declares_sitemap, false)", "null"),
                ("indexing-robots-unavailable", "robots_status >= 500 or robots_status = 429", "cast(robots_status as varchar)"),
                ("indexing-robots-html", "robots_is_html", "null"),
                ("indexing-soft-404-site", "not_found_status between 200 and 299", "cast(not_found_status as varchar)"),
                ("indexing-https-certificate", "tls is not null and (tls.error is not null or not coalesce(tls.trusted, true) or tls.days_left <= 14)",
                 "case when not coalesce(tls.trusted, true) or tls.error is not null or tls.days_left < 0 then 'critical' else 'high' end"),
            )
        ),
        "rule_indexing_robots_format": f"with {_LINES} select site_id, 'indexing-robots-format' as rule_id, '/robots.txt' as url, cast(count(*) as varchar) as note from dr where coalesce(name, '') = '' or name not in ({_texts(KNOWN)}) group by 1",
        "robots_access": f"with {_GROUPS} select * from acc",
        "declared_sitemaps": f"with {_LINES} select distinct site_id, {_resolve('value', 'start_url')} as url from dr join site_files using (site_id) where name = 'sitemap' and value <> ''",
        "probe_findings": (
            f"with one as (select p.*, {_bare('s.start_url')} as home from (select * from probes where url is not null qualify row_number() over (partition by site_id, kind, url order by probed_at desc, status desc, final_url desc) = 1) p left join site_files s using (site_id)), "
            "c as (select *, coalesce(kind = 'image' and status between 200 and 299 and bytes > 0, false) as m, cast(floor(bytes / 1024 + 0.5) as bigint) as kb from one), "
            "d as (select *, m and regexp_matches(coalesce(content_type, ''), 'jpe?g|png') and bytes > 100000 as legacy from c) "
            "select site_id, 'img-legacy-format' as rule_id, url, cast(kb as varchar) as note from d where legacy union all "
            "select site_id, 'perf-oversized-images', url, cast(kb as varchar) from d where m and not legacy and bytes > case when regexp_matches(coalesce(content_type, ''), 'webp|avif') then 500000 else 300000 end union all "
            "select site_id, 'link-broken-external', url, cast(status as varchar) from d where kind = 'link' and status in (404, 410, 500) union all "
            "select site_id, 'indexing-redirect-chain', url, cast(redirects as varchar) from d where kind = 'link' and redirects >= 2 union all "
            "select site_id, 'perf-mixed-content', url, null from d where kind = 'image' and insecure union all "
            "select site_id, 'img-broken', url, cast(status as varchar) from d where kind = 'image' and status >= 400 union all "
            "select site_id, 'perf-broken-assets', url, cast(status as varchar) from d where kind = 'asset' and status >= 400 union all "
            f"select site_id, 'indexing-temporary-redirect', url, null from d where kind = 'link' and len(list_intersect(hops, [302, 307])) > 0 and {_bare('url')} = home and {_host('final_url')} is not null and not {_utility(_path('final_url'))}"
        ),
        "rule_canonical_targets": (
            f"{pages}, {_LOOKUP}, r as (select f.*, {_resolve('canonical', 'url')} as goal from f where ok and canonical <> '') "
            f"select r.site_id, 'indexing-canonical-mismatch' as rule_id, path as url, {_path('goal')} as note from r join site_files s using (site_id) where {_origin('goal')} = {_origin('s.start_url')} and {_path('goal')} <> path union all "
            f"select site_id, 'indexing-canonical-target-invalid', url, why from (select r.site_id, r.path as url, case when t.status >= 400 then 'HTTP ' || t.status when via_redirect then 'redirect' when t.noindex then 'noindex' end as why "
            f"from r join look on look.site_id = r.site_id and look.key = {_key('goal')} where {_key('goal')} <> pkey) where why is not null"
        ),
        "rule_noindex": (
            f"{pages}, ls as (select distinct site_id, {_host('url')} || {_path('url')} as hp from sitemap_urls), "
            f"r as (select f.*, {_path('s.start_url')} as start, l.hp is not null or coalesce(discovered_via, '') = 'sitemap' as listed from f left join ls l on l.site_id = f.site_id and l.hp = {_host('f.url')} || {_path('f.url')} left join site_files s on s.site_id = f.site_id where ok and noindex) "
            f"select site_id, case when not listed and not coalesce(path = start, false) and {_utility('path')} then 'indexing-noindex-utility' else 'indexing-noindex' end as rule_id, path as url, "
            "array_to_string(list_filter([case when meta_noindex then 'meta' end, case when listed then 'sitemap' end, case when path = start then 'start page' end], lambda x: x is not null), ' + ') as note from r"
        ),
        "rule_sitemap": (
            f"{pages}, {_LOOKUP}, en as (select e.site_id, e.url, {_key('e.url')} as key, {_origin('s.start_url')} as home, coalesce(s.sitemap_truncated, false) as cut from (select distinct site_id, url from sitemap_urls where url is not null) e join site_files s using (site_id)) "
            f"select site_id, 'indexing-sitemap-hygiene' as rule_id, url, why as note from (select en.site_id, en.url, case when en.key is null then 'not absolute' when {_origin('en.url')} <> home then 'other origin' when t.status >= 400 then 'HTTP ' || t.status when via_redirect then 'redirect' "
            f"when t.noindex then 'noindex' when {_key(_resolve('nullif(t.canonical, ' + repr('') + ')', 't.url'))} <> {_key('t.url')} then 'canonical elsewhere' end as why from en left join look on look.site_id = en.site_id and look.key = en.key) where why is not null union all "
            f"select site_id, 'indexing-sitemap-gaps', path, null from f where ok and not noindex and pkey is not null and not coalesce({_key(_resolve('nullif(canonical, ' + repr('') + ')', 'url'))} <> pkey, false) and coalesce(discovered_via, '') <> 'sitemap' "
            "and site_id in (select site_id from en where not cut) and not exists (select 1 from en where en.site_id = f.site_id and en.key = f.pkey)"
        ),
        "rule_hreflang": (
            f"{pages}, {_LOOKUP}, he as (select *, {_key('abs')} as key from (select site_id, page_id, path, pkey as own, h, {_resolve('h.href', 'url')} as abs from (select *, unnest(hreflang) as h from f where ok and len(hreflang) > 0))), "
            f"w as (select site_id, page_id, path, {_language()} as why from he union all select site_id, page_id, path, 'relative URL' from he where not regexp_matches(trim(h.href), '(?i)^https?://') "
            "union all select site_id, page_id, path, 'no self' from he group by 1, 2, 3 having not bool_or(coalesce(key = own, false)) "
            "union all select site_id, page_id, path, 'several URLs' from he group by site_id, page_id, path, lower(trim(h.lang)) having count(distinct coalesce(key, trim(h.href))) > 1 "
            "union all select he.site_id, he.page_id, he.path, case when t.status >= 400 then 'HTTP ' || t.status when via_redirect then 'redirect' when t.noindex then 'noindex' "
            "when not exists (select 1 from he b where b.site_id = he.site_id and b.own = he.key and b.key = he.own) then 'no return link' end from he join look on look.site_id = he.site_id and look.key = he.key where he.key <> he.own) "
            "select site_id, 'indexing-hreflang-invalid' as rule_id, path as url, array_to_string(list_sort(list(distinct why)), '; ') as note from w where why is not null group by site_id, page_id, path"
        ),
        "rule_schema_website_missing": (
            f"{pages} select f.site_id, 'schema-website-missing' as rule_id, path as url, cast(null as varchar) as note from f join site_files s using (site_id) where ok and path = {_path('s.start_url')} "
            "and len(list_filter(coalesce(json_ld, []), lambda j: regexp_matches(j, '\"@type\"\\s*:\\s*(\\[[^\\]]*)?\"(Organization|WebSite)\"'))) = 0"
        ),
        "link_edges": f"{pages}, {_EDGES} select * from ed",
        "link_inbound": f"{pages}, {_EDGES} select nd.site_id, nd.path, count(ed.src) as inbound from nd left join ed on ed.site_id = nd.site_id and ed.dst = nd.path group by 1, 2",
        "link_orphans": f"{pages}, {_EDGES} select site_id, path from nd where not exists (select 1 from ed where ed.site_id = nd.site_id and ed.dst = nd.path) and not exists (select 1 from site_files s where s.site_id = nd.site_id and {_path('s.start_url')} = nd.path)",
        "link_broken": f"{pages}, {_EDGES} select ed.site_id, src, dst, status from ed join nd on nd.site_id = ed.site_id and nd.path = ed.dst where status >= 400",
        "link_depth": (
            f"with recursive {PAGES}, {_EDGES}, walk(site_id, path, depth) using key (site_id, path) as (select site_id, {_path('start_url')}, 0 from site_files union "
            "select ed.site_id, ed.dst, min(walk.depth + 1) from walk join ed on ed.site_id = walk.site_id and ed.src = walk.path left join recurring.walk old on old.site_id = ed.site_id and old.path = ed.dst where old.path is null group by 1, 2) "
            "select site_id, path, cast(depth as bigint) as depth from walk"
        ),
        "link_findings": (
            f"{pages}, {_EDGES} select site_id, 'link-orphan-pages' as rule_id, path as url, cast(null as varchar) as note from nd where not exists (select 1 from ed where ed.site_id = nd.site_id and ed.dst = nd.path) "
            f"and not exists (select 1 from site_files s where s.site_id = nd.site_id and {_path('s.start_url')} = nd.path) and not exists (select 1 from f where f.site_id = nd.site_id and f.path = nd.path and meta_noindex) "
            "union all select ed.site_id, 'link-broken-internal', src, dst || ' ' || status from ed join nd on nd.site_id = ed.site_id and nd.path = ed.dst where status >= 400"
        ),
        "page_rank_events": _page_rank_events(),
        "term_counts": f"{pages}, {_TOKENS} select site_id, page_id, term, n from tc",
        "top_terms": f"{pages}, {_TOKENS} select site_id, page_id, cast(rank as integer) as rank, term, floor(round(weight * 1000, 6) + 0.5) / 1000 as weight from tr where rank <= 8",
        "stuffed_terms": (
            f"{pages}, {_TOKENS} select site_id, page_id, term, floor(n / greatest(total, word_count) * 1000 + 0.5) / 10 as percent from (select tr.*, word_count, row_number() over (partition by site_id, page_id order by rank) as k "
            "from tr join tk using (site_id, page_id) where word_count >= 300 and n >= 6 and n / greatest(total, word_count) > 0.06) where k <= 5"
        ),
        "content_findings": (
            f"{pages}, {_TOKENS}, sf as (select tr.site_id, tr.page_id, term, row_number() over (partition by tr.site_id, tr.page_id order by rank) as k from tr join tk using (site_id, page_id) where word_count >= 300 and n >= 6 and n / greatest(total, word_count) > 0.06), "
            "hv as (select site_id, page_id, list(term order by rank) as terms from tr where rank <= 5 group by 1, 2 having count(*) >= 3), "
            "sm as (select site_id, page_id, path, list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(concat_ws(' ', title, array_to_string(h1s, ' '))), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')) as stems from tk where word_count >= 200) "
            "select site_id, 'content-keyword-stuffing' as rule_id, path as url, note from (select site_id, page_id, string_agg(term, ', ' order by term) as note from sf where k <= 5 group by 1, 2) join tk using (site_id, page_id) union all "
            "select site_id, 'content-keyword-alignment', path, array_to_string(terms[1:3], ', ') from hv join sm using (site_id, page_id) where len(list_intersect(list_transform(terms, lambda t: regexp_replace(t, '(ing|ed|es|s)$', '')), stems)) = 0"
        ),
        "duplicate_clusters": f"with recursive {PAGES}, {_CLUSTERS} select site_id, page_id, leader_id from cl",
        "duplicate_findings": f"with recursive {PAGES}, {_CLUSTERS} select site_id, 'indexing-duplicate-content' as rule_id, path as url, cast(leader_id as varchar) as note from cl where (site_id, leader_id) in (select site_id, leader_id from cl group by 1, 2 having count(*) > 1)",
        "misaligned_titles": (
            f"{pages}, {_TOKENS}, hv as (select site_id, page_id, list(term order by rank) as terms from tr where rank <= 5 group by 1, 2 having count(*) >= 3), "
            "sm as (select site_id, page_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(concat_ws(' ', title, array_to_string(h1s, ' '))), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')) as stems from tk where word_count >= 200) "
            "select site_id, page_id, array_to_string(terms[1:3], ', ') as topic from hv join sm using (site_id, page_id) where len(list_intersect(list_transform(terms, lambda t: regexp_replace(t, '(ing|ed|es|s)$', '')), stems)) = 0"
        ),
        "vector_neighbours": (
            "select query_id, vec_id, floor(score * 10000 + 0.5) / 10000 as score from (select q.vec_id as query_id, r.vec_id, round(list_dot_product(cast(q.embedding as double[]), cast(r.embedding as double[])), 6) as score, "
            "row_number() over (partition by q.vec_id order by round(list_dot_product(cast(q.embedding as double[]), cast(r.embedding as double[])), 6) desc, r.vec_id) as k from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) where k <= 10"
        ),
        "page_issues": f"{_scored()} select site_id, rule_id, category, impact, effort, risk, cast(confidence as integer) as confidence, affected from iss join cat using (rule_id)",
        "page_regressions": f"with {_STATES} {_regressions()}",
        "site_regressions": f"with {_STATES} {_site_regressions()}",
        "regression_gate": f"with {_STATES} select snapshot_id, max(case level when 'critical' then 3 when 'warning' then 2 else 1 end) >= 3 as fails from (select snapshot_id, level from ({_regressions()}) union all select snapshot_id, level from ({_site_regressions()})) group by 1",
        "issue_deltas": (
            f"with {_STATES}, ii as (select snapshot_id, rule_id, list_distinct(flatten(list(coalesce(paths, [])))) as paths from snapshot_issue where snapshot_id is not null and rule_id is not null group by 1, 2), "
            "b as (select ii.* from ii join pr using (snapshot_id) where prev_id is not null), a as (select pr.snapshot_id, ii.rule_id, ii.paths from ii join pr on pr.prev_id = ii.snapshot_id), "
            "m as (select coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.rule_id, b.rule_id) as rule_id, a.paths as pa, b.paths as pb from a full join b on a.snapshot_id = b.snapshot_id and a.rule_id = b.rule_id), "
            "d as (select *, len(list_filter(pb, lambda x: not list_contains(pa, x))) as fresh from m) "
            "select snapshot_id, rule_id, case when pa is null then 'new' when pb is null then 'resolved' else 'worsened' end as delta, cast(case when pa is null then len(pb) when pb is null then 0 else fresh end as integer) as fresh from d where pa is null or pb is null or fresh > 0"
        ),
        "snapshot_summary": (
            f"with {_STATES}, {_PAIRS}, {_changes()} select snapshot_id, case worst when 3 then 'critical' when 2 then 'warning' when 1 then 'info' else 'none' end as level, coalesce(critical, 0) as critical, coalesce(warnings, 0) as warnings, "
            "pq.s.overall - pq.p.overall as overall_delta, pq.s.geo - pq.p.geo as geo_delta, crossed from pq left join ct using (snapshot_id)"
        ),
        "gate_new": (
            f"with {_STATES}, {_PAIRS}, {_changes()} select snapshot_id, coalesce(critical, 0) > 0 or snapshot_id in (select snapshot_id from lv where kind <> 'resolved' and coalesce(impact, '') <> 'low') as fails from pq left join ct using (snapshot_id)"
        ),
        "issue_levels": f"with {_STATES}, {_PAIRS}, {_levels()} select * from lv",
        "category_deltas": f"with {_STATES}, {_PAIRS} select snapshot_id, category, score - coalesce(was[category], score) as delta from (select snapshot_id, p.cat as was, unnest(map_keys(s.cat)) as category, unnest(map_values(s.cat)) as score from pq)",
        "pages_added": (
            f"with {_STATES}, st1 as (select snapshot_id, path, arg_max(status, loaded_at) as status from page_state where snapshot_id is not null and path is not null group by 1, 2) "
            "select b.snapshot_id, b.path from st1 b join pr using (snapshot_id) left join st1 a on a.snapshot_id = pr.prev_id and a.path = b.path where prev_id is not null and a.path is null and b.status between 200 and 299"
        ),
        "snapshot_fields": P5.split("select coalesce(a.snapshot_id")[0].replace(
            "cast(sig as varchar) as sig from page", "cast(sig as varchar) as sig, [cast(x as varchar) for x in [sig[1]::varchar, sig[2]::varchar, sig[3]::varchar, sig[4]::varchar, sig[5]::varchar, sig[6]::varchar, sig[7]::varchar, sig[8]::varchar]] as v from page"
        ).replace("cast(sig as varchar) from issue", "cast(sig as varchar), [sig[1]::varchar, sig[2]::varchar, sig[3]::varchar, sig[4]::varchar] as v from issue").replace("kind, k, sig from rec", "kind, k, v from rec")
        + "select a.snapshot_id, a.kind as record_kind, a.k as record_key, n as field from (select a.*, b.v as w, unnest(case when a.kind = 'page' then "
        "['status', 'title', 'description', 'canonical', 'noindex_meta', 'noindex_header', 'h1', 'redirected_to'] else ['impact', 'category', 'title', 'paths'] end) as n, unnest(range(1, len(a.v) + 1)) as i "
        "from a join b on a.snapshot_id = b.snapshot_id and a.kind = b.kind and a.k = b.k) a where v[i] is distinct from w[i]",
        "rule_catalog": f"with {_catalog()} select rule_id, category, impact, effort, risk, cast(confidence as integer) as confidence from cat",
        "rule_host_variants": (
            "with o as (select p.*, s.start_url from (select * from probes where kind = 'link' and url is not null qualify row_number() over (partition by site_id, url order by probed_at desc, status desc, final_url desc) = 1) p join site_files s using (site_id)), "
            f"v as (select site_id, start_url, final_url, case when url like 'http:%' then 'http' when {_host('url')} <> {_host('start_url')} then 'twin' end as kind from o where status between 200 and 299 and {_bare('url')} = {_bare('start_url')}) "
            f"select site_id, 'indexing-host-duplicate' as rule_id, final_url as url, cast(null as varchar) as note from v where kind = 'twin' and {_host('final_url')} <> {_host('start_url')} "
            "union all select site_id, 'indexing-http-not-redirected', final_url, null from v where kind = 'http' and final_url like 'http:%'"
        ),
        "crawl_state": (
            f"{pages} select 'crawl' as snapshot_id, site_id, path, status, title, description, canonical, noindex_meta, header_noindex as noindex_header, h1, redirected_to from ("
            f"select site_id, {_path('coalesce(requested_url, url)')} as path, ord, page_id, status, title, meta_description as description, canonical, "
            "regexp_matches(coalesce(lower(meta_robots), ''), '\\b(noindex|none)\\b') as noindex_meta, header_noindex, h1s[1] as h1, "
            f"case when len(coalesce(redirected_from, [])) > 0 then {_path('url')} end as redirected_to from f where url is not null) "
            f"where path is not null qualify row_number() over (partition by site_id, path order by coalesce(ord, {1 << 62}), page_id) = 1"
        ),
        "vitals_ttfb": (
            "select site_id, 'experimental_time_to_first_byte' as metric, p75, case when p75 <= 800 then 'good' when p75 <= 1800 then 'needs-improvement' else 'poor' end as rating from "
            "(select site_id, quantile_cont(response_time_ms, 0.75) as p75 from (select distinct site_id, page_id, response_time_ms from pages) where response_time_ms is not null group by 1)"
        ),
        "vitals_events": (
            "select event_type, 'interaction_to_next_paint' as metric, p75, case when p75 <= 200 then 'good' when p75 <= 500 then 'needs-improvement' else 'poor' end as rating from "
            "(select event_type, quantile_cont(value, 0.75) as p75 from events where value is not null group by 1)"
        ),
        "event_windows": "select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select distinct on (event_id) * from events) group by 1, 2",
    }
    for rule in rules:
        out[f"rule_{rule.replace('-', '_')}"] = f"{pages} {_page_findings([rule])}"
    return out | _audited(out)
