"""SQL with the results of this subpackage's queries, where SQL can express them."""

_P1 = r"""
with words as (
  select distinct page_id,
    trim(regexp_replace(lower(upper(replace(replace(meta_description, 'ß', 'ss'), 'ﬁ', 'fi'))), '[^\p{L}\p{N}]+', ' ', 'g')) as d,
    list_sort(list_filter(list_transform(
      string_split(regexp_replace(regexp_replace(replace(replace(title, 'ß', 'ss'), 'ﬁ', 'fi'),
        '[\s\p{Z}]([|–—\-·»/]|::)[\s\p{Z}]', chr(1) || ' ', 'g'), '\x01 ?([|–—\-·»/]|::)[\s\p{Z}]', chr(1), 'g'), chr(1)),
      lambda p: trim(regexp_replace(lower(upper(p)), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda p: p <> '')) as t
  from pages where page_id is not null),
groups as (
  select d, t, min(page_id) as first_page_id from words where d <> '' and len(t) > 0 group by d, t having count(distinct page_id) > 1)
"""

ORACLE = {
    "p1_found": _P1 + "select distinct first_page_id, page_id from words join groups using (d, t) where page_id > first_page_id",
    "p1_collapsed": _P1 + "select first_page_id, count(distinct page_id) as copies from words join groups using (d, t) group by first_page_id",
}
