"""SQL of the search, catalogue, page and service queries, for an independent engine."""

from __future__ import annotations

from quire.functions import arabic
from quire.functions.verses import LAST, NAMES, VERSES

_D20 = "0123456789" * 2
_DIGITS = arabic.EASTERN_DIGITS + arabic.PERSIAN_DIGITS

_VIEWS = f"""b as (
   select book_id, coalesce(book_name, '') as book_name, book_category, coalesce(book_type, 1) as book_type, case when book_date > 0 and book_date <> 99999 then book_date end as book_date, authors_csv,
     case when main_author > 0 then main_author end as main_author, coalesce(printed, 0) as printed, coalesce(major_online, 0) as major_online, coalesce(major_ondisk, 0) > 0 as downloaded, meta_data
   from (select *, row_number() over (partition by book_id order by loaded_at desc) as rn from book where deleted_at is null) where rn = 1),
 a as (select author_id, author_name, case when death_number > 0 and death_number <> 99999 then death_number end as death_year
   from (select *, row_number() over (partition by author_id order by loaded_at desc) as rn from author where deleted_at is null) where rn = 1),
 pg as (select * from (select *, row_number() over (partition by book_id, page_id order by loaded_at desc) as rn from page where deleted_at is null) where rn = 1),
 pt as (select distinct book_id, page_id, body, foot, comment from page_text),
 ti as (select * from (select *, row_number() over (partition by book_id, id order by loaded_at desc) as rn from title) where rn = 1),
 sv as (select distinct service_name, key_id, book_id, page_id from service),
 ids as (select book_id, list_filter(list_concat([main_author], list_transform(regexp_extract_all(translate(coalesce(authors_csv, ''), '{_DIGITS}', '{_D20}'), '[0-9]{{1,9}}'), lambda x: cast(x as integer)), coalesce(meta_data.coauthor, cast([] as integer[]))), lambda x: x > 0) as l from b),
 bridge as (select distinct unnest(l) as author_id, book_id from ids),
 bm as (select b.*, a.author_name, a.death_year from b left join a on a.author_id = b.main_author)"""


def _fold(c: str) -> str:
    return f"translate({c}, '{arabic.INDEX_LETTERS + arabic.INDEX_DROP}', '{arabic.INDEX_BECOME}')"


def _tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({_fold(f'''regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g')''')}, '[\\p{{L}}\\p{{N}}]+'), lambda t: case when t = 'ابن' then 'بن' else t end)"


def _verify(c: str) -> str:
    s = f"coalesce({c}, '')"
    s = f"regexp_replace({s}, '<[^>]*>', ' ', 'g')"
    for pair, one in arabic.COMPOSE.items():
        s = f"replace({s}, '{pair}', '{one}')"
    s = f"translate(regexp_replace({s}, '{arabic.VERIFY_DROP}', '', 'g'), '{arabic.VERIFY_LETTERS}', '{arabic.VERIFY_BECOME}')"
    return f"list_transform(regexp_extract_all({s}, '[؀-ۿ]+'), lambda t: case when t = 'ابن' then 'بن' else t end)"


def _exact(c: str, diacritics: bool, hamza: bool, digits: bool) -> str:
    s = f"coalesce({c}, '')"
    for pair, one in arabic.COMPOSE.items():
        s = f"replace({s}, '{pair}', '{one}')"
    s = f"replace(regexp_replace({s}, '<[^>]*>', ' ', 'g'), 'ـ', '')"
    if not diacritics:
        s = f"regexp_replace({s}, '{arabic.VERIFY_DROP}', '', 'g')"
    if not hamza:
        s = f"translate({s}, '{arabic.VERIFY_LETTERS}', '{arabic.VERIFY_BECOME}')"
    if not digits:
        s = f"translate({s}, '{_DIGITS}', '{_D20}')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _stem(c: str) -> str:
    c = f"regexp_replace({c}, '^و(.{{3,}})$', '\\1')"
    c = f"regexp_replace({c}, '^(?:{arabic.STEM_PREFIXES})(.{{2,}})$', '\\1')"
    for s in arabic.STEM_SUFFIXES:
        c = f"regexp_replace({c}, '^(.{{2,}}){s}$', '\\1')"
    return c


_TOK = f"tk as (select book_id, page_id, {_tokens('body')} as tb, {_tokens('foot')} as tf, {_tokens('comment')} as tc from pt)"
_VER = f"vk as (select book_id, page_id, {_verify('body')} as tb, {_verify('foot')} as tf from pt)"
_HITS = "hits as (select book_id, page_id, list_has_any(tb, ['هذا', 'علي']) as inb, list_has_any(tf, ['هذا', 'علي']) as inf from tk where (list_contains(tb, 'هذا') or list_contains(tf, 'هذا')) and (list_contains(tb, 'علي') or list_contains(tf, 'علي')))"


def _in(a: str, b: str) -> str:
    return f"concat_ws(',', case when {a} then 'body' end, case when {b} then 'foot' end)"


def _coverage(per_book: str, top: int) -> str:
    return f"""pb as ({per_book}),
     j as (select pb.book_id, pb.n_hits, bm.book_category, cast(floor((bm.book_date - 1) / 100) + 1 as integer) as century, case when bm.author_name is not null then bm.main_author end as author from pb join bm using (book_id)),
     k as (select 'category' as kind, book_category as id, sum(n_hits) as n from j where book_category is not null group by 2 union all select 'century', century, sum(n_hits) from j group by 2
       union all (select 'book', book_id, n_hits from j order by n_hits desc, book_id limit {top})
       union all (select 'author', author, sum(n_hits) as n from j where author is not null group by 2 order by n desc, author limit {top}))
     select kind, id, cast(n as bigint) as n_hits from k"""


_PER_BOOK = "select book_id, count(*) as n_hits from hits group by 1"
_MATCH = lambda t: f"(list_contains(tb, '{t}') or list_contains(tf, '{t}'))"
_LABEL = "case when pg.page is not null then coalesce(case when trim(part) not in ('', 'الكتاب') then trim(part) end || '/ ', '') || pg.page end"
_PLAIN = "replace(regexp_replace(coalesce(body, ''), '<[^>]+>', '', 'g'), chr(13), chr(10))"
_CAT = "coalesce(bm.book_name, '(unknown ' || {0}.book_id || ')') as book_name"
_SCOPE = f"""s1 as (select book_id from b where book_category in (1, 2, 3, 4, 5, 6)),
 s2 as (select book_id from b where book_date between 300 and 1200 union select book_id from bridge join a using (author_id) where death_year between 300 and 1200),
 s3 as (select book_id from b where downloaded),
 sc as (select book_id from s1 intersect select book_id from s2 intersect select book_id from s3)"""
_TREE = """t as (select book_id, id, page, coalesce(parent, 0) as parent, body from ti)"""
_CHAIN = """m as (select x.book_id, x.id, case when y.id is null or x.parent = 0 then null else x.parent end as parent from ti x left join ti y on x.book_id = y.book_id and x.parent = y.id),
 r as (select book_id, id, cast(id as varchar) as path from m where parent is null union all select m.book_id, m.id, r.path || '/' || m.id from m join r on m.book_id = r.book_id and m.parent = r.id)"""


def _ara(c: str) -> str:
    return f"translate(cast({c} as varchar), '0123456789', '{arabic.EASTERN_DIGITS}')"


_AUTO = "case when printed <> 1 then 'بترقيم آلي' end"
_CITE = f"""c as (select pg.book_id, pg.page_id, case when trim(part) not in ('', 'الكتاب') then trim(part) end as part, pg.page, bm.*, case when translate(meta_data.prefix, '«»', '') <> '' then translate(meta_data.prefix, '«»', '') else book_name end as nm from pg join bm using (book_id)),
 e as (select *, concat_ws(' ', case when part is not null and page is not null then {_ara('part')} || '/ ' || {_ara('page')} when part is not null then {_ara('part')} when page is not null then 'ص ' || {_ara('page')} end, nullif(trim(meta_data.suffix), ''), {_AUTO}) as place,
   'ج ' || {_ara('part')} as v, 'ص ' || {_ara('page')} as p from c)"""

_FLAGS = " union all ".join(
    f"select {bool(i & 4)} as diacritics, {bool(i & 2)} as hamza, {bool(i & 1)} as digits, count(*) as n_pages from pt where contains({_exact('body', bool(i & 4), bool(i & 2), bool(i & 1))}, '{arabic.fold_exact('إلى', bool(i & 4), bool(i & 2), bool(i & 1))}')" for i in range(8)
)
_STEM = arabic.fold_token("استفزاط")
_SURAS = ", ".join(f"({i + 1}, '{n}', {v}, {e})" for i, (n, v, e) in enumerate(zip(NAMES, VERSES, LAST)))
_VARIANTS = ", ".join(f"'{v}'" for v in dict.fromkeys(arabic.fold_token(x) for x in arabic.prefix_variants("فصل")))
_TYPES = "case book_type when 1 then 'كتاب' when 2 then 'مجلة' when 3 then 'مخطوط' when 4 then 'رسالة جامعية' when 5 then 'إلكتروني' when 6 then 'صوتي' else 'غير معروف' end"
_STATUS = "case when not b.downloaded then 'not_downloaded' when coalesce(h.m, 0) > 0 then 'readable' else 'downloaded_no_pages' end"
_EDITION = "case when trim(coalesce(meta_data.suffix, '')) <> '' then trim(meta_data.suffix) when trim(regexp_extract(book_name, '^.*\\s-\\s+(.*)$', 1)) <> '' then trim(regexp_extract(book_name, '^.*\\s-\\s+(.*)$', 1)) end"
_AYA = 1
_TRAD = f"""js as (select book_id, page_id, case when json_valid(services) then services end as j from pg where services is not null),
 m as (select hits.book_id, hits.page_id, coalesce(try_cast(json_extract(j, '$.hadeeth') as integer[]), cast([] as integer[])) as hadeeth from hits left join js using (book_id, page_id))"""


def _named(before: str) -> str:
    v = f"trim(regexp_extract(front, '{before}([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}} \\t-]*)', 1))"
    return f"case when length({v}) between 2 and 70 then {v} end"


def _suffix(letter: str) -> str:
    return f"case when regexp_matches(edition, '^{letter}\\s') then trim(regexp_replace(edition, '^{letter}\\s+', '')) end"


_CARDS = f"""h as (select book_id, max(page_id) as m from pg group by 1),
 na as (select book_id, count(*) as c from (select distinct book_id, author_id from bridge) join a using (author_id) group by 1),
 fi as (select book_id, page_id, row_number() over (partition by book_id order by page_id) as n from pg where page_id >= 1),
 fr as (select fi.book_id, string_agg(translate(regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g'), '{arabic.INDEX_DROP}', ''), chr(10) order by page_id) as front from fi join pt using (book_id, page_id) where n <= 6 group by 1),
 ca as (select b.*, {_STATUS} as content_status, {_EDITION} as edition, c, front from b left join h on h.book_id = b.book_id left join na on na.book_id = b.book_id left join fr on fr.book_id = b.book_id),
 cb as (select *, {_suffix('ت')} as ed, {_suffix('ط')} as pub from ca),
 cc as (select *, ed is null and pub is null and content_status = 'readable' as bare from cb)"""


def _auto(term: str, src: str, key: str, name: str, kind: str) -> str:
    t = arabic.fold_token(term)
    return f"(select '{kind}' as kind, {key} as id, {name} as name, round(cast({len(t)} as double) / length(array_to_string(tk, '')) + case when list_contains(tk, '{t}') then 1 else 0 end, 6) as score from (select *, {_tokens(name)} as tk from {src}) where len(list_filter(tk, lambda x: starts_with(x, '{t}'))) > 0 order by score desc, id limit 10)"


_PAIRS = ", ".join(f"({i}, {b}, {p})" for i, (b, p) in enumerate((b, p) for b in (3, 1, 2, 999_999) for p in (2, 1, 5000)))
_ASKED = f"""k as (select book_id, count(*) filter (key_id = {_AYA}) as n from sv where service_name = 'tafseer' and book_id is not null group by 1 order by n desc, book_id desc limit 6),
 q as (select book_id, row_number() over (order by n desc, book_id desc) as i from k),
 h as (select book_id, min(page_id) as page_id from sv where service_name = 'tafseer' and key_id = {_AYA} group by 1)"""


ORACLE = {
    "search_books_full": f"with {_VIEWS}, o as (select book_id, unnest(l) as author_id, generate_subscripts(l, 1) as i from ids), f as (select book_id, author_id, min(i) as i from o group by 1, 2), g as (select book_id, string_agg(author_name, ' ' order by i) as names from f join a using (author_id) group by 1), w as (select b.book_id, list_contains({_tokens('book_name')}, 'ابو') as x, list_contains({_tokens('names')}, 'ابو') as y, list_contains({_tokens("concat_ws(' ', meta_data.prefix, meta_data.suffix, meta_data.date)")}, 'ابو') as z from b left join g on g.book_id = b.book_id) select book_id, concat_ws(',', case when x then 'book_name' end, case when y then 'all_authors' end, case when z then 'bibliography' end) as matched_in from w where x or y or z",
    "search_authors_full": f"with {_VIEWS}, t as (select author_id, death_text from (select *, row_number() over (partition by author_id order by loaded_at desc) as rn from author where deleted_at is null) where rn = 1), w as (select author_id, list_contains({_tokens('author_name')}, 'ت') as x, list_contains({_tokens('death_text')}, 'ت') as y from a join t using (author_id)) select author_id, concat_ws(',', case when x then 'author_name' end, case when y then 'death_text' end) as matched_in from w where x or y",
    "fetched_pages": f"with {_VIEWS}, q(place, book_id, page_id) as (values {_PAIRS}) select place, q.book_id, q.page_id, {_LABEL} as printed_page, pg.book_id is not null as found, body, foot, comment from q left join pg on pg.book_id = q.book_id and pg.page_id = q.page_id left join pt on pt.book_id = q.book_id and pt.page_id = q.page_id",
    "fetched_titles": f"with {_VIEWS}, q(place, book_id, title_id) as (values {_PAIRS}) select place, q.book_id, title_id, coalesce(body, '') as body from q left join ti on ti.book_id = q.book_id and ti.id = q.title_id",
    "verse_numbers": f"with s as (select cast(unnest(range(1, {len(VERSES) + 1})) as integer) as surah, unnest({VERSES}) as ayat, unnest({NAMES}) as surah_name), e as (select *, sum(ayat) over (order by surah) - ayat as before from s), v as (select *, cast(unnest(range(1, ayat + 1)) as integer) as aya from e) select cast(before + aya as integer) as aya_id, surah, surah_name, aya from v",
    "verse_texts_asked": f"with {_VIEWS}, {_ASKED}, r as (select h.book_id, h.page_id, i, cast(length(coalesce(body, '')) + length(coalesce(foot, '')) as integer) as n_chars from h join q using (book_id) join b using (book_id) left join pt on pt.book_id = h.book_id and pt.page_id = h.page_id where downloaded), w as (select *, coalesce(sum(n_chars) over (order by i rows between unbounded preceding and 1 preceding), 0) as before, cast(row_number() over (order by i) as integer) as place from r) select place, book_id, page_id, n_chars, case when (before < 12000 or place = 1) and place <= 2 then 'ok' else 'remaining' end as status from w",
    "source_status": f"with {_VIEWS}, {_ASKED}, u as (select cast(i - 1 as integer) as place, book_id, true as taking from q union all select cast(count(*) as integer), -1, false from q) select place, u.book_id, h.page_id, case when h.page_id is null then case when taking then 'no_entry_for_this_aya' else 'not_indexed' end when coalesce(downloaded, false) then 'ok' else 'not_downloaded' end as status from u left join h on h.book_id = u.book_id left join b on b.book_id = u.book_id",
    "search_pages": f"with {_VIEWS}, {_TOK}, {_HITS} select hits.book_id, hits.page_id, {_in('inb', 'inf')} as matched_in, {_CAT.format('hits')}, bm.author_name, bm.book_category as category_id, bm.book_date, {_LABEL} as printed_page from hits left join bm using (book_id) left join pg using (book_id, page_id)",
    "search_pages_scoped": f"with {_VIEWS}, {_TOK}, {_HITS}, {_SCOPE} select book_id, page_id from hits join sc using (book_id)",
    "search_pages_window": f"with {_VIEWS}, {_TOK}, {_HITS} select book_id, page_id from hits order by book_id, page_id limit 20 offset 20",
    "search_pages_coverage": f"with {_VIEWS}, {_TOK}, {_HITS}, {_coverage(_PER_BOOK, 10)}",
    "search_pages_wildcard": f"with {_VIEWS}, {_TOK}, w as (select book_id, page_id, len(list_filter(tb, lambda t: regexp_full_match(t, 'است.*اح'))) > 0 as x, len(list_filter(tf, lambda t: regexp_full_match(t, 'است.*اح'))) > 0 as y, len(list_filter(tc, lambda t: regexp_full_match(t, 'است.*اح'))) > 0 as z from tk) select book_id, page_id, concat_ws(',', case when x then 'body' end, case when y then 'foot' end, case when z then 'comment' end) as matched_in from w where x or y or z",
    "postings_search": f"with {_VIEWS}, {_TOK}, {_HITS} select book_id, page_id, {_in('inb', 'inf')} as matched_in from hits",
    "postings_phrase": f"with {_VIEWS}, {_TOK}, w as (select book_id, page_id, contains(' ' || array_to_string(tb, ' ') || ' ', ' من هذا ') as x, contains(' ' || array_to_string(tf, ' ') || ' ', ' من هذا ') as y from tk) select book_id, page_id, {_in('x', 'y')} as matched_in from w where x or y",
    "search_titles": f"with {_VIEWS}, w as (select *, {_tokens('body')} as tk from ti) select book_id, id as title_id, page, parent, body from w where list_contains(tk, 'في') and list_contains(tk, 'باب')",
    "search_books": f"with {_VIEWS}, w as (select *, {_tokens('book_name')} as t1, {_tokens('author_name')} as t2 from bm) select book_id, book_name, author_name, book_category as category_id, book_date from w where list_contains(t1, 'كتاب') or list_contains(t2, 'كتاب')",
    "search_books_rollup": f"with {_VIEWS}, hits as (select book_id from (select *, {_tokens('book_name')} as t1, {_tokens('author_name')} as t2 from bm) where list_contains(t1, 'كتاب') or list_contains(t2, 'كتاب')), {_coverage(_PER_BOOK, 10)} where kind in ('category', 'century')",
    "search_authors": f"with {_VIEWS}, n as (select author_id, count(*) as c from bridge group by 1) select author_id, author_name, death_year, cast(coalesce(c, 0) as integer) as book_count from a left join n using (author_id) where list_contains({_tokens('author_name')}, 'ابو')",
    "search_phrase": f"with {_VIEWS}, {_VER}, w as (select book_id, page_id, contains(' ' || array_to_string(tb, ' ') || ' ', ' من هذا ') as x, contains(' ' || array_to_string(tf, ' ') || ' ', ' من هذا ') as y from vk) select book_id, page_id, {_in('x', 'y')} as matched_in from w where x or y",
    "search_near": f"with {_VIEWS}, {_VER}, w as (select book_id, page_id, len(list_filter(range(1, len(tb) + 1), lambda i: list_has_all(tb[i : i + 10], ['من', 'هذا', 'علي']))) > 0 as x, len(list_filter(range(1, len(tf) + 1), lambda i: list_has_all(tf[i : i + 10], ['من', 'هذا', 'علي']))) > 0 as y from vk) select book_id, page_id, {_in('x', 'y')} as matched_in from w where x or y",
    "search_exact": f"with {_VIEWS}, w as (select book_id, page_id, contains({_exact('body', False, True, False)}, 'إلى ما') as x, contains({_exact('foot', False, True, False)}, 'إلى ما') as y from pt) select book_id, page_id, {_in('x', 'y')} as matched_in from w where x or y",
    "search_exact_flags": f"with {_VIEWS} {_FLAGS}",
    "search_boolean": f"with {_VIEWS}, {_TOK} select book_id, page_id, concat_ws(',', 'هذا', case when {_MATCH('قبل')} then 'قبل' end, case when {_MATCH('بعد')} then 'بعد' end) as matched_terms from tk where {_MATCH('هذا')} and ({_MATCH('قبل')} or {_MATCH('بعد')}) and not {_MATCH('كان')}",
    "search_boolean_report": f"with {_VIEWS}, {_TOK} " + " union all ".join(f"select '{t}' as term, count(*) as total from tk where {_MATCH(t)}" for t in ("هذا", "قبل", "بعد", "كان")),
    "root_stats": f"with {_VIEWS}, {_TOK}, hits as (select book_id from tk where len(list_filter(list_concat(tb, tf), lambda t: {_stem('t')} = {_stem(f"'{_STEM}'")})) > 0), {_coverage(_PER_BOOK, 15)}",
    "resolve_names": f"with {_VIEWS} {_auto('كتا', 'b', 'book_id', 'book_name', 'book')} union all {_auto('أبو', 'a', 'author_id', 'author_name', 'author')}",
    "search_verses": f"with {_VIEWS} select book_id, id as title_id, body from ti where list_has_any({_tokens('body')}, [{_VARIANTS}])",
    "page_cards": f"with {_VIEWS} select pg.book_id, pg.page_id, case when trim(part) not in ('', 'الكتاب') then trim(part) end as part, {_LABEL} as printed_page, lag(pg.page_id) over w as prev_page_id, lead(pg.page_id) over w as next_page_id, cast(length({_PLAIN}) as integer) as n_chars, cast(length(coalesce(foot, '')) as integer) as n_foot from pg left join pt using (book_id, page_id) window w as (partition by pg.book_id order by pg.page_id)",
    "page_chains": f"with recursive {_VIEWS}, {_CHAIN}, o as (select pg.book_id, pg.page_id, max(ti.id) as title_id from pg left join ti on ti.book_id = pg.book_id and ti.page <= pg.page_id group by 1, 2) select o.book_id, o.page_id, o.title_id, r.path as chain from o left join r on r.book_id = o.book_id and r.id = o.title_id",
    "page_services": f"with {_VIEWS}, js as (select book_id, page_id, json_valid(services) as valid, case when json_valid(services) then services end as j from pg where services is not null) select book_id, page_id, valid, coalesce(array_to_string(try_cast(json_extract(j, '$.ayat') as integer[]), ','), '') as ayat, coalesce(array_to_string(try_cast(json_extract(j, '$.hadeeth') as integer[]), ','), '') as hadeeth, cast(coalesce(len(try_cast(json_extract(j, '$.esnad') as varchar[])), 0) as integer) as n_esnad from js",
    "page_ranges": f"with {_VIEWS}, n as (select book_id, page_id, row_number() over (partition by book_id order by page_id) as n from pg where page_id >= 1), s as (select n.*, cast(length(coalesce(body, '')) + length(coalesce(foot, '')) as integer) as n_chars from n left join pt using (book_id, page_id) where n <= 20), t as (select *, sum(n_chars) over (partition by book_id order by page_id) as upto from s) select book_id, page_id, n_chars from t where upto <= 12000 or n = 1",
    "toc": f"with {_VIEWS}, {_TREE}, l1 as (select *, 1 as level from t where parent = 0), l2 as (select t.*, 2 as level from t join l1 on t.book_id = l1.book_id and t.parent = l1.id), u as (select * from l1 union all select * from l2) select book_id, id as title_id, page, parent, body, level, exists (select 1 from t where t.book_id = u.book_id and t.parent = u.id) as has_children from u",
    "book_sections": f"with {_VIEWS}, {_TREE}, l as (select book_id, max(page_id) as last_page from pg group by 1), n as (select *, lead(page) over (partition by book_id, parent order by id) as nxt from t where page is not null), s as (select n.book_id, n.id, n.page, greatest(n.page, coalesce(nxt - 1, last_page, 0)) as e from n left join l using (book_id)) select book_id, id as title_id, page as start_page_id, e as end_page_id, e - page + 1 as total_pages from s",
    "book_cards": f"with {_VIEWS}, {_CARDS} select book_id, book_name, book_category as category_id, book_type, {_TYPES} as book_type_label, book_date, major_online > 0 as available, content_status = 'readable' as downloaded, content_status, cast(coalesce(c, 0) as bigint) as n_authors, meta_data.date as publication_date, edition, coalesce(ed, case when bare then coalesce({_named('(?:دراسة وتحقيق|بتحقيق|تحقيق|المحقق)\\s*[:：]\\s*')}, {_named('حققه(?:\\s+و\\p{L}+\\s+(?:عليه|له|أحاديثه))*\\s+')}) end) as editor, coalesce(pub, case when bare then {_named('(?:دار النشر|الناشر)\\s*[:：]\\s*')} end) as publisher, cast(coalesce(len(meta_data.sub_books), 0) as integer) as n_sub_books from cc",
    "book_parts": f"with {_VIEWS} select book_id, trim(part) as part, count(*) as page_count, min(page_id) as first_page_id, max(page_id) as last_page_id from pg where trim(part) not in ('', 'الكتاب') group by 1, 2",
    "book_authors": f"with {_VIEWS}, o as (select book_id, unnest(l) as author_id, generate_subscripts(l, 1) as i from ids), f as (select book_id, author_id, min(i) as i from o group by 1, 2), p as (select *, row_number() over (partition by book_id order by i) - 1 as position from f) select p.book_id, cast(position as integer) as position, author_id, author_name, death_year, case when author_id = b.main_author then 'main' else 'co' end as role from p join a using (author_id) join b on b.book_id = p.book_id",
    "author_cards": f"with {_VIEWS}, n as (select author_id, list_sort(list(book_id)) as l from bridge group by 1) select author_id, author_name, death_year, cast(coalesce(len(l), 0) as integer) as book_count, coalesce(array_to_string(l, ','), '') as book_ids from a left join n using (author_id)",
    "list_categories": f"with {_VIEWS} select book_category as category_id, count(*) as book_count, count(*) filter (downloaded) as downloaded_count from b where book_category is not null group by 1 having downloaded_count > 0",
    "downloaded_books": f"with {_VIEWS}, h as (select book_id, max(page_id) as m from pg group by 1) select b.book_id, book_name, book_category as category_id, {_STATUS} as content_status from b left join h on h.book_id = b.book_id where downloaded",
    "downloaded_tally": f"with {_VIEWS} select coalesce(book_category, -1) as category_id, count(*) as n_books from b where downloaded group by 1",
    "books_by_period": f"with {_VIEWS} select book_id, book_name, author_name, death_year, book_date, book_category as category_id, downloaded from bm where book_date between 200 and 900 and death_year between 1 and 800",
    "scope_books": f"with {_VIEWS}, {_SCOPE} select book_id from sc",
    "scope_diagnostics": f"with {_VIEWS}, {_SCOPE} select 'category_ids' as source, count(*) as contributed from s1 union all select 'period[300..1200]', count(*) from s2 union all select 'downloaded_only', count(*) from s3 union all select 'intersection', count(*) from sc",
    "library_health": f"with {_VIEWS}, dl as (select book_id, row_number() over (order by book_id) - 1 as r, count(*) over () as n from b where downloaded), pick as (select distinct book_id from dl where n <= 5 or r in (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)), ok as (select book_id from pick where book_id in (select book_id from pg where page_id > 0)) select (select count(*) from b) as catalog_books, (select count(*) from b where downloaded) as downloaded_books, (select count(distinct book_category) from b) as categories, (select count(*) from a) as catalog_authors, (select count(*) from pick) as sampled, (select count(*) from ok) as readable, case when (select count(*) from b) > 0 and ((select count(*) from pick) = 0 or (select count(*) from ok) > 0) then 'ok' else 'degraded' end as status",
    "citations": f"with {_VIEWS}, {_CITE} select book_id, page_id, '«' || nm || '»' || case when place <> '' then ' (' || place || ')' else '' end as default_style, concat_ws('، ', author_name, nm, v, p) || '.' as short_style, concat_ws('. ', case when death_year is not null then author_name || ' (ت ' || {_ara('death_year')} || 'هـ)' else author_name end, nm) || coalesce('. ' || nullif(concat_ws('، ', {_ara('book_date')} || 'هـ', v, p, {_AUTO}), ''), '') || '.' as full_style, cast(4 + case when author_name is null then 1 else 0 end + case when author_name is not null and death_year is null then 1 else 0 end + case when book_date is null then 1 else 0 end as integer) as n_missing from e",
    "verse_entries": f"with {_VIEWS}, su(surah, surah_name, ayat, last) as (values {_SURAS}) select sv.key_id, sv.book_id, sv.page_id, {_CAT.format('sv')}, author_name, coalesce(downloaded, false) as downloaded, surah, surah_name, key_id - last + ayat as aya from sv left join bm using (book_id) join su on sv.key_id between last - ayat + 1 and last where service_name = 'tafseer'",
    "tradition_entries": f"with {_VIEWS} select key_id, sv.book_id, page_id, book_name, author_name, downloaded from sv join bm using (book_id) where service_name = 'hadeeth' and downloaded",
    "verse_coverage": f"with {_VIEWS}, h as (select book_id, min(page_id) as page_id from sv where service_name = 'tafseer' and key_id = {_AYA} group by 1), u as (select book_id from b where downloaded and book_category in (3, 4) union select book_id from h) select u.book_id, {_CAT.format('u')}, author_name, death_year, book_category as category_id, coalesce(book_category in (3, 4), false) as on_shelf, coalesce(downloaded, false) as downloaded, case when h.page_id is not null then 'indexed_covers' when u.book_id in (select book_id from sv where service_name = 'tafseer') then 'indexed_no_entry_for_this_aya' else 'not_indexed_coverage_unknown' end as status, h.page_id from u left join h using (book_id) left join bm using (book_id)",
    "verse_coverage_totals": f"with {_VIEWS}, t as (select distinct key_id, book_id from sv where service_name = 'tafseer'), o as (select book_id from b where downloaded and book_category in (3, 4)), k as (select book_id from o where book_id in (select book_id from t)) select key_id as aya_id, count(*) as indexed_covers, (select count(*) from k) - count(*) filter (book_id in (select book_id from o)) as indexed_no_entry, (select count(*) from o) - (select count(*) from k) as not_indexed from t group by 1",
    "verse_texts": f"with {_VIEWS}, h as (select book_id, min(page_id) as page_id from sv where service_name = 'tafseer' and key_id = {_AYA} group by 1), r as (select h.book_id, h.page_id, cast(length(coalesce(body, '')) + length(coalesce(foot, '')) as integer) as n_chars from h join b using (book_id) left join pt using (book_id, page_id) where downloaded), w as (select *, coalesce(sum(n_chars) over (order by book_id rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (order by book_id) as n from r) select book_id, page_id, n_chars, case when (before < 12000 or n = 1) and n <= 10 then 'ok' else 'remaining' end as status from w",
    "tradition_matches": f"with {_VIEWS}, {_TOK}, {_HITS}, {_TRAD} select book_id, page_id, array_to_string(hadeeth, ',') as hadeeth from m",
    "tradition_sources": f"with {_VIEWS}, {_TOK}, {_HITS}, {_TRAD}, k as (select distinct unnest(hadeeth) as key_id from m) select key_id, sv.book_id, page_id, {_CAT.format('sv')}, author_name, coalesce(downloaded, false) as downloaded from sv join k using (key_id) left join bm using (book_id) where service_name = 'hadeeth'",
}
