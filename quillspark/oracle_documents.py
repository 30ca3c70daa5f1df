"""DuckDB SQL for queries_documents.py. Patterns and constants are written out here, not imported."""

from __future__ import annotations

import re

from quillspark.oracle import PAGES, SEG, STATUS
from quillspark.oracle import SQL as LINT

SQL: dict[str, str] = {}
KEYS = "keys as (select c_custkey::bigint k, c_name as name from customer)"


def pick(key: str, *values: str) -> str:
    return f"([{', '.join(values)}])[{key} % {len(values)} + 1]"


def quoted(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


PARTS = "parts as (select p_partkey::bigint k, p_name as name, p_brand brand, p_type kind_of, p_size size, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b from part)"


def composed(template: str) -> str:
    """A text of columns between angle quotes; a mark stands for a newline, another for a return."""
    return "concat(" + ", ".join(p if k % 2 else "replace(replace(" + quoted(p)[0] + ", '~', chr(10)), '%', chr(13))" for k, p in enumerate(re.split("[‹›]", template))) + ")"


_KINDS = {"xlsx": ("office", "xlsx"), "pptx": ("office", "pptx"), "docx": ("office", "docx"), "pdf": ("pdf", "pdf")} | {x: ("image", "md") for x in ("png", "jpg", "jpeg", "webp")} | {x: ("structured_text", x) for x in ("txt", "md", "csv", "json", "html", "htm")}
_PROMISES = {"office": "native objects and immutable fields preserved", "pdf": "translated reconstruction; visual review required", "image": "text extraction, not image replication", "structured_text": "native syntax and protected fields validated"}
_CAPABLE = "capable as (select * from (values " + ", ".join(f"('{k}', '{a}', '{o}', '{_PROMISES[a]}')" for k, (a, o) in _KINDS.items()) + ") t(kind, adapter, output, guarantee))"
SQL["file_capabilities"] = f"""with {PARTS}, {_CAPABLE}, e as (select *, {pick("size", *quoted("xlsx", "pdf", "png", "md", "exe", "pptx", "docx", "jpeg", "webp", "csv", "json", "htm", "tar.gz", ""))} || case when k % 5 = 0 then left(a, 1) else '' end x from parts),
f as (select 'dir.v1/' || name || ' ' || k || '.' || case when k % 3 = 0 then upper(x) else x end as path, lower(regexp_extract(case when k % 3 = 0 then upper(x) else x end, '([^.]*)$', 1)) kind from e)
select path, kind, adapter, output, guarantee from f left join capable using (kind)"""
SQL["sniffed_kinds"] = f"""with {PARTS}, c as (select k, {pick('k', *quoted('D0CF11E0A1B1', '504B0304', '255044462D312E', '89504E470D0A1A0A', 'FFD8FFE0', '5249464600000000', '', '89504E47'))} || case when size % 2 = 0 then hex('WEBP') else '' end || hex(name) x from parts)
select k, case when x like 'D0CF11E0%' then 'ole' when x like '504B%' then 'zip' when x like '255044462D%' then 'pdf' when x like '89504E470D0A1A0A%' then 'png' when x like 'FFD8FF%' then 'jpg' when x like '52494646________57454250%' then 'webp' else 'text' end kind, md5(unhex(x)) as content from c"""
SQL["image_headers"] = """with o as (select o_orderkey n, o_custkey + 1 w, o_orderkey % 4000 + 1 h, 'i' || o_orderkey || '.' || case when o_orderkey % 11 = 0 then 'webp' when o_orderkey % 17 = 0 then 'gif' else (['png', 'JPEG', 'webp'])[o_orderkey % 3 + 1] end as path from orders),
r as (select *, case when n % 13 > 0 then (['PNG', 'JPEG', 'WEBP'])[n % 3 + 1] end form from o)
select path, form as format, case when form is not null then w end width, case when form is not null then h end height,
 case when path like '%.gif' then 'extension' when form is null then 'header' when n % 11 = 0 and n % 3 < 2 then 'format' end error from r"""
SQL["text_inspection"] = r"""select doc_id, case doc_id % 7 when 2 then null when 3 then null when 1 then length(regexp_replace(text, '[^\p{L} ]', '', 'g')) + 7 + case when doc_id % 2 = 0 then 2 else 0 end else length(text) end::bigint n_chars,
 case when doc_id % 7 in (2, 3) then 'encoding' when doc_id % 7 = 1 and doc_id % 2 = 1 then 'json' end error from documents"""
LINES_OF = """li as (select *, l_orderkey o, l_linenumber % 2 par, 'o' || l_orderkey || '.zip' as path, 'T' || l_partkey t,
  row_number() over (partition by l_orderkey order by l_linenumber % 2, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) i, count(*) over (partition by l_orderkey) n from lineitem),
good as (select * from li where o % 11 in (0, 6, 7, 8, 9, 10))"""
SQL["package_verdicts"] = """select 'o' || o || '.zip' as path, case when o % 11 not in (4, 5) then case o % 3 when 0 then 'docx' when 1 then 'xlsx' else 'pptx' end end kind,
 case o % 11 when 5 then 'File is not a zip file' when 1 then 'duplicate' when 4 then 'signature' when 2 then 'macro' when 3 then 'traversal' else 'ok' end verdict from (select distinct l_orderkey o from lineitem)"""
SQL["package_features"] = f"""with {LINES_OF} select path, 'opaque_assets' feature, count(*) n, true limitation from good where o % 3 = 0 and l_returnflag = 'R' and l_partkey % 5 > 0 group by path
 union all select path, 'charts', count(*), false from good where o % 3 = 1 and l_returnflag = 'N' group by path"""
SQL["broken_relationships"] = f"with {LINES_OF} select path, 'word/_rels/document.xml.rels' as source, 'rId' || i rel_id, 'image' kind, 'word/media/i' || i || '.png' target from good where o % 3 = 0 and l_returnflag = 'R' and l_partkey % 5 = 0"
SQL["shared_cells"] = f"""with {LINES_OF}, c as (select *, (i * 7 + l_partkey) % (n + 1) ref from good where o % 3 = 1)
 select c.path, 'xl/worksheets/sheet1.xml' sheet, 'A' || c.i cell, c.ref::int as index, s.t as value from c left join good s on s.o = c.o and s.i = c.ref + 1"""
SQL["slide_order"] = f"""with {LINES_OF}, p as (select distinct path, o, par from good where o % 3 = 2), r as (select *, row_number() over (partition by path order by case when o % 4 < 2 then par else -par end) - 1 page_no from p)
 select path, page_no::int page_no, 'page ' || (page_no + 1) title, 'ppt/slides/slide' || (par + 1) || '.xml' part from r"""
_PAR = "dense_rank() over (partition by path order by par) - 1"
_DEPTHS = f"""{LINES_OF}, w as (select *, {_PAR} k, case l_suppkey % 7 when 0 then 1 when 1 then -1 else 0 end step from good where o % 3 = 0),
 s as (select *, sum(step) over (partition by path order by i) total from w), d as (select *, total - least(0, min(total) over (partition by path order by i)) depth, (step <> 0)::int + 1 marks from s)"""
SQL["run_groups"] = f"""with {_DEPTHS}, word as (select path, k, t, sum(case when step <> 0 then 1 else 0 end + case when l_partkey % 11 = 0 then 0 else 1 end) over (partition by path, k order by i) island, l_partkey % 11 = 0 or depth > 0 hidden from d),
 q as (select *, case l_returnflag when 'A' then 'b' when 'R' then 'x' else '' end sig, {_PAR} k from good where o % 3 = 2), e as (select *, lag(sig) over w is null or lag(sig) over w <> sig or lag(l_partkey % 3) over w = 0 fresh, (l_partkey % 3 = 0)::int br from q window w as (partition by path, par order by i)),
 g as (select *, sum(fresh::int + br) over (partition by path, par order by i) - br island from e)
 select path, 'word/document.xml' part, 'p:' || k || '/g:' || island::bigint as location, 1::bigint n_runs, t as source from word where not hidden
 union all select path, 'ppt/slides/slide' || (par + 1) || '.xml', 'p:0/g:' || island::bigint, count(*), string_agg(t, '' order by i) from g group by path, par, island"""
UNITS = f"""{LINES_OF}, m as (select *, {_PAR} k, case when l_partkey % 4 = 1 and l_partkey % 11 <> 0 then 1 else 0 end link, l_suppkey % 7 < 2 field from good where o % 3 = 0),
 wr as (select *, l_partkey % 11 = 0 simple from m),
 marks as (select path, k, i, 0 sub, true stop, null as t, '' as link from wr where field union all select path, k, i, 1, false, t, case when link = 1 then 'l' || i else '' end from wr where not simple),
 f as (select *, stop or coalesce(lag(stop) over w or lag(link) over w <> link, false) edge from marks window w as (partition by path, k order by i, sub)),
 isl as (select *, sum(edge::int) over (partition by path, k order by i, sub) island from f),
 br as (select *, {_PAR} k, (l_partkey % 3 = 0)::int b from good where o % 3 = 2), sl as (select *, 2 * (sum(b) over (partition by path, par order by i) - b) island from br),
 units as (select path, 'word/document.xml' part, 'p:' || k || '/u:' || island::bigint as location, 'text' category, string_agg(t, '' order by i) as source from isl where not stop group by path, k, island
 union all select path, 'ppt/slides/slide' || (par + 1) || '.xml', 'p:0/u:' || island::bigint, 'shape_text', string_agg(t, '' order by i) from sl group by path, par, island
 union all select distinct path, 'xl/workbook.xml', 'sheet:0', 'sheet_title', 'Data ' || o from good where o % 3 = 1)"""
SQL["package_units"] = f"with {UNITS} select * from units"
SQL["replaced_units"] = f"with {UNITS} select path, part, location, 'neu ' || source || ' & <mehr>' as source from units where category <> 'sheet_title'"
SQL["renamed_workbooks"] = f"""with {LINES_OF}, b as (select path, o, bool_or(l_linestatus = 'F') formulas from good where o % 3 = 1 group by 1, 2)
 select path, 'xl/workbook.xml' as name, 'changed' change from b union all select path, 'xl/worksheets/sheet1.xml', 'changed' from b where formulas union all select path, 'sheet:0', 'It''s Data ' || o from b"""
SQL["partial_parts"] = f"""with {LINES_OF} select path, 'xl/worksheets/sheet1.xml' as name, (57 + sum(25 + length('A' || i) + length(((i * 7 + l_partkey) % (n + 1))::varchar) + case when l_linestatus = 'F' then 52 + length('B' || i) + length(o::varchar) else 0 end))::bigint size from good where o % 3 = 1 group by path
 union all select path, 'ppt/slides/slide1.xml', (123 + sum(22 + length(t) + case l_returnflag when 'A' then 20 when 'R' then 34 else 0 end + case when l_suppkey % 5 = 0 then 19 else 0 end + case when l_partkey % 3 = 0 then 7 else 0 end))::bigint from good where o % 3 = 2 and par = 0 group by path"""
SQL["formula_references"] = f"""with {PARTS} select k, {pick("k", "name || ',' || kind_of", "kind_of", "''", "a || ',' || b", "'It''s ' || a || ',' || b")} sheets,
 concat({pick("k", composed("SUM('New ‹brand›'!A‹size›,'X'!B2)"), composed("#‹kind_of›!#&'X'!A1"), composed("[Book.xlsx]‹kind_of›!A1"), composed("'‹case when a = lower(kind_of) then chr(88) else a end›:‹b›''s'!A1"), composed("'It''s ‹a›'!A1+Table1[‹b›!]+'‹b›''s'!B‹size›"))}, '*', k) formula from parts""".replace("#", '"')
_FRAME = """'{"type": "stage", "n": ' || event_id || '}'"""
_WORDS = r"""'{"type": "stage", "n": "' || regexp_replace(text, '[^\p{L} ]', '', 'g') || '"}'"""
SQL["event_frames"] = f"""select conv_id, turn, {pick("turn", "2", "2", "1", "2")}::bigint n, {_WORDS} || {pick("turn", *quoted('|{"type": "complete"}'), "'|{" + '"type":' + "' || chr(10) || '" + '"error"}' + "'", "''", *quoted('|{"type": "stage"}'))} frames, {pick("turn", "null", "null", "'malformed'", "'truncated'")} error from conversations"""
SQL["glossary_pairs"] = f"""with {PARTS} select k, k % 4 in (0, 3) valid, case k % 4 when 0 then b || ' ' || size when 3 then name end a, case k % 4 when 0 then name || ' = ' || k when 3 then kind_of end own from parts"""
SQL["text_guards"] = rf"""with d as (select doc_id, left(text, 300) t from documents) select doc_id, replace(t, ' ', ' ') soft, doc_id % 2 = 1 and regexp_matches({pick("doc_id", "'='", "' +'", "''", "'- '")} || t, '^\s*[=+@-]') expression,
 regexp_replace(regexp_replace(t || ' *x*' || chr(13) || chr(10) || ' [y](z)', '\s*\r?\n\s*', ' ', 'g'), '([\\`*_{{}}\[\]()#+.!|>~-])', '\\\1', 'g') escaped,
 regexp_replace(case when doc_id % 2 = 0 then t else replace(t, ' ', chr(9)) end, '[\x01-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') clean, case when doc_id % 3 > 0 then doc_id end a, doc_id % 3 > 0 parsed from d"""
SQL["visual_components"] = """with b as (select *, l_tax * 8 - 0.1::double x0, case when l_quantity = 13 then null else l_discount * 5 end y0, l_quantity / 45 x1, (l_suppkey % 50) / 48::double y1 from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(l_returnflag in ('A', 'N') and l_partkey % 17 > 0 and least(x0, y0, x1, y1) >= 0 and greatest(x0, y0, x1, y1) <= 1 and y0 is not null and x0 < x1 and y0 < y1, false) valid from b"""
SQL["sanitised_settings"] = f"with {KEYS} select k, 'Token=[redacted];a.b.api_key=[redacted];a.image_bytes=<image_bytes len=' || length(name) || '>;plain=' || k || ';raw=<bytes len=2>' settings from keys"
SQL["model_options"] = "select * from (values ('nova-1-pro', 'Nova 1 Pro', 12.0::double), ('nova-2-flash', 'nova-2-flash', 21.0::double), ('other', 'Other flash', 0.0::double), ('google-translate', 'Google Translate (Free)', 0.0::double)) t(id, name, score)"
SQL["retry_waits"] = f"""with {PARTS}, w as (select *, case k % 4 when 1 then k * 7 % 5000 - 100 when 3 then size / 4 end head, case when k % 3 = 0 then size / 2 end detail, case when k % 5 > 0 then size end said from parts)
select k, greatest(1, coalesce(head, detail, said, least(300, 15 * pow(2, least(size % 7, 5)))))::double wait, '2.0,4.0,8.0' transient from w"""
BOXES = """b as (select o_orderkey % 400 page, case when left(o_orderpriority, 1) in ('1', '2') then 'cell' else 'block' end kind, o_orderkey box_no, (o_custkey % 97 * 10)::double x0, (o_orderkey * 7 % 83 * 10)::double y0,
 (o_custkey % 97 * 10 + 15 + o_orderkey % 11 * 5)::double x1, (o_orderkey * 7 % 83 * 10 + 10 + o_custkey % 13 * 5)::double y1 from orders)"""
SQL["points_in_boxes"] = f"""with {BOXES}, p as (select distinct l_orderkey % 400 page, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey point, (l_partkey % 991)::double x, ((l_partkey * 3 + l_linenumber * 57) % 877)::double y from lineitem),
h as (select p.page, point, x, y, min(case when kind = 'cell' then 0 else 1000000000000 end + box_no) best from p left join b on p.page = b.page and x between x0 and x1 and y between y0 and y1 group by all)
select page, case when best is null then 'page' when best < 1000000000000 then 'cell' else 'block' end kind, best % 1000000000000 box_no, count(*) n_points, sum(y) sum_y from h group by 1, 2, 3"""
SQL["page_regions"] = f"""with recursive {BOXES}, k as (select * from b where kind = 'block'),
e as (select x.page, x.box_no a, y.box_no b from k x join k y on x.page = y.page and x.x0 <= y.x1 and y.x0 <= x.x1 and x.y0 <= y.y1 and y.y0 <= x.y1),
r as (select page, box_no a, box_no b from k union select r.page, r.a, e.b from r join e on e.page = r.page and e.a = r.b),
l as (select page, a box_no, min(b) region from r group by 1, 2), u as (select page, region, min(x0) rx0, min(y0) ry0, max(x1) rx1, max(y1) ry1 from l join k using (page, box_no) group by 1, 2)
select page, box_no, region, rx0, ry0, rx1, ry1 from l join u using (page, region)"""
SQL["log_tails"] = "select user_id % 8 bucket, n::int from_end, event_id || ' ' || event_type || ' ' || user_id line from (select *, row_number() over (partition by user_id % 8 order by event_id desc) n from events) where n <= 40"
SQL["rule_guidance"] = """with e as (select *, 'kind ' || (user_id % 60) kind from events),
v as (select kind, ts, max(struct_pack(rule := 'rule ' || (event_id % 9), active := event_type = 'error')) v from e where event_type in ('error', 'purchase') and user_id % 60 <> 7 and user_id % 3 = 0 and event_id % 10 = 0 group by 1, 2),
d as (select event_id doc_id, kind, ts from e where event_type not in ('error', 'purchase') and user_id % 60 % 3 < 2),
j as (select d.*, v.ts since, v.v v from d asof left join v on d.kind = v.kind and d.ts >= v.ts)
select doc_id, kind, case when since is null then 'missing' when ts > since + interval 2 day then 'stale' when v.active then 'active' else 'inactive' end state, case when v.active and ts <= since + interval 2 day then v.rule end as rule from j"""
SQL["style_scales"] = """with f as (select l_returnflag || l_linestatus style, l_orderkey % 10 page, 0.7::double + l_discount * 4 - l_tax fit from lineitem), t as (select style, median(fit) target from f group by 1), l as (select style, page, median(fit) as local from f group by 1, 2)
select page, count(*) n, round(min(greatest(0.8, least(target, local))), 6) least, round(max(greatest(0.8, least(target, local))), 6) most from f join t using (style) join l using (style, page) group by 1"""
SQL["dominant_styles"] = "select region, style, n from (select l_suppkey region, l_returnflag || l_linestatus || l_linenumber style, count(*) n from lineitem group by 1, 2) qualify row_number() over (partition by region order by n desc, style) = 1"
SQL["missing_letters"] = rf"""with t as (select conv_id, turn, left(text, 200) || 'qq-7' e, replace(left(text, 200), {pick("turn", *quoted("e", "n", "é", "A", "zz"))}, '') || 'q7' f from conversations),
l as (select conv_id, turn, unnest(string_split(e, '')) c, 1 n from t union all select conv_id, turn, unnest(string_split(f, '')), -1 from t),
m as (select conv_id, turn, c from l where regexp_matches(c, '[\p{{L}}\p{{Nd}}]') group by all having sum(n) > 0)
select conv_id, turn, coalesce(string_agg(c, '' order by encode(c)) filter (c is not null), '') missing from t left join m using (conv_id, turn) group by 1, 2"""
SQL["page_findings"] = f"""with {PAGES}, b as (select doc_id, page_no, length(body) % 5 = 0 blank from pages_), a as (select doc_id, page_no, page_no % 4 = 1 blank from pages_ where page_no % 5 <> 3 union all select doc_id, 99, length(body) % 5 = 0 from pages_ where page_no = 0),
j as (select doc_id, page_no, case when a.blank is null then 'page_missing' when b.blank is null then 'page_added' when a.blank and not b.blank then 'blank_output' end code from b full join a using (doc_id, page_no))
select doc_id, page_no, code, case when code = 'page_added' then 'review' else 'error' end severity from j where code is not null"""
SQL["typeset_checks"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, array_to_string(list_filter([case when l_partkey % 4 = 0 and (220 + l_quantity)::int >= 245 then 'blank_page' end, case when l_discount * 5 + 0.2::double < 0.45::double then 'small_text' end,
 case when l_linestatus = 'F' then 'compact_layout' end], lambda x: x is not null), ',') findings, case when l_partkey * 50 + l_suppkey >= 65000 then greatest(55000, floor((l_partkey * 50 + l_suppkey) * 0.85::double)) end::int next_scale from lineitem"""
# Parts are runs of a batch's ids, cut at half their length; an answer is wrong by the same rules at every attempt but the first.
SQL["asked_batches"] = f"""with recursive {SEG}, q as (select *, (row_number() over (partition by doc_id order by line_no) - 1) // 24 batch from seg), b as (select doc_id, batch, list(line_no order by line_no) ids from q group by 1, 2),
p as (select doc_id, batch, 0 depth, ids from b
  union all select doc_id, batch, depth + 1, unnest([ids[1:len(ids) // 2], ids[len(ids) // 2 + 1:]]) from p where depth < 2 and len(ids) > 1 and ((len(ids) > 6 and len(list_filter(ids, lambda i: i % 17 = 0)) > 0) or len(list_filter(ids, lambda i: i % 41 = 5)) > 0)),
j as (select *, case when len(ids) > 6 and len(list_filter(ids, lambda i: i % 17 = 0)) > 0 then 'omitted' when len(list_filter(ids, lambda i: i % 41 = 5)) > 0 then 'id' end error from p)
select doc_id, batch, ids[1] first_id, len(ids)::int n_ids, error, depth::int depth, case when error is not null or doc_id % 3 = 0 then 2 else 1 end attempt, case when error is null then len(ids)::int end n_texts from j where error is null or depth = 2 or len(ids) = 1"""
SQL["image_reports"] = r"""with d as (select doc_id, doc_id % 11 = 0 or doc_id % 13 = 0 or not regexp_matches(coalesce(text, ''), '\S') or regexp_matches(lower(trim(text)), '^(error:|\*\[translation error)') bad, doc_id % 7 k, regexp_replace(left(text, 60), '[^\p{L} ]', '', 'g') f, doc_id % 4 = 0 lim from documents),
s as (select *, k = 0 or (k = 1 and regexp_matches(f, '\S')) sound from d)
select doc_id, case when bad then 'failed' end coverage, case when not bad then case when not sound then 'unavailable' when k = 0 then 'passed' else 'needs_review' end end semantic,
 case when bad then 'failed' when sound and k = 0 and not lim then 'passed' else 'needs_review' end status,
 case when bad then 'image_translation_failed:The image''s translation is empty or an error.:error' else concat_ws('|', case when not sound then 'image_review_unavailable:The review''s answer has another form.:review' when k = 1 then 'image_review:' || f || ':review|image_review:x:review' end, case when lim then 'capability_limit:Markdown, not a picture.:review' end) end findings from s"""
# Every attempt's draft is judged by itself; a page takes the first one without defects, or the last.
_ATTEMPTS = PAGES.replace("pages_ as", "own as") + r""", second as (select *, replace(replace(body, '[text continues]', ''), 'Article 5', 'Article five') b2 from own),
drafts as (select doc_id, page_no, a, case a when 1 then body when 2 then b2 else replace(b2, 'TODO check', 'checked') end body from second, range(1, 4) t(a))"""
_LAID = r"""later as (select *, replace(replace(body, '\frac{{1}}{{2}}', '1/2'), 'Chapter 1 one Chapter 2 two', 'Chapter 1 one' || chr(10) || 'Chapter 2 two') b2 from taken),
layouts as (select doc_id, page_no, a translations, defects found, f, case f when 1 then body when 2 then b2 else replace(b2, 'second key: two value', 'and a second key') end body from later, range(1, 4) t(f))""".replace("{{", "{").replace("}}", "}")
_DRAFT_LINT = LINT["page_lint"].replace(PAGES, "pages_ as (select doc_id * 10 + a doc_id, page_no, body from drafts)").replace("case when page_no = 6 then '  ' else body end", "body")
_LAYOUT_LINT = LINT["layout_lint"].replace(PAGES, "pages_ as (select doc_id * 10 + f doc_id, page_no, body from layouts)")
SQL["page_loop"] = f"""with {_ATTEMPTS}, judged as ({_DRAFT_LINT}),
first as (select d.*, defects, row_number() over (partition by d.doc_id, d.page_no order by defects <> '', case when defects = '' then a else -a end) r from drafts d join judged j on j.doc_id = d.doc_id * 10 + a and j.page_no = d.page_no),
taken as (select * from first where r = 1), {_LAID}, laid as ({_LAYOUT_LINT}),
last as (select l.*, defects, row_number() over (partition by l.doc_id, l.page_no order by defects <> '', case when defects = '' then f else -f end) r from layouts l join laid j on j.doc_id = l.doc_id * 10 + f and j.page_no = l.page_no)
select doc_id, page_no, translations::int translations, f::int formats, concat_ws(',', nullif(found, ''), nullif(defects, '')) defects, case when found = '' and defects = '' then 'passed' else 'needs_review' end status, md5(body) draft from last where r = 1"""
SQL["published_orders"] = "select o_orderkey, o_orderstatus, o_totalprice from orders"
SQL["fallback_state"] = """with s as (select k::int shard, case when k % 4 > 1 then 'remote' when k <> 12 and k % 8 <> 1 then 'mirror' when k <> 12 then 'local' end place,
 case when k % 4 > 1 then '' else case when k % 4 = 0 then 'remote:missing' else 'remote:damaged' end || case when k = 12 then ',mirror:damaged,local:missing' when k % 8 = 1 then ',mirror:version' else '' end end failures from range(16) t(k))
select shard, place, failures, c_custkey::varchar as key, place || ' ' || c_name as value from s join customer on c_custkey % 16 = shard where place is not null union all select shard, place, failures, null, null from s where place is null"""
SQL["header_runs"] = """with c as (select l_orderkey row_id, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey col_no, l_returnflag as label from lineitem), l as (select *, coalesce((label <> lag(label) over (partition by row_id order by col_no))::int, 1) n from c), r as (select *, sum(n) over (partition by row_id order by col_no) run from l)
select row_id, min(col_no) first_col, count(*) n_cols, label from r group by row_id, run, label having count(*) >= 3"""
_GRID = """x as (select *, l_orderkey o, row_number() over (partition by l_orderkey order by l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey, l_quantity) i,
  count(*) over (partition by l_orderkey, l_returnflag) nf, count(*) over (partition by l_orderkey, l_returnflag, l_linestatus) ns, count(*) over (partition by l_orderkey) n from lineitem),
boxes as (select o, 0 tier, min(i) first, max(i) + 1 past, 'flag ' || l_returnflag as text from x group by o, l_returnflag
  union all select o, 1, min(i), max(i) + 1, 'status ' || l_linestatus from x where nf > 1 group by o, l_returnflag, l_linestatus
  union all select o, 2, i, i + 1, 'line ' || l_linenumber from x where nf > 1 and ns > 1),
cols as (select o, i c from x where o in (select o from x where nf > 1))"""
SQL["header_paths"] = f"""with {_GRID},
paths as (select o, c, list(text order by tier) p, bool_or(tier = 0 and past - first >= 3) wide from cols join boxes using (o) where first <= c and c < past group by o, c),
short as (select o, c, p, case when wide and len(p) > 1 then p[2:] else p end q from paths),
named as (select o, string_agg(text || ' &amp;<br>', '' order by first desc) parents from boxes where tier = 0 and past - first >= 3 group by o)
select o order_no, c::int col, array_to_string(p, '|') as path, q[1] || case len(q) when 1 then '' when 2 then '<br>(' || q[2] || ')' else ': ' || q[2] || '<br>(' || q[3] || ')' end as label from short
union all select o, 0, 'order ' || o, coalesce(parents, '') || 'order ' || o from (select distinct o from cols) left join named using (o)"""
SQL["flat_tables"] = f"""with {_GRID},
r as (select o, i, n + 1 width, case when l_partkey % 2 = 0 then '' else 'L' end || l_linenumber as label, case when l_suppkey % 2 = 0 then '' else 'shipped from supplier ' end || l_suppkey v from x),
m as (select *, i >= 4 or length(v) > 20 merged from r), t as (select *, max(i) filter (not merged) over (partition by o) full_to from m),
s as (select *, coalesce(width >= 7 and i > full_to, false) tail, case when length(v) <= 6 then i // 2 else 0 end before, width - 1 - i lacks from t)
select o order_no, (2 + i)::int row_no, case when tail then 2 else 1 end part,
  case when tail then label || '|' || v else case when lacks = 1 and label like 'L%' then '|' else '' end || label || '|' || repeat('|', before) || v || repeat('|', i - before - 1) || case when lacks = 1 and label like 'L%' then '' else repeat('|', lacks) end end texts,
  width >= 8 dense from s"""
SQL["distributed_text"] = r"""with p as (select conv_id, turn, regexp_extract_all(coalesce(text, ''), '\s+|[^\s]+') w from conversations), c as (select *, round_even(len(w) * 3 / 10, 0)::int a, round_even(len(w) * 8 / 10, 0)::int b from p)
select conv_id, turn, array_to_string(w[1:a], '') || '|' || array_to_string(w[a + 1:b], '') || '|' || array_to_string(w[b + 1:], '') parts from c"""
SQL["contents_pages"] = rf"""with {PAGES}, l as (select doc_id, page_no, unnest(string_split(body, chr(10))) x, generate_subscripts(string_split(body, chr(10)), 1) i from pages_),
s as (select *, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '(\S)\s{{2,}}(Chapter|Section|Article|Part)', '\1' || chr(10) || '\2', 'g') y from l where regexp_matches(x, '\S') and not regexp_matches(x, '^\s*```')),
n as (select *, max(i) over (partition by doc_id, page_no) last from s), g as (select doc_id, page_no, string_agg(case when i = last and regexp_matches(y, '^[0-9]+$') then '[Page: ' || y || ']' else y end, chr(10) order by i) b from n group by 1, 2)
select p.doc_id, p.page_no, md5(coalesce(b, '')) digest, length(coalesce(b, ''))::bigint n_chars from pages_ p left join g using (doc_id, page_no)"""
def _leaders(title: str) -> str:
    return f"repeat('·', greatest(10, least(65, 80 - (length({title}) * 3) // 2)))"


_RENDERED = {
    "blocks": '<div class="doc-title">‹name›</div>~<div class="doc-chapter">Chapter ‹k› on ‹a›</div>~<div class="doc-paragraph">plain ‹b› text that goes on</div>~<div class="doc-clause"><b>‹size›.1</b> clause ‹a› more of it</div>~<div class="doc-item"><b>1.</b> item ‹name›</div>~'
    '<div class="doc-bullet-item">• bullet ‹a›</div>~<div class="doc-sub-bullet">• deeper ‹b›</div>~<div class="doc-subitem"><b>(1)</b> condition ‹a›</div>~<div class="doc-sub-bullet">• after ‹b›</div>~<table><tbody><tr><th>‹a›</th><th>‹b›</th></tr><tr><td>‹k›</td><td>x</td></tr></tbody></table>~'
    '<div class="doc-tree">└── ‹name›</div>~<svg>~| ‹a›~</svg>~<div class="doc-paragraph">‹a›: ‹b›</div>~<div class="doc-item"><b>‹k›.</b> counted</div>~<div class="doc-subitem-desc">indented ‹b›</div>',
    "cover": '<div class="cover-title">‹name›</div><div class="cover-date">‹brand›</div><div class="cover-date">2024-‹size›</div><div class="cover-stamp-container"><table class="stamp-table"><tr><td>‹kind_of›, ‹a›</td></tr></table></div>',
    "fractions": '~<table class="formula-table"><tr><td>‹name› =</td><td>‹size›</td></tr><tr><td></td><td>‹b›+{‹k›}</td></tr></table>~and ‹a› × ‹k›',
    "lists": '<p class="item"><strong>‹size›.</strong> ‹a›</p>~<p class="item"><strong>‹size + 1›.</strong> ‹b›</p>',
    "normalised": '1. ‹name›~  * 2. ‹a›~<table class="stamp-table"><tr><td>‹a›<br>‹b›</td></tr></table>#‹k›',
    "table": "<table><tbody><tr><th>n</th><th>‹a›&lt;‹size›</th></tr><tr><td>‹k›</td><td></td></tr><tr><td></td><td>‹a›</td></tr><tr><td>‹b›</td><td>‹brand›</td></tr></tbody></table>",
    "toc": '<div class="doc-title">Contents of ‹brand›</div><table class="toc-table"><tr class="toc-0"><td class="toc-entry">Chapter ‹k› <span class="toc-dots">‹@Chapter›</span></td><td class="toc-page-num">‹size›</td></tr>'
    '<tr class="toc-1"><td class="toc-entry">Part ‹a› <span class="toc-dots">‹@Part›</span></td><td class="toc-page-num">9</td></tr><tr class="toc-1"><td class="toc-entry">‹name› <span class="toc-dots">‹@name›</span></td><td class="toc-page-num">‹size›</td></tr>'
    '<tr class="toc-2"><td class="toc-entry" colspan="2">‹b›</td></tr></table><div class="page-footer">‹size›</div>',
    "unsquashed": "  • ‹name›~  • ‹k›.1 first~  • ‹size›.‹size› ‹b›~| ‹a› | 1.1 b |~‹brand›",
}
_RENDERED["toc"] = _RENDERED["toc"].replace("@Chapter", _leaders("'Chapter ' || k")).replace("@Part", _leaders("'Part ' || a")).replace("@name", _leaders("name"))
SQL["rendered_pages"] = f"with {PARTS} " + " union all ".join(f"select k, '{kind}' kind, {composed(body)} body from parts" for kind, body in _RENDERED.items())
_MARKED = "regexp_replace({}, '([\\\\`*_{{}}\\[\\]()#+.!|>~-])', '\\\\\\1', 'g')"
_WRITTEN = {
    "json": composed('{~  "‹a›/b": " new ‹brand› ",~  "n": [~    ‹k›,~    "‹b›"~  ]~}'),
    "csv": composed("id,text%~‹k›, ‹name› %~"),
    "html": composed('<p title="say &quot;‹brand›&quot;">‹name› &amp; more <b>‹k›</b></p>'),
    "md": "concat('# ', " + _MARKED.format("brand || '_1'") + ", chr(10), 'text *', " + _MARKED.format("a || ' *' || name || '*'") + ", '* end')",
    "bad": "null",
}
SQL["written_documents"] = f"with {PARTS} " + " union all ".join(f"select k doc_id, '{kind}' kind, {body} rendered, {quoted('expression in row:2/column:2')[0] if kind == 'bad' else 'null'} error from parts" for kind, body in _WRITTEN.items())
SQL["located_findings"] = f"with {SEG} select doc_id, segment_id, 'line ' || line_no message, location from seg where line_no % 3 = 0"
SQL["answer_checks"] = """with li as (select *, l_orderkey o, l_quantity q, case when l_suppkey % 9 = 0 then 0 when l_suppkey % 13 = 0 then 2 else 1 end copies from lineitem),
w as (select o, list(distinct l_partkey) e, list(l_partkey order by l_partkey, l_suppkey) own from li group by o),
a as (select o, sum(copies) n, bool_or(l_tax = 0.08) and o % 5 = 0 short, bool_or(copies > 0 and l_partkey % 31 = 0) or max(copies) > 1 odd, bool_or(copies > 0 and q = 7) blank, list(distinct l_partkey) filter (copies > 0) got, count(*) filter (copies > 0) lines, list(distinct l_partkey) filter (q <> 9) seen,
  bool_or(l_suppkey % 7 = 0 and q = 3) stray, bool_or(l_suppkey % 7 = 0 and q = 4) mute, count(*) n_lines, bool_or(q in (11, 5)) bad from li group by o),
h as (select *, list_distinct(own) x, len(e) c from w join a using (o)), s as (select *, list_sort(e) z, c // 2 m from h),
p as (select *, case when c > 1 then [z[1:m], z[m + 1:]] else [z] end parts from s)
select o order_no, case when short and n > 0 then 'record' when odd or lines > len(got) then 'id' when blank then 'text' when len(coalesce(got, [])) < c then 'omitted' end answer,
 case when len(coalesce(seen, [])) < c then 'coverage' when stray or mute then 'finding' end review, case when n_lines > c then 'omitted' when bad then 'evidence' end verdict,
 array_to_string(list_transform(flatten(list_transform(parts, lambda y: case when len(y) > 1 then [y[1:len(y) // 2], y[len(y) // 2 + 1:]] else [y] end)), lambda y: array_to_string(y, '+')), ',') halves from p"""
SQL["cached_drafts"] = f"""with {SEG}, o as (select doc_id, line_no, source, case when doc_id % 2 = 0 and line_no % 3 = 0 and line_no % 6 <> 0 then 'acceptance' when line_no % 2 = 0 and line_no % 4 <> 0 then 'draft' end origin from seg)
select doc_id, line_no, origin, case origin when 'acceptance' then upper(source) when 'draft' then 'draft ' || line_no end as value from o"""
SQL["semantic_checks"] = f"with {SEG} select doc_id, case when bool_or(line_no % 40 = 6) then 'unavailable' when bool_or(line_no % 15 = 4) then 'needs_review' else 'passed' end semantic from seg group by 1"
SQL["document_fingerprints"] = f"""with {SEG}, s as (select doc_id, string_agg(length(segment_id) || ':' || segment_id || length(source) || ':' || source, '' order by line_no) x from seg group by 1)
select d.doc_id, sha256('32:' || md5(text) || '3:txt' || length(lang) || ':' || lang || '1:m' || '0:' || '-' || length(coalesce(x, '')) || ':' || coalesce(x, '')) fingerprint from documents d left join s using (doc_id)"""
SQL["submission_fingerprints"] = """with f as (select l_orderkey batch_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey pos, 'f' || l_partkey || '.txt' as name from lineitem), g as (select batch_id, string_agg(length(name) || ':' || name || '32:' || md5(name), '' order by pos) x from f group by 1)
select batch_id, sha256(length(x) || ':' || x || '1:o') fingerprint from g"""
SQL["planned_tools"] = f"""with {KEYS}, a as (select k, {pick("k", *quoted("pdf", "txt", "docx", "png", "md"))} kind, k % 5 in (1, 4) txt, (k % 4 in (0, 3) or (k % 4 = 1 and k % 5 in (0, 3))) and k % 3 <> 2 ok from keys),
t as (select *, list_concat(list_filter([case when k % 7 = 0 then 'vision_translation' else 'native_translation' end, 'source_review', case when not txt then 'visual_review' end, case when k % 2 = 0 then 'table_review' end, case when k % 3 = 0 then 'diagram_review' end, case when not txt then 'visual_review' end, 'source_review'], lambda x: x is not null),
  case when ok and k % 4 = 0 then ['source_review', 'table_review'] when ok and k % 4 = 1 then ['vision_translation'] else [] end) l from a)
select k, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') tools, case when not ok then 'planner_fallback' when k % 3 = 1 then 'plan_confidence' else '' end findings from t"""
SQL["feedback_states"] = f"with {KEYS} select k, {pick('k', 'null', *quoted('observation', 'observation', 'state', 'state', 'observation'))} error from keys"
SQL["appended_states"] = """with w as (select event_type kind, event_id write_id, floor((event_id / 50.0) % 7)::bigint seen, row_number() over (partition by event_type order by event_id) - 1 turn, length(event_type) g from events where event_id % 50 = 0)
select kind, write_id, (g + turn + 1)::bigint generation, case when greatest(0, g + turn - seen) < 3 then 'written' else 'skipped' end outcome from w"""
SQL["text_sections"] = "select c_mktsegment as text, array_to_string(list_sort(list(distinct 'n' || c_nationkey)), ',') sections from customer group by 1"
SQL["sampled_texts"] = f"""with {SEG}, f as (select doc_id, left(source, 20) x, min(line_no) l from seg group by 1, 2), n as (select *, row_number() over (partition by doc_id order by l, x) n from f), t as (select * from n where n <= 5)
select doc_id, string_agg(x, '|' order by n) texts, string_agg(x, '|' order by length(x) desc, x) longest from t group by 1"""
SQL["report_snapshots"] = f"with {KEYS} select k, case when k % 3 = 0 then 'checks,model_calls,plan,status' else 'checks,model_calls,status' end as keys, name checks from keys"
SQL["allowed_patches"] = "select c_custkey segment_no, c_mktsegment as source, case c_mktsegment when 'BUILDING' then 'Bau' else 'Maschinen' end as value, 'needs_review' status from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"
SQL["colours_and_tags"] = f"with {KEYS} select k, '#' || lpad(lower(hex((k * 7919) & 16777215)), 6, '0') colour, name || ' 1 < 2' bare from keys"
SQL["finding_counts"] = f"with {STATUS} select count(*) n, count(*) filter (status = 'failed') failed, count(*) filter (status = 'needs_review') open, max((status = 'failed')::int) exit_code from reports"
SQL["planned_stages"] = f"with {KEYS} select 'f' || k || {pick('k', *quoted('.PDF', '.csv', '.htm', ''))} as path, {pick('k', *quoted('inspect>extract>translate>audit>typeset', 'parse>translate>serialise', 'Translate .htm', 'Translate file'))} stages from keys"
SQL["page_types"] = f"with {KEYS} select k, {pick('k', *quoted('toc', 'table_dense', 'structured_clauses', 'standard', 'table_dense'))} page_type from keys"
SQL["rule_texts"] = f"with {KEYS} select k, case when k % 3 = 0 and k % 2 = 0 then 'je' when k % 3 = 1 and k % 2 = 1 then 'gf' else 'any' end rules from keys"
SQL["scanned_files"] = f"with {PAGES} select 'd' || doc_id as path, count(*) n_pages, bool_or((doc_id + page_no) % 9 = 0 or not regexp_matches(coalesce(body, ''), '\\S')) scanned from pages_ group by 1"
SQL["review_index"] = f"""with {KEYS} select k doc_id, '<article><h2>&lt;' || name || '&gt;</h2><p>Status: <strong>' || case when k % 2 = 0 then 'passed' else 'pending' end || '</strong></p><details><summary>Review findings (' || {pick('k', *quoted('3', '0', '1'))} || ')</summary><ul>' || {pick('k', *quoted('<li>a: b &amp; c</li><li>d: &#x27;e&#x27;</li>', '', '<li>x</li>'))} || '</ul></details></article>' card from keys"""
SQL["lease_events"] = """with recursive r as (select user_id % 10 job, event_id, ts, 'w' || event_id % 3 w, (['claim', 'heartbeat', 'claim', 'finish'])[event_id % 4 + 1] a, row_number() over (partition by user_id % 10 order by ts, event_id) rn from events),
f as (select job, event_id, rn, w own, case when a = 'claim' then w else '' end who, case when a = 'claim' then ts + interval 1 hour end until, case when a = 'claim' then 'claimed' else 'lost' end outcome from r where rn = 1
  union all select job, event_id, rn, w, case when a = 'claim' and alive = '' then w when a = 'finish' and alive = w then '' else alive end, case when (a = 'claim' and alive = '') or (a = 'heartbeat' and alive = w) then ts + interval 1 hour else until end,
    case when a = 'claim' then case when alive = '' then 'claimed' else 'busy' end when alive <> w then 'lost' when a = 'heartbeat' then 'extended' else 'finished' end
  from (select r.*, f.until, case when f.who <> '' and f.until >= r.ts then f.who else '' end alive from f join r on r.job = f.job and r.rn = f.rn + 1))
select job job_id, own as owner, event_id, outcome from f"""
