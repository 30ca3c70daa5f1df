"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from quillspark.operators.feedback import CODE_CHECKS
from quillspark.plans.relations import SNIPPETS, STATES

SQL: dict[str, str] = {}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Written out here, so that a wrong pattern of the library shows.
NUMBER, URL, PLACEHOLDER = r"\p{Nd}+(?:[.,]\p{Nd}+)*", r"https?://[^\s<>]+", r"(?i)\[(?:omitted|continues?|translation error)[^\]]*\]"
CJK_UNITS, SEPARATED = "万|萬|亿|億|千|百|年|月|日|時|时|년|월|일|시|만|억|천|백", r"\p{Nd}[.,:/-]\p{Nd}"
WORD_UNITS = "million|billion|thousand|hundred|january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec|once|twice|one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|am|pm"
TRUNCATED = (r"(?i)\[(?:text\s+)?continues?\]", r"(?i)\[(?:rest\s+of\s+)?(?:page|section|article)?\s*omitted\]", r"(?i)\[sentence\s+continues\]", r"(?i)\b(?:TODO|FIXME)\b")
CJK_RUN = "[一-鿿぀-ゟ゠-ヿ]{10,}"
TOC_TITLE = r"(?i)^(?:#+\s*)?(?:Table\s+of\s+Contents|Contents|目次|목차|目录|Sommaire|Inhalt|Indice|Tabla\s+de\s+contenidos)\b"
TOC_LEADER = r"[·.\s]{2,}\s*\p{Nd}+$"
TOC_ENTRY = r"(?i)^(?:#+\s*)?(?:Chapter|Section|Article|Part|Chapitre|Kapitel|Capítulo|Capitolo|Appended|Supplementary|第\s*\p{Nd}+\s*[章節条部]|제\s*\p{Nd}+\s*[장절조])\b"
MESSAGES = {"coverage": "Source segment has no translation.", "numbers": "Numeric entities differ from the source.", "url": "A URL in the source text was changed.", "placeholder": "Output contains an omission or error placeholder."}
NOW, JOBS_NOW = "timestamp '2024-01-30 00:00:00'", "timestamp '1996-06-17 00:00:00'"
CODES = "[" + ", ".join(map(_text, CODE_CHECKS)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


SEG = rf"""
tok as (select doc_id, text, unnest(t) x, generate_subscripts(t, 1) - 1 line_no from (select doc_id, text, regexp_extract_all(text, '[^\r\n]+|[\r\n]+') t from documents where text is not null)),
off as (select *, (sum(length(x)) over (partition by doc_id order by line_no) - length(x))::int b from tok),
seg as (select doc_id, line_no::bigint line_no, substr(sha256('txt' || chr(0) || 'offset:' || b || ':' || (b + length(x))), 1, 24) segment_id, 'txt' part, 'offset:' || b || ':' || (b + length(x)) as location,
  {strip("x")} source, substr(text, greatest(0, b - 150) + 1, b + length(x) + 150 - greatest(0, b - 150)) context, b, length(x) n
  from off where not regexp_matches(x, '[\r\n]') and regexp_matches(x, '\p{{L}}'))"""
PAIRS = SEG + r""",
dig as (select *, substr(md5(doc_id || ':' || line_no), 1, 1) d from seg),
pairs as (select doc_id, line_no, segment_id, location, b, n, case when d = '5' then source || ' https://example.org/a' else source end source,
  case when d = '1' then null when d = '2' then source || ' 7' when d = '3' then '[omitted]' when d = '4' then regexp_replace(source, '[0-9]', '9', 'g') else source end candidate from dig)"""


def finding_of(rel: str) -> str:
    head = "doc_id, '{0}' code, '{1}' message, 'error' severity, segment_id, location"
    full = f"{strip('coalesce(candidate, ' + chr(39) * 2 + ')')} <> ''"
    parts = [
        f"select {head.format('coverage', MESSAGES['coverage'])} from {rel} where not ({full})",
        f"select {head.format('numbers', MESSAGES['numbers'])} from {rel} where {full} and list_sort(regexp_extract_all(source, '{NUMBER}')) <> list_sort(regexp_extract_all(candidate, '{NUMBER}'))",
        f"select {head.format('url', MESSAGES['url'])} from (select *, unnest(regexp_extract_all(source, '{URL}')) u from {rel} where {full}) where not contains(candidate, u)",
        f"select {head.format('placeholder', MESSAGES['placeholder'])} from {rel} where {full} and regexp_matches(candidate, '{PLACEHOLDER}')",
    ]
    return " union all ".join(parts)


FOUND = PAIRS + f", found as ({finding_of('pairs')})"
CHECKS = ", flags as (select doc_id, bool_or(code = 'coverage') c, bool_or(code in ('numbers', 'url', 'placeholder')) p from found group by 1), checked as (select d.doc_id, unnest(['coverage', 'protected_entities']) check_name, unnest([case when c then 'failed' else 'passed' end, case when p then 'failed' else 'passed' end]) status from documents d left join flags using (doc_id))"
STATUS = FOUND + CHECKS + """,
allf as (select doc_id, code, severity from found union all select doc_id, 'toxic', 'review' from labels where toxic = 1),
fs as (select doc_id, count(*) filter (severity = 'error') n_errors, count(*) filter (severity = 'review') n_reviews from allf group by 1),
cs as (select doc_id, bool_or(status = 'failed') failed, bool_or(status <> 'passed') open from checked group by 1),
reports as (select d.doc_id, case when coalesce(n_errors, 0) > 0 or failed then 'failed' when coalesce(n_reviews, 0) > 0 or open then 'needs_review' else 'passed' end status, coalesce(n_errors, 0) n_errors, coalesce(n_reviews, 0) n_reviews from documents d left join fs using (doc_id) left join cs using (doc_id))"""
OBS = f"""obs0 as (select event_type kind, event_id obs_id, user_id doc, ts, list_slice({CODES}, 1, event_id % 6 + 1) eligible, ({CODES})[(event_id // 7) % 6 + 1] f from events),
obs as (select kind, obs_id, doc, ts, eligible, case when obs_id % 4 = 0 and list_contains(eligible, f) then [f] else [] end failures from obs0)"""
_states = "[" + ", ".join(map(_text, STATES)) + "]"
JOBS = f"""j0 as (select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey id, * from lineitem),
j1 as (select *, case when id % 499 = 0 then 'running' else ({_states})[id % 7 + 1] end state from j0),
jobs as (select id, l_orderkey batch_id, 'p' || (l_suppkey % 7) provider, state, (id % 100)::int progress, case when state = 'running' then 'w' || (id % 5) end as owner, l_shipdate lease_until, id % 13 = 0 cancel_requested, id row_no,
  case when state in ('passed', 'needs_review') then 'a' || id end artifact, id % 50 model_calls, id % 7 previous_model_calls, (l_quantity * 100000)::bigint size from j1),
batches as (select o_orderkey id, md5(o_custkey::varchar) token_hash, md5(o_orderpriority) fingerprint, o_orderdate + interval 60 days expires from orders)"""
RECOVERED = JOBS + f", rec as (select * replace (case when state = 'running' and lease_until < {JOBS_NOW} then case when cancel_requested then 'cancelled' else 'queued' end else state end as state, case when not (state = 'running' and lease_until < {JOBS_NOW}) then owner end as owner) from jobs)"
_snips = "[" + ", ".join(f"replace({_text(s.replace(chr(10), '~~'))}, '~~', chr(10))" for s in SNIPPETS) + "]"
PAGES = f"pages_ as (select conv_id doc_id, turn page_no, case when s is null then text else text || chr(10) || s end body from (select *, ({_snips})[(conv_id * 7 + turn) % 13 + 1] s from conversations))"
LINES = PAGES + ", lined as (select doc_id, page_no, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) - 1 pos from pages_), stripped as (select *, " + strip("line") + " s from lined)"
ASKED = "asked as (select case when o_orderkey % 9 = 0 then -o_orderkey else o_orderkey end id, md5((o_custkey + case when o_orderkey % 5 = 0 then 1 else 0 end)::varchar) token_hash, md5(case when o_orderkey % 4 = 0 then 'other' else o_orderpriority end) fingerprint from orders)"

SQL["text_segments"] = f"with {SEG} select doc_id, line_no, segment_id, location, source, context from seg"
SQL["segment_stats_by_lang"] = f"with {SEG} select lang, count(*) n_segments, sum(length(seg.source))::bigint n_chars, max(length(seg.source))::bigint longest, min(segment_id) first_id from seg join documents using (doc_id) group by 1"
SQL["segment_batches"] = f"with {SEG}, r as (select *, (row_number() over (partition by doc_id order by line_no) - 1) // 24 batch from seg) select doc_id, batch, count(*) n, min(line_no) first_line, max(line_no) last_line from r group by 1, 2"
SQL["neighbour_context"] = f"with {SEG} select doc_id, line_no, left(array_to_string(list(source) over (partition by doc_id order by line_no rows between 3 preceding and 3 following), ' '), 5000) around from seg"
SQL["context_dictionary"] = f"with {SEG}, s as (select doc_id, line_no, left(source, 12) context from seg), f as (select doc_id, context, row_number() over (partition by doc_id order by min(line_no)) - 1 k from s group by 1, 2) select doc_id, line_no, context, 'context_' || k context_ref from s join f using (doc_id, context)"
SQL["rendered_documents"] = f"""with {PAIRS},
o2 as (select o.doc_id, o.line_no, case when p.candidate is not null and {strip("p.candidate")} <> '' then regexp_extract(x, '^\\s*') || {strip("p.candidate")} || regexp_extract(x, '\\s*$') else x end y from off o left join pairs p using (doc_id, line_no)),
r as (select doc_id, string_agg(y, '' order by line_no) t from o2 group by 1)
select d.doc_id, length(coalesce(t, d.text))::bigint n_chars, md5(coalesce(t, d.text)) digest from documents d left join r using (doc_id)"""
SQL["segment_findings"] = f"with {FOUND} select * from found"
SQL["conversion_candidates"] = f"""with {PAIRS}, q as (select *, coalesce(candidate, '') c from pairs)
select doc_id, segment_id, len(regexp_extract_all(source, '{NUMBER}')) <> len(regexp_extract_all(c, '{NUMBER}')) or regexp_matches(lower(source || chr(10) || c), '{CJK_UNITS}')
  or regexp_matches(lower(source || chr(10) || c), '(^|[^\\p{{L}}\\p{{N}}_])(?:{WORD_UNITS})($|[^\\p{{L}}\\p{{N}}_])') or regexp_matches(lower(source || chr(10) || c), '{SEPARATED}') plausible
from q where list_sort(regexp_extract_all(source, '{NUMBER}')) <> list_sort(regexp_extract_all(c, '{NUMBER}'))"""
SQL["normalised_numbers"] = f"with n as (select doc_id, list_sort(regexp_extract_all(text, '{NUMBER}')) x from documents) select doc_id, len(x)::bigint n, array_to_string(x, ',') numbers from n where len(x) > 0"
SQL["id_reconciliation"] = f"""with {SEG}, s as (select doc_id, line_no from seg),
b as (select * from s where (doc_id + line_no) % 7 <> 0 union all select * from s where (doc_id + line_no) % 11 = 1 union all select doc_id, line_no + 100000 from s where line_no % 5 = 0), c as (select doc_id, line_no, count(*) n from b group by 1, 2)
select doc_id, line_no, case when s.doc_id is null then 'unknown' when n is null then 'missing' else 'duplicate' end kind from s full join c using (doc_id, line_no) where s.doc_id is null or n is null or n > 1"""
SQL["check_rollup"] = f"with {FOUND}{CHECKS} select * from checked"
SQL["report_status"] = f"with {STATUS} select * from reports"
SQL["segment_quality_report"] = f"with {STATUS} select lang, status, count(*) n_docs, sum(n_errors)::bigint n_errors, sum(n_reviews)::bigint n_reviews from reports join documents using (doc_id) group by 1, 2"
SQL["failure_codes"] = f"with {FOUND} select doc_id, array_to_string(list_sort(list(distinct code)), ',') codes from (select doc_id, code from found where code in (select unnest({CODES})) union all select doc_id, 'visual' from labels where quality = 0) group by 1"
SQL["report_observations"] = f"""with {STATUS}, codes as (select doc_id, list(distinct code) f from (select doc_id, code from allf where code in (select unnest({CODES})) union all select doc_id, 'visual' from labels where quality = 0) group by 1)
select d.doc_id, array_to_string(list_sort(list_distinct(list_concat(['coverage', 'numbers'], coalesce(f, [])))), ',') eligible, array_to_string(list_sort(coalesce(f, [])), ',') failures from documents d left join codes using (doc_id)"""
SQL["segment_roles"] = f"with {SEG} select doc_id, line_no, 'source_review' || case when line_no % 4 = 0 then ',table_review' else '' end || case when line_no % 6 = 0 then ',diagram_review' else '' end roles from seg"
SQL["accepted_numbers"] = f"with {FOUND} select doc_id, case when code = 'numbers' and doc_id % 2 = 0 then 'numeric_equivalence' else code end code, case when code = 'numbers' and doc_id % 2 = 0 then 'info' else severity end severity, count(*) n from found group by 1, 2, 3"
_fix = f"case when {strip('coalesce(candidate, ' + chr(39) * 2 + ')')} = '' then source else regexp_replace(regexp_replace(candidate, ' 7$', ''), '\\[omitted\\]', '', 'g') end"
SQL["repair_rounds"] = f"""with {FOUND}, b0 as (select distinct doc_id, segment_id from found),
p1 as (select doc_id, segment_id, location, source, case when b0.doc_id is not null then {_fix} else candidate end candidate, (b0.doc_id is not null)::int repairs from pairs left join b0 using (doc_id, segment_id)), f1 as ({finding_of("p1")}), b1 as (select distinct doc_id, segment_id from f1),
p2 as (select doc_id, segment_id, location, source, case when b1.doc_id is not null then {_fix} else candidate end candidate, repairs + (b1.doc_id is not null)::int repairs from p1 left join b1 using (doc_id, segment_id)), f2 as ({finding_of("p2")}), b2 as (select distinct doc_id, segment_id from f2)
select doc_id, sum(repairs)::bigint repairs, count(b2.doc_id) unresolved from p2 left join b2 using (doc_id, segment_id) group by 1"""
SQL["call_budget"] = f"with {SEG}, n as (select doc_id, count(*) n_segments from seg group by 1) select doc_id, n_segments, least(512, greatest(48, ceil(n_segments / 24.0)::bigint * 15 + 22)) budget from n"

EVIDENCE = f"""{OBS}, w as (select * from obs where ts between {NOW} - interval 30 days and {NOW}), e as (select *, unnest({CODES}) code from w),
s as (select kind, code, count(*) filter (list_contains(eligible, code)) documents, count(*) filter (list_contains(eligible, code) and list_contains(failures, code)) failures, count(distinct case when list_contains(eligible, code) and list_contains(failures, code) then ts::date end) failure_days from e group by 1, 2),
ev as (select *, round(case when documents > 0 then failures / documents else 0 end, 4) rate, documents >= 3 and failures >= 2 and failure_days >= 1 and case when documents > 0 then failures / documents else 0 end >= 0.20 active from s)"""
SQL["feedback_evidence"] = f"with {EVIDENCE} select * from ev"
SQL["active_rules"] = f"with {EVIDENCE} select kind, coalesce(string_agg(code, ',' order by code) filter (active), '') rules from ev group by 1"
SQL["observations_latest"] = f"with {OBS} select kind, obs_id, row_number() over (partition by kind order by ts desc, obs_id desc) as position from obs where ts <= {NOW} qualify position <= 200"
SQL["rate_limited_requests"] = """with recursive r as (select user_id as id, event_id request_id, epoch_us(ts) / 1e6 t, row_number() over (partition by user_id order by ts, event_id) rn from events),
f as (select id, request_id, rn, [t] times, true accepted, null::bigint wait from r where rn = 1
  union all select id, request_id, rn, case when len(k) < 3 then list_append(k, t) else k end, len(k) < 3, case when len(k) >= 3 then greatest(1, floor(k[1] + 86400 - t + 0.999)::bigint) end
  from (select r.id, r.request_id, r.rn, r.t, list_filter(f.times, lambda x: x > r.t - 86400) k from f join r on r.id = f.id and r.rn = f.rn + 1))
select id as identity, request_id, accepted, wait retry_seconds from f"""
SQL["stream_limiter"] = SQL["rate_limited_requests"]

SQL["recovered_jobs"] = f"with {RECOVERED} select state, count(*) n, count(owner) owned, min(id) first_id from rec group by 1"
SQL["provider_load"] = f"with {JOBS} select provider, count(*) running from jobs where state = 'running' group by 1"
SQL["claimable_jobs"] = f"""with {RECOVERED}, l as (select provider, count(*) running from rec where state = 'running' group by 1),
q as (select rec.*, row_number() over (partition by provider order by row_no) k from rec join batches on batches.id = batch_id where state = 'queued' and expires > {JOBS_NOW}),
c as (select q.id, provider, row_no, row_number() over (order by row_no) claim_no from q left join l using (provider) where k <= 40 - coalesce(running, 0))
select id, provider, row_no, claim_no from c where claim_no <= 300 - (select count(*) from rec where state = 'running')"""
SQL["beating_jobs"] = f"with {JOBS} select id, owner from jobs where state = 'running' and not cancel_requested and batch_id in (select id from batches where expires > {JOBS_NOW})"
SQL["finished_jobs"] = f"with {JOBS} select id, case when cancel_requested then 'cancelled' else 'needs_review' end state, 100 progress, case when not cancel_requested then artifact end artifact from jobs where state = 'running'"
SQL["cancelled_jobs"] = f"with {JOBS} select case when state in ('queued', 'waiting_credentials') then 'cancelled' else state end state, cancel_requested or state in ('queued', 'running', 'waiting_credentials') cancel_requested, count(*) n from jobs group by 1, 2"
SQL["resumed_jobs"] = f"with {JOBS}, h as (select *, state in ('failed', 'cancelled', 'waiting_credentials') hit from jobs) select case when hit then 'queued' else state end state, count(*) n, sum(case when hit then 0 else model_calls end)::bigint model_calls, sum(previous_model_calls + case when hit then model_calls else 0 end)::bigint previous_model_calls, count(*) filter (cancel_requested and not hit) cancels from h group by 1"
SQL["submit_outcomes"] = f"with {JOBS}, {ASKED} select a.id, case when b.id is null then 'created' when b.token_hash <> a.token_hash then 'token_invalid' when expires <= {JOBS_NOW} then 'expired' when b.fingerprint <> a.fingerprint then 'key_reused' else 'repeated' end outcome from asked a left join batches b on a.id = b.id"
SQL["batch_access"] = f"with {JOBS}, {ASKED} select a.id, case when b.id is null or b.token_hash <> a.token_hash then 'denied' when expires <= {JOBS_NOW} then 'expired' else 'granted' end outcome from asked a left join batches b on a.id = b.id"
SQL["batch_snapshots"] = f"with {JOBS}, t as (select *, state in ('passed', 'needs_review', 'failed', 'cancelled', 'expired') d from jobs) select batch_id, count(*) n_jobs, count(*) filter (d) n_terminal, bool_and(d) finished, count(artifact) n_artifacts from t group by 1"
SQL["expired_jobs"] = f"with {JOBS}, h as (select jobs.*, coalesce(expires <= {JOBS_NOW}, false) and state <> 'expired' hit from jobs left join batches on batches.id = batch_id) select case when hit then 'expired' else state end state, hit or cancel_requested cancel_requested, count(*) n, count(owner) filter (not hit) owned from h group by 1, 2"
SQL["upload_breaches"] = f"with {JOBS}, w as (select id, batch_id, size, count(*) over o c, sum(size) over o t from jobs window o as (partition by batch_id order by row_no)), k as (select *, case when c > 5 then 'too_many' when size > 4900000 then 'file_too_large' when t > 10000000 then 'batch_too_large' end breach from w) select id, batch_id, breach from k where breach is not null"
SQL["job_progress"] = "select user_id job_id, greatest(0, least(95, trunc(value)::int)) progress, left(event_type || ':' || event_id, 2000) message from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"
SQL["run_log_tail"] = "select event_id, event_type from events order by ts desc, event_id desc limit 100"

SQL["review_windows"] = """with p as (select conv_id doc_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 i from conversations),
n as (select doc_id, max(i) m from p group by 1), s as (select doc_id, unnest(range(0, m + 1, 4)) w from n)
select p.doc_id, w::bigint window_start, count(*) n_pages, string_agg(turn::varchar, ',' order by turn) page_nos, md5(string_agg(text, chr(10) order by turn)) digest from p join s on p.doc_id = s.doc_id and i >= w and i < w + 6 group by 1, 2"""
SQL["released_pages"] = f"with {PAGES}, r as (select doc_id, page_no, count(*) over (partition by doc_id order by page_no) c from pages_ where (doc_id + page_no) % 6 <> 4) select doc_id, page_no from r where c = page_no + 1"
SQL["page_corrections"] = f"with {PAGES}, t as (select * from pages_ where page_no % 3 <> 1), f as (select doc_id, page_no + 1 n, page_no fix_no from pages_) select f.doc_id, n, fix_no, min(t.page_no) page_no from f join t on t.doc_id = f.doc_id and (t.page_no = n - 1 or t.page_no = n) group by 1, 2, 3"
_trunc = " or ".join(f"regexp_matches(d, '{p}')" for p in TRUNCATED)
SQL["page_lint"] = f"""with {PAGES}, q as (select doc_id, page_no, case when page_no = 6 then '  ' else body end d from pages_)
select doc_id, page_no, array_to_string(list_filter([case when {strip("d")} = '' then 'empty' end, case when starts_with(d, '*[Translation Error:') then 'engine_error' end, case when {_trunc} then 'truncated' end, case when regexp_matches(d, '{CJK_RUN}') then 'untranslated' end,
  case when regexp_matches(d, '(?m)^(?:Article|Section|Chapter)\\s+[0-9]+(?:\\.[0-9]+)*\\s*$') and len(string_split(d, chr(10))) < 4 then 'missing_body' end], lambda x: x is not null), ',') defects from q"""
SQL["layout_lint"] = f"""with {LINES}, g as (select doc_id, page_no, list(s) filter (s <> '') own from stripped group by 1, 2),
q as (select p.*, coalesce(own, []) own, list_filter(own, lambda x: starts_with(x, '|')) pipes from pages_ p left join g using (doc_id, page_no)),
b as (select *, list_transform(pipes, lambda x: len(regexp_extract_all(x, '\\|'))) bars, regexp_matches(body, '(?i)<table\\b') tab, page_no % 3 = 0 toc from q)
select doc_id, page_no, array_to_string(list_filter([
  case when toc and len(list_filter(own, lambda x: len(regexp_extract_all(x, '(?i)\\b(?:Chapter|Section|Article|Part)\\s+[0-9]+')) >= 2)) > 0 then 'toc_concatenated' end,
  case when toc and regexp_matches(body, '(?m)^\\s*\\|.*\\|.*\\|') then 'toc_table' end,
  case when page_no % 4 = 1 and not toc and not regexp_matches(body, '(?m)^[ \\t]*[•*\\-▪]\\s+') then 'nested_lists' end,
  case when regexp_matches(body, '\\\\frac\\{{|\\$\\$') then 'latex' end,
  case when page_no % 2 = 0 and len(pipes) > 0 and not tab then 'multi_tier_headers' end,
  case when not tab and not regexp_matches(body, '\\|.*\\|') and len(regexp_extract_all(body, '(?m)^[•*\\-▪]\\s+[^:\\n]{{5,30}}:\\s+[^\\n]{{4,}}')) >= 3 then 'two_column_lists' end,
  case when len(pipes) > 0 and list_max(bars) - list_min(bars) > 3 then 'ragged_table' end,
  case when len(list_filter(own, lambda x: not regexp_matches(x, '^(\\||<tr|<table|<td)') and len(regexp_extract_all(x, '[^\\n:]{{3,35}}:\\s*[^\\n:]{{2,30}}')) >= 2)) > 0 then 'squashed_pairs' end], lambda x: x is not null), ',') defects from b"""
SQL["page_kinds"] = f"""with {LINES}, g as (select doc_id, page_no, list(s order by pos) filter (s <> '' and not regexp_matches(s, '^\\s*```')) own, count(*) filter (s <> '') n from stripped group by 1, 2),
e as (select *, len(list_filter(own, lambda x: regexp_matches(x, '{TOC_LEADER}') or regexp_matches(x, '{TOC_ENTRY}'))) k, len(list_filter(own[1:3], lambda x: regexp_matches(x, '{TOC_TITLE}'))) t from g),
c as (select *, {strip("regexp_replace(body, '(?i)\\[(?:Stamp|Seal|Approved):\\s*[\\s\\S]*?\\]', '', 'g')")} clean from pages_)
select c.doc_id, c.page_no, coalesce(len(own) > 0 and (t > 0 or (k >= 4 and k / len(own) > 0.35)), false) toc,
  n between 1 and 6 and length(clean) < 350 and not (regexp_matches(clean, '(?i)<(?:table|ul|ol)\\b') or regexp_matches(clean, '(?i)\\b(?:Chapter|Article|Section|[0-9]+[A-Za-z]?(?:\\.[0-9]+)+)\\b') or regexp_matches(clean, '(?m)^\\s*#{{2,}}')
  or regexp_matches(clean, '(?m)^\\s*(?:[①-⑳]|\\([0-9]+\\)|[0-9]+[.)、]|[0-9]+\\s+\\S)') or regexp_matches(clean, '\\|.*\\|')) cover from c join e using (doc_id, page_no)"""
BLOCK = r"""case when s = '' then 'blank' when regexp_matches(s, '^\s*```') then 'fence' when regexp_matches(s, '(?i)<table\b') or starts_with(s, '<svg') then 'markup'
 when starts_with(s, '|') or (len(regexp_extract_all(s, '\|')) >= 2 and not regexp_matches(s, '^(#|Article|Chapter|Section)')) then 'table' when regexp_matches(s, '──|┬|│|└──|├──') then 'tree'
 when regexp_matches(s, '^#{1,6}') then 'heading_' || length(regexp_extract(s, '^#{1,6}')) when regexp_matches(s, '(?i)^(?:Chapter\s+[0-9]+|第\s*[0-9]+\s*章|Appended\s+Table|Supplementary\s+Provisions)\b') then 'chapter'
 when regexp_matches(s, '(?i)^(?:Section\s+[0-9]+|第\s*[0-9]+\s*節)\b') then 'section' when regexp_matches(s, '(?i)^(?:Article\s+[0-9]+|第\s*[0-9]+\s*条)\b') then 'article'
 when regexp_matches(s, '^[0-9]+[A-Za-z]?(?:\.[0-9]+)+\s+') then 'clause' when regexp_matches(s, '^[0-9]+[.)、]\s*.') then 'item'
 when regexp_matches(s, '^[•*\-▪▫○·]\s+') then case when indent >= 2 then 'sub_bullet' else 'bullet' end when regexp_matches(s, '^([①-⑳]|\([0-9]+\))') then 'subitem'
 when regexp_matches(s, '^[0-9]+\s+\S') then 'item' when indent >= 2 then 'subitem_desc' else 'paragraph' end"""
TYPED = LINES + rf", indented as (select *, length(line) - length(regexp_replace(line, '^\s+', '')) indent from stripped), typed as (select *, {BLOCK} kind from indented)"
SQL["block_types"] = f"with {TYPED} select kind block_type, count(*) n, min(line) first_line from typed group by 1"
SQL["paragraph_blocks"] = rf"""with {TYPED}, l as (select *, lag(line) over o pl, lag(s) over o ps, lag(kind) over o pk, lag(indent) over o pi from typed window o as (partition by doc_id, page_no order by pos)),
m as (select *, coalesce(s <> '' and not (ps like '%:' or pl like '%  ' or contains(lower(pl), '<br>') or ends_with(pl, '\') or (indent >= 2 and indent > pi))
  and not regexp_matches(s, '(?i)^(?:[0-9]+[A-Za-z]?(?:\.[0-9]+)+|[0-9]+[.)、]|[0-9]+\s+\S|Article|Chapter|Section|[①-⑳]|\([0-9]+\)|[•*\-▪▫○·]|\||#+)') and not regexp_matches(s, '^[^\n:]{{2,50}}\s*:\s*[^\n]+$')
  and not regexp_matches(line, '──|┬|│|└──|├──') and not regexp_matches(line, '^\s*```') and not regexp_matches(line, '(?i)<table\b') and pk in ('clause', 'item', 'bullet', 'sub_bullet', 'subitem', 'paragraph'), false) joins from l),
b as (select *, sum((not joins)::int) over (partition by doc_id, page_no order by pos)::bigint block_no from m)
select doc_id * 100 + page_no doc_id, block_no, string_agg(s, ' ' order by pos) block_text from b group by doc_id, page_no, block_no"""
SQL["toc_entries"] = f"with {LINES}, r as (select *, sum((not regexp_matches(s, '^[0-9]+$'))::int) over (partition by doc_id, page_no order by pos)::bigint entry_no from stripped where s <> '' and not regexp_matches(s, '^\\s*```')) select doc_id * 100 + page_no doc_id, entry_no, string_agg(s, ' ··· ' order by pos) entry from r where entry_no > 0 group by doc_id, page_no, entry_no"
SQL["table_normalize"] = rf"""with {LINES}, p as (select *, starts_with(s, '|') or (len(regexp_extract_all(s, '\|')) >= 2 and not regexp_matches(s, '^(#|Article|Chapter|Section)')) pipe, max(pos) over (partition by doc_id, page_no) last from stripped),
l as (select *, lag(pipe) over (partition by doc_id, page_no order by pos) before from p), i as (select *, sum((before is null or pipe <> before)::int) over (partition by doc_id, page_no order by pos) island from l),
c as (select *, regexp_matches(s, '^\s*\|?(?:\s*:?-{{2,}}:?\s*\|)+\s*:?-{{2,}}:?\s*\|?\s*$') rule, list_transform(string_split(regexp_replace(s, '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(x)) cells from i),
w as (select *, max(case when not rule then len(cells) end) over (partition by doc_id, page_no, island) width, max(pos) over (partition by doc_id, page_no, island) = last tail from c),
o as (select *, case when not pipe then line when tail or width is null then s when rule then '|' || array_to_string(list_transform(range(width), lambda x: '---'), '|') || '|'
  else '| ' || array_to_string(case when len(cells) >= width then cells when not regexp_matches(cells[1], '^[0-9]+[.)]?$') and len(cells) = width - 1 then list_concat([''], cells) else list_concat(cells, list_transform(range(width - len(cells)), lambda x: '')) end, ' | ') || ' |' end y from w)
select doc_id, page_no, md5(string_agg(y, chr(10) order by pos)) digest, length(string_agg(y, chr(10) order by pos))::bigint n_chars from o group by 1, 2"""

SQL["json_leaves"] = "select event_id doc_id, '/a~1b/event_type' as location, event_type source, '/a~1b/event_type: ' || event_type context from events union all select event_id, '/list/0', event_type, '/list/0: ' || event_type from events"
SQL["html_objects"] = r"with pages_ as (select page_id, html || (['<table><tr><td>x</td></tr></table>', '<img alt=''y''/>', '<p>none</p>', '<svg><g/></svg><img>'])[page_id % 4 + 1] html from pages), t as (select page_id, unnest(regexp_extract_all(html, '<(table|img|svg)[\s>/]', 1)) x, generate_subscripts(regexp_extract_all(html, '<(table|img|svg)[\s>/]', 1), 1) - 1 k from pages_) select page_id doc_id, k::bigint object_no, case x when 'img' then 'image_unknown' when 'svg' then 'diagram' else x end category from t"
SQL["retry_delays"] = """with e as (select event_id n, event_id from events), m as (select *, case when n % 7 = 0 then (n % 40)::double end h, case when n % 5 = 1 then (n % 90)::double when n % 5 = 2 then 0.5 end s from e)
select event_id, case when n % 5 < 3 then coalesce(greatest(1.0, h), greatest(1.0, s), least(300.0, 15.0 * pow(2.0, least(n % 8, 5)))) end::double as delay, least(30.0, pow(2.0, n % 8 + 1))::double as transient, n % 2 <> 0 and n % 600 in (408, 500, 502, 503, 504) is_transient from m"""
SQL["retry_delays"] = SQL["retry_delays"].replace("coalesce(greatest(1.0, h), greatest(1.0, s),", "coalesce(case when h is not null then greatest(1.0, h) end, case when s is not null then greatest(1.0, s) end,")
SQL["normalised_settings"] = """select c_custkey, (['de', 'fr', 'zh-CN', 'Klingon'])[c_custkey % 4 + 1] as language, ([272629760, 524288, 2097152]::bigint[])[c_custkey % 3 + 1] body_limit, c_custkey % 3 < 2 free, c_name || '.docx' as file, 'nova-' || c_nationkey || '-pro' model, c_custkey % 3 <> 0 as numeric from customer"""
SQL["csv_cells"] = """with c as (select p_partkey doc_id, unnest([p_name, p_brand]) x, unnest([1, 2]) j from part) select doc_id, 'row:1/column:' || j as location, 'table_cell' category, trim(x) as source from c where regexp_matches(x, '\\p{L}')"""
SQL["sheet_names"] = """with s as (select c_nationkey::bigint workbook, c_custkey pos, case when c_custkey % 9 = 0 then 'History_1' else c_mktsegment || ' sheet' end stem from customer), n as (select *, row_number() over (partition by workbook, lower(stem) order by pos) n from s)
select workbook, pos, stem || case when n > 1 then ' (' || n || ')' else '' end sheet_name from n"""
SQL["evidence_fold"] = """with recursive r as (select event_type kind, event_id obs_id, user_id doc, ts, row_number() over (partition by event_type order by ts, event_id) rn from events),
f as (select kind, obs_id, doc, ts, rn, [{'t': ts, 'd': doc}] held, true fresh from r where rn = 1
  union all select kind, obs_id, doc, ts, rn, case when is_new then list_append(k, {'t': ts, 'd': doc})[-50:] else k end, is_new
  from (select *, not list_contains(list_transform(k, lambda x: x.d), doc) is_new from (select r.kind, r.obs_id, r.doc, r.ts, r.rn, list_filter(f.held, lambda x: x.t >= r.ts - interval 5 days) k from f join r on r.kind = f.kind and r.rn = f.rn + 1)))
select kind, obs_id, doc, ts from f where fresh"""
SQL["windowed_evidence"] = f"""with {OBS}, w as (select kind, len(failures) n, date_trunc('day', ts) - to_days(d::int) as start from obs, range(30) t(d))
select start::timestamp as start, kind, count(*) documents, sum(n)::bigint failures from w where start + interval 30 day <= (select max(ts) - interval 1 day from obs) group by 1, 2"""
SQL["batch_exits"] = f"with {JOBS} select batch_id, count(*) filter (state = 'passed') n_passed, count(*) filter (state = 'needs_review') n_needs_review, count(*) filter (state = 'failed') n_failed, max((state = 'failed')::int) exit_code from jobs group by 1"
