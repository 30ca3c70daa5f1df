"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, chat, decontaminate, licenses, merkle, mixing, neardup, quality, search, substring_dedup, suffix_dedup, tokens, warc


def _table(name: str, use: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: use(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _op8(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "source", "lang", "n_chars", "text", "rate", "n_copies", "copy", "order_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": _table("documents", licenses.digest),
    "op2_decontamination": _op2,
    "op3_chat_format": _table("conversations", chat.digest),
    "op4_suffix_dedup": _table("documents", suffix_dedup.digest),
    "op5_token_shards": _table("documents", tokens.digest),
    "op6_quality_rules": _table("documents", quality.digest),
    "op7_substring_dedup": _table("documents", substring_dedup.digest),
    "op8_mix_sources": _table("documents", _op8),
    "op9_warc": _table("pages", warc.digest),
    "op10_minhash_neardup": _table("documents", lambda docs: neardup.link(docs, percent=85)),
    "op11_bpe_codec": _table("documents", bpe.digest),
    "op12_lexical_search": _op12,
    "op13_merkle_manifest": _table("documents", merkle.digest),
    "pipeline": _pipeline,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_decontamination"] = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w from benchmark),
bs as (select distinct item_id, least(5, len(w)) k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) g from b where len(w) > 0),
q as (select item_id, count(*) n from bs group by 1),
ks as (select distinct k from bs),
ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) g from d, ks where len(w) >= k)
select doc_id, item_id, n n_item_shingles, count(*) n_shared from ds join bs using (k, g) join q using (item_id)
group by 1, 2, 3 having 100 * count(*) >= 80 * n
"""

ORACLE_SQL["op3_chat_format"] = """
with rows as (
  select false added, conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') r, role, coalesce(text, '') t, text from conversations
  union all select true, -1, 0, 'user', 'user', '<|im_end|><|im_start|>assistant ok', '<|im_end|><|im_start|>assistant ok'
  union all select true, -1, 1, 'assistant', 'assistant', '<|im_end|><|im_start|>assistant ok', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, role nulls first, text nulls first) filter (r = 'assistant'), '')) loss_sha256,
  sum(12 + length(replace(replace(replace(r, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + 1 + length(replace(replace(t, '&', '&amp;'), '<|', '&lt;|')) + 11)::bigint formatted_chars
from rows group by added, conv_id
"""

ORACLE_SQL["op4_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
c as (select doc_id, k, substr(x, 2000 * k + 1, 2198) y from (select doc_id, x, unnest(range((length(x) + 1999) // 2000)) k from d)),
p as (select doc_id, k * 1000 + j i, y, j from (select doc_id, k, y, unnest(range(least(1000, length(y) // 2))) j from c)),
w as (select doc_id, i, md5(substr(y, 2 * j + 1, 200)) h from p where 2 * j + 200 <= length(y)),
f as (select doc_id, i, row_number() over (partition by h order by doc_id, i) > 1 late from w),
m as (select p.doc_id, p.i, substr(p.y, 2 * p.j + 1, 2) b,
  coalesce(sum(f.late::int) over (partition by p.doc_id order by p.i rows between 99 preceding and current row), 0) > 0 gone
  from p left join f on p.doc_id = f.doc_id and p.i = f.i),
r as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) starts from m),
a as (select doc_id, count(*) filter (gone) n_removed, count(*) filter (starts) n_spans, string_agg(b, '' order by i) filter (not gone) kept from r group by 1)
select d.doc_id, length(x) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256
from d left join a using (doc_id)
"""

_END = r"[.!?…]([\x20\"''”»)\]]|$)"
_MENU = (
    "home|menu|login|log in|sign in|sign up|register|search|next|previous|back|share|print|contact|contact us|about|about us|sitemap|help|faq|top|more|read more|subscribe"
    "|accueil|connexion|se connecter|inscription|s''inscrire|recherche|rechercher|suivant|précédent|retour|partager|imprimer|contactez-nous|à propos|plan du site|aide|haut de page|en savoir plus|lire la suite|s''abonner"
    "|startseite|anmelden|einloggen|registrieren|suche|suchen|weiter|zurück|teilen|drucken|kontakt|über uns|impressum|hilfe|nach oben|mehr|mehr erfahren|weiterlesen|abonnieren"
    "|inicio|menú|iniciar sesión|registrarse|buscar|siguiente|anterior|volver|compartir|imprimir|contacto|contáctenos|acerca de|sobre nosotros|mapa del sitio|ayuda|arriba|más|leer más|suscribirse"
)
_FURNITURE = (
    "lorem ipsum|enable javascript|cookie policy|uses cookies|use of cookies|terms of use|terms of service|privacy policy|click here to|page not found|skip to content|share this (post|page|article)|powered by wordpress"
    "|activer javascript|politique de cookies|utilise des cookies|utilisation de cookies|conditions d''utilisation|mentions légales|politique de confidentialité|cliquez ici pour|page introuvable|aller au contenu|partager cet article|propulsé par wordpress"
    "|javascript aktivieren|cookie-richtlinie|verwendet cookies|verwendung von cookies|nutzungsbedingungen|datenschutzerklärung|klicken sie hier|seite nicht gefunden|zum inhalt springen|diesen (artikel|beitrag) teilen|präsentiert von wordpress"
    "|activar javascript|habilite javascript|política de cookies|utiliza cookies|uso de cookies|términos de uso|condiciones de uso|aviso legal|política de privacidad|haga clic aquí|página no encontrada|saltar al contenido|ir al contenido|compartir este artículo|funciona con wordpress"
)
_ALL_LINES = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
b as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select doc_id, i, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) h from (select doc_id, w, unnest(range(1, len(w) - 1)) i from b)),
tw as (select doc_id, i from (select *, count(*) over (partition by doc_id, h) c from g) where c > 1),
rep as (select doc_id, count(distinct i + k) n from tw, range(3) r(k) group by 1),
lines as (select doc_id, x, translate(trim(x), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from (select doc_id, unnest(l) x from b)),
judged as (select doc_id, length(x) n,
  (regexp_matches(x, '([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{4}}[^\x20\x09-\x0D]') and not regexp_matches(x, '{_END}'))
  or len(regexp_extract_all(x, '[!#*$%&|<>=_~^{{}}\[\]\\]')) * 5 > length(x)
  or regexp_matches(x, '(\|[^|]*){{3}}|([»›→][^»›→]*){{3}}') or (length(low) < 200 and regexp_matches(low, '^({_MENU})([ ,/·-]+({_MENU}))*[ .]*$')) or regexp_matches(low, '{_FURNITURE}') bad from lines),
q as (select doc_id, sum(n) total, coalesce(sum(n) filter (not bad), 0) good from judged group by 1),
r as (select b.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(2 * good >= total, true) enough
  from b left join rep using (doc_id) left join q using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and enough kept from r
"""
ORACLE_SQL["op6_quality_rules"] = _ALL_LINES

ORACLE_SQL["op7_substring_dedup"] = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, w[i] x, i, case when i + 49 <= len(w) then md5(array_to_string(w[i:i + 49], ' ')) end h from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d)),
f as (select *, h is not null and doc_id > min(doc_id) over (partition by h) late from p),
m as (select doc_id, i, x, sum(late::int) over (partition by doc_id order by i rows between 49 preceding and current row) > 0 gone from f),
a as (select doc_id, count(*) n_words, count(*) filter (gone) n_removed, string_agg(x, ' ' order by i) filter (not gone) kept from m group by 1)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join a using (doc_id)
"""

ORACLE_SQL["op8_mix_sources"] = """
with d as (select row_number() over () k, *, coalesce(source, chr(0) || 'null') src from documents),
s as (select src, sum(greatest(coalesce(n_chars, 0), 0))::double size from d group by 1),
t as (select sum(size) total, sum(sqrt(size)) weights from s),
r as (select src, round(case when size <= 0 or weights <= 0 then 1.0 else sqrt(size) / weights * total / size end, 6) rate from s, t),
m as (select src, rate, greatest(1, ceil(rate / 16))::bigint draws from r),
c as (select src, sum(exp(-rate / draws) * pow(rate / draws, i) / gamma(i + 1)) over (partition by src order by i) upto from m, range(0, 65) x(i)),
u as (select k, src, unnest(list_transform(range(draws), lambda j:
  ('0x' || substr(md5('count-17' || case when j = 0 then '' else '-' || j end || ':' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0)) u from d join m using (src)),
n as (select k, count(upto) n_copies from u left join c on u.src = c.src and upto <= u group by k)
select doc_id, source, lang, n_chars, text, rate, n_copies::int n_copies, copy::int as copy, md5('order-17:' || coalesce(doc_id::varchar, 'null') || ':' || copy) order_key
from (select d.*, rate, n_copies, unnest(range(n_copies)) as copy from d join n using (k) join m using (src))
"""

ORACLE_SQL["op9_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) payload_bytes, sha1(b) x, max(page_id) over (partition by b) original from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (5 * i // 20) * 5 + 1, 5))::bigint >> (15 - (5 * i % 20))::int) & 31) + 1)::int, 1)), '') payload_digest,
  case when page_id = original then 'response' else 'revisit' end record_type,
  case when page_id <> original then original end refers_to
from h
"""

ORACLE_SQL["op10_minhash_neardup"] = f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ') || (least(5, len(w)))::varchar) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(1, len(w))) + 1)) i from d)),
n as (select doc_id, count(*) n from s group by 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * c >= 85 * (nx.n + ny.n - c)),
e as (select x, y from links union all select y, x from links),
reach as (select doc_id x, doc_id y from d union select reach.x, e.y from reach join e on reach.y = e.x)
select d.doc_id, coalesce(max(n.n), 0) n_shingles, min(reach.y) component_id, d.doc_id = min(reach.y) kept
from d left join n using (doc_id) join reach on reach.x = d.doc_id group by d.doc_id
"""

ORACLE_SQL["op12_lexical_search"] = rf"""
with t as (select item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) term from benchmark),
q as (select item_id, term, count(*) times from t group by all),
w as (select row_number() over () k, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') x from documents),
d as (select k, doc_id, len(x)::bigint n from w where len(x) > 0),
s as (select count(*)::bigint n_docs, sum(n)::bigint n_terms from d),
p as (select k, term, count(*)::bigint tf from (select k, unnest(x) term from w) where term in (select term from q) group by all),
f as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint weight from p, s group by term, n_docs),
m as (select k, doc_id, 25 + (75 * n * n_docs) // n_terms m from d, s),
c as (select item_id, doc_id, k, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join p using (term) join f using (term) join m using (k) group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from c where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""
_MIXED = "xor(c, case when i % 8 = 0 then ascii(substr(doc_id::varchar, (i // 8 + 1)::int, 1))::bigint else 0 end)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, range((8 * length(doc_id::varchar))::bigint)), lambda c, i: xor({_MIXED} >> 1, ({_MIXED} & 1) * 3988292384)), 4294967295)"


def _fields(text: str) -> str:
    return "concat({})".format(", ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)))


ORACLE_SQL["op13_merkle_manifest"] = f"""
with recursive d as (select row_number() over () k, doc_id, lang, sha256({_fields("text")}) leaf,
    sha256({_fields(f"case when coalesce({_CRC} % 3 = 0, false) then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end")}) claimed from documents),
o as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, k) - 1 idx, count(*) over (partition by lang) cnt from d),
nodes as (select lang, 0 lvl, idx, cnt, leaf h from o
  union all select lang, lvl + 1, idx // 8, (cnt + 7) // 8, sha256(string_agg(h, '' order by idx)) from nodes where cnt > 1 group by lang, lvl, idx // 8, cnt),
subs as (select lang, lvl, h, row_number() over (order by lang nulls first) - 1 idx, count(*) over () cnt from nodes where cnt = 1),
tops as (select 0 lvl, idx, cnt, h from subs
  union all select lvl + 1, idx // 8, (cnt + 7) // 8, sha256(string_agg(h, '' order by idx)) from tops where cnt > 1 group by lvl, idx // 8, cnt),
every as (select true low, lang, lvl, idx, cnt, h from nodes union all select false, null, lvl, idx, cnt, h from tops),
steps as (select low, lang, lvl, idx, coalesce(string_agg(h, '') over (partition by low, lang, lvl, idx // 8 order by idx rows between unbounded preceding and 1 preceding), '') before,
    coalesce(string_agg(h, '') over (partition by low, lang, lvl, idx // 8 order by idx rows between 1 following and unbounded following), '') behind from every where cnt > 1),
lows as (select k, lang, 0 lvl, idx, claimed h, '' proof from o
  union all select l.k, l.lang, l.lvl + 1, l.idx // 8, sha256(before || l.h || behind), l.proof || before || behind
  from lows l join steps s on s.low and s.lang is not distinct from l.lang and s.lvl = l.lvl and s.idx = l.idx),
ends as (select k, l.lang, l.h, l.proof, s.idx, s.h subroot from lows l join subs s on s.lang is not distinct from l.lang and s.lvl = l.lvl),
highs as (select k, 0 lvl, idx, h, proof from ends
  union all select l.k, l.lvl + 1, l.idx // 8, sha256(before || l.h || behind), l.proof || before || behind from highs l join steps s on not s.low and s.lvl = l.lvl and s.idx = l.idx),
root as (select h root, lvl from tops where cnt = 1)
select o.doc_id, o.leaf, e.subroot, root, sha256(g.proof) proof_sha256, g.h folded_root, g.h = root verified
from o join ends e using (k) join highs g using (k) join root r on g.lvl = r.lvl
"""
