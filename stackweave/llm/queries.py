"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontamination, exact_dedup, html_text, maxent_lm, near_dedup, packing, quality, secret_scan, toxicity, warc, whitening
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan.scan_secrets(docs).drop("source")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_files() -> tuple[str, str]:
    """One vocabulary in the two forms that the tokenizer libraries read."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_files())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_warc": op7_warc,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op12_conversation_repair": r"""
with recursive t as (select list(list_reduce([i] || range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crcs from range(256) r(i)),
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce([4294967295] || list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda ch: cast(ord(ch) as bigint)), lambda s, b: xor(s >> 8, crcs[(xor(s, b) & 255) + 1])), 4294967295) % 20 as k from conversations, t),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy from c where k <> 0),
o as (select conv_id, turn, role, text, row_number() over w as i, lag(role[1:1]) over w as before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail from d window w as (partition by conv_id order by turn nulls first, role, text)),
f as (select *, role[1:1] as r, case when tail = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when tail not in ('.', '!', '?') then 't' else '' end as fault from o),
steps as (select * from (values (0, 's', 1, null), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')) v(s, r, z, made)),
e as (select f.conv_id, f.i, v.s, v.s as z, 2 as cost, 'D' as letter, cast([] as varchar[]) as line from f, (values (0), (1), (2), (3)) v(s)
 union all select f.conv_id, f.i, m.s, m.z, case when f.r = m.r then 0 else 1 end + case when fault = 't' then 5 else 0 end, case when f.r = m.r then 'K' else 'R' end, [case when f.r = m.r then role else made end || ':' || text] from f, steps m where fault not in ('b', 'd') and (f.r = m.r or made is not null)),
ins as (select * from (values (0, 0, 0, '', cast([] as varchar[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])) v(s, z, cost, letter, line)),
p as (select conv_id, 0 as i, z as s, {'cost': cost, 'audit': letter, 'lines': line} as b from (select distinct conv_id from c), ins where s = 0
 union all select e.conv_id, e.i, ins.z, min({'cost': p.b.cost + e.cost + ins.cost, 'audit': p.b.audit || e.letter || ins.letter, 'lines': list_concat(list_concat(p.b.lines, e.line), ins.line)}) from p join e on e.conv_id is not distinct from p.conv_id and e.i = p.i + 1 and e.s = p.s join ins on ins.s = e.z group by e.conv_id, e.i, ins.z),
a as (select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'b') as blank, count_if(fault = 'd') as duplicate, count_if(fault = 't') as truncated, count_if(before is not null and before || r not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
g as (select p.conv_id, min(b) as b from p left join a on a.conv_id is not distinct from p.conv_id where p.i = coalesce(a.n, 0) and s in (0, 3) group by p.conv_id)
select g.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(b.cost as bigint) as cost, b.audit as audit, sha256(array_to_string(b.lines, chr(10))) as repaired_sha256
from g left join a on a.conv_id is not distinct from g.conv_id
""",
    "op1_chat_format": r"""
with turns as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
rendered as (
  select conv_id, count(*) as n,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as rendered,
         list(sha256(role || chr(31) || text) order by turn nulls first, role, text) as ds
  from turns group by conv_id),
prefixes as (select distinct unnest(list_transform(range(1, len(ds)), lambda k: array_to_string(ds[1:k], ','))) as p from rendered),
heads as (select min(conv_id) as conv_id, count(*) as copies, max(n) as n_turns, any_value(rendered) as rendered, array_to_string(ds, ',') as p
  from rendered group by ds)
select conv_id, cast(n_turns as integer) as n_turns, copies, rendered from heads anti join prefixes using (p)
""",
    "op5_decontamination": r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select distinct cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
k as (select item_id, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win, least(len(ws), 10) as n
  from b, lateral (select unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i) where len(ws) > 0),
lens as (select distinct n from k),
d as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as win from w, lens, lateral (select unnest(range(1, len(ws) - n + 2)) as i)),
m as (select distinct doc_id, i, n, item_id from d join k using (win, n)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list from (select distinct doc_id, item_id from m) group by doc_id),
terms as (select distinct win, n, j, string_split(win, ' ')[j] as term from k, lateral (select unnest(range(1, n + 1)) as j)),
tok as (select doc_id, p, ws[p] as term from w, lateral (select unnest(range(1, len(ws) + 1)) as p) where ws[p] in (select term from terms)),
freq as (select term, count(*) as c from tok group by term),
rarest as (select win, first(term order by coalesce(c, 0), j) as term from terms left join freq using (term) group by win),
anchors as (select distinct doc_id, p, win from tok join rarest using (term)),
needed as (select win, count(distinct term) as n_terms from terms group by win),
met as (select a.doc_id, a.p, a.win, count(distinct t.term) as n_met from anchors a join (select distinct win, term from terms) n on n.win = a.win join tok t on t.doc_id = a.doc_id and t.term = n.term and t.p between a.p - 15 and a.p + 15 group by all),
near as (select doc_id, count(distinct item_id) as n_near from met join needed using (win) join k using (win) where n_met = n_terms group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from w left join hits using (doc_id) left join items using (doc_id) left join near using (doc_id)
""",
    "op4_exact_dedup": r"""
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size, sha256(norm) as text_sha256 from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from n join g using (norm)
""",
}
