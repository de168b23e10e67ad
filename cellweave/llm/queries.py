"""One named query per operator over its whole table, with SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, best_fit, byte_bpe, conversation_repair, exact_dedup, merkle_manifest, ngram_join, packed_ids, quality, secret_scan, substring_dedup, token_counts, url_filter
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op1_ngram_join", """
with recursive split as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
gram as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from split),
size as (select doc_id, count(g) n from documents left join gram using (doc_id) group by doc_id),
pair as (select x.doc_id a, y.doc_id b, count(*) c from gram x join gram y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
link as (select a, b from pair join size sa on sa.doc_id = a join size sb on sb.doc_id = b where 100 * c >= 75 * (sa.n + sb.n - c)),
near as (select a, b from link union select b, a from link),
reach as (select doc_id s, doc_id t from documents union select r.s, e.b from reach r join near e on e.a = r.t)
select doc_id, n n_shingles, component_id from size join (select s doc_id, min(t) component_id from reach group by s) using (doc_id)
""")
def op1(spark: SparkSession, path: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, path, "documents"))


@query("op2_quality")
def op2(spark: SparkSession, path: str) -> DataFrame:
    return quality.score(read(spark, path, "documents"), read(spark, path, "labels"))


@query("op3_secret_scan")
def op3(spark: SparkSession, path: str) -> DataFrame:
    return secret_scan.scan(read(spark, path, "documents"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, path: str) -> DataFrame:
    return byte_bpe.encode_decode(read(spark, path, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_packed_ids")
def op5(spark: SparkSession, path: str) -> DataFrame:
    packed = packed_ids.stored(packed_ids.pack_matrices(read(spark, path, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("sequence_id", "n_tokens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts")


@query("op6_url_filter", """
with recursive page as (select page_id, url, html, coalesce(regexp_extract(url, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 1), '') scheme,
    translate(coalesce(regexp_extract(url, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 3), '') path,
    coalesce(regexp_extract(url, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 4), '') query from pages),
href as (select page_id, scheme, host, path, query, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) href
  from page where scheme <> '' and regexp_matches(html, '(?i)canonical|http-equiv')),
target as (select scheme || host || path || query a, case when href like '%://%' then href when href like '//%' then regexp_replace(scheme, '//$', '') || href
    when href like '/%' then scheme || host || href else scheme || host || case when regexp_extract(path, '(?s)^(.*/)', 1) = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end || href end t
  from href where href <> ''),
edge as (select distinct a, regexp_extract(t, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 1)
    || translate(regexp_extract(t, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(t, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 3) || regexp_extract(t, '(?s)^(.*?://)([^/?#]*)([^?#]*)(\\?[^#]*)?', 4) b from target),
both_ways as (select a, b from edge union select b, a from edge),
reach as (select a n, a m from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a),
part as (select n, min(m) c from reach group by n),
seen as (select n node, c, regexp_extract(n, '(?s)^(.*?://)([^/?#]*)([^?#]*)', 2) host, regexp_extract(n, '(?s)^(.*?://)([^/?#]*)([^?#]*)', 3) path from part),
rule(verdict, rule_host, rule_path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged as (select node, c, arg_max(verdict, length(rule_host || rule_path)) verdict from seen left join rule
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by node, c),
bad as (select node from judged join (select c from judged group by c having max((verdict = 'block')::int) = 1 and coalesce(max((verdict = 'allow')::int), 0) = 0) using (c)),
own as (select page_id, any_value(host) host, any_value(path) path, any_value(scheme || host || path || query) node, arg_max(rule_host || rule_path, length(rule_host || rule_path)) rule,
    arg_max(verdict, length(rule_host || rule_path)) verdict
  from page left join rule on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select page_id, host, path, rule, coalesce(verdict, case when node in (select node from bad) then 'block' end, 'allow') verdict from own
""")
def op6(spark: SparkSession, path: str) -> DataFrame:
    return url_filter.judge(read(spark, path, "pages"))


@query("op7_token_counts")
def op7(spark: SparkSession, path: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, path, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_exact_dedup", """
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, sha256(coalesce(text, '')) text_sha256
from documents window g as (partition by coalesce(text, ''))
""")
def op8(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, path, "documents"))


@query("op9_cross_polytope")
def op9(spark: SparkSession, path: str) -> DataFrame:
    return ann.search(read(spark, path, "embeddings"))


@query("op10_best_fit")
def op10(spark: SparkSession, path: str) -> DataFrame:
    return best_fit.pack(read(spark, path, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_substring_dedup", """
with split as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) i from split),
win as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) > 1 late from starts),
word as (select doc_id, unnest(w) x, generate_subscripts(w, 1) j from split),
edge as (select doc_id, j, sum(step) step from (select doc_id, i j, 1 step from win where late union all select doc_id, i + 20, -1 from win where late) group by doc_id, j),
mark as (select doc_id, j, x, coalesce(sum(step) over (partition by doc_id order by j), 0) > 0 gone from word left join edge using (doc_id, j))
select doc_id, count(j) n_words, count(*) filter (where gone) n_removed, sha256(coalesce(string_agg(x, ' ' order by j) filter (where not gone), '')) kept_sha256
from documents left join mark using (doc_id) group by doc_id
""")
def op11(spark: SparkSession, path: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, path, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: crc32 of an ASCII text as a DuckDB macro.
_CRC = """list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda x: ord(x)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1))))"""


@query("op12_conversation_repair", f"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, xor({_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")}, 4294967295) % 20 f
  from conversations),
seen as (select conv_id, turn, case when f = 4 then 'user' else role end role, case f when 1 then '' when 2 then translate(text, '.!?', '') else text end text,
  unnest(case when f = 3 then [0, 1] else [0] end) copy from src where f <> 0),
ranked as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 again,
  not regexp_matches(text, '[^\\x20\\x09-\\x0D]') blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') cut from seen),
r as materialized (select *, left(role, 1) x, case when blank or again then 1 else 0 end gone, case when not blank and not again and cut then 1 else 0 end t from ranked),
ins(p, n, q) as (values (0,0,0),(1,0,1),(2,0,2),(3,0,3),(0,1,2),(1,1,2),(2,1,3),(3,1,2),(0,2,3),(1,2,3),(2,2,2),(3,2,3)),
edit(p, e, x, q, c) as (values (0,'D','',0,3),(1,'D','',1,3),(2,'D','',2,3),(3,'D','',3,3),(0,'R','',2,2),(1,'R','',2,2),(2,'R','',3,2),(3,'R','',2,2),
  (0,'K','s',1,0),(0,'K','u',2,0),(1,'K','u',2,0),(2,'K','a',3,0),(3,'K','u',2,0)),
dp as (select distinct conv_id, 0::bigint i, 0 st, {{'c': 0::bigint, 'a': ''}} b from r
  union all
  select conv_id, i, st, min(b) b from (select dp.conv_id, r.i, edit.q st, {{'c': dp.b.c + 2 * ins.n + edit.c + case when e = 'D' then 0 else t end, 'a': dp.b.a || repeat('I', ins.n) || e}} b
    from dp join r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1 join ins on ins.p = dp.st join edit on edit.p = ins.q and (edit.x = '' or edit.x = r.x) and (e = 'D' or gone = 0)) group by conv_id, i, st),
best as (select conv_id, min({{'c': dp.b.c + 2 * ins.n, 'a': dp.b.a || repeat('I', ins.n)}}) b from dp join (select conv_id k, max(i) m from r group by conv_id) on k is not distinct from conv_id and m = i
  join ins on ins.p = st where ins.q in (0, 3) group by conv_id),
letter as (select conv_id, unnest(string_split(b.a, '')) e, generate_subscripts(string_split(b.a, ''), 1) k from best where b.a <> ''),
numbered as (select conv_id, e, k, sum(case when e = 'I' then 0 else 1 end) over (partition by conv_id order by k) i from letter),
left_over as (select n.conv_id, e, k, r.x, r.role, case when e = 'I' then '' else r.text end text, row_number() over (partition by n.conv_id order by k) - 1 place
  from numbered n left join r on r.conv_id is not distinct from n.conv_id and r.i = n.i and e <> 'I' where e <> 'D'),
headed as (select *, max(case when place = 0 and e = 'K' and x = 's' then 1 else 0 end) over (partition by conv_id) s from left_over),
hash as (select conv_id, sha256(string_agg(case when e = 'K' then role when (place - s) % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by k)) h from headed group by conv_id),
pairs as (select conv_id, x, lead(x) over (partition by conv_id order by i) y from r),
illegal as (select conv_id, count(*) n from pairs where y is not null and x || y not in ('su', 'ua', 'au') group by conv_id),
fault as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, sum(blank::int) blank, sum((not blank and again)::int) duplicate, sum(t) truncated from r group by conv_id)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal.n, 0) illegal,
  coalesce(best.b.c, 0) cost, coalesce(best.b.a, '') audit, coalesce(h, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) o left join fault on fault.conv_id is not distinct from o.conv_id left join illegal on illegal.conv_id is not distinct from o.conv_id
left join best on best.conv_id is not distinct from o.conv_id left join hash on hash.conv_id is not distinct from o.conv_id
""")
def op12(spark: SparkSession, path: str) -> DataFrame:
    conversations = read(spark, path, "conversations")
    return conversation_repair.repair(conversations, conversation_repair.damaged(conversations))


@query("op13_merkle_manifest", f"""
with recursive f as (select doc_id, source, lang, n_chars, text, case when xor({_CRC.format("doc_id::varchar")}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end cut from documents),
enc as (select doc_id, source, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') head,
  coalesce(strlen(text) || ':' || text, '-') t, coalesce(strlen(cut) || ':' || cut, '-') c from f),
leaf as materialized (select doc_id, source, sha256(head || t) leaf, sha256(head || c) shown, row_number() over (partition by source order by doc_id nulls first, sha256(head || t)) - 1 pos, count(*) over (partition by source) n from enc),
node as (select source, 0 level, pos, n, leaf h from leaf
  union all select source, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos)) from node where n > 1 group by source, level, pos // 3),
sub as (select source, h subroot, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from node where n = 1),
top as (select 0 level, pos, n, subroot h from sub
  union all select level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by level, pos // 3),
path as (select l.doc_id, l.source, l.leaf, l.shown, s.subroot, (select h from top where n = 1) root, s.pos sat, l.pos,
  list_concat(coalesce((select list([x.before, x.after] order by x.level) from (select o.level, coalesce(string_agg(o.h, '' order by o.pos) filter (where o.pos < l.pos // (3 ** o.level)::bigint), '') before,
      coalesce(string_agg(o.h, '' order by o.pos) filter (where o.pos > l.pos // (3 ** o.level)::bigint), '') after from node o
      where o.source is not distinct from l.source and o.n > 1 and o.pos // 3 = l.pos // (3 ** (o.level + 1))::bigint group by o.level) x), []),
    coalesce((select list([x.before, x.after] order by x.level) from (select o.level, coalesce(string_agg(o.h, '' order by o.pos) filter (where o.pos < s.pos // (3 ** o.level)::bigint), '') before,
      coalesce(string_agg(o.h, '' order by o.pos) filter (where o.pos > s.pos // (3 ** o.level)::bigint), '') after from top o
      where o.n > 1 and o.pos // 3 = s.pos // (3 ** (o.level + 1))::bigint group by o.level) x), [])) p
  from leaf l join sub s on s.source is not distinct from l.source),
done as (select *, sha256(array_to_string(list_transform(p, lambda x: x[1] || x[2]), '')) proof_sha256, list_reduce(list_concat([['', shown]], p), lambda a, x: ['', sha256(x[1] || a[2] || x[2])])[2] folded_root from path)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified from done
""")
def op13(spark: SparkSession, path: str) -> DataFrame:
    found = merkle_manifest.manifest(read(spark, path, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")
