"""The registered queries of the corpus operators, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, conversations, decontamination, hard_negatives, jaccard_join, language_id, packing, pii, quality, sharding, substrings, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op8_order_filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_report(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(spark, table(spark, sf_dir, "documents"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op11_blocked_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_cost_to_go_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_noisy_channel, op2_jump_hash_shards, op3_host_rules, op4_cross_parsing, op5_positional_index, op6_cutting_stock, op7_grammar_round_trip,
    op8_order_filtered_join, op9_token_files, op10_disclosure, op11_blocked_negatives, op12_cost_to_go_repair, op13_rolling_windows,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: What separates the words of the decontamination contract.
OP5_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP5_SQL = rf"""
with recursive
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{OP5_WORD}') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{OP5_WORD}') w from benchmark),
items as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') phrase
  from b, lateral (select unnest(range(1, greatest(1, len(w) - 9) + 1)) i) where len(w) > 0
),
sizes as (select distinct n from items),
places as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') phrase
  from d, sizes, lateral (select unnest(range(1, len(w) - n + 2)) i) where len(w) >= n
),
hits as (select p.doc_id, p.i, p.n, t.item_id from places p join items t using (n, phrase)),
covered as (
  select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hits)) group by doc_id
),
found as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from hits) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""


OP3_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') host, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from documents
),
places as (select doc_id, i, array_to_string(w[i : i + 4], ' ') g from d, lateral (select unnest(range(1, len(w) - 3)) i) where len(w) >= 5),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from places) where n > 1),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from again) group by doc_id),
c as (
  select d.doc_id, host, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
    len(lines) n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words
  from d left join covered using (doc_id)
),
b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, 100 * n_dup_lines > 30 * n_lines many_dup_lines,
    n_symbols > n_words many_symbols
  from c
),
hosts as (
  select host, rule, count(*) n, count(*) filter (failed) f
  from (unpivot (select host, base_failed, many_dup_lines, many_symbols from b) on base_failed, many_dup_lines, many_symbols into name rule value failed)
  group by host, rule
),
m as (select rule, sum(f) / sum(n) mean, coalesce(var_samp(f / n), 0) v, avg(1 / n) inv from hosts group by rule),
s as (select rule, mean, mean * (1 - mean) c, v - mean * (1 - mean) * inv between_hosts from m),
k as (select *, greatest(c / between_hosts - 1, 1) k from s),
shrunk as (
  select host, rule, n, mean, between_hosts, k, case when between_hosts <= 0 then mean else (f + k * mean) / (n + k) end rate from hosts join k using (rule)
),
r as (
  select host, max(rate) filter (rule = 'base_failed') base_rate,
    bool_or(between_hosts > 0 and rate - 2.0 * sqrt(rate * (1 - rate) / (n + k + 1)) > 1.25 * mean) filter (rule = 'many_dup_lines') often_dup,
    bool_or(between_hosts > 0 and rate - 2.0 * sqrt(rate * (1 - rate) / (n + k + 1)) > 1.25 * mean) filter (rule = 'many_symbols') often_symbols
  from shrunk group by host
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b.base_failed,
  not b.base_failed and base_rate <= 0.5 and not (b.many_dup_lines and often_dup) and not (b.many_symbols and often_symbols) kept,
  b.many_dup_lines, b.many_symbols
from b join r using (host)
"""

OP7_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
e as (
  select *, contains(text, '<|im_start|>') or contains(text, '<|im_end|>') or regexp_matches(text, '<\\+\|')
    or contains(role, '<|im_start|>') or contains(role, '<|im_end|>') or regexp_matches(role, '<\\+\|') or contains(role, chr(10)) or contains(role, '%25') or contains(role, '%0A') escaped
  from t
)
select cast(conv_id as bigint) conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(24 + length(case when escaped then regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') else role end)
    + length(case when escaped then regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') else text end)) as bigint) formatted_chars
from e group by conv_id
"""


#: The jump hash in steps, and the checksum byte by byte. Slots follow id, checksum and size
#: in each shard as long as the table is one bucket of ranks (up to 100,000 rows).
OP2_SQL = r"""
with recursive
bits(b, c, k) as (
  select i, cast(i as ubigint), 0 from range(256) t(i)
  union all select b, case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end, k + 1 from bits where k < 8
),
crc as (select list(c order by b) steps from bits where k = 8),
d as (
  select cast(doc_id as bigint) doc_id, cast(coalesce(octet_length(encode(text)), 0) + 8 as bigint) size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as ubigint)) bytes
  from documents
),
rows as (
  select doc_id, size,
    cast(xor(list_reduce(list_prepend(cast(4294967295 as ubigint), bytes), lambda c, b: xor(c >> 8, steps[cast(xor(c, b) & 255 as bigint) + 1])), cast(4294967295 as ubigint)) as bigint) text_crc32
  from d, crc
),
jumps(doc_id, state, home, target) as (
  select distinct doc_id, cast(coalesce(doc_id, 0) as hugeint) + case when doc_id < 0 then cast(18446744073709551616 as hugeint) else 0 end, cast(-1 as bigint), cast(0 as bigint) from rows
  union all
  select doc_id, moved, target, cast(floor((target + 1) * (2147483648.0::double / ((moved >> 33) + 1)::double)) as bigint)
  from (select *, (state * 2862933555777941757 + 1) % cast(18446744073709551616 as hugeint) moved from jumps where target < 25)
),
placed as (select doc_id, max(target) filter (target < 24) shard, max(target) filter (target < 25) grown_shard from jumps group by doc_id)
select doc_id, size, text_crc32, 'key' law, cast(shard as int) shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 slot, cast(grown_shard as int) grown_shard
from rows join placed using (doc_id)
"""

OP8_SQL = r"""
with recursive
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') g from d, lateral (select unnest(range(1, greatest(1, len(w) - 3) + 1)) i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
beside as (select a u, b v from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from d union select v, other from reach join beside on u = reach.doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, least_id component_id
from d left join n using (doc_id) join (select doc_id, min(other) least_id from reach group by doc_id) using (doc_id)
"""


#: Rows have a number of their own, so that equal rows stay apart.
OP11_SQL = r"""
with v as (
  select row_number() over () r, cast(vec_id as bigint) vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.r, a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, cast(list_inner_product(a.x, b.x) as bigint) score
  from v a join v b on a.r <> b.r where a.vec_id % 100 = 0
),
p as (select r, anchor_id, other_id positive_id, score positive_score, row_number() over (partition by r order by score desc, other_id) k from s where same qualify k <= 5),
n as (
  select p.*, other_id negative_id, score negative_score, row_number() over (partition by p.r, k order by score desc, other_id) rank
  from p join s on s.r = p.r and not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5
)
select anchor_id, positive_id, cast(rank as int) rank, negative_id, positive_score, negative_score from n
"""

#: The cheapest edits row by row, with up to two rows put in before each; the least letters among equals.
OP12_SQL = r"""
with recursive
bits(b, c, k) as (
  select i, cast(i as ubigint), 0 from range(256) t(i)
  union all select b, case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end, k + 1 from bits where k < 8
),
crc as (select list(c order by b) steps from bits where k = 8),
keyed as (
  select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    list_transform(regexp_extract_all(hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))), '..'), lambda h: cast('0x' || h as ubigint)) bytes
  from conversations
),
parts as (
  select conv_id, turn, role, text,
    cast(xor(list_reduce(list_prepend(cast(4294967295 as ubigint), bytes), lambda c, b: xor(c >> 8, steps[cast(xor(c, b) & 255 as bigint) + 1])), cast(4294967295 as ubigint)) as bigint) % 20 k
  from keyed, crc
),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
  from parts, lateral (select unnest(range(case when k = 3 then 2 else 1 end))) where k <> 0
),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from damaged),
faulty as (
  select *, left(role, 1) ch, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) pair,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
      when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 't' else '' end fault
  from placed
),
fills(st, role, nxt) as (values ('', 'user', 'u'), ('s', 'user', 'u'), ('u', 'assistant', 'a'), ('a', 'user', 'u')),
keeps(st, ch) as (values ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
best(conv_id, i, st, cost, audit, said) as (
  select distinct conv_id, cast(0 as bigint), '', 0, '', cast([] as varchar[]) from damaged
  union all
  (
    with one as (select * from best union all select b.conv_id, b.i, nxt, cost + 3, audit || 'I', list_append(said, role || ':') from best b join fills using (st)),
    two as (select * from one union all select b.conv_id, b.i, nxt, cost + 3, audit || 'I', list_append(said, role || ':') from one b join fills using (st)),
    edited as (
      select t.conv_id, f.i, st, cost + 4 cost, audit || 'D' audit, said from two t join faulty f on t.conv_id is not distinct from f.conv_id and f.i = t.i + 1
      union all
      select t.conv_id, f.i, ch, cost + case when fault = 't' then 3 else 0 end, audit || 'K', list_append(said, role || ':' || text)
      from two t join faulty f on t.conv_id is not distinct from f.conv_id and f.i = t.i + 1 join keeps using (st, ch) where fault not in ('b', 'd')
      union all
      select t.conv_id, f.i, nxt, cost + 3 + case when fault = 't' then 3 else 0 end, audit || 'R', list_append(said, fills.role || ':' || text)
      from two t join faulty f on t.conv_id is not distinct from f.conv_id and f.i = t.i + 1 join fills using (st) where fault not in ('b', 'd')
    )
    select * from edited qualify row_number() over (partition by conv_id, st order by cost, audit) = 1
  )
),
ends as (select *, max(i) over (partition by conv_id) n from best),
one_more as (select * from ends where i = n union all select e.conv_id, i, nxt, cost + 3, audit || 'I', list_append(said, role || ':'), n from ends e join fills using (st) where i = n),
two_more as (select * from one_more union all select e.conv_id, i, nxt, cost + 3, audit || 'I', list_append(said, role || ':'), n from one_more e join fills using (st)),
cheapest as (select * from two_more where st in ('', 'a') qualify row_number() over (partition by conv_id order by cost, audit) = 1),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
    count(*) filter (fault = 't') truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal
  from faulty group by conv_id
)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  cast(coalesce(cost, 0) as bigint) cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(said, chr(10)), '')) repaired_sha256
from (select distinct cast(conv_id as bigint) conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id left join cheapest b on b.conv_id is not distinct from o.conv_id
"""

OP13_SQL = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
places as (select r, doc_id, i, array_to_string(w[i : i + 12], ' ') g from d, lateral (select unnest(range(1, len(w) - 11)) i) where len(w) >= 13),
least as (select g, min(doc_id) first_id from places group by g),
gone as (select distinct r, unnest(range(i, i + 13)) p from places join least using (g) where first_id < doc_id),
words as (select r, unnest(range(1, len(w) + 1)) p, unnest(w) word from d),
left_over as (select r, string_agg(word, ' ' order by p) kept from words anti join gone using (r, p) group by r),
counts as (select r, count(*) n from gone group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join counts using (r) left join left_over using (r)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the whole result."""
    return {
        "op2_jump_hash_shards": OP2_SQL, "op3_host_rules": OP3_SQL, "op5_positional_index": OP5_SQL, "op7_grammar_round_trip": OP7_SQL, "op8_order_filtered_join": OP8_SQL,
        "op11_blocked_negatives": OP11_SQL, "op12_cost_to_go_repair": OP12_SQL, "op13_rolling_windows": OP13_SQL,
    }
