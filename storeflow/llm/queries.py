"""The registered queries of the operators, over the whole tables, with
production parameters. Each derives the contract's columns from its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, conversations, decontamination, licenses, line_dedup, merkle, quality, sharding, simhash_dedup, substring_dedup, token_counts, toxicity
from .stages import documents, table

#: Documents of more tokens than this are over the limit.
TOKEN_LIMIT = 1024

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.groups(documents(spark, sf_dir))


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(documents(spark, sf_dir))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "segments")


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


ORACLE_SQL["op6_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as k
            from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
least as (select k, min(doc_id) as m from windows group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join least using (k) where m < doc_id),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(documents(spark, sf_dir)).drop("removed")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op7_benchmark_decontamination"] = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
items as (select distinct item, least(len(w), 13) as n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as k
          from (select item, w, unnest(range(1, greatest(len(w) - 11, 2))) as i from b where len(w) > 0)),
sizes as (select distinct n from items),
windows as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as k
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d join sizes on len(w) >= n)),
found as (select doc_id, items.n, i, item from windows join items on items.n = windows.n and items.k = windows.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join named using (doc_id)
"""


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlap(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return decontamination.judged(found).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, document."""
    docs = documents(spark, sf_dir)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


ORACLE_SQL["op12_conversation_repair"] = r"""
with recursive
keyed as (select coalesce(conv_id::varchar, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as key from conversations),
kinds as (select *, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::bigint),
                 lambda crc, b: list_reduce(range(8), lambda t, k: case when t & 1 = 1 then xor(t >> 1, 3988292384) else t >> 1 end, xor(crc, b)),
                 4294967295::bigint)) % 20 as kind from keyed),
damaged as (select conv, turn, case when kind = 4 then 'user' else role end as role,
                   case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                   unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
numbered as (select conv, turn, role, text, row_number() over (partition by conv order by turn nulls first, role, sha256(concat(length(role)::varchar, ':', role, text)), copy) as i
             from damaged),
shown as (select *, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as t,
                 row_number() over (partition by conv, role, text order by i) as nth from numbered),
rows as (select conv, turn, role, text, i, left(role, 1) as initial,
                case when t = '' then 1 when nth > 1 then 2 when right(t, 1) in ('.', '!', '?') then 0 else 3 end as fault,
                lag(left(role, 1)) over (partition by conv order by i) as before from shown),
inserts as (select * from (values (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'),
                                  (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')) as x(s, m, fee, mark)),
moves as (select * from (values (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'),
                                (2, 3, 'K', 'a'), (0, 2, 'R', ''), (1, 2, 'R', ''), (2, 3, 'R', ''), (3, 2, 'R', '')) as x(m, s, op, own)),
paths as (
  select distinct conv, 0::bigint as i, 0 as s, {'cost': 0::bigint, 'audit': '', 'made': []::varchar[]} as p from rows
  union all
  select r.conv, r.i, v.s, min({
      'cost': paths.p.cost + n.fee + case v.op when 'D' then 2 when 'K' then 0 else 1 end + case when r.fault = 3 and v.op <> 'D' then 5 else 0 end,
      'audit': concat(paths.p.audit, n.mark, v.op),
      'made': list_concat(paths.p.made, case n.mark when 'I' then [if(n.m = 2, 'user:', 'assistant:')] when 'II' then ['user:', 'assistant:'] else []::varchar[] end,
                          case v.op when 'D' then []::varchar[] when 'K' then [concat(r.role, ':', r.text)] else [concat(if(v.s = 2, 'user:', 'assistant:'), r.text)] end)}) as p
  from paths join rows r on r.conv = paths.conv and r.i = paths.i + 1
       join inserts n on n.s = paths.s
       join moves v on v.m = n.m and (v.op <> 'K' or v.own = r.initial) and (v.op = 'D' or r.fault not in (1, 2))
  group by r.conv, r.i, v.s),
lengths as (select conv, max(i) as i from rows group by conv),
ended as (select conv, min({'cost': p.cost + n.fee, 'audit': concat(p.audit, n.mark),
                            'made': list_concat(p.made, case n.mark when 'I' then [if(n.m = 2, 'user:', 'assistant:')] when 'II' then ['user:', 'assistant:'] else []::varchar[] end)}) as p
          from paths join lengths using (conv, i) join inserts n on n.s = paths.s where n.m in (0, 3) group by conv),
told as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
                count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
                count(*) filter (before is not null and concat(before, initial) not in ('su', 'ua', 'au')) as illegal from rows group by conv)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(p.cost, 0) as cost, coalesce(p.audit, '') as audit,
       sha256(coalesce(array_to_string(p.made, chr(10)), '')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, ' ') as conv from conversations) left join told using (conv) left join ended using (conv)
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.audited(rows, conversations.damaged(rows))


ORACLE_SQL["op13_phrase_collocations"] = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as p from documents),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
grams as (select lang, size, g, count(*) as f
          from (select lang, size, unnest([array_to_string(list_slice(w, i, i + size - 1), ' ') for i in range(1, len(w) - size + 2)]) as g
                from words, (select unnest([1, 2, 3, 4]) as size) where len(w) >= size)
          group by lang, size, g),
totals as (select lang, sum(f) as n from grams where size = 1 group by lang),
candidates as materialized (select *, string_split(g, ' ') as w from grams where size > 1 and f >= 30),
often as materialized (select concat(lang, chr(1), g) as part, f from grams where f >= 30),
halves as materialized (select lang, size, g, f as a, k, concat(lang, chr(1), array_to_string(list_slice(w, 1, k), ' ')) as x,
                               concat(lang, chr(1), array_to_string(list_slice(w, k + 1, size), ' ')) as y
                        from (select *, unnest(range(1, size)) as k from candidates)),
cuts as (select lang, size, g, a, k, often.f as l, r, (2000000::hugeint * a) // (often.f::hugeint + r) as score
         from (select halves.*, often.f as r from halves join often on y = part) join often on x = part),
best as (select *, row_number() over (partition by lang, g order by score, k) as place from cuts),
parts as (select lang, f, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
          from (select lang, f, w, size, n, unnest(range(1, size - n + 2)) as i from (select *, unnest(range(2, size)) as n from candidates))),
most as (select lang, g, max(f) as f from parts group by lang, g),
kept as (select best.* from best left join most using (lang, g) where place = 1 and not coalesce(100 * most.f >= 80 * a, false)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, g) as rank from kept)
select lang, rank, g as phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))
