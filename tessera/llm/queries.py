"""The ten operators as queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontamination, htmltext, licenses, lines, mixing, quality, sharding, simhash, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_quality_rules, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_quality_classifier,
        op6_license_scans, op7_sharding, op8_mixing, op9_substring_dedup, op10_html_extraction,
    )
}

_MEASURES = quality.MEASURES
_OP2 = r"""
with base as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (
  select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from base),
win as (
  select rid, i, array_to_string(ws[i:i + 4], ' ') as k from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
again as (
  select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from win) where c > 1),
covered as (
  select rid, sum(least(5, coalesce(nx - i, 5)))::bigint as n_repeat_words
  from (select rid, i, lead(i) over (partition by rid order by i) as nx from again) group by rid),
counts as (
  select w.doc_id, w.lang, w.source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(ls)::bigint as n_lines
  from w left join covered using (rid)),
m as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when n_words > 0 then n_symbols * 1000 // n_words else 0 end as symbols,
    case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as repeats,
    case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as dup_lines,
    case when n_words > 0 then word_chars * 1000 // n_words else 0 end as word_length
  from counts),
long as (
  select lang, source, unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) as measure,
    unnest([symbols, repeats, dup_lines, word_length]) as x from m where not base_failed),
bins as (
  select lang, source, measure, (x >> greatest(0, length(bin(x)) - BITS)::bigint) << greatest(0, length(bin(x)) - BITS)::bigint as bin,
    count(*) as n from long group by all),
FENCES
drawn as (
  select o.lang, o.source, o.measure, (o.docs * o.fence + PRIOR * ((l.docs * l.fence + PRIOR * e.fence) // (l.docs + PRIOR))) // (o.docs + PRIOR) as fence
  from f2 o join f1 l on o.lang is not distinct from l.lang and o.measure = l.measure join f0 e on o.measure = e.measure),
limits as (
  select lang, source,
    MAXES
  from drawn group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(symbols > max_symbols, false) and not coalesce(repeats > max_repeats, false)
    and not coalesce(dup_lines > max_dup_lines, false) and not coalesce(word_length > max_word_length, false) as kept,
  max_symbols, max_repeats, max_dup_lines, max_word_length
from m left join limits l on m.lang is not distinct from l.lang and m.source is not distinct from l.source
"""


def _fence_sql(name: str, keys: str) -> str:
    group = ", ".join(k for k in (keys, "measure") if k)
    allowance = " ".join(f"when '{m}' then {a}" for m, a in _MEASURES.items())
    return f"""{name} as (
  select {group}, max(docs) as docs,
    (min(bin) filter (upto * 4 >= docs * 3) + {quality.REACH} * (min(bin) filter (upto * 4 >= docs * 3) - min(bin) filter (upto * 4 >= docs))
      + case measure {allowance} end)::bigint as fence
  from (select {group}, bin, sum(n) over (partition by {group} order by bin) as upto, sum(n) over (partition by {group}) as docs
        from (select {group}, bin, sum(n) as n from bins group by {group}, bin))
  group by {group}),"""


_OP8 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k from documents),
by_source as (
  select source, source_size, ([5.0, 2.0, 1.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, 2.0::double * source_size as most
  from (select source, sum(size)::bigint as source_size from sized group by source)),
ranked as (
  select *, row_number() over o as rank, sum(source_size::double) over () * 1.5::double - (sum(most) over (o rows unbounded preceding) - most) as left_over,
    sum(w) over () - (sum(w) over (o rows unbounded preceding) - w) as left_weight
  from by_source window o as (order by most / w, source nulls last)),
level as (
  select rank as r, left_over as lo, left_weight as lw from ranked where left_over * w / left_weight <= most order by rank limit 1),
plan as (
  select source, source_size, case when rank < r then most else lo * w / lw end as target from ranked, level),
cut as (
  select s.doc_id, size, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs,
    sum(size) over (partition by s.source order by k, s.doc_id nulls first, size rows unbounded preceding) - size as before
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::bigint - before)))::bigint as taken
from cut
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Word lists instead of text replacement: lines are dropped from a list, marks from a list of tokens, words are looked up in a map.
_OP6 = rf"""
with plain as (
  select doc_id as id, null as license, coalesce(text, '') as t from documents
  union all select null, name, body from (values {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.texts())}) v(name, body)),
kept as (
  select id, license, list_filter(string_split(lower(t), chr(10)),
    lambda l: not (regexp_matches(l, '{licenses.NOTICE}') or (regexp_matches(l, '{licenses.HOLDER}') and not regexp_matches(l, '{licenses.IN_SENTENCE}')))) as ls from plain),
tokens as (
  select id, license, list_filter(regexp_split_to_array(array_to_string(ls, chr(10)), '[\x20\x09-\x0D]+'), lambda x: not regexp_full_match(x, '{licenses.MARK}')) as xs from kept),
words as (
  select id, license, regexp_extract_all(array_to_string(xs, ' '), '[\p{{L}}\p{{N}}]+') as ws from tokens),
spelled as (
  select id, license, list_transform(ws, lambda w: coalesce(map {{{", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in licenses.SPELLINGS.items())}}}[w], w)) as ws from words),
joined as (
  select id, license, {"replace(" * len(licenses.PHRASES)}'  ' || array_to_string(string_split(array_to_string(ws, ' '), ' '), '  ') || '  '{"".join(f", ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')" for a, b in licenses.PHRASES.items())} as t from spelled),
digests as (
  select id, license, sha256(trim(regexp_replace(t, ' +', ' ', 'g'))) as digest from joined),
known as (
  select digest, min(license) as license from digests where license is not null group by digest)
select d.id as doc_id, d.digest, k.license from digests d left join known k using (digest) where d.license is null
"""

ORACLE = {
    "op6_license_scans": _OP6,
    "op2_quality_rules": _OP2.replace("BITS", str(quality.BITS))
    .replace("FENCES", "\n".join(_fence_sql(n, k) for n, k in (("f2", "lang, source"), ("f1", "lang"), ("f0", ""))))
    .replace("MAXES", ",\n    ".join(f"max(fence) filter (measure = '{m}')::bigint as max_{m}" for m in _MEASURES))
    .replace("PRIOR", str(quality.PRIOR)),
    "op8_mixing": _OP8,
}
