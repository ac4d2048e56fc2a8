"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, collocations, jaccard_join, license_scan, mixing, nn_descent, positional_index, quality_rules, reply_trees, substring_dedup, surrogates, whitening
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}

#: SQL text of the words of a text, for the twins.
SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op1_quality_rules"] = op1_quality_rules
ORACLES["op1_quality_rules"] = rf"""
with d as (
  select doc_id, source, coalesce(text, '') as text, {SQL_WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (
  select doc_id, unnest(range(1, len(w) - 3)) as i, w from d where len(w) >= 5),
h as (select doc_id, i, array_to_string(w[i:i+4], ' ') as gram from g),
t as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from h) where c > 1),
r as (select doc_id, count(*) as n from (select distinct doc_id, i + k as p from t, (select unnest(range(0, 5)) as k)) group by doc_id),
c as (
  select d.doc_id, source, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (doc_id)),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from c),
hs as (select source, count(*)::double as n, sum(base_failed::int)::double as f from f group by source),
m as (select count(*) as k, sum(n) as n, sum(f) as f, sum(n*n) as nn, sum(f*f/n) as ff from hs),
p as (select *, least(greatest(f/n, 1e-6), 1-1e-6) as mean from m),
q as (select mean, ((ff - f*f/n) - (k-1)*mean*(1-mean)) / nullif(greatest(mean*(1-mean)*(n - nn/n - (k-1)), 0), 0) as rho from p),
b as (select mean, 1/least(greatest(coalesce(rho, 0), 1e-4), 0.5) - 1 as weight from q),
v as (select source, (f + mean*weight)/(n + weight) > 0.5 as host_failed from hs, b)
select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not host_failed) as kept
from f join v on f.source is not distinct from v.source
"""

FIXED_CONVERSATION = "</s>[INST] ok [/INST]"


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(FIXED_CONVERSATION).alias("text"),
    )
    chats = reply_trees.reply_trees(reply_trees.chain_nodes(own.unionByName(more)))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = chats.select(
        "tree", "formatted", reply_trees.turns_of(F.col("formatted")).alias("turns"),
        F.concat_ws("", reply_trees.loss_texts(F.col("formatted"), F.col("loss_mask"))).alias("loss"),
    )
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", turn)), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES["op3_reply_trees"] = op3_reply_trees
ORACLES["op3_reply_trees"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as o from (
    select conv_id, turn, role, text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (select *, length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 24 as n from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text, '' order by o)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by o) filter (role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from e group by conv_id
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _license_twin() -> str:
    """Only the wording of the templates and the threshold come from the operator; all else is worked out in SQL."""
    t = license_scan.THRESHOLD
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())
    return rf"""
with raw(template, body) as (values {rows}),
tw as (select template, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w from raw),
t as (select template, len(w) as n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) as own from tw),
dw as (select doc_id, row_number() over () as r, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w from documents),
d as (select doc_id, r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) as p, len(w) as n from dw),
c as (select r, template, p, d.n as dn, t.n as tn, own from d, t where len(list_intersect(list_distinct(p), own)) >= {t} * len(own) / (2 - {t}) - 1e-9),
s as (select *, unnest(list_distinct(list_concat(range(0, greatest(dn - tn, 0) + 1, greatest(1, tn // 16)), [greatest(dn - tn, 0)]))) as start from c),
g as (select r, template, start, own, list_distinct(p[start+1:start+tn-1]) as g from s),
x as (select r, template, start, 2.0 * len(list_intersect(g, own)) / (len(g) + len(own)) as dice from g where len(g) > 0),
b as (select r, template, max(dice) as dice, arg_min(start, (-dice, start)) as start from x where dice >= {t} group by 1, 2),
h as (select *, count(*) over (partition by r) as n, row_number() over (partition by r order by dice desc, start, template) as k from b)
select doc_id, coalesce(h.n, 0)::bigint as n_hits, string_split(template, '/')[1] as license_id, template, (start + 1)::bigint as word_no, round(dice, 6) as dice
from d left join (select * from h where k = 1) h using (r)
"""


QUERIES["op9_license_scan"] = op9_license_scan
ORACLES["op9_license_scan"] = _license_twin()


def bpe_digest(coded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The digest columns of ids and decoded texts."""
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *keep,
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES["op6_bpe"] = op6_bpe


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_mix_key").alias("mix_key"), F.col("_n_tokens").alias("n_tokens"))


QUERIES["op2_mixing"] = op2_mixing


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", classifier.predicted().alias("predicted"))


QUERIES["op4_quality_classifier"] = op4_quality_classifier


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.surrogate_text(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.configured_key(spark))
    return out.select("doc_id", F.col("_n_entities").alias("n_entities"), "text")


QUERIES["op10_surrogates"] = op10_surrogates


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op5_substring_dedup"] = op5_substring_dedup
ORACLES["op5_substring_dedup"] = rf"""
with d as (select doc_id, {SQL_WORDS} as w from documents),
g as (select doc_id, i, hash(array_to_string(w[i:i+12], ' ')) as h, array_to_string(w[i:i+12], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
f as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h, gram) as m from g) where m < doc_id),
p as (select distinct doc_id, i + k as i from f, (select unnest(range(0, 13)) as k)),
r as (select doc_id, list(i) as gone from p group by doc_id),
k as (select d.doc_id, w, coalesce(gone, []) as gone from d left join r using (doc_id)),
x as (select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed from k),
u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d where len(w) > 0),
s as (select u.doc_id, string_agg(word, ' ' order by u.i) as kept from u anti join p on u.doc_id = p.doc_id and u.i = p.i group by u.doc_id)
select x.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) as kept_sha256 from x left join s using (doc_id)
"""


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES["op7_nn_descent"] = op7_nn_descent


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES["op8_jaccard_join"] = op8_jaccard_join


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WIDE_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

QUERIES["op11_positional_index"] = op11_positional_index
ORACLES["op11_positional_index"] = rf"""
with i as (select item_id, {_WIDE_WORDS} as w from benchmark),
g as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[s:s+9], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
d as (select doc_id, {_WIDE_WORDS} as w from documents),
p as (
  select doc_id, s, k, array_to_string(w[s:s+k-1], ' ') as gram
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from g))),
m as (select doc_id, s, p.k, item_id from p join g on p.k = g.k and p.gram = g.gram),
h as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(s, s + k)) as pos from m) group by 1),
o as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from m) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(o.n, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join h using (doc_id) left join o using (doc_id)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES["op12_whitening"] = op12_whitening


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES["op13_collocations"] = op13_collocations
ORACLES["op13_collocations"] = r"""
with texts as (
  select coalesce(lang, 'und') as lang, row_number() over () as r, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps
  from documents),
pieces as (select lang, r, unnest(ps) as piece, generate_subscripts(ps, 1) as piece_no from texts),
w as (select lang, r, unnest(list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '')) as w1, generate_subscripts(list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> ''), 1) as i, piece_no from pieces),
x as (select *, lead(w1) over p as w2, lead(w1, 2) over p as w3 from w window p as (partition by r, piece_no order by i)),
g as (
  select lang, 1 as k, w1 as phrase, [w1] as ws from x
  union all select lang, 2, w1 || ' ' || w2, [w1, w2] from x where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, [w1, w2, w3] from x where w3 is not null),
f as (select lang, k, phrase, any_value(ws) as ws, count(*)::hugeint as a from g group by 1, 2, 3),
t as (select lang, sum(a) as n from f where k = 1 group by 1),
c as (select * from f where k > 1 and a >= 10),
halves as (
  select lang, phrase, k, a, 1 as cut, ws[1] as lp, array_to_string(ws[2:k], ' ') as rp from c
  union all select lang, phrase, k, a, 2, array_to_string(ws[1:2], ' '), ws[3] from c where k = 3),
cut as (
  select h.lang, h.phrase, h.k, h.a, h.cut, l.a as l, r.a as r, (1000000::hugeint * h.a * h.a) // (l.a * r.a) as score
  from halves h join f l on l.lang = h.lang and l.phrase = h.lp join f r on r.lang = h.lang and r.phrase = h.rp),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ as (
  select lang, phrase, max(a) as a from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, a from c where k = 3
    union all select lang, array_to_string(ws[2:3], ' '), a from c where k = 3) group by 1, 2),
kept as (select low.* from low left join inner_ i on i.lang = low.lang and i.phrase = low.phrase and low.k = 2 where i.a is null or 100 * i.a < 50 * low.a),
top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept qualify rank <= 2000)
select top.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from top join t on t.lang = top.lang
"""
