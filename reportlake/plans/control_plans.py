"""Queries over controls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import controls as C

from .catalog import query
from .views import view


def ctl(spark, d):
    return view(spark, d, "v_controls")


def with_criterion(spark, d):
    """Controls with the criterion that each would be mapped to."""
    return ctl(spark, d).withColumn("criterion", F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")))


CRITERION = "case when id % 7 <> 0 then cast(id % 3 as varchar) end as criterion"
ACTIVE = "(merged_to_control_id is null or merged_to_control_id = 'DUPLICATE_INSTANCE')"


@query("p01_active_controls", f"select id, scan_id, control_id from v_controls where {ACTIVE}")
def p01(spark, d):
    return C.active_controls(ctl(spark, d)).select("id", "scan_id", "control_id")


@query("p02_filter_by_confidence", "select id, control_confidence from v_controls where coalesce(control_confidence, 0) >= 0.75")
def p02(spark, d):
    return C.filter_by_confidence(ctl(spark, d), "control_confidence", 0.75)[0].select("id", "control_confidence")


@query("p03_high_low_split", "select id, case when coalesce(control_confidence, 1) >= 0.75 and merged_to_control_id is null then 'high' else 'low' end as band from v_controls")
def p03(spark, d):
    return C.high_low_split(ctl(spark, d), "control_confidence").select("id", "band")


@query("p04_exclude_ignored", "select id from v_controls where id not in (select id from v_cuecs)")
def p04(spark, d):
    return C.exclude_ignored(ctl(spark, d), view(spark, d, "v_cuecs")).select("id")


@query("p05_list_deviations", "select id, scan_id, cast(page_first as bigint) as page from v_controls where has_deviation and control_confidence >= 0.75")
def p05(spark, d):
    return C.list_deviations(ctl(spark, d)).select("id", "scan_id", F.col("page").cast("long").alias("page"))


@query("p07_column_contains", "select id from v_controls where contains(lower(coalesce(control_desc, '')), 'urgent') and contains(lower(coalesce(control_test, '')), 'small')")
def p07(spark, d):
    return C.column_contains(ctl(spark, d), {"control_desc": "URGENT", "control_test": "small"}).select("id")


@query("p08_validate_controls", "select id, trim(control_desc) as control_desc, control_confidence from v_controls where trim(control_desc) <> ''")
def p08(spark, d):
    return C.validate_controls(ctl(spark, d)).select("id", "control_desc", "control_confidence")


@query("p13_flag_blank_ids", "select id, case when trim(control_id) = '' then least(control_confidence, 0.1) else control_confidence end as control_confidence, case when trim(control_id) = '' then 'blank control id' end as note from v_controls")
def p13(spark, d):
    return C.flag_blank_ids(ctl(spark, d)).select("id", "control_confidence", "note")


@query("p14_penalize_incomplete", f"""with m as (select *, array_to_string(list_filter([case when control_id = '' then 'control_id' end, case when control_desc = '' then 'control_desc' end,
  case when control_test is null then 'control_test' end, case when control_test_results is null then 'control_test_results' end], lambda x: x is not null), ', ') as f from v_controls)
select id, case when {ACTIVE} then f else '' end as missing_fields, round(case when {ACTIVE} and f <> '' then greatest(0, control_confidence - 0.2) else control_confidence end, 6) as control_confidence from m""")  # fmt: skip
def p14(spark, d):
    return C.penalize_incomplete(ctl(spark, d)).select("id", "missing_fields", F.round("control_confidence", 6).alias("control_confidence"))


@query("p16_backfill_deviation", "select id, case when has_deviation then coalesce(nullif(trim(regexp_extract(control_test_results, '(?i)deviation noted\\.\\s*(.*)', 1)), ''), case when lower(control_test_results) like '%deviation%' or lower(control_test_results) like '%exception%' then substr(control_test_results, 1, 300) end) end as deviation_desc from v_controls")
def p16(spark, d):
    return C.backfill_deviation(ctl(spark, d)).select("id", "deviation_desc")


@query("p19_high_confidence_ids", "select id from v_controls where control_confidence > 0.7")
def p19(spark, d):
    return ctl(spark, d).where(F.col("control_confidence") > 0.7).select("id")


@query("p20_logical_consistency", "select id, not (lower(control_desc) like '%security policy%' and lower(coalesce(control_test, '')) like '%background check%') as consistent from v_controls")
def p20(spark, d):
    return ctl(spark, d).select("id", C.logically_consistent(F.col("control_desc"), F.col("control_test")).alias("consistent"))


RANKED = "select *, trim(control_id) as key, row_number() over (partition by scan_id, trim(control_id) order by coalesce(control_confidence, 0) desc, control_seq, id) as rn from v_controls where trim(control_id) <> ''"


@query("w01_pick_primary", f"select id, scan_id, key, rn from ({RANKED})")
def w01(spark, d):
    return C.pick_primary(ctl(spark, d)).select("id", "scan_id", "key", F.col("rn").cast("long").alias("rn"))


@query("w02_pick_merge_primary", "select id, row_number() over (partition by scan_id, trim(control_id) order by length(control_desc) desc, coalesce(control_confidence, 0) desc, id) as rn from v_controls where trim(control_id) <> ''")
def w02(spark, d):
    return C.pick_merge_primary(ctl(spark, d)).select("id", F.col("rn").cast("long").alias("rn"))


@query("j03_duplicate_pairs", f"with r as ({RANKED}) select a.scan_id, a.key, a.id as a_id, b.id as b_id from r a join r b on a.scan_id = b.scan_id and a.key = b.key and a.rn = 1 and b.rn > 1")
def j03(spark, d):
    return C.duplicate_pairs(with_criterion(spark, d)).select("scan_id", "key", "a_id", "b_id")


def graded(a, b):
    """Similarities on all sides of the thresholds."""
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(0.61 + ((F.length(a) + F.length(b)) % 8) * 0.05)


SCORED = f"""with r as (select *, {CRITERION} from ({RANKED})),
pairs as (select a.id as a_id, b.id as b_id, a.scan_id,
  case when lower(trim(a.control_desc)) = lower(trim(b.control_desc)) then 1.0E0 else 0.61E0 + ((length(a.control_desc) + length(b.control_desc)) % 8) * 0.05E0 end as sim,
  least(abs(a.page_first-b.page_first), abs(a.page_first-b.page_last), abs(a.page_last-b.page_first), abs(a.page_last-b.page_last)) as dist,
  coalesce(a.criterion = b.criterion, false) as same, coalesce(a.criterion <> b.criterion, false) as differ, a.has_deviation <> b.has_deviation as dev,
  a.page_first as af, a.page_last as al, b.page_first as bf, b.page_last as bl,
  lower(trim(coalesce(a.control_test, ''))) as ta, lower(trim(coalesce(b.control_test, ''))) as tb
  from r a join r b on a.scan_id = b.scan_id and a.key = b.key and a.rn = 1 and b.rn > 1),
t as (select *, case when ta <> '' and tb <> '' and ta = tb then 0.10 when length(ta) > 20 and length(tb) > 20 and substr(ta,1,50) = substr(tb,1,50) then 0.07 else 0 end as test, (ta <> '' and tb <> '' and ta <> tb) or dev as varies from pairs),
s as (select *, 0.70E0*sim + case when same then 0.15 else 0 end + test + case when dev then 0 else 0.05 end + case when dist <= 1 then 0.05 else 0 end as base from t),
c as (select *, case when sim >= 0.85 and differ then 'CRITERIA_VARIANT' when sim >= 0.85 and varies then 'TEST_VARIANT' when sim >= 0.85 then 'IDENTICAL' when sim >= 0.7 and not differ and not varies then 'IDENTICAL' else 'AMBIGUOUS' end as class,
  round(case when sim >= 0.85 and differ then least(base, 0.95) when sim >= 0.85 and varies then least(base, 0.9) when sim >= 0.85 then base when sim >= 0.7 and not differ and not varies then base when sim >= 0.7 then least(base*0.85E0, 0.8E0) else least(base*0.8E0, 0.75E0) end, 6) as score from s)
"""


@query("f36_duplicate_class", SCORED + "select a_id, b_id, class, score, cast(dist as bigint) as page_distance from c")
def f36(spark, d):
    return C.duplicate_class(C.duplicate_pairs(with_criterion(spark, d)), graded).select("a_id", "b_id", "class", "score", "page_distance")


@query("f37_auto_merge", SCORED + """, m as (select a_id, b_id, round(0.65E0*sim + case when same then 0.15 else 0 end + test + case when dev then 0 else 0.05 end + case when abs(al-bf) <= 1 or abs(bl-af) <= 1 then 0.05 else 0 end, 6) as merge_score from c)
select a_id, b_id, merge_score, case when merge_score >= 0.7 then 'merge' when merge_score < 0.6 then 'cap' else 'keep' end as decision from m""")  # fmt: skip
def f37(spark, d):
    return C.auto_merge_decision(C.duplicate_pairs(with_criterion(spark, d)), graded).select("a_id", "b_id", "merge_score", "decision")


@query("t02_top_suggestions", SCORED + "select a_id, b_id, score from c where score >= 0.5 order by score desc, a_id, b_id limit 50")
def t02(spark, d):
    return C.top_suggestions(C.duplicate_class(C.duplicate_pairs(with_criterion(spark, d)), graded)).select("a_id", "b_id", "score")


@query("a24_suggestion_actions", SCORED + "select case when class = 'IDENTICAL' then 'merge' when class in ('CRITERIA_VARIANT','TEST_VARIANT') then 'link_as_instances' else 'review_manually' end as action, count(*) as n from c group by 1")
def a24(spark, d):
    return C.suggestion_actions(C.duplicate_class(C.duplicate_pairs(with_criterion(spark, d)), graded))


@query("f38_page_distance", "select id, cast(least(abs(page_first - 3), abs(page_last - 3)) as bigint) as distance from v_controls")
def f38(spark, d):
    return ctl(spark, d).select("id", T.page_distance(C.pages(F.col("page_first"), F.col("page_last")), F.array(F.lit(3))).alias("distance"))


@query("a07_consolidate_group", """select scan_id, trim(control_id) as key, count(*) as n, arg_max(control_desc, (length(control_desc), -id)) as control_desc, bool_or(has_deviation) as has_deviation, max(control_confidence) as control_confidence,
  array_to_string(list_sort(list_distinct(list_concat(list(page_first), list(page_last)))), ',') as pages, string_agg(id::varchar, ',' order by id) as merged_ids
  from v_controls where trim(control_id) <> '' group by 1, 2 having count(*) > 1""")  # fmt: skip
def a07(spark, d):
    return C.consolidate_group(ctl(spark, d)).drop("control_test")


@query("a11_duplicate_keys", "select lower(trim(control_id)) as key, count(*) as n from v_controls where trim(control_id) <> '' group by 1 having count(*) > 1")
def a11(spark, d):
    return C.duplicate_keys(ctl(spark, d), "control_id")


@query("w21_number_instances", "select id, row_number() over (partition by scan_id, trim(control_id) order by control_seq, id) as instance_number, count(*) over (partition by scan_id, trim(control_id)) as total_instances from v_controls where trim(control_id) <> ''")
def w21(spark, d):
    return C.number_instances(ctl(spark, d)).select("id", "instance_number", "total_instances")


@query("a23_duplicate_groups", "select scan_id, trim(control_id) as key, string_agg(id::varchar, ',' order by control_seq, id) as members, count(*) as n from v_controls where trim(control_id) <> '' group by 1, 2 having count(*) > 1")
def a23(spark, d):
    return C.duplicate_groups(ctl(spark, d))


@query("f56_link_instances", "with g as (select scan_id, trim(control_id) as key, string_agg(id::varchar, ',' order by control_seq, id) as m from v_controls where trim(control_id) <> '' group by 1, 2 having count(*) > 1) select id, sha1(m) as duplicate_group_id, case when m is not null then 'DUPLICATE_INSTANCE' end as marker from v_controls c left join g on c.scan_id = g.scan_id and trim(c.control_id) = g.key")
def f56(spark, d):
    return C.link_instances(ctl(spark, d)).select("id", "duplicate_group_id", "marker")


PATTERN = "case when regexp_matches(control_id, '^[A-Z]{2,5}-\\d+-\\d+$') or regexp_matches(control_id, '^[A-Z]\\.\\d+\\.\\d+$') or regexp_matches(control_id, '^[A-Z]\\.\\d+$') then regexp_replace(control_id, '\\d', 'X', 'g') end"
LEARNED = f"select organization, {PATTERN} as pattern, count(*) as frequency, min(updated_at) as first_seen, max(updated_at) as last_seen, count(distinct scan_id) as n_scans from v_controls where control_confidence >= 0.9 and {PATTERN} is not null group by 1, 2"


@query("f01_id_pattern", f"select id, {PATTERN} as pattern from v_controls")
def f01(spark, d):
    return ctl(spark, d).select("id", T.id_pattern(F.col("control_id")).alias("pattern"))


@query("f03_merged_pattern", "select id, case when control_id <> '' then case when split_part(control_id,'-',1) = 'BUI' then 'BUI' else 'XXX' end || '-' || case when split_part(control_id,'-',2) = '01' then '01' else 'XX' end || '-' || case when split_part(control_id,'-',3) = '01' then '01' else 'XX' end end as merged from v_controls where control_id <> '' and substr(control_id, 2, 2) <> 'UI' or substr(control_id, 1, 3) = 'BUI'")
def f03(spark, d):
    rows = ctl(spark, d).where("control_id <> '' and substr(control_id, 2, 2) <> 'UI' or substr(control_id, 1, 3) = 'BUI'")
    return rows.select("id", T.merged_pattern(F.col("control_id"), F.lit("BUI-01-01")).alias("merged"))


@query("f04_id_signature", "select id, regexp_replace(regexp_replace(control_id, '\\d', '#', 'g'), '\\p{L}', 'L', 'g') as signature from v_controls")
def f04(spark, d):
    return ctl(spark, d).select("id", T.id_signature(F.col("control_id")).alias("signature"))


@query("f05_positional_match", "select id, round(case when control_id = '' then 0.0 else list_sum(list_transform(range(1, 10), lambda i: case when substr(control_id, i, 1) = substr('BUI-01-01', i, 1) then 1 else 0 end)) / 9.0 end, 6) as score from v_controls")
def f05(spark, d):
    return ctl(spark, d).select("id", F.round(T.positional_match(F.col("control_id"), F.lit("BUI-01-01")), 6).alias("score"))


@query("a09_learn_patterns", LEARNED)
def a09(spark, d):
    return C.learn_patterns(ctl(spark, d))


@query("a10_org_profile", f"with l as ({LEARNED}) select organization, pattern, frequency, count(*) over (partition by organization) as total_patterns, (sum(frequency) over (partition by organization))::bigint as total_occurrences, round(frequency / sum(frequency) over (partition by organization) * 100, 1) as pct from l")
def a10(spark, d):
    return C.org_profile(C.learn_patterns(ctl(spark, d)))


@query("p22_prune_patterns", f"with l as ({LEARNED}) select organization, pattern, frequency from l where frequency >= 5")
def p22(spark, d):
    return C.prune_patterns(C.learn_patterns(ctl(spark, d))).select("organization", "pattern", "frequency")


@query("a12_id_consensus", """with s as (select id, scan_id, regexp_replace(regexp_replace(control_id, '\\d', '#', 'g'), '\\p{L}', 'L', 'g') as sig from v_controls where control_id <> ''),
n as (select scan_id, sig, count(*) as n from s group by 1, 2), b as (select scan_id, arg_max(sig, (n, sig)) as consensus, max(n) as cn, sum(n) as ids from n group by 1),
x as (select id, sig, consensus, cn, ids, round(list_sum(list_transform(range(1, greatest(length(sig), length(consensus))+1), lambda i: case when i <= least(length(sig), length(consensus)) and substr(sig,i,1) = substr(consensus,i,1) then 1 else 0 end)) / greatest(length(sig), length(consensus)), 6) as score from s join b using (scan_id))
select id, consensus, score, score < 0.5 and cn >= greatest(20, ids*0.1) as anomaly from x""")  # fmt: skip
def a12(spark, d):
    return C.id_consensus(ctl(spark, d)).select("id", "consensus", "score", "anomaly")


METRICS = "select scan_id, count(*) as total, count(control_test) as with_test, count(*) filter (has_deviation) as deviations, round(avg(control_confidence), 4) as avg_confidence, count(*) filter (control_confidence < 0.5) as ambiguous, count(*) filter (control_test_results is null) as partial from {v} group by 1"


@query("a01_baseline_metrics", METRICS.format(v="v_controls"))
def a01(spark, d):
    return C.baseline_metrics(ctl(spark, d))


@query("a25_baseline_regressions", f"""with cur as ({METRICS.format(v="v_controls")}), old as ({METRICS.format(v="(select * from v_controls where id % 10 <> 0)")}),
j as (select cur.*, cur.total - old.total as delta, (cur.total - old.total) * 100.0 / old.total as p, (cur.with_test - old.with_test) * 100.0 / old.with_test as t, old.ambiguous as oa from cur join old using (scan_id))
select scan_id, delta, round(p, 4) as pct, array_to_string(list_filter([case when p < -5 then 'controls' end, case when ambiguous > 1.5*oa then 'ambiguous' end, case when partial > 0 then 'partial' end, case when t < -10 then 'tests' end], lambda x: x is not null), ',') as flags from j""")  # fmt: skip
def a25(spark, d):
    c = ctl(spark, d)
    return C.baseline_regressions(C.baseline_metrics(c), C.baseline_metrics(c.where("id % 10 <> 0")))


@query("a03_scan_context_counts", """select s.scan_id, coalesce(controls, 0) as controls, coalesce(deviations, 0) as deviations, coalesce(cuecs, 0) as cuecs, coalesce(cuecs_high, 0) as cuecs_high, coalesce(cuecs_low, 0) as cuecs_low, coalesce(orgs, 0) as orgs from (select n_nationkey + 5 as scan_id from nation) s
  left join (select scan_id, count(*) as controls, count(*) filter (has_deviation) as deviations from v_controls group by 1) c using (scan_id)
  left join (select scan_id, count(*) as cuecs, count(*) filter (cuec_confidence >= 0.7) as cuecs_high, count(*) filter (cuec_confidence < 0.7 and cuec_confidence <> 0) as cuecs_low from v_cuecs group by 1) u using (scan_id)
  left join (select scan_id, count(*) as orgs from v_orgs group by 1) o using (scan_id)""")  # fmt: skip
def a03(spark, d):
    scans = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 5).alias("scan_id"))
    return C.context_counts(scans, ctl(spark, d), view(spark, d, "v_cuecs"), view(spark, d, "v_orgs"))


@query("a05_control_stats", "select scan_id, count(*) as total, cast(min(page_first) as bigint) as first_page, cast(max(page_last) as bigint) as last_page, round(avg(control_confidence), 4) as avg_confidence from v_controls group by 1")
def a05(spark, d):
    return ctl(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"), F.min("page_first").cast("long").alias("first_page"), F.max("page_last").cast("long").alias("last_page"), F.round(F.avg("control_confidence"), 4).alias("avg_confidence"))


@query("j14_recall", """with t as (select distinct scan_id, control_id from v_controls where id % 5 <> 0), e as (select distinct scan_id, control_id from v_controls where id % 3 <> 0),
j as (select coalesce(t.scan_id, e.scan_id) as scan_id, t.control_id is not null as it, e.control_id is not null as ie from t full outer join e on t.scan_id = e.scan_id and t.control_id = e.control_id)
select scan_id, count(*) filter (it and ie) as found, count(*) filter (not ie) as missing, count(*) filter (not it) as extra, round(count(*) filter (it and ie) / count(*) filter (it), 4) as rate from j group by 1""")  # fmt: skip
def j14(spark, d):
    c = ctl(spark, d)
    return C.recall_against_source(c.where("id % 5 <> 0"), c.where("id % 3 <> 0"))


@query("u02_id_sets", "select 'missing' as kind, control_id from (select control_id from v_controls where id % 5 <> 0 except select control_id from v_controls where id % 3 <> 0) union all select 'common', control_id from (select control_id from v_controls where id % 5 <> 0 intersect select control_id from v_controls where id % 3 <> 0)")
def u02(spark, d):
    c = ctl(spark, d)
    t, e = c.where("id % 5 <> 0").select("control_id"), c.where("id % 3 <> 0").select("control_id")
    return t.subtract(e).select(F.lit("missing").alias("kind"), "control_id").union(t.intersect(e).select(F.lit("common"), "control_id"))


@query("j15_snapshot_diff", """with a as (select id, control_desc, control_confidence from v_controls where id % 5 <> 0), b as (select id, control_desc, case when id % 4 = 0 then 0.0 else control_confidence end as control_confidence from v_controls where id % 7 <> 0),
j as (select coalesce(a.id, b.id) as id, a.control_desc as d1, b.control_desc as d2, a.control_confidence as c1, b.control_confidence as c2 from a full outer join b on a.id = b.id)
select id, 'control_desc' as field from j where d1 is distinct from d2 union all select id, 'control_confidence' from j where c1 is distinct from c2""")  # fmt: skip
def j15(spark, d):
    c = ctl(spark, d)
    b = c.where("id % 7 <> 0").withColumn("control_confidence", F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("control_confidence")))
    return C.snapshot_diff(c.where("id % 5 <> 0"), b, "id", ["control_desc", "control_confidence"]).select("id", "field")


@query("w11_overlapping_ranges", "select id, next_id from (select id, page_last, lead(page_first) over w as nf, lead(id) over w as next_id from v_controls window w as (partition by scan_id order by page_first, page_last, id)) where page_last > nf")
def w11(spark, d):
    return C.overlapping_ranges(ctl(spark, d)).select("id", "next_id")


@query("w14_assign_seq", "select id, case when id % 2 = 0 then control_seq else row_number() over (partition by scan_id order by id) end as seq from v_controls")
def w14(spark, d):
    w = F.row_number().over(Window.partitionBy("scan_id").orderBy("id"))
    return ctl(spark, d).withColumn("given", F.when(F.col("id") % 2 == 0, F.col("control_seq"))).select("id", F.coalesce("given", w.cast("long")).alias("seq"))


@query("w19_budgeted_results", "select id, rn from (select id, row_number() over (partition by scan_id order by has_deviation desc, control_seq, id) as rn from v_controls) where rn <= 15")
def w19(spark, d):
    return C.budgeted_results(ctl(spark, d)).select("id", F.col("rn").cast("long").alias("rn"))


@query("j08_invalidate_off_pages", "select id, case when control_confidence >= 0.75 and page_first not in (1, 2) and page_last not in (1, 2) then 0.0 else control_confidence end as control_confidence from v_controls")
def j08(spark, d):
    return C.invalidate_off_pages(ctl(spark, d), [1, 2]).select("id", "control_confidence")


@query("f12_parse_page_refs", "select id, array_to_string(list_sort(list_distinct([page_first, page_last])), ',') as pages from v_controls")
def f12(spark, d):
    raw = F.concat_ws(", ", F.col("page_last"), F.lit("x"), F.col("page_first"), F.col("page_last"))
    return ctl(spark, d).select("id", F.array_join(T.parse_page_refs(raw), ",").alias("pages"))


@query("f13_parse_page_ranges", "select id, case when id % 10 = 0 then null else array_to_string(list_sort(list_distinct(list_concat([20], range(page_first, page_last + 1)))), ',') end as pages from v_controls")
def f13(spark, d):
    raw = F.concat(F.lit("20, "), F.col("page_first"), F.lit("-"), F.col("page_last"), F.when(F.col("id") % 10 == 0, ", 9-2").otherwise(""))
    return ctl(spark, d).select("id", F.array_join(T.parse_page_ranges(raw), ",").alias("pages"))


@query("f14_normalize_percent", "select id, round(case when id % 3 = 1 and id % 101 <= 1 then id % 101 else (id % 101) / 100.0E0 end, 6) as confidence from v_controls")
def f14(spark, d):
    n = F.col("id") % 101
    raw = F.when(F.col("id") % 3 == 0, F.concat(n, F.lit("%"))).when(F.col("id") % 3 == 1, n.cast("string")).otherwise((n / 100).cast("string"))
    return ctl(spark, d).select("id", F.round(T.normalize_percent(raw), 6).alias("confidence"))


MERGED = "merged_to_control_id is not null and merged_to_control_id <> 'DUPLICATE_INSTANCE'"


@query("f55_merge_history", f"""with m as (select cast(merged_to_control_id as bigint) as id, count(*) as n, string_agg(id::varchar, ',' order by id::varchar) as ids from v_controls where {MERGED} group by 1)
select c.id, case when id % 4 = 0 then 1 else 0 end + (n is not null)::int as events, case when n is not null then ids when id % 4 = 0 then 'old' end as last_ids from v_controls c left join m using (id)""")  # fmt: skip
def f55(spark, d):
    c = ctl(spark, d)
    old = F.array(F.struct(F.lit("auto").alias("type"), F.lit(0.8).alias("confidence"), F.array(F.lit("old")).alias("merged_from_ids"), F.lit("before").alias("reason")))
    primaries = c.select("id", F.when(F.col("id") % 4 == 0, old).cast(C.HISTORY).alias("merge_history"))
    merged = c.where(MERGED).select("id", F.col("merged_to_control_id").cast("long").alias("merged_to"))
    told = C.record_merges(primaries, merged)
    return told.select("id", F.coalesce(F.size("merge_history"), F.lit(0)).alias("events"), F.array_join(F.element_at("merge_history", -1)["merged_from_ids"], ",").alias("last_ids"))


@query("f55_split_controls", """select id, case when merged_to_control_id is not null and id % 2 = 0 then null else merged_to_control_id end as merged_to_control_id,
  case when merged_to_control_id is null then control_confidence when id % 2 = 1 then 0.0E0 when id % 4 = 0 then 0.5E0 else control_confidence end as control_confidence,
  case when merged_to_control_id is not null and id % 2 = 0 then 'split' when merged_to_control_id is not null then 'merged' else 'plain' end as state from v_controls""")  # fmt: skip
def f55b(spark, d):
    c = C.merged_away(ctl(spark, d).withColumn("annotation", F.lit("seen")))
    damaged = c.withColumn("annotation", F.when((F.col("id") % 4 == 0) & F.col("merged_to_control_id").isNotNull(), "seen\n{broken").otherwise(F.col("annotation")))
    out = C.split_controls(damaged, damaged.where("id % 2 = 0").select("id"))
    state = F.when(F.contains("annotation", F.lit("Split, confidence restored")), "split").when(F.contains("annotation", F.lit("original_confidence")) | F.contains("annotation", F.lit("{broken")), "merged").otherwise("plain")
    return out.select("id", "merged_to_control_id", "control_confidence", state.alias("state"))


@query("f57_format_confidence", "select id, cast(cast(round(control_confidence * 100) as int) as varchar) || '%' as shown from v_controls")
def f57(spark, d):
    return ctl(spark, d).select("id", T.format_confidence(F.col("control_confidence")).alias("shown"))


@query("t07_column_sort", "select id, control_test from v_controls order by coalesce(control_test, ''), id")
def t07(spark, d):
    return ctl(spark, d).orderBy(F.coalesce("control_test", F.lit("")), "id").select("id", "control_test")


@query("j19_delete_cascade", "select scan_id, count(*) as n from v_controls where scan_id <> 3 group by 1")
def j19(spark, d):
    gone = spark.createDataFrame([(3,)], "scan_id int")
    return ctl(spark, d).join(F.broadcast(gone), "scan_id", "left_anti").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


@query("a20_extraction_diagnostics", f"""with a as (select scan_id, coalesce(control_confidence, 0) as c, has_deviation, id from v_controls where {ACTIVE})
select r.scan_id, raw, continuations, coalesce(after_merge, 0) as after_merge, coalesce(rejected, 0) as rejected, coalesce(final, 0) as final, coalesce(avg_confidence, 0) as avg_confidence, coalesce(deviations, 0) as deviations, coalesce(with_assertions, 0) as with_assertions, raw - coalesce(after_merge, 0) as merged_away
from (select scan_id, count(*) as raw, count(*) filter (id % 7 = 0) as continuations from v_controls group by 1) r left join (
  select scan_id, count(*) as after_merge, count(*) filter (c < 0.5) as rejected, count(*) filter (c >= 0.5) as final, round(coalesce(avg(c) filter (c >= 0.5), 0), 3) as avg_confidence, count(*) filter (c >= 0.5 and has_deviation) as deviations, count(*) filter (c >= 0.5 and id % 3 = 0) as with_assertions from a group by 1) m using (scan_id)""")  # fmt: skip
def a20(spark, d):
    c = ctl(spark, d)
    raw = c.withColumn("continuation", F.col("id") % 7 == 0)
    named = F.when(F.col("id") % 3 == 0, F.array(F.lit("EO1"))).otherwise(F.array().cast("array<string>"))
    return C.extraction_diagnostics(raw, C.active_controls(c).withColumn("assertions", named))
