"""Queries over organizations, user-entity controls, scans, usage and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import controls as C
from reportlake.operators import jobs as J
from reportlake.operators import orgs as O  # noqa: N812
from reportlake.operators import verdicts as V

from .catalog import query
from .views import view


def orgs(spark, d):
    return view(spark, d, "v_orgs")


KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(third_party_name), '\\([^)]*\\)', '', 'g'), '[.,]', '', 'g'), '\\b(inc|llc|ltd|corp|corporation|incorporated|plc|gmbh|sarl|sa|bv|lp|llp|co)\\b', '', 'g'))"


@query("f08_canonical_key", f"select distinct third_party_name, {KEY} as canonical_name from v_orgs")
def f08(spark, d):
    return O.with_canonical(orgs(spark, d)).select("third_party_name", "canonical_name").distinct()


@query("j04_canonicalize_orgs", f"select distinct third_party_name, case when third_party_name like '%(SUP)' then 'supplier' else {KEY} end as canonical_name from v_orgs")
def j04(spark, d):
    aliases = spark.createDataFrame([("sup", "supplier")], "alias string, canonical string")
    return O.canonicalize_orgs(orgs(spark, d), aliases).select("third_party_name", "canonical_name").distinct()


@query("a06_dedup_orgs", "select scan_id, lower(third_party_name) as name_key, min(org_key) as org_key, string_agg(third_party_page_ref, ',' order by org_key, third_party_page_ref, third_party_description) as page_refs from v_orgs group by 1, 2")
def a06(spark, d):
    return O.dedup_orgs_by_name(orgs(spark, d))


@query("a08_canonical_summaries", f"select scan_id, {KEY} as canonical_name, count(distinct third_party_page_ref) as pages, count(distinct third_party_name) as aliases, round(max(third_party_confidence + 0.0), 3) as max_confidence from v_orgs group by 1, 2")
def a08(spark, d):
    return O.canonical_summaries(orgs(spark, d))


@query("j12_mark_common", f"select distinct third_party_name, case when {KEY} in (select lower(s_name) from supplier where s_suppkey % 3 = 0) or lower(third_party_name) in (select lower(s_name) || ' (sup)' from supplier where s_suppkey % 3 = 1) then 'Yes' else 'No' end as common_so, case when {KEY} in (select lower(s_name) from supplier where s_suppkey % 3 = 0) or lower(third_party_name) in (select lower(s_name) || ' (sup)' from supplier where s_suppkey % 3 = 1) then 'Yes' when org_key % 2 = 0 then 'Maybe' end as likely_so from v_orgs")
def j12(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    common = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name")).unionByName(s.where("s_suppkey % 3 = 1").select(F.concat("s_name", F.lit(" (SUP) ")).alias("name")))
    own = orgs(spark, d).withColumn("likely_so", F.when(F.col("org_key") % 2 == 0, "Maybe"))
    return O.mark_common(own, common).select("third_party_name", "common_so", "likely_so").distinct()


COMPANIES = "select distinct s_suppkey % 25 as scan_id, s_name as company from supplier"


@query("p09_drop_self_references", f"select scan_id, org_key, third_party_name, count(*) as n from v_orgs o where not exists (select 1 from ({COMPANIES}) c where c.scan_id = o.scan_id and contains(lower(o.third_party_name), lower(c.company))) group by 1, 2, 3")
def p09(spark, d):
    comp = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % 25).alias("scan_id"), F.col("s_name").alias("company"))
    return O.drop_self_references(orgs(spark, d), comp).groupBy("scan_id", "org_key", "third_party_name").agg(F.count(F.lit(1)).alias("n"))


@query("p21_keep_verdict", "select org_key, round(sum(case when org_key % 4 = 1 then 0 else third_party_confidence end), 4) as total from v_orgs group by 1")
def p21(spark, d):
    verdicts = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("org_key"), (F.col("s_suppkey") % 4 != 1).alias("keep"))
    return O.apply_keep_verdict(orgs(spark, d), verdicts).groupBy("org_key").agg(F.round(F.sum("third_party_confidence"), 4).alias("total"))


def with_notes(spark, d):
    """Organizations, with a first note on some, and answers about them: yes, no, failed or none."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("org_key"))
    k = F.col("org_key")
    rows = s.select("org_key", ((k % 11) / 10).alias("third_party_confidence"), F.when(k % 2 == 0, F.array(F.lit("first"))).alias("confidence_justification"))
    answers = s.where(k % 5 != 0).select("org_key", (k % 3 == 0).alias("yes"), F.when(k % 4 != 0, F.concat(F.lit("because "), k.cast("string"))).alias("reason"), F.when(k % 7 == 0, "timeout").alias("error"))
    return rows, answers


ANSWERED = "s as (select s_suppkey as k, (s_suppkey % 11) / 10.0E0 as c, case when s_suppkey % 2 = 0 then 'first' end as was, s_suppkey % 5 <> 0 as answered, s_suppkey % 3 = 0 as yes, case when s_suppkey % 4 <> 0 then 'because ' || s_suppkey::varchar else 'No reason provided' end as reason, s_suppkey % 7 = 0 as failed from supplier)"


@query("f59_verified_orgs", f"""with {ANSWERED} select k as org_key, case when c < 0.9 or not answered or failed then c when yes then least(1.0E0, round(c + 0.2, 3)) else round(c - 0.2, 3) end as third_party_confidence,
concat_ws('|', was, case when c >= 0.9 and answered then case when failed then 'GPT-4o review failed: timeout' when yes then 'GPT-4o review: confirmed as subservice org (+0.2). Reason: ' || reason else 'GPT-4o review: NOT a subservice org (-0.2). Reason: ' || reason end end) as notes from s""")  # fmt: skip
def f59b(spark, d):
    rows, answers = with_notes(spark, d)
    out = V.verify_orgs(rows, answers.withColumnRenamed("yes", "is_likely_subservice_org"))
    return out.select("org_key", "third_party_confidence", F.array_join("confidence_justification", "|").alias("notes"))


@query("p21_rejected_orgs", f"with {ANSWERED} select k as org_key, case when answered and not failed and not yes then 0.0E0 else c end as third_party_confidence, concat_ws('|', was, case when answered and not failed and not yes then 'Filtered by GPT: ' || reason end) as notes from s")
def p21b(spark, d):
    rows, answers = with_notes(spark, d)
    out = V.reject_orgs(rows, answers.select("org_key", F.when(F.col("error").isNull(), F.col("yes")).alias("keep"), "reason"))
    return out.select("org_key", "third_party_confidence", F.array_join("confidence_justification", "|").alias("notes"))


@query("f34_org_confidence", """select org_key, third_party_description, round(least(1.0, greatest(0.0, 0.0 + case when org_key % 5 = 0 then -0.8 else 0 end + case when org_key % 5 <> 0 and org_key % 3 = 0 then 0.5 else 0 end + case when org_key % 4 = 0 then 0.2 else -0.1 end
  + case when (org_key % 10)/10.0 > 0.5 then round(0.4 * (org_key % 10)/10.0, 3) else 0 end)), 6) as score from (select distinct org_key, third_party_description from v_orgs)""")  # fmt: skip
def f34(spark, d):
    rows = orgs(spark, d).select("org_key", "third_party_description").distinct()
    rows = rows.withColumns({"is_company": F.col("org_key") % 5 == 0, "common": F.col("org_key") % 3 == 0, "likely_so": F.when(F.col("org_key") % 4 == 0, "Yes").otherwise("No"), "provider": (F.col("org_key") % 10) / 10, "near": F.lit(False)})
    return O.org_confidence(rows).select("org_key", "third_party_description", "score")


@query("f35_final_adjust", "select s_suppkey as org_key, round(least(1.0, greatest(0.0, (s_suppkey % 11)/10.0E0 + case s_suppkey % 3 when 0 then -0.2 when 1 then 0.1 else 0 end + case when s_suppkey % 2 = 0 then 0.1 else 0 end + case when s_suppkey % 13 <= 2 then 0.1 when s_suppkey % 13 >= 10 then -0.1 else 0 end)), 3) as score from supplier")
def f35(spark, d):
    k = F.col("s_suppkey")
    likely = F.when(k % 3 == 0, "No").when(k % 3 == 1, "Yes")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("org_key"), O.final_adjust((k % 11) / 10, likely, F.when(k % 2 == 0, "Yes"), k % 13).alias("score"))


@query("f59_verify_verdict", "select s_suppkey as org_key, round(case when s_suppkey % 11 >= 9 then case s_suppkey % 3 when 0 then least(1.0, (s_suppkey % 11)/10.0E0 + 0.2) when 1 then greatest(0.0, (s_suppkey % 11)/10.0E0 - 0.2) else (s_suppkey % 11)/10.0E0 end else (s_suppkey % 11)/10.0E0 end, 3) as score from supplier")
def f59(spark, d):
    k = F.col("s_suppkey")
    verdict = F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "rejected")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("org_key"), O.verify_verdict((k % 11) / 10, verdict).alias("score"))


@query("f10_keyword_distance", "select s_suppkey as org_key, least(levenshtein(lower(s_name), 'supplier'), levenshtein(lower(s_name), 'subservice')) as distance from supplier where not contains(s_name, ' ')")
def f10(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").where("not contains(s_name, ' ')")
    return rows.select(F.col("s_suppkey").alias("org_key"), T.keyword_distance(F.col("s_name"), ["supplier", "subservice"]).alias("distance"))


@query("f09_edit_distance", "select p_partkey, levenshtein(p_name, p_type) as distance from part")
def f09(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("w12_nearest_two", "select scan_id, org_key from (select scan_id, org_key, row_number() over (partition by scan_id order by levenshtein(lower(third_party_name), 'supplier'), org_key, third_party_name, third_party_description, third_party_page_ref, third_party_confidence) as rn from v_orgs) where rn <= 2")
def w12(spark, d):
    return O.nearest_two(orgs(spark, d), F.levenshtein(F.lower("third_party_name"), F.lit("supplier"))).select("scan_id", "org_key")


@query("u03_only_in", "with s as (select distinct third_party_name || '/' || third_party_description as k, scan_id % 3 as src from v_orgs) select k, min(src) as src from s group by k having count(*) = 1")
def u03(spark, d):
    s = orgs(spark, d).select(F.concat_ws("/", "third_party_name", "third_party_description").alias("k"), (F.col("scan_id") % 3).alias("src")).distinct()
    return s.groupBy("k").agg(F.min("src").alias("src"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("u01_originals_plus_summaries", f"select scan_id, third_party_name as name, null::bigint as aliases from v_orgs union all select scan_id, {KEY}, count(distinct third_party_name) from v_orgs group by 1, 2")
def u01(spark, d):
    o = orgs(spark, d)
    return o.select("scan_id", F.col("third_party_name").alias("name")).unionByName(O.canonical_summaries(o).select("scan_id", F.col("canonical_name").alias("name"), "aliases"), allowMissingColumns=True)


@query("t03_confidence_deltas", """with a as (select third_party_name as name, max(third_party_confidence) as x from v_orgs where scan_id < 13 group by 1), b as (select third_party_name as name, max(third_party_confidence) as y from v_orgs where scan_id >= 13 group by 1)
select coalesce(a.name, b.name) as name, round(abs(coalesce(x, 0) - coalesce(y, 0)), 6) as delta from a full outer join b on a.name = b.name order by delta desc, name limit 10""")  # fmt: skip
def t03(spark, d):
    o = orgs(spark, d)
    a = o.where("scan_id < 13").groupBy(F.col("third_party_name").alias("name")).agg(F.max("third_party_confidence").alias("x"))
    b = o.where("scan_id >= 13").groupBy(F.col("third_party_name").alias("name")).agg(F.max("third_party_confidence").alias("y"))
    delta = F.round(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))), 6)
    return a.join(b, "name", "full_outer").select("name", delta.alias("delta")).orderBy(F.desc("delta"), "name").limit(10)


@query("f33_cuec_confidence", """select id, round(least(1.0E0, 0.3E0 + case cuec_gpt_opinion when 'yes' then 0.1E0 when 'no' then -0.3E0 else -0.2E0 end + case when id % 5 < 2 then 0.2E0 else 0 end
 + case when contains(lower(cuec_description), 'responsible for') or contains(lower(cuec_description), 'must') then 0.15E0 else 0 end + case when contains(lower(cuec_description), 'must') or contains(lower(cuec_description), 'ensure') then 0.1E0 else 0 end
 + case when id % 7 = 0 then -0.4E0 else 0 end + case when length(trim(cuec_description)) < 30 or (not ends_with(trim(cuec_description), '.') and length(trim(cuec_description)) < 80) then -0.3E0 else 0 end), 3) as score from v_cuecs""")  # fmt: skip
def f33(spark, d):
    return O.cuec_confidence(view(spark, d, "v_cuecs").withColumn("distance", F.col("id") % 5).withColumn("is_company", F.col("id") % 7 == 0)).select("id", "score")


@query("f46_responsibility_terms", "select id, contains(cuec_description, 'responsible for') or contains(cuec_description, 'must') as duty, contains(cuec_description, 'must') or contains(cuec_description, 'ensure') as obligation from v_cuecs")
def f46(spark, d):
    t = F.col("cuec_description")
    return view(spark, d, "v_cuecs").select("id", T.responsibility(t).alias("duty"), T.any_of(t, T.OBLIGATIONS).alias("obligation"))


@query("a21_distinct_cuecs", "select scan_id, cuec_description, min(id) as id from v_cuecs group by 1, 2")
def a21(spark, d):
    w = Window.partitionBy("scan_id", "cuec_description").orderBy("cuec_seq", "id")
    return view(spark, d, "v_cuecs").withColumn("r", F.row_number().over(w)).where("r = 1").select("scan_id", "cuec_description", "id")


@query("w09_fixed_batches", "select id, (row_number() over (partition by scan_id order by cuec_seq) - 1) // 5 as batch from v_cuecs")
def w09(spark, d):
    n = F.row_number().over(Window.partitionBy("scan_id").orderBy("cuec_seq"))
    return view(spark, d, "v_cuecs").select("id", F.floor((n - 1) / 5).alias("batch"))


@query("t04_order_by_confidence", "select id, cuec_confidence from v_cuecs order by cuec_confidence desc, cuec_seq")
def t04(spark, d):
    return view(spark, d, "v_cuecs").orderBy(F.desc("cuec_confidence"), "cuec_seq").select("id", "cuec_confidence")


@query("p18_flag_low_confidence", "select id, 'low confidence' as note from v_cuecs where cuec_confidence < 0.5 and cuec_confidence <> 0")
def p18(spark, d):
    return C.low_confidence_notes(view(spark, d, "v_cuecs"))


NOTED = "n as (select scan_id, id, cuec_confidence as c, case when id % 4 = 0 then 'seen: LOW Confidence' when id % 4 = 1 then 'fine' end as was from v_cuecs), f as (select *, c < 0.5 and c <> 0 and coalesce(id % 4 <> 0, true) as flagged from n)"


def flagged_cuecs(spark, d):
    was = F.when(F.col("id") % 4 == 0, "seen: LOW Confidence").when(F.col("id") % 4 == 1, "fine")
    rows = view(spark, d, "v_cuecs").select("scan_id", "id", "cuec_confidence", was.alias("cuec_justification"))
    return V.flag_low(rows, "cuec_confidence", "cuec_justification", "CUEC")


@query("p18_flagged_cuecs", rf"with {NOTED} select id, flagged, case when flagged then coalesce(was, '') || '\nAutomated cleanup: Low confidence CUEC (confidence: ' || printf('%.2f', c) || ')' else was end as cuec_justification from f")
def p18b(spark, d):
    return flagged_cuecs(spark, d).select("id", "flagged", "cuec_justification")


@query("p18_flag_counts", f"with {NOTED} select scan_id, count(*) filter (flagged) as flagged from f group by 1")
def p18c(spark, d):
    return V.flag_counts(flagged_cuecs(spark, d))


@query("j06_best_company", "select id, company from (select id, company, row_number() over (partition by id order by company_confidence desc nulls last, company_id desc) as r from v_scans) where r = 1")
def j06(spark, d):
    return J.best_company(view(spark, d, "v_scans"))


@query("t05_recent_scans", "select id, scan_date from v_scans order by scan_date desc, id desc limit 500")
def t05(spark, d):
    return J.recent_scans(view(spark, d, "v_scans"), 900).select("id", "scan_date")


@query("w03_retain_newest", "select company_id, id from (select company_id, id, row_number() over (partition by company_id order by scan_date desc, id desc) as r from v_scans) where r <= 20")
def w03(spark, d):
    return J.retain_newest(view(spark, d, "v_scans")).select("company_id", "id")


@query("w13_estimate_duration", """with l as (select report_type, id, elapsed_seconds as e, row_number() over (partition by report_type order by id desc) as r from v_scans),
k as (select *, avg(e) over (partition by report_type) as m, stddev_pop(e) over (partition by report_type) as s from l where r <= 10),
o as (select report_type, list(e order by r) as xs from k where abs(e - m) <= 2*s group by 1)
select report_type, round(list_reduce(xs, lambda a, x: 0.7*x + 0.3*a), 1) as estimate from o""")  # fmt: skip
def w13(spark, d):
    return J.estimate_duration(view(spark, d, "v_scans"))


TYPED = "select report_type || '-' || company_id::varchar as report_type, id, case when id % 9 = 0 then 0 else elapsed_seconds end as elapsed_seconds from v_scans"


@query("w13_estimate_or_base", f"""with t as ({TYPED}), l as (select *, row_number() over (partition by report_type order by id desc) as r from t),
k as (select * from l where r <= 10), f as (select report_type, count(*) as found from k group by 1),
s as (select *, abs(elapsed_seconds - avg(elapsed_seconds) over p) <= 2 * stddev_pop(elapsed_seconds) over p as near from k where elapsed_seconds <> 0 window p as (partition by report_type)),
g as (select report_type, count(*) as timed, count(*) filter (near) as near, list(elapsed_seconds order by r) filter (near) as xs from s group by 1),
j as (select report_type, found, coalesce(timed, 0) as timed, coalesce(near, 0) as near, xs from f left join g using (report_type))
select report_type, case when found < 5 or timed < 5 or near < 5 then case when starts_with(report_type, 'SOC1') then 1200.0E0 else 2100.0E0 end else round(list_reduce(xs, lambda a, x: 0.7*x + 0.3*a), 1) end as estimated_seconds,
case when found < 5 then found when timed < 5 then timed else near end as based_on_scans, found < 5 or timed < 5 or near < 5 as is_fixed_estimate from j""")  # fmt: skip
def w13b(spark, d):
    scans = view(spark, d, "v_scans").select(F.concat_ws("-", "report_type", F.col("company_id").cast("string")).alias("report_type"), "id", F.when(F.col("id") % 9 == 0, 0).otherwise(F.col("elapsed_seconds")).alias("elapsed_seconds"))
    return J.estimate_or_base(scans)


@query("a02_usage_totals", """with m as (select model, count(*) as calls, sum(prompt_tokens) as p, sum(completion_tokens) as c from v_usage group by 1),
k as (select *, case when model = 'view' then (p * 30.0E0 + c * 60.0E0) / 1e6 else (p * 0.15E0 + c * 0.6E0) / 1e6 end as cost from m)
select round(sum(cost), 4) as gpt_cost, string_agg(model || ' (' || calls::varchar || ' calls)', ', ' order by model) as gpt_model, sum(calls)::bigint as total_calls, sum(p + c)::bigint as total_tokens from k""")  # fmt: skip
def a02b(spark, d):
    return V.usage_totals(view(spark, d, "v_usage"), spark.createDataFrame([("view", 30.0, 60.0)], "model string, i double, o double"))


@query("a02_usage_summary", "select model, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens from v_usage group by rollup(model)")
def a02(spark, d):
    return J.usage_summary(view(spark, d, "v_usage"))


PRICES = [("click", 2.5, 10.0), ("view", 0.15, 0.6), ("purchase", 1.1, 4.4)]


@query("f42_call_cost", "with p(model, i, o) as (values ('click', 2.5, 10.0), ('view', 0.15, 0.6), ('purchase', 1.1, 4.4)) select call_id, round((prompt_tokens * coalesce(i, 0.15) + completion_tokens * coalesce(o, 0.6)) / 1e6, 9) as cost from v_usage u left join p on p.model = u.model")
def f42(spark, d):
    return J.call_cost(view(spark, d, "v_usage"), spark.createDataFrame(PRICES, "model string, i double, o double")).select("call_id", "cost")


@query("t08_latest_audit", "select call_id from v_usage where extractor = 'x1' order by ts desc, call_id desc limit 50")
def t08(spark, d):
    return J.latest_audit(view(spark, d, "v_usage"), "x1").select("call_id")


@query("a18_queue_stats", "select status, count(*) as n from v_jobs group by 1")
def a18(spark, d):
    return J.queue_stats(view(spark, d, "v_jobs"))


@query("w18_queue_position", "select event_id, row_number() over (partition by status order by priority, ts, event_id) as position from v_jobs")
def w18(spark, d):
    return J.queue_positions(view(spark, d, "v_jobs")).select("event_id", "position")


@query("f50_percent_complete", "select event_id, case when progress = 100 then 100.0 else least(90.0, progress / 80.0 * 100) end as pct from v_jobs")
def f50(spark, d):
    p = F.col("progress")
    return view(spark, d, "v_jobs").select("event_id", T.percent_complete(p, F.lit(80.0), p == 100).alias("pct"))


@query("f51_overall_progress", "select event_id, floor(0.20E0*100 + 0.10E0*progress + 0.65E0*((progress + 50 + 20)/3.0E0) + 0.05E0*0)::bigint as overall from v_jobs")
def f51(spark, d):
    p = F.col("progress")
    return view(spark, d, "v_jobs").select("event_id", T.overall_progress(F.lit(100), p, [p, F.lit(50), F.lit(20)], F.lit(0)).alias("overall"))


@query("r01_progress_batch", "select job_id, date_trunc('minute', ts) as minute, count(*) as n, max(progress) as progress from v_jobs group by 1, 2")
def r01(spark, d):
    return view(spark, d, "v_jobs").groupBy("job_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("progress"))


@query("w16_last_messages", "select conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn, role, text) as rendered from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as r from conversations) where r <= 20 group by 1")
def w16(spark, d):
    return J.last_messages(spark.read.parquet(f"{d}/conversations.parquet"))


@query("f17_calendar_months", "select o_orderkey, (year(timestamp '1998-08-02') - year(o_orderdate)) * 12 + month(timestamp '1998-08-02') - month(o_orderdate) as months from orders")
def f17(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.calendar_months(F.col("o_orderdate"), F.lit("1998-08-02").cast("date")).alias("months"))
