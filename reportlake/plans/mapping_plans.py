"""Queries over framework mappings and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.operators import mapping as M
from reportlake.operators import spellings as N

from .catalog import query
from .views import view

CONTROL_IDS = "select distinct framework, criterion_id as id from v_mappings m join v_controls c on m.control_db_id = c.id where c.control_confidence >= 0.75 and m.confidence >= 0.95"
CUEC_IDS = "select distinct r_name as framework, n_name as id from v_cuecs join nation on n_nationkey = scan_id join region on n_regionkey = r_regionkey where cuec_confidence >= 0.9"
COVERED = f"select c.framework, c.section, c.id, case when a.id is not null then 'control' when b.id is not null then 'cuec' else 'missed' end as coverage from v_criteria c left join ({CONTROL_IDS}) a on a.framework = c.framework and a.id = c.id left join ({CUEC_IDS}) b on b.framework = c.framework and b.id = c.id"


def maps(spark, d):
    return view(spark, d, "v_mappings")


def covered(spark, d):
    """Coverage of every criterion by confident controls and user-entity controls."""
    sure = view(spark, d, "v_controls").where("control_confidence >= 0.75").select(F.col("id").alias("control_db_id"))
    by_control = maps(spark, d).where("confidence >= 0.95").join(sure, "control_db_id", "left_semi").select("framework", F.col("criterion_id").alias("id"))
    names = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    cuecs = view(spark, d, "v_cuecs").where("cuec_confidence >= 0.9").select("scan_id").distinct()
    by_cuec = names.join(cuecs, F.col("n_nationkey") == F.col("scan_id")).select(F.col("r_name").alias("framework"), F.col("n_name").alias("id"))
    return M.framework_coverage(view(spark, d, "v_criteria"), by_control, by_cuec)


@query("j02_framework_coverage", f"with x as ({COVERED}) select framework, count(*) as total, count(*) filter (coverage = 'control') as control, count(*) filter (coverage = 'cuec') as cuec, count(*) filter (coverage = 'likely') as likely, count(*) filter (coverage = 'missed') as missed from x group by 1")
def j02(spark, d):
    return M.coverage_totals(covered(spark, d))


@query("j02_criterion_coverage", f"with x as ({COVERED}) select framework, id, coverage from x")
def j02b(spark, d):
    return covered(spark, d).select("framework", "id", "coverage")


def naming_texts(spark, d):
    """Documents that name some criteria in passing, as other people spell them."""
    names = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("long").alias("k"), F.lower(F.translate("n_name", "_", "-")).alias("name"))
    # a nation is one of 25 rows at any scale
    docs = view(spark, d, "v_docs").withColumn("k", F.pmod("doc_id", F.lit(25)).cast("long"))
    return docs.join(F.broadcast(names), "k", "left").select("doc_id", F.concat("text", F.lit(" see "), F.coalesce("name", F.lit("-")), F.lit(".")).alias("text"))


LIKELY = r"""select c.framework, c.section, c.id, case when exists (select 1 from v_mappings m where m.framework = 'ASIA' and m.framework = c.framework and m.criterion_id = c.id) then 'control' when exists (
  select 1 from (select text || ' see ' || coalesce(lower(replace(n_name, '_', '-')), '-') || '.' as text from v_docs left join (select * from nation where n_nationkey % 3 <> 0) n on doc_id % 25 = n_nationkey) t
  where regexp_matches(t.text, '(?i)\b' || replace(c.id, '_', '[. -]?') || '\b')) then 'likely' else 'missed' end as coverage from v_criteria c"""


@query("j02_likely_coverage", f"with x as ({LIKELY}) select framework, count(*) as total, count(*) filter (coverage = 'control') as control, count(*) filter (coverage = 'cuec') as cuec, count(*) filter (coverage = 'likely') as likely, count(*) filter (coverage = 'missed') as missed from x group by 1")
def j02c(spark, d):
    """Coverage where controls map to one framework only, and documents name criteria of the others."""
    criteria = view(spark, d, "v_criteria")
    by_control = maps(spark, d).where("framework = 'ASIA'").select("framework", F.col("criterion_id").alias("id"))
    named = N.ids_in_text(naming_texts(spark, d), criteria).select("id").distinct()
    return M.coverage_totals(M.framework_coverage(criteria, by_control, by_control.limit(0), criteria.select("framework", "id").join(named, "id")))


@query("a16_coverage_rollup", f"with x as ({COVERED}) select framework, section, count(*) as total, count(*) filter (coverage <> 'missed') as mapped, cast(grouping(framework) * 2 + grouping(section) as bigint) as level from x group by rollup(framework, section)")
def a16(spark, d):
    return M.coverage_rollup(covered(spark, d))


@query("j01_validate_matches", "select control_db_id, framework, criterion_id, confidence from v_mappings m where confidence >= 0.6 and exists (select 1 from v_criteria c where c.framework = m.framework and c.id = m.criterion_id and c.section <> 'S1')")
def j01(spark, d):
    return M.validate_matches(maps(spark, d), view(spark, d, "v_criteria").where("section <> 'S1'")).select("control_db_id", "framework", "criterion_id", "confidence")


@query("w15_top_k_matches", "select control_db_id, framework, criterion_id, pos from (select *, row_number() over (partition by control_db_id, framework order by confidence desc, criterion_id) as pos from (select control_db_id, framework, criterion_id, max(confidence) as confidence from v_mappings group by 1, 2, 3)) where pos <= 2")
def w15(spark, d):
    best = maps(spark, d).groupBy("control_db_id", "framework", "criterion_id").agg(F.max("confidence").alias("confidence"))
    return M.top_k_matches(best, 2).select("control_db_id", "framework", "criterion_id", "pos")


@query("t01_primary_mapping", "select control_db_id, framework as primary_framework, criterion_id as primary_criterion, confidence as primary_confidence from (select *, row_number() over (partition by control_db_id order by confidence desc, framework, criterion_id) as r from v_mappings) where r = 1")
def t01(spark, d):
    return M.primary_mapping(maps(spark, d))


@query("a15_criteria_by_section", "select framework, coalesce(section, 'Unspecified') as section, string_agg(id, ',' order by id) as ids, count(*) as n from v_criteria group by 1, 2")
def a15(spark, d):
    return M.criteria_by_section(view(spark, d, "v_criteria"))


@query("j24_mapped_controls", "select c.framework, c.id, count(distinct m.control_db_id) as n_controls, coalesce(bool_or(k.has_deviation), false) as any_deviation from v_criteria c left join (v_mappings m join v_controls k on m.control_db_id = k.id) on m.framework = c.framework and m.criterion_id = c.id group by 1, 2")
def j24(spark, d):
    return M.mapped_controls_per_criterion(view(spark, d, "v_criteria"), maps(spark, d), view(spark, d, "v_controls"))


@query("j25_primary_details", "with p as (select *, row_number() over (partition by control_db_id order by confidence desc, framework, criterion_id) as r from v_mappings) select control_db_id, p.framework, section, description from p left join v_criteria c on c.framework = p.framework and c.id = p.criterion_id where r = 1")
def j25(spark, d):
    crit = view(spark, d, "v_criteria").select("framework", F.col("id").alias("primary_criterion"), "section", "description")
    return M.primary_mapping(maps(spark, d)).withColumnRenamed("primary_framework", "framework").join(crit, ["framework", "primary_criterion"], "left").select("control_db_id", "framework", "section", "description")


@query("a04_framework_usage", "select framework, count(distinct control_db_id) as controls, count(*) as mappings, round(avg(confidence), 4) as avg_confidence from v_mappings group by 1")
def a04(spark, d):
    return M.framework_usage(view(spark, d, "v_controls"), maps(spark, d))


@query("u04_unexpected_frameworks", "with u as (select control_db_id, list_sort(list_distinct(list(framework))) as used from v_mappings group by 1) select control_db_id, array_to_string(list_filter(used, lambda f: f not in ('ASIA', 'EUROPE', 'AFRICA')), ',') as unexpected from u where len(list_filter(used, lambda f: f not in ('ASIA', 'EUROPE', 'AFRICA'))) > 0")
def u04(spark, d):
    return M.unexpected_frameworks(maps(spark, d), ["ASIA", "EUROPE", "AFRICA"])


@query("j17_rejoin_answers", "with a as (select control_db_id, min(framework) as framework from v_mappings where control_db_id % 4 <> 0 group by 1) select c.id, a.framework, case when a.framework is null then 'mapping failed' end as note from v_controls c left join a on a.control_db_id = c.id")
def j17(spark, d):
    return M.rejoin_answers(view(spark, d, "v_controls"), maps(spark, d).where("control_db_id % 4 <> 0")).select("id", "framework", "note")


@query("t06_frameworks_by_priority", "select distinct framework, priority from v_criteria order by priority")
def t06(spark, d):
    return view(spark, d, "v_criteria").select("framework", "priority").distinct().orderBy("priority")


REPORTS = "select id, case when id % 11 = 0 then 'OTHER' else report_type end as report_type, case id % 4 when 0 then ['iso/iec 27001'] when 1 then ['COSO', 'SSAE 18'] when 2 then [] end as standards from v_scans"


@query("j16_frameworks_for", f"""with r as ({REPORTS}), k(framework, kinds, standards) as (values ('TSC', ['SOC2', 'COMBINED'], ['SSAE 18', 'AT-C 105', 'AT-C 205']), ('COSO', ['SOC1', 'SOC2', 'COMBINED'], ['COSO 2013']), ('FINANCIAL_ASSERTIONS', ['SOC1', 'COMBINED'], ['SSAE 18', 'AT-C 320']),
  ('COSO_ICFR', ['SOC1', 'COMBINED'], ['COSO 2013', 'PCAOB AS 2201']), ('ISAE3402', ['SOC1', 'COMBINED'], ['ISAE 3402', 'IAASB']), ('CSAE3416', ['SOC1', 'SOC2', 'COMBINED'], ['CSAE 3416', 'CPA Canada']), ('AAF0106', ['SOC1', 'SOC2', 'COMBINED'], ['AAF 01/06', 'AUASB']),
  ('GS007', ['SOC1', 'SOC2', 'COMBINED'], ['GS 007', 'IDW']), ('ISO27001', ['SOC2', 'COMBINED'], ['ISO/IEC 27001:2013', 'ISO/IEC 27001:2022'])),
s as (select id, upper(unnest(standards)) as std from r), o as (select framework, upper(unnest(standards)) as own from k)
select r.id, framework from r, k where list_contains(kinds, case when report_type = 'OTHER' then 'SOC2' else report_type end) union select id, framework from s, o where contains(own, std)""")  # fmt: skip
def j16(spark, d):
    k = F.col("id") % 4
    standards = F.when(k == 0, F.array(F.lit("iso/iec 27001"))).when(k == 1, F.array(F.lit("COSO"), F.lit("SSAE 18"))).when(k == 2, F.array().cast("array<string>"))
    reports = view(spark, d, "v_scans").select("id", F.when(F.col("id") % 11 == 0, "OTHER").otherwise(F.col("report_type")).alias("report_type"), standards.alias("standards"))
    known = M.registry(spark)
    return M.frameworks_for(reports, known, known.where("framework <> 'NIST'"))


@query("f54_domain_criteria", """with d as (select distinct case id % 6 when 0 then 'Availability' when 1 then 'Confidentiality' when 2 then 'Privacy' when 3 then 'Processing Integrity' when 4 then 'Security' end as domain from v_controls),
c as (select id from v_criteria union select 'PI' || id from v_criteria union select 'Conf ' || id from v_criteria)
select domain, id from d, c where domain is null or (domain = 'Availability' and starts_with(id, 'A')) or (domain = 'Confidentiality' and starts_with(id, 'Conf')) or (domain = 'Privacy' and starts_with(id, 'P')) or (domain = 'Processing Integrity' and starts_with(id, 'PI')) or (domain = 'Security' and starts_with(id, 'C'))""")  # fmt: skip
def f54(spark, d):
    k = F.col("id") % 6
    domains = view(spark, d, "v_controls").select(F.when(k == 0, "Availability").when(k == 1, "Confidentiality").when(k == 2, "Privacy").when(k == 3, "Processing Integrity").when(k == 4, "Security").alias("domain")).distinct()
    c = view(spark, d, "v_criteria").select("id")
    every = c.union(c.select(F.concat(F.lit("PI"), "id"))).union(c.select(F.concat(F.lit("Conf "), "id")))
    return M.domain_criteria(domains, every)


PROMPT = "Control: {control_desc}\nCriteria:\n{criteria_list}{deviation_context}\nName the {5} best."


@query("f43_render_prompt", """with m as (select control_db_id, string_agg('- ' || criterion_id || ': ' || coalesce(description, 'N/A'), chr(10) order by criterion_id) as listed from (select distinct control_db_id, criterion_id, description from v_mappings m left join v_criteria c on c.id = m.criterion_id and c.priority > 1) group by 1),
c as (select id, control_desc, listed, has_deviation, case when id % 2 = 0 then repeat(control_test_results, 4) else control_test_results end as dev from v_controls join m on control_db_id = id)
select id, 'Control: ' || control_desc || chr(10) || 'Criteria:' || chr(10) || listed || case when has_deviation and coalesce(dev, '') <> '' then chr(10) || 'NOTE: This control has a documented deviation/exception: ' || case when length(dev) > 80 then substr(dev, 1, 80) || '...' else dev end || chr(10) || 'Consider criteria related to monitoring, deficiency reporting, or control evaluation.' else '' end || chr(10) || 'Name the {5} best.' as prompt from c""")  # fmt: skip
def f43(spark, d):
    known = view(spark, d, "v_criteria").where("priority > 1").select(F.col("id").alias("criterion_id"), "description")
    named = maps(spark, d).select("control_db_id", "criterion_id").distinct().join(known, "criterion_id", "left")
    none = F.lit(None).cast("string")
    one = F.struct(F.col("criterion_id").alias("id"), F.col("description"), none.alias("principle"), none.alias("name"))
    listed = named.groupBy(F.col("control_db_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("criteria"))
    c = view(spark, d, "v_controls").withColumn("dev", F.when(F.col("id") % 2 == 0, F.repeat("control_test_results", F.lit(4))).otherwise(F.col("control_test_results")))
    return c.join(listed, "id").select("id", M.render_prompt(PROMPT, F.col("control_desc"), F.col("criteria"), F.col("has_deviation"), F.col("dev")).alias("prompt"))


@query("f40_detect_standards", r"""with t as (select doc_id, upper(text || case doc_id % 5 when 0 then ' see isae 3402' when 1 then ' IDW  PS951 and iso27001' when 2 then ' Nist 800-53' when 3 then ' AAF 0106' else '' end) as t, case doc_id % 4 when 0 then 'SOC1' when 1 then 'SOC2' when 2 then 'COMBINED' end as kind from v_docs),
f as (select doc_id, list_concat(case kind when 'SOC1' then ['FINANCIAL_ASSERTIONS', 'COSO_ICFR', 'COSO'] when 'SOC2' then ['TSC', 'COSO'] when 'COMBINED' then ['TSC', 'COSO', 'FINANCIAL_ASSERTIONS', 'COSO_ICFR'] else [] end, list_filter([
  case when regexp_matches(t, 'ISAE\s*3402') or contains(t, 'INTERNATIONAL STANDARD ON ASSURANCE ENGAGEMENTS') then 'ISAE3402' end, case when regexp_matches(t, 'CSAE\s*3416') or contains(t, 'CANADIAN STANDARD ON ASSURANCE') then 'CSAE3416' end,
  case when regexp_matches(t, 'AAF\s*01/?06') or contains(t, 'AUSTRALIAN AUDITING FRAMEWORK') then 'AAF0106' end, case when regexp_matches(t, 'GS\s*007') or regexp_matches(t, 'IDW\s*PS\s*951') or contains(t, 'GERMAN AUDITING STANDARD') then 'GS007' end,
  case when regexp_matches(t, 'ISO\s*/?27001') or regexp_matches(t, 'ISO/IEC\s*27001') then 'ISO27001' end, case when regexp_matches(t, 'NIST\s*CSF') or contains(t, 'NIST CYBERSECURITY FRAMEWORK') or regexp_matches(t, 'NIST\s*800') then 'NIST' end], lambda x: x is not null)) as f from t)
select doc_id, array_to_string(f, ',') as frameworks from f""")  # fmt: skip
def f40(spark, d):
    k, n = F.col("doc_id") % 5, F.col("doc_id") % 4
    more = F.when(k == 0, " see isae 3402").when(k == 1, " IDW  PS951 and iso27001").when(k == 2, " Nist 800-53").when(k == 3, " AAF 0106").otherwise("")
    kind = F.when(n == 0, "SOC1").when(n == 1, "SOC2").when(n == 2, "COMBINED")
    return view(spark, d, "v_docs").select("doc_id", F.array_join(M.detect_standards(F.concat("text", more), kind), ",").alias("frameworks"))


@query("u06_consolidate_mappings", "select control_db_id, string_agg(framework || '=' || n::varchar, ';' order by framework) as mapped from (select control_db_id, framework, count(distinct criterion_id) as n from v_mappings where confidence >= 0.8 group by 1, 2) group by 1")
def u06(spark, d):
    per = maps(spark, d).where("confidence >= 0.8").groupBy("control_db_id", "framework").agg(F.countDistinct("criterion_id").alias("n"))
    return per.groupBy("control_db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("framework", "n"))), lambda x: F.concat_ws("=", x["framework"], x["n"].cast("string"))), ";").alias("mapped"))


@query("a26_exec_summary", f"with x as ({COVERED}) select (select count(*) from v_controls where control_confidence >= 0.89) as controls, (select count(*) from v_cuecs where cuec_confidence >= 0.9) as cuecs, (select count(*) from x where coverage <> 'missed') as criteria_present")
def a26(spark, d):
    c = view(spark, d, "v_controls").agg(F.count_if(F.col("control_confidence") >= 0.89).alias("controls"))
    u = view(spark, d, "v_cuecs").agg(F.count_if(F.col("cuec_confidence") >= 0.9).alias("cuecs"))
    x = covered(spark, d).agg(F.count_if(F.col("coverage") != "missed").alias("criteria_present"))
    return c.crossJoin(u).crossJoin(x)  # one row each
