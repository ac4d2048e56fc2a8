"""Queries over confidence factors, periods, continuations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import controls as C
from reportlake.operators import orgs as O  # noqa: N812
from reportlake.operators import scoring as K
from reportlake.operators import islands as I
from reportlake.operators import spellings as N

from .catalog import query
from .views import table, view


@query("f32_multi_factor", "select id, round((0.30E0*control_confidence + 0.20E0*((id % 10)/10.0E0) + 0.20E0*((2 + (control_test is not null)::int)/3.0E0) + 0.15E0*0.5E0 + 0.15E0*(case when has_deviation then 0.3E0 else 1.0E0 end) + 0.10E0*(case when control_id <> '' then 1.0E0 else 0.0E0 end)) / 1.10E0, 3) as score from v_controls")
def f32(spark, d):
    f = {"model": F.col("control_confidence"), "pattern": (F.col("id") % 10) / 10, "fields": (2 + F.col("control_test").isNotNull().cast("int")) / 3, "mapping": F.lit(0.5), "deviation": F.when(F.col("has_deviation"), 0.3).otherwise(1.0), "id_format": F.when(F.col("control_id") != "", 1.0).otherwise(0.0)}
    return view(spark, d, "v_controls").select("id", K.multi_factor(f).alias("score"))


@query("f31_framework_category", "with x as (select id, 0.6E0*control_confidence + 0.4E0*((id % 10)/10.0E0) as a, 0.6E0*((id % 7)/7.0E0) + 0.4E0*(id % 22)/22.0E0 as b from v_controls) select id, case when greatest(a, b) < 0.70 then 'AMBIGUOUS' when a >= b then 'TSC' else 'COSO' end as category from x")
def f31(spark, d):
    k = F.col("id")
    return view(spark, d, "v_controls").select("id", K.framework_category(F.col("control_confidence"), (k % 10) / 10, (k % 7) / 7, k % 22).alias("category"))


@query("p15_partial_extraction", "select id, (length(trim(control_desc || repeat('x', cast(id % 30 as int)))) > 50 and id % 4 in (0, 3)) or id % 4 = 1 as partial from v_controls")
def p15(spark, d):
    n = F.col("id") % 4
    found = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("EO1"))).when(n == 2, F.array(F.lit("EO1"), F.lit("CO2")))
    desc = F.concat("control_desc", F.repeat(F.lit("x"), (F.col("id") % 30).cast("int")))
    return view(spark, d, "v_controls").select("id", C.partial_extraction(desc, found).alias("partial"))


WORDS = [("Existence", "the"), ("Existence", "licen"), ("Rights", "por"), ("Rights", "und"), ("Valuation", "les")]


@query("f30_keyword_assertions", """with k(assertion, keyword) as (values ('Existence','the'),('Existence','licen'),('Rights','por'),('Rights','und'),('Valuation','les')),
h as (select doc_id, assertion, count(distinct keyword) as m from v_docs, k where contains(lower(text), keyword) group by 1, 2)
select doc_id, assertion, m, round(least(0.95E0, 0.5E0 + least(0.4E0, 0.1E0*m)), 6) as confidence from h where round(0.5E0 + 0.1E0*m, 6) >= 0.6""")  # fmt: skip
def f30(spark, d):
    return N.keyword_assertions(view(spark, d, "v_docs"), spark.createDataFrame(WORDS, "assertion string, keyword string"))


@query("f39_ids_in_text", "select doc_id, 'V3' as id from v_docs where regexp_matches(text || ' v-3 ', '(?i)\\bV[. \\-]?3\\b') union all select doc_id, 'version.3' from v_docs where regexp_matches(text || ' v-3 ', '(?i)\\bversion[. \\-]?3\\b')")
def f39(spark, d):
    docs = view(spark, d, "v_docs").withColumn("text", F.concat("text", F.lit(" v-3 ")))
    return N.ids_in_text(docs, spark.createDataFrame([("V3",), ("version.3",)], "id string"))


PERIODS = """with d as (select o_custkey * 10000 + year(o_orderdate) as k, list_sort(list_distinct(list(o_orderdate::date))) as ds from orders group by 1),
m as (select k, ds, len(ds) as n, ds[1] as a, ds[len(ds)] as z, (year(ds[len(ds)]) - year(ds[1])) * 12 + month(ds[len(ds)]) - month(ds[1]) as mo,
  list_filter(ds[2:len(ds)-1], lambda x: (year(x) - year(ds[1])) * 12 + month(x) - month(ds[1]) between 6 and 12) as mid from d)
select k, case when n = 1 then 'Type 1' when n = 2 then case when mo between 6 and 12 or z - a <= 30 then 'Type 2' else 'Type 1' end when len(mid) > 0 then 'Type 2' else 'Type 1' end as kind,
  case when n = 1 then a when n = 2 then case when mo not between 6 and 12 and z - a <= 30 then a else z end when len(mid) > 0 then mid[len(mid)] else z end as period_end from m"""  # fmt: skip


@query("f18_deduce_period", PERIODS)
def f18(spark, d):
    key = F.col("o_custkey") * 10000 + F.year("o_orderdate")
    dates = table(spark, d, "orders").groupBy(key.alias("k")).agg(F.array_sort(F.collect_set(F.col("o_orderdate").cast("date"))).alias("ds"))
    return dates.select("k", K.deduce_period(F.col("ds")).alias("p")).select("k", F.col("p.kind").alias("kind"), F.col("p.end").alias("period_end"))


@query("a14_drop_frequent_dates", "select o_orderkey from (select o_orderkey, count(*) over (partition by o_custkey % 10, o_orderdate::date) as n from orders) where n <= 8")
def a14(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("doc_id"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey")
    return K.drop_frequent(rows).select("o_orderkey")


@query("j05_weights_with_fallback", "select distinct organization, case when organization = 'BUILDING' then 0.4E0 else 0.3E0 end as weight from v_controls")
def j05(spark, d):
    w = spark.createDataFrame([("BUILDING", 0.4), (None, 0.3)], "organization string, weight double")
    return K.weights_with_fallback(view(spark, d, "v_controls").select("organization").distinct(), w, 0.2)


@query("f47_validate_weights", "select call_id, concat_ws(',', case when not (prompt_tokens % 100)/100.0E0 between 0.05 and 0.6 then 'a' end, case when abs((prompt_tokens % 100)/100.0E0 + 0.5 - 1) > 0.001 then 'sum' end) as errors from v_usage")
def f47(spark, d):
    w = view(spark, d, "v_usage").select("call_id", ((F.col("prompt_tokens") % 100) / 100).alias("a"), F.lit(0.5).alias("b"))
    return K.validate_weights(w, ["a", "b"]).select("call_id", "errors")


@query("j09_pages_near_control", "select c.id, p.page_no from v_controls c join (select distinct doc_id, page_no from v_pages) p on p.doc_id = c.scan_id and p.page_no between c.page_first and c.page_first + 2")
def j09(spark, d):
    return K.pages_near(view(spark, d, "v_controls"), view(spark, d, "v_pages"), 2)


@query("j21_apply_dedup_groups", "select scan_id, third_party_name, round(sum(case when third_party_name like '%(SUP)' and org_key % 2 = 0 then least(third_party_confidence, 0.2) else third_party_confidence end), 4) as total from v_orgs group by 1, 2")
def j21(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    groups = s.select(F.col("s_name").alias("canonical"), F.array(F.concat("s_name", F.lit(" (SUP)"))).alias("variations"))
    return K.apply_dedup_groups(view(spark, d, "v_orgs"), groups).groupBy("scan_id", "third_party_name").agg(F.round(F.sum("third_party_confidence"), 4).alias("total"))


@query("j22_apply_adjustments", "select org_key, round(sum(case when third_party_confidence >= 0.8 and org_key % 3 = 0 then 0.1 else third_party_confidence end), 4) as total from v_orgs group by 1")
def j22(spark, d):
    adj = table(spark, d, "supplier").select(F.lower("s_name").alias("name"), (F.col("s_suppkey") % 3 == 0).alias("should_reduce"), F.lit(0.1).alias("confidence"))
    orgs = view(spark, d, "v_orgs").withColumn("canonical_name", F.lower(F.regexp_replace("third_party_name", r", Inc\.| \(SUP\)", "")))
    return K.apply_adjustments(orgs, adj).groupBy("org_key").agg(F.round(F.sum("third_party_confidence"), 4).alias("total"))


@query("j26_resolve_type", "select id, case when id % 5 = 0 then 'SOC2' when id % 2 = 0 then report_type end as resolved from v_scans")
def j26(spark, d):
    scans = view(spark, d, "v_scans").withColumn("hash", F.sha2(F.col("id").cast("string"), 256))
    det = scans.select("hash", F.when(F.col("id") % 5 == 0, "SOC2").alias("user_confirmed"), F.col("report_type").alias("detected"), F.when((F.col("id") % 2 == 0) | (F.col("id") % 5 == 0), F.lit("2100-01-01")).otherwise(F.lit("2000-01-01")).cast("timestamp").alias("expires_at"))
    return K.resolve_type(scans, det, F.lit("2030-01-01").cast("timestamp")).select("id", F.col("found").alias("resolved"))


def own_companies(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("scan_id"), F.concat("s_name", F.lit(", LLC.")).alias("company"))


@query("j27_mark_self_orgs", "select distinct scan_id, third_party_name, case when org_key % 25 = scan_id then 'No' end as likely_so from v_orgs")
def j27(spark, d):
    """By containment alone, which SQL can say."""
    return O.mark_self_orgs(view(spark, d, "v_orgs"), own_companies(spark, d), alike=None).select("scan_id", "third_party_name", "likely_so").distinct()


@query("j27_similar_self_orgs")
def j27b(spark, d):
    """Rows that differ in page and confidence only are one before they are marked."""
    orgs = view(spark, d, "v_orgs").select("scan_id", "third_party_name", "third_party_description").distinct()
    return O.mark_self_orgs(orgs, own_companies(spark, d)).select("scan_id", "third_party_name", "third_party_description", "likely_so").distinct()


@query("a17_entity_counts", "select 'controls' as entity, count(*) as n from v_controls union all select 'cuecs', count(*) from v_cuecs union all select 'orgs', count(*) from v_orgs")
def a17(spark, d):
    one = lambda v, name: view(spark, d, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
    return one("v_controls", "controls").union(one("v_cuecs", "cuecs")).union(one("v_orgs", "orgs"))


@query("a19_group_control_ids", "select scan_id, org_key, string_agg(distinct third_party_page_ref, ',' order by third_party_page_ref) as refs from v_orgs group by 1, 2")
def a19(spark, d):
    return K.group_control_ids(view(spark, d, "v_orgs"))


@query("t09_orgs_by_confidence", "select scan_id, org_key, third_party_confidence + 0.0 as confidence from v_orgs order by confidence desc, scan_id, org_key")
def t09(spark, d):
    return view(spark, d, "v_orgs").select("scan_id", "org_key", (F.col("third_party_confidence") + 0.0).alias("confidence")).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "scan_id", "org_key")


@query("t10_choose_heading", "select doc_id, line_no from (select doc_id, line_no, row_number() over (partition by doc_id order by regexp_matches(line, '^\\s*(section\\s+)?([IVX]+|\\d+)[.):]') desc, length(line) desc, line_no) as r from v_lines where contains(lower(line), 'the')) where r = 1")
def t10(spark, d):
    return K.choose_heading(view(spark, d, "v_lines"), "the").select("doc_id", "line_no")


@query("p06_report_projection", """with s as (select n_nationkey as scan_id, case n_nationkey % 3 when 0 then ' ' when 1 then n_name end as company from nation), r as (select n_nationkey as scan_id, 'stored ' || n_name as company, 'auditor ' || n_regionkey::varchar as auditor from nation where n_nationkey % 2 = 0)
select s.scan_id, coalesce(nullif(trim(s.company), ''), r.company) as company, r.auditor, coalesce(c.ids, '') as controls, coalesce(u.ids, '') as cuecs, coalesce(o.n, 0) as orgs from s left join r using (scan_id)
  left join (select scan_id, md5(string_agg(id::varchar, ',' order by id)) as ids from v_controls group by 1) c using (scan_id) left join (select scan_id, md5(string_agg(id::varchar, ',' order by id)) as ids from v_cuecs group by 1) u using (scan_id)
  left join (select scan_id, count(*) as n from v_orgs group by 1) o using (scan_id)""")  # fmt: skip
def p06(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey") % 3
    scans = n.select(F.col("n_nationkey").alias("scan_id"), F.when(k == 0, " ").when(k == 1, F.col("n_name")).alias("company"))
    stored = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("scan_id"), F.concat(F.lit("stored "), "n_name").alias("company"), F.concat(F.lit("auditor "), F.col("n_regionkey").cast("string")).alias("auditor"))
    c = view(spark, d, "v_controls").select("scan_id", "id", "control_id", "control_desc", "control_confidence")
    u = view(spark, d, "v_cuecs").select("scan_id", "id", "cuec_description")
    out = K.report_projection(scans, c, u, view(spark, d, "v_orgs"), results=stored)
    ids = lambda name: F.when(F.size(name) > 0, F.md5(F.array_join(F.transform(name, lambda x: x["id"].cast("string")), ","))).otherwise("").alias(name)
    return out.select("scan_id", "company", "auditor", ids("controls"), ids("cuecs"), F.size("orgs").cast("long").alias("orgs"))


PARSED = "select scan_id, id as control_seq, control_id, case when id % 6 = 0 then null else control_desc end as control_desc, has_deviation from v_controls where control_confidence >= 0.5"


def parsed(spark, d):
    done = view(spark, d, "v_controls").where("control_confidence >= 0.5")
    rows = done.select("scan_id", F.col("id").alias("control_seq"), "control_id", F.when(F.col("id") % 6 != 0, F.col("control_desc")).alias("control_desc"), "has_deviation")
    estimates = table(spark, d, "nation").select(F.col("n_nationkey").alias("scan_id"), F.when(F.col("n_nationkey") % 2 == 0, 30).alias("estimate"))
    return C.partial_controls(rows, estimates, limit=3, min_pct=50.0)


@query("p17_partial_controls", f"""with p as ({PARSED}), g as (select scan_id, count(*) as total_parsed, least(3, count(*) filter (coalesce(control_id, '') <> '' or coalesce(control_desc, '') <> '')) as count from p group by 1)
select scan_id, total_parsed, count, case when scan_id % 2 = 0 then round(100.0E0 * total_parsed / 30, 2) else least(100.0E0, total_parsed) end as completion_pct, case when scan_id % 2 = 0 then 100.0E0 * total_parsed / 30 >= 50 else total_parsed >= 50 end as threshold_met from g""")  # fmt: skip
def p17(spark, d):
    return parsed(spark, d)[1].drop("estimate")


@query("p17_partial_rows", f"select scan_id, control_seq, control_id, control_desc, has_deviation from (select *, row_number() over (partition by scan_id order by control_seq) as r from ({PARSED}) where coalesce(control_id, '') <> '' or coalesce(control_desc, '') <> '') where r <= 3")
def p17b(spark, d):
    return parsed(spark, d)[0]


@query("p10_heuristic_excluded", """with o as (select distinct scan_id, org_key, third_party_description as kind from v_orgs)
select scan_id, org_key, kind, contains(lower(kind), 'standard') or (org_key % 25 = scan_id and org_key % 4 in (0, 1, 3)) as excluded from o""")  # fmt: skip
def p10(spark, d):
    key = F.substring(F.md5(F.col("org_key").cast("string")), 1, 16)
    company = table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("scan_id"), F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 16).alias("company"))
    o = view(spark, d, "v_orgs").select("scan_id", "org_key", F.col("third_party_description").alias("kind")).distinct()
    n = F.col("org_key") % 4
    # the company itself inside a name, one letter off, another name, inside a description
    name = F.when(n == 0, F.concat(F.lit("The "), F.upper(key))).when(n == 1, F.concat(F.substring(key, 1, 15), F.lit("z"))).otherwise(F.reverse(F.md5(key)))
    desc = F.concat(F.regexp_replace("kind", " provider", ""), F.when(n == 3, F.concat(F.lit(" of "), key)).otherwise(""))
    rows = o.withColumn("third_party_name", name).withColumn("third_party_description", desc).withColumn("third_party_confidence", F.lit(0.7))
    out = O.heuristic_excluded(rows, company)
    return out.where("third_party_confidence = if(excluded, 0.0, 0.7)").select("scan_id", "org_key", "kind", "excluded")


@query("f49_append_log", "select id, case when id % 2 = 0 then '[SYSTEM] changed' else 'first | [SYSTEM] changed' end as log from v_controls")
def f49(spark, d):
    old = F.when(F.col("id") % 2 == 1, "first")
    return view(spark, d, "v_controls").select("id", T.append_log(old, F.lit("changed")).alias("log"))


@query("f48_coalesce_fields", "select id, case when id % 3 = 0 then scan_date end as a, coalesce(case when id % 3 = 0 then scan_date end, scan_date) as found from v_scans")
def f48(spark, d):
    a = F.when(F.col("id") % 3 == 0, F.col("scan_date"))
    return view(spark, d, "v_scans").select("id", a.alias("a"), F.coalesce(a, "scan_date").alias("found"))


@query("w04_merge_continuations")
def w04(spark, d):
    c = view(spark, d, "v_controls")
    rows = c.select("scan_id", F.col("id").alias("pos"), "control_id", F.col("control_desc").alias("body"), (F.col("id") % 7 == 0).alias("continues"), F.col("page_last").cast("long").alias("end_line"), F.col("control_confidence").alias("confidence"))
    return I.merge_continuations(rows)
