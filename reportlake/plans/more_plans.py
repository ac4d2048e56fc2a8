"""Queries over streams' batch forms, fuzzy matching, sources and further functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.functions.similarity import indel_ratio, seq_ratio
from reportlake.operators import controls as C
from reportlake.operators import matching as X
from reportlake.sources import files as S
from reportlake.streaming import jobs as R

from .catalog import query
from .control_plans import LEARNED
from .views import view


def stamped(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("r05_usage_windows", "with s as (select model, prompt_tokens, unnest(range(0, 4)) as k, ts from v_usage) select model, time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' as start, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens from s group by 1, 2")
def r05(spark, d):
    return R.usage_stream(stamped(view(spark, d, "v_usage"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r03_idle_watchdog", """with l as (select *, case when ts - lag(ts) over (partition by job_id order by ts) <= interval '30 minutes' then 0 else 1 end as brk from v_jobs), s as (select *, sum(brk) over (partition by job_id order by ts rows between unbounded preceding and current row) as sess from l)
select job_id, min(ts) as started, count(*) as n, max(progress) >= 90 as close from s group by job_id, sess""")  # fmt: skip
def r03(spark, d):
    return R.idle_watchdog(stamped(view(spark, d, "v_jobs"))).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("r07_stale_scans", "select scan_id, max(updated_at) > timestamp '1998-06-01' as stale from v_controls group by 1")
def r07(spark, d):
    c = view(spark, d, "v_controls")
    return R.stale_scans(c, c.select("scan_id").distinct().withColumn("summary_at", F.lit("1998-06-01").cast("timestamp")))


@query("x01_seq_ratio")
def x01(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", seq_ratio("p_name", "p_type").alias("ratio"))


@query("x06_indel_ratio")
def x06(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", indel_ratio("p_name", "p_type").alias("ratio"))


@query("x02_score_batch", "select id, case when lower(trim(control_desc)) = lower(trim(coalesce(control_test, ''))) then 1.0E0 else 0.6E0 end as score from v_controls")
def x02(spark, d):
    return X.score_batch(view(spark, d, "v_controls").select("id", F.col("control_desc").alias("a"), F.col("control_test").alias("b")))


@query("x03_consolidate_cuecs", "select id, scan_id, min(id) over w as group_id, count(*) over w as n from v_cuecs window w as (partition by scan_id, trim(regexp_replace(lower(trim(cuec_description)), '[^a-z0-9]+', ' ', 'g')))")
def x03(spark, d):
    return X.consolidate_cuecs(view(spark, d, "v_cuecs"))


@query("x03_near_cuecs", """with b as (select id, scan_id, trim(regexp_replace(lower(trim(cuec_description)), '[^a-z0-9]+', ' ', 'g')) as core from v_cuecs)
select id, scan_id, min(id) over (partition by scan_id, core) as group_id, count(*) over (partition by scan_id, core) as n from b""")  # fmt: skip
def x03b(spark, d):
    c = view(spark, d, "v_cuecs")
    body = F.regexp_replace("cuec_description", r"\.?$", "")
    # a letter more makes wordings of one report near copies; different duties or systems stay apart
    return X.consolidate_cuecs(c.withColumn("cuec_description", F.concat(body, F.when(F.col("id") % 5 == 0, "s").otherwise(""))), least=0.985)


@query("j07_fuzzy_upsert")
def j07(spark, d):
    c = view(spark, d, "v_controls")
    old = c.where("id % 2 = 0").select("id", "scan_id", F.col("control_desc").alias("text"), F.col("control_confidence").alias("confidence"))
    new = c.where("id % 2 <> 0").select("scan_id", F.col("control_desc").alias("text"), F.col("control_confidence").alias("confidence"))
    return X.fuzzy_upsert(new, old)


@query("j13_rescue_bad_chunks")
def j13(spark, d):
    lines = view(spark, d, "v_lines").select("doc_id", F.col("line").alias("text"))
    return X.rescue_bad_chunks(lines.where("xxhash64(text) % 20 = 0"), lines.where("xxhash64(text) % 20 <> 0"))


def failed_cuecs(spark, d):
    """Failed wordings of each report, of all kinds of luck: as a good one, a letter off, over two lines of the source, known to
    the source alone, or nowhere."""
    c = view(spark, d, "v_cuecs").select("scan_id", "id", "cuec_description")
    own = F.concat("cuec_description", F.lit(" and user entities should review the access of user "), F.col("id").cast("string"), F.lit("."))
    k = F.col("id") % 6
    lines = c.select(F.col("scan_id").alias("doc_id"), F.row_number().over(Window.partitionBy("scan_id").orderBy("id")).cast("long").alias("line_no"), own.alias("line"))
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    good = c.where(k == 0).select(F.col("scan_id").alias("doc_id"), F.col("cuec_description").alias("text"))
    bad = c.select(F.col("scan_id").alias("doc_id"), F.when(k == 0, F.concat(F.lit(" "), "cuec_description")).when(k == 1, F.concat(F.substring("cuec_description", 3, 999), F.lit("?"))).when(k == 2, own).when(k == 3, F.upper(own)).otherwise(F.md5("cuec_description")).alias("text"))
    two = lines.withColumn("text", F.concat_ws(" ", "line", after)).where("line_no % 11 = 0").select("doc_id", "text")
    return bad.unionByName(two), good, lines


@query("j13_rescue_report")
def j13b(spark, d):
    return X.rescue_report(*failed_cuecs(spark, d)).withColumn("score", F.round("score", 9))


@query("j13_recovered_rows")
def j13c(spark, d):
    bad, good, lines = failed_cuecs(spark, d)
    return X.recovered_rows(X.rescue_report(bad, good, lines), good).withColumn("justification", F.array_join("justification", "|"))


@query("f27_match_heading")
def f27(spark, d):
    """Headings made of every line: as it is, with the line after it, or with a letter lost."""
    lines = view(spark, d, "v_lines")
    own = view(spark, d, "v_docs").select("doc_id", F.split("text", "\n").alias("ls"))
    # the line after comes from the text itself, so no line is shuffled for it
    pairs = F.arrays_zip("ls", F.concat(F.slice("ls", F.lit(2), F.size("ls")), F.array(F.lit(""))).alias("after"))
    toc = own.select("doc_id", F.posexplode(pairs).alias("p", "l")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.col("l.ls").alias("line"), "l.after")
    k = F.col("line_no") % 3
    heading = F.when(k == 0, F.concat(F.lit("1. "), "line")).when(k == 1, F.concat_ws(" ", "line", "after")).otherwise(F.concat(F.substring("line", 1, 3), F.substring("line", 5, 1 << 30)))
    return X.match_heading(toc.select("doc_id", heading.alias("heading")), lines)


@query("j18_pattern_pairs", f"with l as ({LEARNED}) select organization, pattern, pattern || 'X' as other, 0.85E0 as similarity, 2 * frequency as frequency, 'auto_merge' as action from l")
def j18(spark, d):
    p = C.learn_patterns(view(spark, d, "v_controls"))
    # the last part longer, another separator, another prefix
    changed = [F.concat("pattern", F.lit("X")), F.translate("pattern", "-", "."), F.concat(F.lit("00"), F.substring("pattern", 4, 20))]
    every = p
    for c in changed:
        every = every.unionByName(p.withColumn("pattern", c))
    return X.pattern_pairs(every).withColumn("similarity", F.round("similarity", 6))


@query("f02_pattern_similarity", f"""with l as (select organization, pattern from ({LEARNED})) select organization, pattern, unnest(['same', 'longer', 'dots', 'short', 'prefix']) as kind, unnest([1.0E0, 0.85E0, 0.0E0, 0.0E0, 0.3E0]) as similarity from l""")
def f02(spark, d):
    p = C.learn_patterns(view(spark, d, "v_controls")).select("organization", "pattern")
    other = {"same": F.col("pattern"), "longer": F.concat("pattern", F.lit("X")), "dots": F.translate("pattern", "-", "."), "short": F.substring_index("pattern", "-", 2), "prefix": F.concat(F.lit("00"), F.substring("pattern", 4, 20))}
    rows = p.select("organization", "pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("other")) for k, v in other.items()])).alias("o"))
    rows = rows.select("organization", "pattern", "o.kind", "o.other")
    return rows.select("organization", "pattern", "kind", F.round(X.pattern_similarity(F.col("pattern"), F.col("other")), 6).alias("similarity"))


@query("f11_similarity", """select p_partkey, unnest(['equal', 'blank', 'head']) as kind, unnest([1.0E0, 0.0E0, round(2.0E0 * length(trim(p_name)) / (length(trim(p_name)) * 2 + 4), 6)]) as similarity from part""")
def f11(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    other = {"equal": F.concat(F.lit("  "), F.upper("p_name")), "blank": F.lit("  "), "head": F.concat("p_name", F.lit("####"))}
    rows = p.select("p_partkey", "p_name", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("other")) for k, v in other.items()])).alias("o"))
    return rows.select("p_partkey", "p_name", "o.kind", "o.other").select("p_partkey", "kind", F.round(seq_ratio("p_name", "other"), 6).alias("similarity"))


@query("f28_parse_model_json", "select id, case when id % 5 = 4 then null else id end as answer from v_controls")
def f28(spark, d):
    k = F.col("id").cast("string")
    plain = F.concat(F.lit('{"answer": '), k, F.lit("}"))
    raw = F.when(F.col("id") % 5 == 0, plain).when(F.col("id") % 5 == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```"))).when(F.col("id") % 5 == 2, F.concat(F.lit("Sure. "), plain, F.lit(" done"))).when(F.col("id") % 5 == 3, F.concat(F.lit('{"answer": '), k, F.lit(",}"))).otherwise(F.lit('{"answer": '))
    return view(spark, d, "v_controls").select("id", X.parse_model_json(raw, "answer long")["answer"].alias("answer"))


@query("f58_parse_json_array", "select id, id::varchar || '|b' as items from v_controls")
def f58(spark, d):
    k = F.col("id").cast("string")
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit('["'), k, F.lit('", "b"]'))).otherwise(F.concat(k, F.lit(",\n b")))
    return view(spark, d, "v_controls").select("id", F.array_join(T.parse_json_array(raw), "|").alias("items"))


@query("f15_parse_date_any", """select o_orderkey, case when k = 3 and day(t) <= 12 then make_timestamp(year(t), day(t), month(t), 12, 0, 0.0) when k = 8 then t + interval 5 hours when k = 9 then t + interval 90 second when k = 11 then null else t + interval 12 hours end as parsed
from (select o_orderkey, o_orderkey % 12 as k, date_trunc('day', o_orderdate) as t from orders)""")  # fmt: skip
def f15(spark, d):
    """Each of the eight formats, three ISO ones, and what is no date at all."""
    k, t = F.col("o_orderkey") % 12, F.date_trunc("day", "o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "dd MMM yyyy", "yyyy-MM-dd'T05:00:00'", "yyyy-MM-dd' 00:01:30Z'", "yyyy-MM-dd'T00:00:00'", "dd.MM.yyyy"]
    raw = F.coalesce(*[F.when(k == i, F.date_format(t, f)) for i, f in enumerate(forms)])
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.parse_date_any(raw).cast("timestamp_ntz").alias("parsed"))


@query("s06_combined_result", "select scan_id, count(*) as controls from v_controls group by 1")
def s06(spark, d):
    c = view(spark, d, "v_controls").select("scan_id", "id", "control_id")
    u, o = view(spark, d, "v_cuecs").select("scan_id", "id"), view(spark, d, "v_orgs").select("scan_id", "org_key")
    return S.combined(c, u, o).where("controls is not null").select("scan_id", F.size("controls").cast("long").alias("controls"))


@query("s07_split_valid", "select count(*) filter (control_test is not null) as good, count(*) filter (control_test is null) as bad from v_controls")
def s07(spark, d):
    good, bad = S.split_valid(view(spark, d, "v_controls"), ["control_test"], ["control_confidence"])
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))  # one row each


@query("s08_export_objectives", "select id, control_id from v_controls where control_confidence >= 0.7")
def s08(spark, d):
    return S.export_tables(view(spark, d, "v_controls"), view(spark, d, "v_cuecs"))["objectives"].select("id", "control_id")


@query("s08_export_orgs", """with o as (select scan_id, coalesce(third_party_confidence, 0) < 0.7 as low, org_key, third_party_name as name, third_party_description as description, round(nullif(coalesce(third_party_confidence, 0), 0), 2) as confidence from v_orgs),
p as (select *, row_number() over (partition by scan_id order by low, org_key, name, description, confidence nulls first) as no, count(*) filter (not low) over (partition by scan_id) as high from o)
select scan_id, 8 + no + case when low then 2 else 0 end as row, name, description, confidence from p
union all select scan_id, 10 + max(high), '--- Low Confidence Orgs ---', '', null from p where low group by 1""")  # fmt: skip
def s08b(spark, d):
    return S.export_tables(view(spark, d, "v_controls"), view(spark, d, "v_cuecs"), view(spark, d, "v_orgs"))["orgs"]


@query("s08_export_conclusion", "select distinct scan_id, case scan_id % 4 when 0 then '' when 1 then 'Report ' || scan_id::varchar when 2 then '{broken' else '{\"other\":' || scan_id::varchar || '}' end as conclusion from v_controls")
def s08c(spark, d):
    scans, k, n = view(spark, d, "v_controls").select("scan_id").distinct(), F.col("scan_id") % 4, F.col("scan_id").cast("string")
    text = F.when(k == 1, F.to_json(F.struct(F.concat(F.lit("Report "), n).alias("summary")))).when(k == 2, F.lit("{broken")).when(k == 3, F.concat(F.lit('{"other":'), n, F.lit("}")))
    return S.export_conclusion(scans.select("scan_id", text.alias("executive_summary")))


@query("s10_deep_merge", "select id, case when id % 3 = 0 then 'new' else control_id end as control_id from v_controls")
def s10(spark, d):
    c = view(spark, d, "v_controls").select("id", "control_id")
    return S.deep_merge(c, c.where("id % 3 = 0").withColumn("control_id", F.lit("new")), "id", [])
