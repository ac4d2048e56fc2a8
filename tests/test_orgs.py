"""Self-organizations and common lists against plain Python."""

import random
import re
from difflib import SequenceMatcher

from reportlake.operators import jobs as J
from reportlake.operators import orgs as O
from reportlake.plans import catalog
from reportlake.plans.views import view

SF = "/root/testdata/sf0.001"
FORMS = r"\b(inc|llc|ltd|corp|corporation|incorporated|plc|gmbh|sarl|sa|bv|lp|llp|co)\b"


def is_self(name, desc, companies):
    n, d = (re.sub("[.,]", "", (x or "").lower()) for x in (name, desc))
    alike = lambda c, x: bool(x.strip()) and SequenceMatcher(None, c, x.strip()).ratio() > 0.85
    own = {re.sub(FORMS, "", re.sub("[.,]", "", (c or "").lower())).strip() for c in companies} - {""}
    return any(c in n or c in d or alike(c, n) or alike(c, d) for c in own)


def test_self_orgs_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["Acme", "Acne", "Data", "Services", "Hosting", "Inc.", "Co", "LLC", "Group"]
    text = lambda n: " ".join(rng.choices(parts, k=rng.randrange(n)))
    companies = [(k % 7, c) for k, c in enumerate(["Acme, Inc.", "Acme Data Services LLC", "Hosting Group", "Co", None, "", "Data Services Hosting, Co.", "Group Acme"])]
    rows = [(rng.randrange(8), text(5) or None, text(6) or None, rng.choice(["Yes", "Maybe", None])) for _ in range(150)]
    df = spark.createDataFrame(rows, "scan_id long, third_party_name string, third_party_description string, likely_so string")
    got = O.mark_self_orgs(df, spark.createDataFrame(companies, "scan_id long, company string")).select(*df.columns).collect()
    want = [(s, n, d, "No" if is_self(n, d, [c for k, c in companies if k == s]) else y) for s, n, d, y in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(w[3] == "No" for w in want) > 5


def test_self_orgs_of_the_given_tables(spark):
    names = {}
    for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey", "s_name").collect():
        names.setdefault(r["s_suppkey"] % 25, []).append(f"{r['s_name']}, LLC.")
    rows = view(spark, SF, "v_orgs").select("scan_id", "third_party_name", "third_party_description").distinct().collect()
    want = sorted((s, n, d, "No" if is_self(n, d, names.get(s, [])) else "~") for s, n, d in rows)
    got = sorted((r[0], r[1], r[2], r[3] or "~") for r in catalog.QUERIES["j27_similar_self_orgs"](spark, SF).collect())
    assert got == want and any(g[3] == "No" for g in got)


def test_base_estimates(spark):
    rows = [("SOC1", k, float(v)) for k, v in enumerate([100, 110, 120, 0, 130])] + [("SOC2", k, 50.0) for k in range(4)] + [("COMBINED", k, float(v)) for k, v in enumerate([10, 20, 30, 40, 50, 60])]
    rows += [("SOC1x", k, float(v)) for k, v in enumerate([5] * 4 + [900])] + [("SOC9", 1, None)]
    got = {r[0]: tuple(r)[1:] for r in J.estimate_or_base(spark.createDataFrame(rows, "report_type string, id long, elapsed_seconds double")).collect()}
    assert got == {"SOC1": (1200.0, 4, True), "SOC2": (2100.0, 4, True), "COMBINED": (14.3, 6, False), "SOC1x": (got["SOC1x"][0], 5, False), "SOC9": (2100.0, 1, True)}
