"""Rows of an organization sheet that lies in many parts."""

from reportlake.sources import files as S


def test_rows_are_numbered_over_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 9)
    rows = [(None if k % 3 == 2 else k % 3, k * 7 % 50, f"n{k}", None, [None, 0.9, 0.2, 0.75][k % 4]) for k in range(120)] + [(0, 1, "same", "d", 0.8)] * 20
    df = spark.createDataFrame(rows, "scan_id long, org_key long, third_party_name string, third_party_description string, third_party_confidence double")
    want = []
    for scan in (0, 1, None):
        own = sorted((((c or 0) < 0.7, k, n, d or "", c) for s, k, n, d, c in rows if s == scan), key=lambda x: (*x[:4], x[4] or 0))
        high = sum(not x[0] for x in own)
        want += [(scan, 8 + i + (2 if x[0] else 0), x[2], x[3], x[4]) for i, x in enumerate(own, 1)] + [(scan, 10 + high, S.LOW_MARK, "", None)]
    assert sorted(map(repr, map(tuple, S.export_orgs(df).collect()))) == sorted(map(repr, want))
