"""Order-dependent folds and period rules on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from reportlake.operators import islands
from reportlake.operators import scoring as K


def test_merge_continuations(spark):
    rows = [(1, 1, "A", "x", True, 3, 0.8), (1, 2, "", "y", False, 5, 0.4), (1, 3, "A", "z", False, 6, 0.2), (1, 4, "B", "q", False, 7, 1.0), (2, 1, None, None, None, 1, 0.5)]
    df = spark.createDataFrame(rows, "scan_id long, pos long, control_id string, body string, continues boolean, end_line long, confidence double")
    got = {(r["scan_id"], r["pos"]): (r["control_id"], r["body"], r["end_line"], round(r["confidence"], 6)) for r in islands.merge_continuations(df).collect()}
    assert got == {(1, 1): ("A", "x y z", 6, 0.4), (1, 4): ("B", "q", 7, 1.0), (2, 1): ("", "", 1, 0.5)}


def test_periods(spark):
    d = datetime.date
    cases = [[d(2024, 5, 1)], [d(2023, 10, 1), d(2024, 9, 30)], [d(2024, 1, 1), d(2024, 1, 20)], [d(2024, 1, 1), d(2024, 4, 1)], [d(2023, 1, 1), d(2023, 12, 31), d(2024, 2, 1)]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ds array<date>")
    got = [(r["p"]["kind"], r["p"]["start"], r["p"]["end"]) for r in df.select("i", K.deduce_period(F.col("ds")).alias("p")).orderBy("i").collect()]
    assert got == [("Type 1", None, d(2024, 5, 1)), ("Type 2", d(2023, 10, 1), d(2024, 9, 30)), ("Type 2", d(2023, 7, 1), d(2024, 1, 1)), ("Type 1", None, d(2024, 4, 1)), ("Type 2", d(2023, 1, 1), d(2023, 12, 31))]
