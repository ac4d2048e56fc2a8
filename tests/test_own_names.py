"""Names and descriptions that hold or resemble a company of their report, against all pairs."""

import random

from pyspark.sql import functions as F

from reportlake.functions import similarity
from reportlake.functions import text as T
from reportlake.functions.similarity import ratio
from reportlake.operators import orgs as O  # noqa: N812


def test_own_named_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(O, "PACK", 7)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    own = [(k % 3, word(rng.randrange(1, 14))) for k in range(40)] + [(0, ""), (1, None), (None, "abc")]
    texts = [(k % 4, word(rng.randrange(0, 30))) for k in range(200)] + [(s, c[:-1] + "x") for s, c in own[:40]] + [(0, None), (None, "abc"), (1, own[3][1])]
    df, comp = spark.createDataFrame(texts, "scan_id long, text string"), spark.createDataFrame(own, "scan_id long, company string")
    for alike in (None, 0.85):
        want = {(s, t) for s, t in texts for r, c in own if s is not None and s == r and t and c and (c in t or (alike and ratio(c, t) > alike))}
        got = [tuple(r) for r in O.own_named(df, comp, alike).collect()]
        assert sorted(got) == sorted(want)


def test_no_join_of_all_names_with_all_companies(spark):
    """The plan joins on whole texts only: no condition on parts of names is left to pairs of a report."""
    rows = spark.createDataFrame([(1, k, f"Firm{k}, Inc.", "") for k in range(20)], "scan_id long, org_key long, third_party_name string, third_party_description string")
    comp = spark.createDataFrame([(1, f"firm{k}") for k in range(2, 9)], "scan_id long, company string")
    left = O.drop_self_references(rows, comp)
    plan = left._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" not in plan
    assert sorted(r["org_key"] for r in left.collect()) == [0, 1, *range(9, 20)]


def test_few_names_are_compared(monkeypatch):
    """Of 3,000 names that differ in a few digits, or in all letters, only few are held against a text in full."""
    rng, asked = random.Random(6), []
    numbered = [f"supplier#{k * 25:09d}" for k in range(3000)]
    mixed = ["".join(rng.choices("0123456789abcdef", k=16)) for _ in range(3000)]
    texts = [f"supplier#{k * 25 + 1:09d} inc" for k in range(100)] + [x[:15] + "z" for x in mixed[:100]] + [x[::-1] for x in mixed[:100]] + ["", "x" * 30]
    right = numbered + mixed
    want = [any(ratio(x, y) > 0.85 for y in right) for x in texts[::10]]
    for name in ("common_subsequence", "common_subsequences"):
        real = getattr(similarity, name)
        monkeypatch.setattr(similarity, name, lambda a, b, *w, real=real: asked.extend([1] * (1 if isinstance(b, str) else len(b))) or real(a, b, *w))
    got = similarity.any_alike(texts, right, 0.85)
    assert got[::10] == want and sum(got) == 100 and len(asked) < 20 * len(texts)


def test_any_alike_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(120):
        letters, over = rng.choice(["ab", "abcd ", "0123456789abcdef", "aé İß\U0001d54f"]), rng.choice([0.0, 0.3, 0.5, 0.72, 0.85, 0.9, 1.0])
        word = lambda n: "".join(rng.choices(letters, k=rng.randrange(n)))  # noqa: E731, B023
        right = [word(24) for _ in range(rng.choice([0, 1, 40]))] + [word(200)]
        left = [word(30) for _ in range(20)] + [f" {y[:-1]}{word(3)}".upper() for y in right] + [None]
        assert similarity.any_alike(left, right, over) == [any(ratio(x, y) > over for y in right) for x in left]


def test_a_text_is_worked_out_once_for_all_phrases(spark):
    """The text stands once in the test for generic words, however many words there are, so that it is worked out once."""
    rows = spark.createDataFrame([("A Framework",), ("acme",), (None,)], "s string")
    own = F.concat(F.lit("The "), "s")
    assert [r[0] for r in rows.select(T.any_of(own, O.GENERIC_WORDS)).collect()] == [True, False, None]
    tree = rows.select(T.any_of(own, ["x", "y"]))._jdf.queryExecution().optimizedPlan().toString()
    inner = tree[tree.index("contains(") :]
    assert "concat(" not in inner.split(")")[0] and "lower(" not in inner.split(")")[0]
