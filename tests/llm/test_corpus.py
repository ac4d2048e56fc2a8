"""Deduplication, joins, neighbours, surrogates, mixing, BPE and the pipeline against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import bpe, jaccard_join, mixing, nn_descent, substring_dedup, surrogates
from reportlake.llm.common import most_frequent
from reportlake.llm.components import components
from reportlake.llm.lexicon import Lexicon, compile_words


def words(t):
    return (t or "").encode().split()


def substring_rows():
    """Random texts with shared passages, exact copies, repeated and missing ids, one very common line."""
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(400)]
    shared = [rng.choices(vocab, k=30) for _ in range(4)]
    line = [f"c{i}" for i in range(17)]
    rows = [(i, " ".join(rng.choices(vocab, k=20) + (shared[i % 4][: 10 + i % 21] if i % 3 else []) + rng.choices(vocab, k=9))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices(vocab, k=i % 7) + line[: 11 + i % 7] + rng.choices(vocab, k=5 + i % 5) + line[3:])) for i in range(60)]
    rows += [(300 - i, rows[7][1]) for i in range(5)] + [(300, "short copy"), (301, "short copy"), (4, rows[70][1]), (4, rows[5][1])]
    return rows + [(70, "rep " * 60), (71, "rep " * 14), (None, " ".join(shared[0])), (72, None), (72, "")]


@pytest.mark.parametrize("max_passages", [substring_dedup.MAX_PASSAGES, 2])
def test_substring_dedup_by_brute_force(spark, docs, none, max_passages):
    rows = substring_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(df, max_passages=max_passages).collect())
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(d, first.get(key, d))
    want = []
    for d, t in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        want.append((-1 if d is None else d, len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want)
    assert substring_dedup.substring_dedup(docs).count() == 10 and substring_dedup.substring_dedup(none).count() == 0


def test_suffix_automaton_finds_first_documents():
    rng = random.Random(3)
    seqs = [[b"ab"[i : i + 1] for i in (rng.randrange(2) for _ in range(40))] for _ in range(6)]
    auto = substring_dedup.SuffixAutomaton()
    for d, s in enumerate(seqs):
        auto.add(s, d)
    auto.settle()
    for s in seqs:
        want = [min(d for d, t in enumerate(seqs) for i in range(len(t) - 4) if t[i : i + 5] == s[k : k + 5]) for k in range(len(s) - 4)]
        assert auto.first_docs(s, 5) == want


def test_jaccard_components_by_brute_force(spark, none):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(5000)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(200, "A b"), (201, "a B"), (202, None), (203, " "), (204, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in words(t)]
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    name = {d: d for d in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                inter = len(sets[a] & sets[b])
                if inter and 100 * inter >= 85 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {d: (len(s), name[d]) for d, s in sets.items()}
    assert jaccard_join.jaccard_components(none).count() == 0
    # sets that share the first hash are told apart by the second
    few = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_rows(df, bits=6).collect()}
    assert few == got


def test_jaccard_odd_rows(docs):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.jaccard_components(docs).collect())
    assert len(got) == 10 and (2, 15, 1) in got and (3, 0, 3) in got and (4, 0, 4) in got and got.count((5, got[5][1], 5)) == 2


def test_count_tree_rules_out_nothing_that_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 4000, 120).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[:-5], s[:3] + np.uint64(1)])) for s in sets]
    n = np.array([len(s) for s in sets])
    points = jaccard_join.points_of([jaccard_join.group_counts(s) for s in sets])
    tree = jaccard_join.CountTree(n, points, np.arange(len(sets)))
    found = {frozenset(p) for x, y in jaccard_join.surviving(tree, tree, 85) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 85 * (n[i] + n[j] - inter):
                assert frozenset((i, j)) in found


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 16))
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)] + [(1000 + i, [float(x) for x in v[0]]) for i in range(9)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (0, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nn_descent.nearest(df, F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert 2000 not in got and 2050 not in got
    assert [x[1] for x in sorted(got[0])] == [1000, 1001, 1002, 1003, 1004]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in range(50, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = set(np.argsort(-s)[:5].tolist())
        hit, total = hit + len(want & {x[1] for x in got[q]}), total + 5
    assert hit / total >= 0.9
    few = nn_descent.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert nn_descent.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_the_given_table(spark):
    """Recall at 5 of the query over a whole table, against brute force in double precision."""
    from reportlake.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"] is not None}
    rows = {k: v for k, v in rows.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(rows))
    unit = np.stack([rows[k] / np.linalg.norm(rows[k]) for k in ids])
    got = {}
    for r in queries.op7_nn_descent(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[np.searchsorted(ids, q)]
        s[ids == q] = -9
        order = np.lexsort((ids, -np.round(s, 12)))[:5]
        hit, total = hit + len(set(ids[order].tolist()) & {x[1] for x in got[q]}), total + 5
        assert all(abs(score - s[np.searchsorted(ids, v)]) < 1e-9 for _, v, score in got[q])
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hit / total >= 0.9


def test_neighbours_of_outliers_and_tight_clusters(spark):
    """Every query gets its five, also where cells hold hardly anyone or only each other; copies and an exact tie among them."""
    rng = np.random.default_rng(12)
    cone = rng.standard_normal((1500, 24)) * 0.05 + 1.0
    cone[[50, 100]] = -1.0 + rng.standard_normal((2, 24)) * 0.05  # two on the other side
    tight = [rng.standard_normal(24) for _ in range(3)]
    for c, t in enumerate(tight):
        for i in range(3 + c * 4):
            cone[200 + 50 * c + i] = t + rng.standard_normal(24) * 1e-4
    cone[[400, 401, 402, 403]] = cone[400]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cone)] + [(5000, [1.0, 2.0]), (5050, [2.0, 1.0]), (6000, [1.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(range(0, 1500, 50), 5) | {5000: 1, 5050: 1}
    unit = cone / np.linalg.norm(cone, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(np.lexsort((np.arange(1500), -np.round(s, 12)))[:5].tolist()) & set(got[q]))
    assert hit / 150 >= 0.9 and 100 in got[50] and 50 in got[100] and set(got[400]) >= {401, 402, 403}


def test_neighbours_among_near_copies(spark):
    """Cosines that single precision takes for equal."""
    rng = np.random.default_rng(0)
    v = np.repeat(rng.standard_normal((15, 64)), 60, 0) + rng.standard_normal((900, 64)) * 1e-5
    v = v[rng.permutation(900)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hit / 90 >= 0.95


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    scale = [1e200 if i % 3 == 0 else 1e-200 if i % 3 == 1 else 1.0 for i in range(60)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i] * scale[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nn_descent.nearest(df, F.col("vec_id") % 10 == 0).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = unit @ unit[q]
        s[q] = -9
        best = int(np.argmax(s))
        assert got[(q, 1)][0] == best and abs(got[(q, 1)][1] - s[best]) < 1e-9


def luhn_ok(digits):
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in each) % 10 == 0


def iban_ok(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_surrogates_keep_type_and_identity(spark, docs, none):
    text = "Mr. John Smith, Mrs. Jane Smith, +1 (168) 555-5254 and +1 168 555 5254, 4539578763621486, a.b@mail1.example.com A.B@MAIL1.EXAMPLE.COM, 10.1.2.3, GB29NWBK60161331926819"
    plain = "clean text, version 2.0 of 1999, order 9807915762804490, part AB12CDEFGHIJKLMNO"
    out = surrogates.surrogate_text(spark.createDataFrame([(1, text), (2, plain)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = out[0]["text"]
    assert out[1]["text"] == plain and out[1]["_n_entities"] == 0 and out[0]["_n_entities"] == 9
    assert not any(x in new for x in ("John", "Smith", "555-5254", "4539578763621486", "a.b@mail1")) and new.startswith("Mr. ") and ", Mrs. " in new
    parts = new.split(", ")
    assert parts[0].split()[-1] == parts[1].split()[-1]
    phones = ["".join(c for c in p if c.isdigit()) for p in parts[2].split(" and ")]
    assert phones[0] == phones[1] and len(phones[0]) == 11 and phones[0][0] == "1"
    assert luhn_ok(parts[3]) and parts[3] != "4539578763621486" and parts[3][0] == "4"
    mails = parts[4].split()
    assert mails[0].upper() == mails[1] and mails[0].endswith(".example.com")
    assert parts[5].startswith("10.") and parts[5] != "10.1.2.3" and parts[6][:2] == "GB" and iban_ok(parts[6])
    odd = surrogates.surrogate_text(docs, "k").collect()
    assert len(odd) == 10 and sum(r["text"] is None for r in odd) == 1 and surrogates.surrogate_text(none, "k").count() == 0
    assert surrogates.configured_key(spark) != surrogates.configured_key(spark)


def test_surrogates_follow_a_name_through_a_text(spark):
    token = "".join("0123456789abcdef"[i * i % 16] for i in range(5000))
    rows = [(1, "Mr. John Smith came. Smith spoke, then John Smith left; smith and Smithson stayed."), (2, "Dr. Ana Silva and Mrs. Ana Silva"), (3, f"token={token} end"), (4, "password: correcthorsebattery"), (5, "г-н Иван Петров и Петров"), (6, "漢字@example.com مثال@example.com")]
    out = {r["doc_id"]: r["text"] for r in surrogates.surrogate_text(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    w = out[1].replace(".", "").replace(",", "").replace(";", "").split()
    assert w[2] == w[4] == w[8] and w[1] == w[7] and "Smith " not in out[1] and "smith and Smithson" in out[1]
    doctor, lady = out[2].removeprefix("Dr. ").split(" and Mrs. ")
    assert doctor == lady and doctor.split()[0][-1] in "ae"
    new = out[3].removeprefix("token=").removesuffix(" end")
    assert len(new) == 5000 and set(new) <= set("0123456789abcdef") and new[-44:] != token[-44:]
    assert "horse" not in out[4] and out[5].split()[2] == out[5].split()[4] and all("а" <= c <= "я" for c in out[5].split()[2].lower())
    han, arabic = (m.split("@")[0] for m in out[6].split())
    assert all("一" <= c <= "龥" for c in han) and all("\u0621" <= c <= "\u064a" for c in arabic) and han != "漢字"


def test_surrogates_stay_distinct_whatever_their_number(spark):
    address = spark.range(60_000).select(F.concat(F.lit("192.168."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"))
    letters = [F.substring(F.lit("abcdefghijklmnopqrst"), (F.floor(F.col("id") / 20**k) % 20).cast("int") + 1, F.lit(1)) for k in range(4)]
    family = spark.range(8_000).select(F.concat(F.lit("Mr. John X"), *letters, F.lit(" met Mr. X"), *letters).alias("text"))
    short = spark.range(1000).select(F.concat(F.lit("(555) 555-0"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("text"))
    texts = lambda df: [r["text"] for r in surrogates.surrogate_text(df, "k").select("text").collect()]
    out = texts(address)
    assert len(set(out)) == 60_000 and all(t.startswith("192.168.") for t in out)
    out = texts(family)
    assert len(set(out)) == 8_000 and all(t.split()[2] == t.split()[-1] for t in out)
    assert len(set(texts(short))) == 1000
    assert surrogates.collisions(family.unionByName(short), "k").isEmpty()


def test_mixing_budgets(spark, docs, none):
    rows = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "w " * 10, "small") for i in range(100)] + [(2000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, entropy_share=1.0, max_repeats=2.5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n == {"big": 400, "small": 250, None: 1}
    assert out.select("doc_id").distinct().count() == 501
    again = mixing.mix(df, entropy_share=1.0, max_repeats=2.5)
    assert out.exceptAll(again).isEmpty()
    clash = mixing.mix(df.withColumn("epochs", F.lit(9)).withColumn("cut_key", F.lit("x")).withColumn("rest", F.lit(0)), entropy_share=1.0, max_repeats=2.5)
    assert clash.count() == out.count() and {"epochs", "cut_key", "rest"} <= set(clash.columns)
    last = out.where("source = 'small' and _epoch = 2").select("doc_id").collect()
    key = lambda d: hashlib.md5(f"0|2|{d}".encode()).hexdigest()
    assert sorted(r["doc_id"] for r in last) == sorted(sorted(range(1000, 1100), key=key)[:50])
    assert mixing.mix(docs).count() >= 10 and mixing.mix(none).count() == 0


def test_mixing_entropy_is_met(spark):
    import math

    sources = spark.createDataFrame([(f"s{i}", 10 * 3**i) for i in range(6)], "_src string, tokens long")
    t, _ = mixing.bisected_exponent(sources, 0.9, None)
    w = [(10 * 3**i) ** t for i in range(6)]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert abs(h - 0.9 * math.log(6)) < 1e-4


tokenizers = pytest.importorskip("tokenizers")


def test_bpe_equals_the_library(docs, none):
    path = bpe.default_tokenizer()
    lib = tokenizers.Tokenizer.from_file(path)
    out = bpe.bpe_round_trip(docs).select("text", "ids", "decoded").collect()
    assert len(out) == 10
    for r in out:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe.bpe_round_trip(none).count() == 0


def test_frequent_rows_fit_the_limit(spark):
    counts = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.when(F.col("id") < 10, 1000 + F.col("id")).otherwise(7).alias("n"))
    got = {r["word"] for r in most_frequent(counts, "word", 1000).collect()}
    assert {f"w{i}" for i in range(10)} <= got and 700 < len(got) <= 1000
    assert most_frequent(counts, "word", 5000).count() == 5000 and most_frequent(counts.limit(0), "word", 5).count() == 0


def test_lexicon_holds_exactly_its_words():
    rng = random.Random(4)
    entries = {bytes(rng.choices(b"abcd", k=rng.randrange(1, 9))): rng.randbytes(4 * rng.randrange(1, 4)) for _ in range(800)}
    lex = Lexicon(compile_words(list(entries.items())[:400]))
    for k, (w, ids) in enumerate(entries.items()):
        assert lex.get(w) == (ids if k < 400 else None)
    assert Lexicon(compile_words([])).get(b"a") is None


def test_pipeline_by_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, frame = {}, docs
    for name, stage in pipeline.STAGES:
        frame = pipeline.written(stage(spark, frame, sf), name)
        steps[name] = frame
        if name != "bpe":
            assert frame.columns == pipeline.COLUMNS
    kept = {r["doc_id"]: r["text"] for r in steps["quality_classifier"].collect()}
    single = {r["doc_id"] for r in steps["jaccard_join"].collect()}
    grams = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, t in kept.items() if (w := [x.lower() for x in words(t)])}
    first = {d: d for d in kept}
    changed = True
    while changed:
        changed = False
        for d, e in itertools.combinations(sorted(grams), 2):
            if first[d] != first[e] and 100 * len(grams[d] & grams[e]) >= 80 * len(grams[d] | grams[e]):
                first[d] = first[e] = min(first[d], first[e])
                changed = True
    assert single == set(first.values()) and len(single) < len(kept)
    masked = {r["doc_id"]: r["text"] for r in steps["pii_surrogates"].collect()}
    assert set(masked) == single and {r["doc_id"] for r in steps["mixing"].collect()} == single
    lib = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    for r in steps["bpe"].collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(masked[r["doc_id"]] or "", add_special_tokens=False).ids


def test_stages_take_odd_and_empty_tables(spark, docs, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    want = {"quality_classifier": 10, "jaccard_join": 8, "pii_surrogates": 10}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "bpe" or out.columns == pipeline.COLUMNS
        n = out.count()
        assert n <= want.get(name, 99) and (name not in ("jaccard_join", "pii_surrogates") or n == want[name]) and n > 0
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_near_copies_stage_by_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = [f"w{i}" for i in range(98)]
    edited = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(long)]
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (10, one), (11, one), (11, two), (None, two), (None, one), (None, "alone here"), (None, "alone here"), (12, one), (20, ""), (20, ""), (None, None), (None, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_copies(spark, docs, "").collect()), key=repr)
    want = [(1, " ".join(long)), (10, one), (11, two), (20, ""), (None, "alone here"), (None, None), (None, " ")]
    assert got == sorted(want, key=repr)


def test_jaccard_links_through_rows_without_an_id(spark):
    base = [f"t{i}" for i in range(80)]
    text = lambda k: " ".join(f"z{i}" if i in [0, 1, 2, 77, 78, 79][:k] else w for i, w in enumerate(base))
    # 1 and 2 meet only through the row without an id; two more of those meet each other
    rows = [(2, text(6)), (None, text(3)), (1, text(0)), (1, text(0)), (None, "q " + " ".join(f"r{i}" for i in range(40))), (None, " ".join(f"r{i}" for i in range(40))), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df, percent=90).collect()), key=repr)
    assert got == sorted([(2, 1), (None, 1), (1, 1), (1, 1), (None, None), (None, None), (3, 3)], key=repr)
    assert jaccard_join.jaccard_rows(df, percent=90).where("doc_id is null and component_id is null").select("first_key").distinct().count() == 1
    grams = [frozenset(zip(w, w[1:], w[2:], w[3:])) for _, t in rows if (w := words(t))]
    links = lambda i: sum(100 * len(grams[i] & g) >= 90 * len(grams[i] | g) for j, g in enumerate(grams) if j != i)
    pairs, per_row = jaccard_join.jaccard_links(df, percent=90)
    assert sorted(r["n_links"] for r in per_row.collect()) == sorted([links(i) for i in range(len(grams))] + [0])
    assert sum(r["rows_a"] * r["rows_b"] for r in pairs.collect()) + 1 == sum(map(links, range(len(grams)))) // 2


def test_sketches_rule_out_no_overlap():
    rng = np.random.default_rng(2)
    for n, m, both in [(1, 1, 0), (1, 1, 1), (7, 9, 5), (100, 120, 90), (3000, 2500, 2400), (5000, 5000, 3500)]:
        for _ in range(5):
            own = np.unique(rng.integers(0, 1 << 64, n + m - both, dtype=np.uint64))
            rng.shuffle(own)
            s, t = np.sort(own[:n]), np.sort(own[n - both :])
            bound = jaccard_join.shared_at_most(jaccard_join.sketch(s), jaccard_join.sketch(t), len(s), len(t))
            assert both <= bound == jaccard_join.shared_at_most(jaccard_join.sketch(t), jaccard_join.sketch(s), len(t), len(s))
            if n > 1000:
                assert bound < both + 0.45 * (min(n, m) - both)
