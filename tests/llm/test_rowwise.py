"""Quality rules, licence scan, chat formatting, classifier: small fixtures with every odd case."""

import hashlib

from pyspark.sql import functions as F

from reportlake.llm import classifier, license_scan, quality_rules, queries, reply_trees


def test_quality_rules(docs, none):
    out = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(docs).collect()}
    assert sum(1 for _ in out) == 9 and quality_rules.quality_rules(docs).count() == 10
    assert out[(3, 0)]["base_failed"] and out[(4, 0)]["word_chars"] == 0
    seven = next(r for (k, _), r in out.items() if k == 7)
    assert seven["n_dup_lines"] == 1 and seven["n_repeat_words"] >= 145 and seven["base_failed"]
    long = out[(8, 20000)]
    assert long["n_repeat_words"] == 0 and long["kept"]
    assert quality_rules.quality_rules(none).count() == 0


def test_repeated_words_by_brute_force(spark):
    texts = ["a b c d e a b c d e f", "a a a a a a a", "a b c d e", "q a b c d e x y a b c d e b c d e x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.rule_counts(df).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert got[k] == len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)})


def test_host_rate_is_shrunk(spark):
    rows = [(i, "x", f"big{i % 3}") for i in range(30)] + [(100, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("base_failed", F.col("doc_id").isin(0, 1, 2, 100))
    verdict = {r["source"]: r for r in quality_rules.host_verdicts(df).collect()}
    assert 0.1 < verdict["tiny"]["host_rate"] < 1.0 and not verdict["big0"]["host_failed"]


def license_by_brute_force(text, t=license_scan.THRESHOLD):
    """{template: (dice, first word)} by comparing all windows."""
    w = license_scan.normal_words(text or "")
    out = {}
    for name, body in license_scan.TEMPLATES.items():
        own, n = set(license_scan.bigrams(body)), len(license_scan.normal_words(body))
        last = max(len(w) - n, 0)
        for s in sorted({*range(0, last + 1, max(1, n // license_scan.STEPS)), last}):
            g = set(zip(w[s : s + n], w[s + 1 : s + n], strict=False))
            g = {f"{a} {b}" for a, b in g}
            dice = 2 * len(g & own) / (len(g) + len(own))
            if g and dice >= t and dice > out.get(name, (0, 0))[0]:
                out[name] = (dice, s + 1)
    return out


def test_license_scan(docs, none, spark):
    out = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert (out[5]["license_id"], out[5]["word_no"], out[5]["dice"]) == ("apache-2.0", 4, 1.0)
    assert out[3]["n_hits"] == 0 and out[3]["license_id"] is None and out[4]["n_hits"] == 0
    assert license_scan.license_scan(docs).count() == 10 and license_scan.license_scan(none).count() == 0
    assert license_scan.license_scan(docs, templates={}).where("n_hits > 0").isEmpty()


def test_license_bodies_inside_long_texts_by_brute_force(spark):
    t = license_scan.TEMPLATES
    prose = [f"word{i * 7 % 501}" for i in range(900)]
    wrapped = lambda text, mark: "\n".join(f"{mark} {text[i : i + 70]}" for i in range(0, len(text), 70))
    edited = " ".join(w for i, w in enumerate(t["mit"].split()) if i % 14)
    texts = [
        " ".join(prose[:400]) + "\n" + wrapped(t["mit"], "//") + "\n" + " ".join(prose[400:]), " ".join(prose[:123] + t["bsd-3-clause"].split() + prose[123:]), edited + " " + " ".join(prose),
        wrapped(t["apache-2.0/header"], "#"), "see: " + t["mit/note"], " ".join(t["mit"].split()[:60]), t["gpl-3.0/header"], "", None, "license", " ".join(prose),
    ]
    rows = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k]["license_id"] for k in range(7)] == ["mit", "bsd-3-clause", "mit", "apache-2.0", "mit", None, "gpl-3.0"]
    for k, text in enumerate(texts):
        want = license_by_brute_force(text)
        best = min(((-d, s, name) for name, (d, s) in want.items()), default=None)
        got = rows[k]
        assert got["n_hits"] == len(want) and (best is None or (got["dice"], got["word_no"], got["template"]) == (round(-best[0], 6), best[1], best[2]))


def test_reply_tree_paths_and_ranks(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good <|end|> &lt;", 1.0), ("t", 3, 1, "assistant", "bad", -1.0), ("t", 4, 2, "user", "more", 0.0), ("t", 5, 4, "assistant", "x", 1.0), ("t", 6, 4, "assistant", "y", 0.5), (None, 1, None, None, None, None)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {(r["tree"], r["leaf"]): r for r in reply_trees.reply_trees(nodes).select("*", reply_trees.turns_of(F.col("formatted")).alias("t"), reply_trees.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    assert set(out) == {("t", 3), ("t", 5), ("t", 6), (None, 1)}
    assert [tuple(x) for x in out[("t", 5)]["t"]] == [("user", "q"), ("assistant", "good <|end|> &lt;"), ("user", "more"), ("assistant", "x")]
    assert out[("t", 5)]["l"] == ["good <|end|> &lt;", "x"]
    assert [out[("t", k)]["path_rank"] for k in (5, 6, 3)] == [1, 2, 3]
    best = reply_trees.reply_trees(nodes.where("tree = 't'"), best=1).collect()
    assert [r["leaf"] for r in best] == [5]


def test_long_chain_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i} </s>") for i in range(70)] + [(1, 3, "assistant", "tie"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["tree"]: r for r in reply_trees.reply_trees(reply_trees.chain_nodes(df)).select("tree", "n_turns", reply_trees.turns_of(F.col("formatted")).alias("t")).collect()}
    assert out[1]["n_turns"] == 71 and [x["text"] for x in out[1]["t"]][3:5] == ["m3 </s>", "tie"]
    assert out[2]["n_turns"] == 1
    assert reply_trees.reply_trees(reply_trees.chain_nodes(df.limit(0))).count() == 0


def test_turn_digests_end_each_turn_with_a_line_feed(spark, tmp_path):
    rows = [(1, 1, "assistant", "b\n"), (1, 0, "user", None), (1, 2, "assistant", ""), (2, 0, "assistant", "<|end|> &lt; \U0001f600")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    fixed = "</s>[INST] ok [/INST]"
    want = {-1: ([("user", fixed), ("assistant", fixed)]), 1: [("user", ""), ("assistant", "b\n"), ("assistant", "")], 2: [("assistant", rows[3][3])]}
    out = {r["conv_id"]: r for r in queries.op3_reply_trees(spark, str(tmp_path)).collect()}
    assert set(out) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        own = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{role}\n{t}\n" for role, t in turns), loss)]
        assert [out[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")] == [len(turns), own[0], len(loss), own[1]]


def test_classifier_held_out_accuracy(spark):
    good = [(i, " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(40 + i % 50)), 1) for i in range(240)]
    bad = [(1000 + i, f"BUY### NOW$$$ {i}!! " * 12, 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = classifier.fit(rows, rows)
    out = classifier.score(rows, model, keep=("doc_id", "quality")).withColumn("p", classifier.predicted()).where(classifier.held_out(F.col("doc_id"))).collect()
    assert out and sum(r["p"] == r["quality"] for r in out) / len(out) >= 0.95


def test_classifier_ranks_the_held_out_rows_of_the_given_tables(spark):
    from reportlake.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    out = queries.op4_quality_classifier(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y, _ in held if y == k] for k in (1, 0))
    assert sum(p == y for _, y, p in held) / len(held) >= 0.95 and sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.98


def test_classifier_odd_cases(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    assert classifier.score(none, model).count() == 0 and hashlib


def test_classifier_cuts_above_the_median_if_most_are_bad(spark):
    good = [(i, " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(40 + i % 50)), 1) for i in range(60)]
    bad = [(1000 + i, f"BUY### NOW$$$ {i}!! " * 12, 0) for i in range(240)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = classifier.fit(rows, rows)
    out = classifier.score(rows, model, keep=("doc_id", "quality")).withColumn("p", classifier.predicted()).collect()
    assert model["quantile"] > 0.5 and sum(r["p"] == r["quality"] for r in out) / len(out) >= 0.95
