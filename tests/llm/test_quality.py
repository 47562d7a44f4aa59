"""Quality rules and classifier: statistics by brute force, rules on planted faults, held-out accuracy."""

import math
import random
import re
import zlib

import pytest

from sparkloom.llm import quality_classifier as K
from sparkloom.llm import quality_rules as R
from sparkloom.llm import queries as Q

TEXTS = [None, "", " \t\n ", "one", "a b", "a b c", "a b c a b c", "x x x x x x", "a b c d a b c e\na b\n\n \na b\na b", "# $5 <b> & *|%", "É Ü\u00a0x\x1cy z", "l1\nl2\nl1\r\nl1", "w " * 3000, "a b c d e f g h " * 400]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcde") + rng.choice(["", "\n", ".\n", "&"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, words string")
    got = R.judge(docs, []).select("doc_id", "__quality_s.*", "__quality_failed", "__quality_kept").collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = want = brute(texts[r["doc_id"]])
        assert (r["count_words"], r["count_word_chars"], r["count_n_symbols"], r["count_n_dup_lines"], r["count_n_repeat_words"]) == want, texts[r["doc_id"]]
        failed = n < 50 or 100 * repeat > 50 * n
        assert r["__quality_failed"] == failed and r["__quality_kept"] == (not failed)


def labelled(spark, n=900):
    """Good prose; bad: shouting, or symbols, or nothing to tell from (noise)."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("of the stone river walks under green light and sings every morning slowly".split()) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(60, 120))]
        bad = k % 5 == 0
        if bad and k % 10:
            words = [w.upper() + "!!" for w in words]
        elif bad:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_are_learned_and_keep_clean_rows(spark):
    docs, labels = labelled(spark)
    rules = R.fit(docs, labels)
    assert 1 <= len(rules) <= 4 and all(r.precision > 0.95 for r in rules)
    kept = {r["doc_id"] for r in R.keep_good(docs, labels).collect()}
    assert kept == {k for k in range(900) if k % 5}


def test_rules_without_labels_or_of_one_kind(spark):
    docs, labels = labelled(spark, 60)
    assert R.fit(docs, labels.limit(0)) == [] and R.fit(docs, labels.where("quality = 1")) == []
    assert R.fit(docs, labels.selectExpr("doc_id", "cast(null as int) quality")) == []
    assert R.keep_good(docs.limit(0), labels).collect() == []


def test_filters_keep_columns_whatever_their_names(spark):
    docs, labels = labelled(spark, 60)
    wide = docs.selectExpr("*", "1 AS quality", "'a' AS label", "2.5 AS score", "3 AS n_words", "4 AS `a.b`")
    for keep in (R.keep_good, K.keep_good):
        assert keep(wide, labels).columns == wide.columns
        assert keep(wide, labels).count() > 0


def test_rules_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = Q.op3_quality_rules(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        n, chars, symbols, dup, repeat = want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    from pyspark.sql import functions as F

    model = K.fit(docs, labels, keep=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", K.score(model, F.col("text")).alias("s")).collect()}
    test = [k for k in got if held(k)]
    assert sum((got[k] >= 0.5) == bool(k % 5) for k in test) / len(test) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_scores_of_odd_texts(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, 200)
    model = K.fit(docs, labels)
    odd = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", K.score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in odd)
    assert len({r["s"] for r in odd if not r["text"]}) == 1


@pytest.mark.parametrize("condition, share", [("false", 0.5), ("quality = 1", 0.9), ("quality = 0", None)])
def test_scores_without_both_labels(spark, condition, share):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, 60)
    model = K.fit(docs, labels.where(condition))
    got = {r["s"] for r in docs.select(K.score(model, F.col("text")).alias("s")).collect()}
    assert len(got) == 1 and (got == {0.5} if share == 0.5 else (min(got) > 0.9 if share else max(got) < 0.1))


def test_classifier_query_on_held_out_labels(spark):
    """Of the held-out labelled documents of sf0.01, good ones score higher than bad ones."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [(r["score"], labels[r["doc_id"]]) for r in Q.op4_quality_classifier(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    good, bad = ([s for s, y in found if y == k] for k in (1, 0))
    assert len(bad) > 5 and sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(s >= 0.3 for s in good) / len(good) > 0.95


def test_null_and_repeated_ids_are_scored(spark, tmp_path):
    docs, labels = labelled(spark, 60)
    docs.union(spark.createDataFrame([(None, "no id"), (1, None), (1, None)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = Q.op4_quality_classifier(spark, str(tmp_path)).collect()
    assert len(found) == 63 and [r["held_out"] for r in found if r["doc_id"] is None] == [False]


def plain_rules(rows, cuts, weight, names):
    """Sequential covering over rows (part, label, statistics), with loops."""
    share = lambda p, n: math.log2(p / (p + n))
    weigh = lambda some, part, label: sum(weight[label] for r in some if r[:2] == (part, label))
    rules, left, barred = [], rows, set()
    while len(rules) < 10:
        grown, chosen = [], left
        while len(grown) < 3:
            p, n = weigh(chosen, "grow", 0), weigh(chosen, "grow", 1)
            if not p or not n:
                break
            best = (1e-9, None, None)
            for k, name in enumerate(names):
                for cut in cuts[name] if grown or name not in barred else ():
                    for above in (False, True):
                        in_ = [r for r in chosen if (r[2][k] > cut) == above]
                        a, b = weigh(in_, "grow", 0), weigh(in_, "grow", 1)
                        if a >= 8 * weight[0] and a * (share(a, b) - share(p, n)) > best[0] + 1e-12:
                            best = (a * (share(a, b) - share(p, n)), R.Condition(name, above, cut), in_)
            if best[1] is None:
                break
            grown.append(best[1:])
            chosen = best[2]
            if not weigh(chosen, "grow", 1):
                break
        if not grown:
            break
        worth = [(weigh(c, "prune", 0) - weigh(c, "prune", 1)) / (weigh(c, "prune", 0) + weigh(c, "prune", 1) + 1e-9) for _, c in grown]
        kept = worth.index(max(worth))
        covers = grown[kept][1]
        precise = [(weigh(covers, a, 0) + 1e-9) / (weigh(covers, a, 0) + weigh(covers, a, 1) + 2e-9) for a in ("grow", "prune")]
        if min(precise) < 0.9 or not weigh(covers, "prune", 0):
            barred.add(grown[0][0].statistic)
            continue
        rules.append(tuple(c for c, _ in grown[: kept + 1]))
        barred.clear()
        left = [r for r in left if r not in covers]
    return rules


def test_learner_against_a_plain_one(spark):
    rng = random.Random(12)
    names, weight = ["a", "b", "c"], {0: 1.0, 1: 2.0}
    rows = []
    for k in range(400):
        bad = rng.random() < 0.4
        a = rng.choice([5, 6, 7]) if bad and k % 3 else rng.choice([0, 1, 2, 5])
        rows.append((k, 0 if bad else 1, float(a), float(rng.choice([8, 9]) if bad and k % 3 == 0 else rng.randrange(9)), float(rng.randrange(4))))
    df = spark.createDataFrame(rows, "doc_id long, label int, a double, b double, c double")
    part = {r["doc_id"]: "prune" if r["p"] == 0 else "grow" for r in df.selectExpr("doc_id", "pmod(xxhash64(cast(doc_id as string), 'part'), 3) AS p").collect()}
    found = R.learn_rules(df, weight, names)
    values = {n: sorted({r[2 + k] for r in rows}) for k, n in enumerate(names)}
    cuts = {n: [(x + y) / 2 for x, y in zip(v, v[1:])] for n, v in values.items()}  # so few values that each is a quantile
    want = plain_rules([(part[r[0]], r[1], r[2:], r[0]) for r in rows], cuts, weight, names)
    assert [r.conditions for r in found] == want and len(want) >= 2


def test_classifier_query_learns_from_training_rows_only(spark, sf_dir):
    found = Q.op4_quality_classifier(spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
