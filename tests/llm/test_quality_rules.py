import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondage.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def base(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    texts = [None, "", " \t\n", "a b c", "a b c a b c", "x " * 3000, "a b a b a b a", "l\n\nl\n l\nl", "#*$%&|<> é漢😀", "w1 w2 w3 " + " ".join(f"v{i}" for i in range(20_000)) + " w1 w2 w3", "a\x0bb\x0cc\rd\x1ce\xa0f"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = docs.withColumn("n_words", F.lit("clash"))
    rows = qr.with_stats(docs).collect()
    assert len(rows) == 1000 + len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)


def plain_em(patterns, rounds=qr.MAX_ROUNDS):
    """Counts of vote tuples to (prior, table), by loops."""
    m, total = len(next(iter(patterns))), sum(patterns.values())
    prior, table = qr.START_PRIOR, [(qr.START_BAD, qr.START_GOOD)] * m

    def chance(votes, side):
        out = prior if side else 1 - prior
        for v, t in zip(votes, table):
            out *= t[side][v] if v >= 0 else 1 - sum(t[side])
        return out

    for _ in range(rounds):
        good = {p: n * chance(p, 1) / (chance(p, 0) + chance(p, 1)) for p, n in patterns.items()}
        w = qr.ANCHOR * total
        mass = (total - sum(good.values()), sum(good.values()))
        new = []
        for i in range(m):
            sides = []
            for side, start in ((0, qr.START_BAD), (1, qr.START_GOOD)):
                seen = [sum(good[p] if side else n - good[p] for p, n in patterns.items() if p[i] == v) for v in (0, 1)]
                sides.append(tuple((s + w * start[v]) / (mass[side] + w) for v, s in enumerate(seen)))
            new.append(tuple(sides))
        new_prior = (mass[1] + w * qr.START_PRIOR) / (total + w)
        moved = max([abs(new_prior - prior), *(abs(a - b) for x, y in zip(new, table) for s, t in zip(x, y) for a, b in zip(s, t))])
        prior, table = new_prior, new
        if moved < qr.TOLERANCE:
            break
    return prior, table


def test_em_and_verdict_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = qr.judge_documents(docs, keep=["doc_id"]).collect()
    names = [f"vote_{r.name}" for r in qr.RULES]
    patterns = Counter(tuple(r[n] for n in names) for r in rows)
    prior, table = plain_em(patterns)
    for r in rows:
        odds = math.log(prior / (1 - prior))
        for v, t in zip((r[n] for n in names), table):
            odds += math.log((t[1][v] if v >= 0 else 1 - sum(t[1])) / (t[0][v] if v >= 0 else 1 - sum(t[0])))
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert (r.base_failed, r.kept) == (failed, r.n_words > 0 and r.posterior >= 0.5)


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = qr.judge_documents(docs, keep=["doc_id"]).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, True), (1, "", True), (1, "", True)], "doc_id long, text string, kept boolean")
    rows = qr.judge_documents(docs).collect()
    assert len(rows) == 3 and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    assert qr.judge_documents(docs.limit(0)).count() == 0
