"""Quality rules on trusted texts that the counts have not seen."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from sigtab.llm import common, rules
from sigtab.llm.queries import QUERIES
from test_models import spark_hash


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_trusted_texts_are_kept(spark, tmp_path, size):
    sf = f"/root/testdata/{size}"
    labels, docs = common.read(spark, sf, "labels"), common.read(spark, sf, "documents")
    held = labels.where((F.col("quality") == 1) & (common.fold(F.col("doc_id"), 4) == 1))
    labels.join(held, "doc_id", "left_anti").write.parquet(f"{tmp_path}/labels.parquet")
    os.symlink(f"{sf}/documents.parquet", tmp_path / "documents.parquet")
    found = QUERIES["op9_quality_rules"](spark, str(tmp_path)).join(docs.select("doc_id", "lang"), "doc_id").where("not base_failed")
    trusted = found.join(held, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("lost")).toPandas()
    bad = found.join(labels.where("quality = 0"), "doc_id", "left_semi").agg(F.count("*"), F.count_if(~F.col("kept"))).first()
    print(size, trusted.to_dict("records"), "bad, rejected:", tuple(bad))
    assert len(trusted) > 1 and (trusted["lost"] <= 0.05 * trusted["n"]).all()
    assert bad[1] >= 0.3 * bad[0]


def test_judge_by_others_brute_force(spark, odd):
    buckets, prior, rows = 512, 2.0, odd.select("doc_id", "text").collect()
    trusted = spark.createDataFrame([(n,) for n in range(0, 30)] + [(None,), (3,)], "doc_id long")

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [spark_hash(x) % buckets for x in w] + [spark_hash(a, b) % buckets for a, b in zip(w, w[1:])]

    n, g = [0] * buckets, [0] * buckets
    each = [(r["doc_id"], r["doc_id"] is not None and r["doc_id"] < 30, grams(r["text"])) for r in rows]
    for _, good, of in each:
        for b in of:
            n[b] += 1
            g[b] += good
    want = {}
    for key, good, of in each:
        total = 0.0
        for b in of:
            c = of.count(b) if len(of) < 3000 else None
            if c is None:
                break
            expected = (sum(g) - good * len(of)) * (n[b] - c) / max(1, sum(n) - len(of))
            total += math.log((g[b] - good * c + prior) / (expected + prior))
        else:
            want.setdefault((key, (len(of) + 1) // 2), set()).add(round(total / len(of), 8) if of else 0.0)
    got = rules.judge_by_others(odd, trusted, buckets=buckets, prior=prior).collect()
    again = rules.judge_by_others(odd, trusted, buckets=buckets, prior=prior, broadcast_keys=0).collect()  # the ordinary join
    plain = lambda rows: sorted((str(r["doc_id"]), r["n_words"], round(r["mean_ratio"], 8), r["kept"]) for r in rows)
    assert plain(got) == plain(again)
    checked = 0
    for r in got:
        if (r["doc_id"], r["n_words"]) in want:
            assert any(abs(r["mean_ratio"] - x) < 1e-6 for x in want[r["doc_id"], r["n_words"]])
            checked += 1
    assert checked > 60
