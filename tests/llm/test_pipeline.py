"""The pipeline, each stage against what plain Python makes of its input."""

import numpy as np

import corpus_pipeline
from sigtab.llm import common, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    labels = common.read(spark, SF, "labels").toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        given = docs.toPandas()
        docs = common.stored(stage(spark, docs, SF), "test")
        got = docs.toPandas()
        if name == "best-fit packing":
            assert set(got["doc_id"]) == set(given["doc_id"]) and got.groupby("sequence_id")["length"].sum().max() <= 2048
            continue
        assert list(got.columns) == list(given.columns) and got["doc_id"].is_unique
        assert got.merge(given, on=list(given.columns)).shape[0] == len(got)
        gone = labels[labels.index.isin(set(given["doc_id"]) - set(got["doc_id"]))]
        if name == "quality classifier":
            assert (gone["quality"] == 0).mean() > 0.7
        elif name == "language ID":
            assert len(got) > 0.97 * len(given)
        elif name == "SimHash near-dedup":
            fp = np.array([simhash.simhash((t or "").encode()) for t in given["text"]], np.uint64)
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
            kept = set()
            left = set(range(len(fp)))
            while left:
                group, todo = set(), {min(left)}
                while todo:
                    group |= todo
                    todo = {j for i in todo for j in np.flatnonzero(near[i]).tolist()} - group
                left -= group
                kept.add(min(given["doc_id"][i] for i in group))
            assert set(got["doc_id"]) == kept
    assert docs.count()


def test_odd_documents(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(n, int(n % 2), int(n % 5 == 0)) for n in range(50)] + [(None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            got = common.stored(stage(spark, table, str(tmp_path)), "test")
            assert got.count() <= max(1, table.count()) or name == "best-fit packing"
            if name != "best-fit packing":
                assert got.columns == table.columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
