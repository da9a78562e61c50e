import zlib

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, learnable=language.fold("doc_id", 3) != 1)
    got = language.predict(docs.select("doc_id", "text", F.lit(1).alias("score"), F.lit("q").alias("key")), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200
    right = np.mean([r.lang_pred == r.lang for r in held])
    assert right > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    sure = [r for r in held if r.score > 0.9]
    assert np.mean([r.lang_pred == r.lang for r in sure]) > 0.93


def test_odd_rows(spark):
    rows = [(1, "der die das und ist nicht " * 5, "de"), (2, "the and of with this that " * 5, "en"), (3, None, "en"), (4, "123 !!", "de"), (5, "", None), (None, "the of and", "en"), (2, "the and of with this that " * 5, "en"), (6, "É", "fr"), (7, "the " * 300000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, learnable=F.col("doc_id") < 6)
    got = {(r.doc_id): (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and got[None][0] == "en" and got[7][0] == "en"
    assert got[3] == got[5] == got[4] == ("und", 0.0)
    assert got[6][0] in ("de", "en")
    none = language.fit(docs, learnable=F.lit(False))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_rows_do_not_depend_on_their_neighbours():
    import pyarrow as pa

    from loomspan.llm.textbuf import utf8

    texts = ["Ünder den Bäumen", "", "a", "ÀÉ été"]
    data, offsets = utf8(pa.array(texts))
    bucket, at = language.features(data, offsets, 1 << 12)
    for i, t in enumerate(texts):
        own, own_at = language.features(*utf8(pa.array([t])), 1 << 12)
        assert sorted(own) == sorted(bucket[at[i] : at[i + 1]])
    low, _ = language.features(*utf8(pa.array(["àé été"])), 1 << 12)
    assert sorted(low) == sorted(bucket[at[3] : at[4]])
