import random
import re
import time

from pyspark.sql import functions as F

from loomspan.functions import guards as G
from loomspan.functions import text as T


def windowed(text):
    hits = [(m.start(), m.group()) for m in re.finditer(T.MONEY, text)]
    return any(len({f for p, f in hits if 0 <= pos - p <= G.CLUSTER_WINDOW}) >= G.CLUSTER_SIZE for pos, _ in hits)


def test_clusters_are_those_of_every_window(spark):
    rng = random.Random(3)
    texts = ["", "$1", "$1$2$3$4", "$1 $1 $1 $1", "é$1ü$2x$3" + "y" * 1490 + "$4", "$1$2$3" + "y" * 1495 + "$4"]
    texts += ["".join(f"${rng.randrange(1, 9)}" + "x" * rng.choice([1, 200, 450, 500, 760, 1490]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: (r.c, [(x.pos, x.fig) for x in r.p] if r.p is not None else None) for r in rows.select("i", G.has_price_cluster(F.col("t")).alias("c"), T.figure_positions(F.col("t")).alias("p")).collect()}
    assert got[-1][0] is False
    for i, t in enumerate(texts):
        assert got[i] == (windowed(t), [(m.start(), m.group()) for m in re.finditer(T.MONEY, t)]), t


def test_long_price_lists_take_no_time(spark):
    page = lambda n, k: " ".join(f"item {i} ${i % k}.00 " + "w" * 700 for i in range(n))
    run = lambda text: spark.createDataFrame([(text,)], "t string").select(G.quality(F.col("t"), F.col("t"), F.lit("x"), F.lit("Pricing")).alias("q"), G.has_price_cluster(F.col("t")).alias("c")).collect()
    run(page(50, 3))
    began = time.time()
    assert not run(page(5000, 3))[0].c
    assert time.time() - began < 3  # of which a small page takes most
    assert run(page(5000, 5000))[0].q.warnings
