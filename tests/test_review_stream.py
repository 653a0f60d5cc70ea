"""A review as a stream, cut into batches at random places, against the fold of all its events."""

import random

import pytest
from pyspark.sql import functions as F

from lacre.operators import review
from lacre.streaming import review_stream


def events(rng, n):
    box = lambda: tuple(float(rng.randint(0, 9)) for _ in range(4))
    out = []
    for doc in (1, 2, 3):
        rows = [("e%d" % i, "CPF", i, [box(), box()], 0.5, None, False) for i in range(3)]
        seqs = iter(range(1, 10_000))
        out.append((doc, next(seqs), "carregar", None, None, None, None, rows))
        for _ in range(n):
            action = rng.choice(["alternarRejeicao", "marcarVista", "ajustarBBox", "adicionarManual", "removerManual", "selecionar", "definirModo", *(["carregar"] if rng.random() < 0.1 else [])])
            if action == "carregar":
                out.append((doc, next(seqs), action, None, None, None, None, rows[: rng.randint(0, 3)]))
            else:
                out.append((doc, next(seqs), action, rng.choice(["e0", "e1", "e2", "m0", "m1", "zz"]), 7, rng.randint(0, 2), box(), None))
    return sorted(out, key=lambda e: e[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_of_reviews_is_the_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    every, schema = events(rng, 25), f"doc_id bigint, {review_stream.EVENT}"
    source, seen = str(tmp_path / "in"), {}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    cuts = sorted({0, len(every), *(rng.randrange(len(every)) for _ in range(3))})
    again = []
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # Each batch begins with rows of the one before, as a source that starts anew would send them.
        spark.createDataFrame([*again, *every[a:b]], schema).coalesce(1).write.mode("append").parquet(source)
        again = every[max(a, b - 4) : b]

        def collect(df, n):
            for r in df.collect():
                seen[r["doc_id"], r["entidade_id"]] = None if r["removido"] else r.asDict(True)

        out = review_stream.follow_reviews(stream).writeStream.foreachBatch(collect).outputMode("update")
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame(every, schema)
    last = table.where("acao = 'carregar'").groupBy("doc_id").agg(F.max_by("retangulos", "seq").alias("r"))
    loaded = last.select("doc_id", F.inline("r"))
    want = {(r["doc_id"], r["entidade_id"]): r.asDict(True) for r in review.review_states(loaded, table.drop("retangulos")).collect()}
    assert want and {k: {f: v for f, v in s.items() if f != "removido"} for k, s in seen.items() if s} == want
