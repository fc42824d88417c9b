"""Operators on inputs that limits by size, share or length used to cut."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import ann, chat, components, mixing, quality, queries, secretscan
from rasterloom.llm.common import materialize, small_table


def _letters(n):
    return "".join(chr(97 + int(d)) for d in str(n))  # digits are evened out in lines


def test_quality_lines_of_a_large_host_go_and_copies_stay(spark):
    own = lambda i: " ".join(f"u{_letters(i)}x{_letters(j)}" for j in range(60))
    article = [" ".join(f"a{_letters(i)}y{_letters(j)}" for j in range(30)) for i in range(10)]
    footer = "All rights reserved by the owner of this page"
    rows = [(i, f"{own(i)}\n{footer}") for i in range(230)]
    rows += [(1000 + i, "\n".join(article[: i % 10] + [article[i % 10].replace("y", f"edit{_letters(i)} y", 1)] + article[i % 10 + 1 :])) for i in range(300)]
    rows += [(2000 + i, "\n".join(x.upper().replace("A", "b") for x in article)) for i in range(250)]
    rows += [(3000 + i, own(3000 + i)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'h' as source")
    out = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert len(out) == len(rows) and all(out[i].words_left == 60 and out[i].n_words == 69 for i in range(230))
    assert all(r.kept for r in out.values())
    assert all(out[i].words_left == out[i].n_words for i in out if i >= 1000)


def test_mixing_gives_rare_and_null_sources_their_weight(spark):
    d = spark.range(10000).selectExpr("id as doc_id", "case when id < 5 then 'rare' when id < 7 then null else concat('s', id % 19) end as source", "'t' as text")
    out = mixing.poisson_mix(d).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    want = 10000 / 21
    assert len(n) == 21 and all(abs(x - want) < 6 * want**0.5 for x in n.values())
    numbers = out.where("doc_id < 7").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("__mix_copies").alias("m"), F.countDistinct("__mix_copy").alias("d"), F.max("__mix_copy").alias("last")).collect()
    assert len(numbers) == 7 and all(r.n == r.m == r.d == r["last"] for r in numbers)
    most = spark.range(30000).selectExpr("id as doc_id", "if(id = 0, 'rare', 'common') as source")
    n = mixing.poisson_mix(most).where("source = 'rare'").count()  # in blocks: 15,000 copies of one row
    assert abs(n - 15000) < 6 * 15000**0.5


def test_ann_repeated_rows_use_up_no_places(spark):
    rng = np.random.default_rng(1)
    far = [(100 + i, rng.normal(size=2).tolist()) for i in range(30)]
    rows = [(0, [1.0, 0.0])] + [(5, [3.0, 0.0])] * 30 + [(8, [3.0, 0.0]), (9, [3.0, 0.0])] + [(7, [9.0 + i, 0.0]) for i in range(30)] + far * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.nearest(df, every=1000).orderBy("rank").collect()]
    best = {}
    for i, v in rows:
        if i:
            best[i] = max(best.get(i, -np.inf), v[0])
    assert got == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]


def test_few_edges_are_one_file_whatever_the_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.range(60).selectExpr("id + 1 as u", "id as v").unionByName(spark.range(100, 140).selectExpr("id + 100 as u", "100 as v"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components.components(edges)
        assert len(found.inputFiles()) == 1
        assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(200, 240)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_small_tables_start_no_python(spark):
    rows = [(1, "a\"\\\n\0\u20ac\U0001f600", -(1 << 62)), (2, None, None)]
    got = small_table(spark, rows, "a int, b string, c bigint")
    assert [tuple(r) for r in got.collect()] == rows and got.dtypes == [("a", "int"), ("b", "string"), ("c", "bigint")]
    assert small_table(spark, [], "a int").count() == 0
    docs = spark.range(3).selectExpr("id as doc_id", "'password = abcdefgh1234' as text", "id as k")
    plan = secretscan.candidates(docs, secretscan.RULES)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "ExternalRDD" not in plan and "LogicalRDD" not in plan


def test_chat_texts_are_written_three_times(spark, sf_dir, monkeypatch):
    written = []

    def noted(df):
        written.append(df.columns)
        return materialize(df)

    monkeypatch.setattr(chat, "materialize", noted)
    out = queries.op2_chat_tree(spark, sf_dir)
    assert sum("formatted" in c or "tokens" in c for c in written) == 3  # turns, nodes, segments
    assert out.count() == 1 + spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
