from rasterloom.queries import QUERIES


def test_detect_pages_reads_brands_beyond_64_bytes(spark, tmp_path):
    box = "\0\0\0Pftypmif1\0\0\0\0" + "miaf" * 15 + "avif"  # 80 bytes, the brand that counts at 76
    spark.createDataFrame([(1, box), (2, "<html>")], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(tuple(r) for r in QUERIES["detect_pages"](spark, str(tmp_path)).collect()) == [(1, "AVIF"), (2, None)]
