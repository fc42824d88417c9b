"""Queries on container layouts and item graphs."""

from pyspark.sql import functions as F

from rasterloom.operators import containers
from rasterloom.plans.derive import SQL_L8, SQL_RGB, raster_l8, raster_rgb, table
from rasterloom.plans.registry import query


def _le(v: str, n: int) -> str:
    h = f"lpad(hex(CAST({v} AS BIGINT)), {2 * n}, '0')"
    return " || ".join(f"{h}[{2 * i + 1}:{2 * i + 2}]" for i in range(n - 1, -1, -1))


@query(f"""WITH {SQL_RGB}, r AS (SELECT image_id, y, string_agg(lpad(hex(b), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(r), 2, '0'), '' ORDER BY x) || '00' AS row FROM rgb GROUP BY image_id, y),
i AS (SELECT image_id, count(*) AS h, string_agg(row, '' ORDER BY y DESC) AS data FROM r GROUP BY image_id)
SELECT image_id, '424D' || {_le('54 + 64 * h', 4)} || '000000003600000028000000' || '15000000' || {_le('h', 4)} || '0100180000000000' || {_le('64 * h', 4)} || 'C40E0000C40E00000000000000000000' || data AS bmp_hex FROM i""")
def bmp_encode_hex(spark, sf_dir):
    return containers.bmp_encode_rgb(raster_rgb(spark, sf_dir))


@query("SELECT p_partkey, b AS bits, CAST((p_size * b + 31) // 32 * 4 AS BIGINT) AS stride, CAST(54 + CASE WHEN b <= 8 THEN 4 * (1 << b) ELSE 0 END + (p_size * b + 31) // 32 * 4 * (p_partkey % 97 + 1) AS BIGINT) AS file_bytes FROM part, (VALUES (1), (4), (8), (24), (32)) t(b)")
def bmp_layout(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 97 + 1).alias("h"))
    parts = [rows.select("p_partkey", F.lit(b).alias("bits"), containers.bmp_stride(F.col("p_size"), b).alias("stride"), containers.bmp_size(F.col("p_size"), F.col("h"), b, 1 << b if b <= 8 else 0).cast("bigint").alias("file_bytes")) for b in (1, 4, 8, 24, 32)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ICO = "e AS (SELECT c_nationkey AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS idx, CAST(c_custkey * 16 % 256 AS BIGINT) AS w, CAST(c_custkey * 48 % 256 AS BIGINT) AS h FROM customer)"


def _icons(spark, sf_dir):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), idx.alias("idx"), (F.col("c_custkey") * 16 % 256).alias("w"), (F.col("c_custkey") * 48 % 256).alias("h"))


@query(f"WITH {_ICO}, a AS (SELECT nation, idx, CASE WHEN w = 0 THEN 256 ELSE w END * CASE WHEN h = 0 THEN 256 ELSE h END AS area FROM e) SELECT nation, idx, area FROM a QUALIFY row_number() OVER (PARTITION BY nation ORDER BY area DESC, idx) = 1")
def ico_best_entry(spark, sf_dir):
    return containers.ico_best_entry(_icons(spark, sf_dir), "nation")


@query(f"WITH {_ICO} SELECT nation, 6 + 16 * count(*) AS metadata_bytes FROM e GROUP BY nation")
def ico_metadata_bytes(spark, sf_dir):
    return _icons(spark, sf_dir).groupBy("nation").agg((6 + 16 * F.count(F.lit(1))).alias("metadata_bytes"))


@query(f"WITH {_ICO}, s AS (SELECT nation, idx, w * 2 AS w, h * 2 AS h FROM e) SELECT nation, idx, '000001000100' || lpad(hex(CASE WHEN w >= 256 THEN 0 ELSE w END), 2, '0') || lpad(hex(CASE WHEN h >= 256 THEN 0 ELSE h END), 2, '0') || '00000100' || '2000' || {_le('w * h * 4 + 40', 4)} || '16000000' AS directory_hex FROM s")
def ico_directory_hex(spark, sf_dir):
    rows = _icons(spark, sf_dir).select("nation", "idx", (F.col("w") * 2).alias("w"), (F.col("h") * 2).alias("h"))
    return rows.select("nation", "idx", containers.ico_directory(F.col("w"), F.col("h"), F.lit(32), F.col("w") * F.col("h") * 4 + 40).alias("directory_hex"))


_TIFF = "t AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS p, l_partkey % 4 + 1 AS s, ([1, 2, 4, 8, 16, 32])[l_suppkey % 6 + 1] AS b, l_linenumber % 3 + 1 AS f FROM lineitem)"


@query(f"""WITH {_TIFF}, m AS (SELECT *, CASE WHEN s = 1 AND b = 1 AND p IN (0, 1) THEN 'L1' WHEN s = 1 AND b = 32 AND f = 3 THEN 'F32' WHEN s = 1 AND b = 32 AND f = 2 THEN 'I32' WHEN s = 1 AND b = 16 AND p IN (0, 1) THEN 'L16'
WHEN s = 1 AND b IN (2, 4, 8) AND p IN (0, 1) THEN 'L8' WHEN s = 1 AND b IN (1, 2, 4, 8) AND p = 3 THEN 'P8' WHEN s = 2 AND b = 8 AND p IN (0, 1) THEN 'La8' WHEN s = 3 AND b = 8 AND p IN (2, 6) THEN 'Rgb8' WHEN s = 4 AND b = 8 AND p = 2 THEN 'Rgba8' WHEN s = 4 AND b = 8 AND p = 5 THEN 'Cmyk8' END AS mode FROM t)
SELECT mode, count(*) AS n FROM m GROUP BY mode""")
def tiff_layout_infer(spark, sf_dir):
    p, s, f = F.col("l_partkey") % 7, F.col("l_partkey") % 4 + 1, F.col("l_linenumber") % 3 + 1
    b = F.get(F.array(*(F.lit(x) for x in (1, 2, 4, 8, 16, 32))), (F.col("l_suppkey") % 6).cast("int"))
    return table(spark, sf_dir, "lineitem").select(containers.tiff_layout(p, s, b, f).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST((h + rps - 1) // rps AS BIGINT) AS strips, CAST(h - ((h + rps - 1) // rps - 1) * rps AS BIGINT) AS last_rows, CAST((h - ((h + rps - 1) // rps - 1) * rps) * p_size * 3 AS BIGINT) AS last_bytes FROM (SELECT p_partkey, p_size, p_partkey % 97 + 1 AS h, p_partkey % 10 + 1 AS rps FROM part)")
def tiff_strip_geometry(spark, sf_dir):
    h, rps = F.col("p_partkey") % 97 + 1, F.col("p_partkey") % 10 + 1
    n = F.ceil(h / rps)
    last = h - (n - 1) * rps
    return table(spark, sf_dir, "part").select("p_partkey", n.cast("bigint").alias("strips"), last.cast("bigint").alias("last_rows"), (last * F.col("p_size") * 3).cast("bigint").alias("last_bytes"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, max(l_partkey) % 500 + 1 AS size FROM lineitem GROUP BY l_orderkey, l_linenumber), b AS (SELECT *, CAST(coalesce(sum((size + 15) // 16 * 16) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM p)
SELECT l_orderkey, l_linenumber, base, base + size AS "end" FROM b""")
def tiff_page_relocation(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_partkey") % 500 + 1).alias("size"))
    return containers.relocate_pages(pages, "l_orderkey", "l_linenumber", "size").select("l_orderkey", "l_linenumber", "base", "end")


@query("SELECT l_orderkey, greatest(max(l_linenumber * 12 + 8), max(l_partkey % 900 + l_suppkey % 40)) - CAST(sum(l_suppkey % 40) AS BIGINT) AS metadata_bytes FROM lineitem GROUP BY l_orderkey")
def tiff_metadata_bytes(spark, sf_dir):
    """The larger of the directory's end and the payload's end, less the payload."""
    size = F.col("l_suppkey") % 40
    end = F.greatest(F.max(F.col("l_linenumber") * 12 + 8), F.max(F.col("l_partkey") % 900 + size))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((end - F.sum(size)).alias("metadata_bytes"))


@query("""WITH RECURSIVE d AS (SELECT n_nationkey AS node, (n_nationkey * 7 + 3) % 25 AS nxt FROM nation), w AS (SELECT node AS head, node, nxt, 1 AS depth, [node] AS seen FROM d UNION ALL
SELECT w.head, d.node, d.nxt, depth + 1, list_append(seen, d.node) FROM w JOIN d ON d.node = w.nxt WHERE NOT list_contains(seen, d.node)) SELECT head, CAST(max(depth) AS INTEGER) AS pages FROM w GROUP BY head""")
def tiff_ifd_chain(spark, sf_dir):
    """Directories that a chain walk meets before it would come back: nations as directories, a next-pointer each."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("__ifd_nation")
    return spark.sql("""WITH RECURSIVE w(head, node, nxt, depth, seen) AS (
        SELECT n_nationkey, n_nationkey, (n_nationkey * 7 + 3) % 25, 1, array(n_nationkey) FROM __ifd_nation
        UNION ALL SELECT w.head, d.n_nationkey, (d.n_nationkey * 7 + 3) % 25, depth + 1, array_append(seen, d.n_nationkey) FROM w JOIN __ifd_nation d ON d.n_nationkey = w.nxt WHERE NOT array_contains(seen, d.n_nationkey))
        SELECT head, max(depth) AS pages FROM w GROUP BY head""")


@query(f"WITH {SQL_L8}, n AS (SELECT image_id, y, count(DISTINCT v) AS entries FROM l8 GROUP BY image_id, y) SELECT image_id, y, CAST(1 << CAST(length(bin(greatest(entries, 4) - 1)) AS INTEGER) AS INTEGER) AS colors, CAST(length(bin(greatest(entries, 4) - 1)) - 1 AS INTEGER) AS size_field FROM n")
def gif_color_table_size(spark, sf_dir):
    rows = raster_l8(spark, sf_dir).groupBy("image_id", "y").agg(F.count_distinct("v").alias("entries"))
    colors, size = containers.gif_table(F.col("entries"))
    return rows.select("image_id", "y", colors.alias("colors"), size.alias("size_field"))


_KINDS = ("IHDR", "gAMA", "tEXt", "IDAT", "prVt", "XxXx", "fcTL", "eXIf", "iCCP", "IEND")


@query("WITH k AS (SELECT event_id, user_id, (['" + "', '".join(_KINDS) + """'])[event_id % 10 + 1] AS kind FROM events), c AS (SELECT *, CASE WHEN kind IN ('IHDR', 'IDAT', 'fcTL', 'IEND') THEN 'interpreted' WHEN kind IN ('gAMA', 'iCCP') THEN 'color' WHEN kind IN ('tEXt', 'eXIf') THEN 'metadata' WHEN kind = 'prVt' THEN 'opaque' ELSE 'critical' END AS class,
coalesce(max(CASE WHEN kind = 'IDAT' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_idat FROM k) SELECT event_id, kind, class, after_idat FROM c""")
def chunk_classification(spark, sf_dir):
    """Chunks of a stream (a user's events in order): class, and whether image data came before."""
    from pyspark.sql import Window

    kind = F.get(F.array(*(F.lit(k) for k in _KINDS)), (F.col("event_id") % 10).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.max(F.when(F.col("kind") == "IDAT", 1).otherwise(0)).over(before), F.lit(0)) == 1
    return rows.select("event_id", "kind", containers.chunk_class(F.col("kind")).alias("class"), after.alias("after_idat"))


@query("""SELECT o_orderkey AS item_id, p_partkey AS property, p_type AS kind, l_linenumber % 2 = 1 AS essential FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'""")
def item_property_assoc(spark, sf_dir):
    """Items (orders) to properties (parts) through associations (lineitems): equi-joins, the join side by size."""
    items = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    assoc = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("property"), (F.col("l_linenumber") % 2 == 1).alias("essential"))
    props = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("property"), F.col("p_type").alias("kind"))
    return assoc.join(items, "item_id").join(props, "property").select("item_id", "property", "kind", "essential")


_RUNS = "r AS (SELECT l_orderkey AS track, l_linenumber AS run, max(l_partkey) % 9 + 1 AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY track ORDER BY run) AS BIGINT) AS last FROM r)"


@query(f"WITH {_RUNS}, s AS (SELECT o_orderkey AS track, o_custkey % 30 AS sample FROM orders) SELECT s.track, s.sample, e.run FROM s JOIN e ON e.track = s.track AND s.sample >= e.last - e.n AND s.sample < e.last")
def sample_to_chunk_range_join(spark, sf_dir):
    """The run that holds a sample: a range join within the equi-join on the track."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("run")).agg((F.max("l_partkey") % 9 + 1).alias("n"))
    ranges = containers.run_starts(runs, "track", "run", "n")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"), (F.col("o_custkey") % 30).alias("sample"))
    return wanted.join(ranges, "track").where("sample >= first AND sample < last").select("track", "sample", "run")


@query("""WITH x AS (SELECT l_orderkey, l_partkey % 300 AS start, l_partkey % 300 + l_suppkey % 50 + 1 AS "end" FROM lineitem), p AS (SELECT *, coalesce(max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM x)
SELECT l_orderkey, CAST(sum(greatest("end" - greatest(before, start), 0)) AS BIGINT) AS covered FROM p GROUP BY l_orderkey""")
def extent_union_bytes(spark, sf_dir):
    start = F.col("l_partkey") % 300
    extents = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start"), (start + F.col("l_suppkey") % 50 + 1).alias("end"))
    return containers.covered_bytes(extents, "l_orderkey")


@query("WITH c AS (SELECT doc_id, unnest(range(0, 4)) AS ordinal, strlen(text) AS n FROM documents), p AS (SELECT doc_id, ordinal, n // (ordinal + 2) AS size FROM c) SELECT doc_id, CAST(sum(8 + size + size % 2) + 12 AS BIGINT) AS riff_bytes, CAST(sum(CASE WHEN ordinal = 0 THEN 0 ELSE 8 + size + size % 2 END) + 12 + 8 AS BIGINT) AS metadata_bytes FROM p GROUP BY doc_id")
def riff_extents(spark, sf_dir):
    """Chunks padded to even sizes, the first of them pixels: the file's extent, and what isn't pixel payload."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ordinal"))
    size = F.expr("n div (ordinal + 2)")
    whole = 8 + size + size % 2
    return rows.groupBy("doc_id").agg((F.sum(whole) + 12).alias("riff_bytes"), (F.sum(F.when(F.col("ordinal") > 0, whole).otherwise(0)) + 20).alias("metadata_bytes"))


@query("SELECT event_id, event_id % 256 >> 7 = 1 AS forbidden, CAST((event_id % 256 >> 3) & 15 AS INTEGER) AS type, (event_id >> 2) & 1 = 1 AS extended, (event_id >> 1) & 1 = 1 AS sized FROM events")
def av1_obu_header(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", containers.obu_header((F.col("event_id") % 256).cast("int")).alias("h")).select("event_id", "h.*")


@query("""WITH v AS (SELECT event_id, event_id * event_id AS v FROM events), g AS (SELECT event_id, v, greatest(CAST(ceil(length(ltrim(bin(v), '0')) / 7.0) AS INTEGER), 1) AS n FROM v)
SELECT event_id, array_to_string([lpad(hex((v >> (7 * i)) % 128 + CASE WHEN i + 1 < n THEN 128 ELSE 0 END), 2, '0') for i in range(0, n)], '') AS digits FROM g""")
def av1_leb128(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", containers.leb128(F.col("event_id") * F.col("event_id")).alias("digits"))


_CHUNKS = "c AS (SELECT user_id AS image_id, event_id AS ordinal, CASE event_id % 4 WHEN 0 THEN 'sRGB' WHEN 1 THEN 'gAMA' WHEN 2 THEN 'cHRM' ELSE 'iCCP' END AS kind, repeat(lpad(hex(event_id // 4 % 7), 2, '0'), CAST(CASE event_id % 4 WHEN 0 THEN 1 + event_id // 28 % 2 WHEN 1 THEN 3 + event_id // 28 % 2 WHEN 2 THEN 31 + event_id // 28 % 2 ELSE 2 END AS INTEGER)) || CASE WHEN event_id % 8 = 3 THEN '00' WHEN event_id % 8 = 7 THEN '0041' ELSE '' END AS digits FROM events)"


@query(f"""WITH {_CHUNKS}, g AS (SELECT *, CASE kind WHEN 'sRGB' THEN digits IN ('00', '01', '02', '03') WHEN 'gAMA' THEN length(digits) = 8 WHEN 'cHRM' THEN length(digits) = 64
  ELSE list_position([digits[2 * i + 1:2 * i + 2] for i in range(0, length(digits) // 2)], '00') BETWEEN 2 AND length(digits) // 2 - 1 END AS good FROM c)
SELECT image_id, ordinal, kind, CASE WHEN good AND ordinal = min(ordinal) FILTER (WHERE good) OVER (PARTITION BY image_id, kind) THEN 'color' ELSE 'metadata' END AS role FROM g""")
def png_color_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id as image_id", "event_id as ordinal", "case event_id % 4 when 0 then 'sRGB' when 1 then 'gAMA' when 2 then 'cHRM' else 'iCCP' end as kind", "concat(repeat(lpad(hex(event_id div 4 % 7), 2, '0'), cast(case event_id % 4 when 0 then 1 + event_id div 28 % 2 when 1 then 3 + event_id div 28 % 2 when 2 then 31 + event_id div 28 % 2 else 2 end as int)), case when event_id % 8 = 3 then '00' when event_id % 8 = 7 then '0041' else '' end) as digits")
    return containers.first_color_chunks(e, "image_id").select("image_id", "ordinal", "kind", "role")
