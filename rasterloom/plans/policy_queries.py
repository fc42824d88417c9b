"""Queries on formats, detection, policies and options."""

from pyspark.sql import functions as F

from rasterloom.operators import catalog, detect, options, policy
from rasterloom.plans.derive import table
from rasterloom.plans.registry import query

_FORMATS = "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{m}', '{e[0]}', '{','.join(e)}', '{s}')" for n, m, e, s in catalog.FORMATS) + ") t(format, mime_type, extension, extensions, verification_scope))"
_MODES = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}, {str(e).lower()}, {str(f).lower()})" for a, b, c, d, e, f in catalog.MODES) + ") t(mode, color, bytes_per_pixel, channels, has_alpha, has_color))"

# Byte prefixes to detect, each also with what follows from a page's text.
PREFIXES = (
    "", "ff", "ffd8ff", "89504e470d0a1a0a", "89504e47", "47494638", "4749463839", "474946383961", "474946383761", "42", "424d", "52494646", "5249464600000000", "52494646000000005745", "524946460000000057454250", "5249464600000000574542505650384c", "524946460000000057415645",
    "4d4d", "4d4d002a", "49492b00", "4d4d0000", "000001", "00000100", "00000200", "00000014667479706d696631", "0000001866747970617669660000000061766966", "00000018667479706d6966310000000061766966", "00000018667479706d696631000000006d69663161766966", "58585858", "00000001", "000000016674797061766966", "4749463839ff",
)
_PREFIX_ROWS = "p AS (SELECT hex_prefix, from_hex(hex_prefix) AS b FROM (VALUES " + ", ".join(f"('{x}')" for x in PREFIXES) + ") t(hex_prefix))"


def _prefixes(spark):
    return spark.createDataFrame([(x,) for x in PREFIXES], "hex_prefix string").withColumn("b", F.unhex("hex_prefix"))


def _starts(*signatures: str) -> str:
    return "(" + " OR ".join(f"h LIKE '{s.upper()}%'" for s in signatures) + ")"


_BE = "CAST('0x' || h[1:8] AS BIGINT)"
_BRANDS = "len(list_filter(range(33, CAST(least({0} * 2, strlen(h)) AS BIGINT), 8), lambda i: h[i:i + 7] IN ('61766966', '61766973'))) > 0"
_DETECT = f"""CASE WHEN {_starts('ffd8ff')} THEN 'JPEG' WHEN {_starts('89504e470d0a1a0a')} THEN 'PNG' WHEN {_starts('474946383761', '474946383961')} THEN 'GIF' WHEN {_starts('424d')} THEN 'BMP'
WHEN h LIKE '52494646________57454250565038%' AND h[31:32] IN ('20', '4C', '58') THEN 'WEBP' WHEN {_starts(*detect.TIFF)} THEN 'TIFF' WHEN {_starts(*detect.ICO)} THEN 'ICO'
WHEN h[9:24] IN ('6674797061766966', '6674797061766973') THEN 'AVIF'
WHEN h[9:24] IN ('667479706D696631', '667479706D736631') THEN CASE WHEN {_BE} >= 20 AND {_BE} * 2 <= strlen(h) AND {_BE} % 4 = 0 AND {_BRANDS.format(_BE)} THEN 'AVIF' END END"""


@query(f"WITH {_PREFIX_ROWS}, h AS (SELECT hex_prefix, hex(b) AS h FROM p) SELECT hex_prefix, {_DETECT} AS format FROM h")
def detect_signature(spark, sf_dir):
    return _prefixes(spark).select("hex_prefix", detect.detect_format(F.col("b")).alias("format"))


@query(f"WITH h AS (SELECT page_id, upper(hex(encode(substr(html, 1, 64)))) AS h FROM pages) SELECT page_id, {_DETECT} AS format FROM h")
def detect_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", detect.detect_format(F.encode("html", "UTF-8")).alias("format"))


def _begun(n: int, *signatures: str) -> str:
    return f"WHEN strlen(h) < {2 * n} AND (" + " OR ".join(f"'{s.upper()}' LIKE h || '%'" for s in signatures) + f") THEN {n}"


_MIN = ", ".join(
    f"CASE {x} END"
    for x in (
        _begun(3, "ffd8ff"),
        _begun(8, "89504e470d0a1a0a"),
        _begun(6, "474946383761", "474946383961"),
        _begun(2, "424d"),
        _begun(4, "52494646") + " WHEN h NOT LIKE '52494646%' THEN NULL WHEN strlen(h) < 16 THEN 8 WHEN strlen(h) < 24 THEN CASE WHEN '57454250' LIKE h[17:] || '%' THEN 12 END WHEN h[17:24] <> '57454250' THEN NULL WHEN strlen(h) < 32 AND ('56503820' LIKE h[25:] || '%' OR '5650384C' LIKE h[25:] || '%' OR '56503858' LIKE h[25:] || '%') THEN 16",
        _begun(4, *detect.TIFF),
        _begun(4, *detect.ICO),
        f"WHEN strlen(h) < 8 THEN 4 WHEN {_BE} < 8 THEN NULL WHEN strlen(h) < 24 THEN 12 WHEN h[9:24] IN ('667479706D696631', '667479706D736631') AND {_BE} >= 20 AND {_BE} % 4 = 0 AND {_BE} * 2 > strlen(h) THEN {_BE}",
    )
)


@query(f"""WITH {_PREFIX_ROWS}, h AS (SELECT hex_prefix, hex(b) AS h FROM p), d AS (SELECT hex_prefix, h, {_DETECT} AS format FROM h),
e AS (SELECT hex_prefix, CASE WHEN format = 'AVIF' AND {_BE} < 8 THEN NULL ELSE format END AS format, least({_MIN}) AS minimum FROM d)
SELECT hex_prefix, format, CAST(CASE WHEN format IS NULL THEN minimum END AS BIGINT) AS minimum FROM e""")
def detect_prefix_minimum(spark, sf_dir):
    return _prefixes(spark).select("hex_prefix", detect.detect_prefix(F.col("b")).alias("d")).select("hex_prefix", "d.format", "d.minimum")


@query(f"WITH {_FORMATS} SELECT * FROM f")
def format_catalog(spark, sf_dir):
    return catalog.formats(spark)


_ALIAS = "a AS (SELECT format, unnest(string_split(extensions, ',')) AS alias FROM f)"


@query(f"WITH {_FORMATS}, {_ALIAS}, n AS (SELECT alias AS name FROM a UNION SELECT upper(alias) FROM a UNION SELECT lower(p_brand) FROM part) SELECT name, format FROM n LEFT JOIN a ON a.alias = lower(name)")
def format_from_name(spark, sf_dir):
    known = catalog.aliases(spark).select("alias")
    names = known.select(F.col("alias").alias("name")).union(known.select(F.upper("alias"))).union(table(spark, sf_dir, "part").select(F.lower("p_brand"))).distinct()
    return names.select("name", catalog.format_of_name(F.col("name")).alias("format"))


@query(f"""WITH {_FORMATS}, {_ALIAS}, u AS (SELECT page_id, url, (SELECT alias FROM (SELECT alias, row_number() OVER (ORDER BY alias) - 1 AS i FROM a) WHERE i = page_id % 15) AS x FROM pages),
p AS (SELECT page_id, url AS path FROM u UNION ALL SELECT page_id + 1000000, url || '/img.' || upper(x) FROM u), e AS (SELECT page_id, regexp_extract(path, '[^/]\\.([^./]*)/*$', 1) AS ext FROM p)
SELECT page_id, ext, format, format IS NULL AS unsupported FROM e LEFT JOIN a ON a.alias = lower(ext)""")
def format_from_path(spark, sf_dir):
    names = sorted(a for _, _, e, _ in catalog.FORMATS for a in e)
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    image = F.get(F.array(*(F.lit(x.upper()) for x in names)), (F.col("page_id") % 15).cast("int"))
    paths = pages.unionByName(pages.select((F.col("page_id") + 1000000).alias("page_id"), F.concat("path", F.lit("/img."), image).alias("path")))
    out = paths.select("page_id", catalog.extension_of_path(F.col("path")).alias("ext"))
    fmt = catalog.format_of_name(F.col("ext"))
    return out.select("page_id", "ext", fmt.alias("format"), fmt.isNull().alias("unsupported"))


@query(f"""WITH {_FORMATS}, o AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in catalog.OPERATIONS)}) t(operation)),
r AS (SELECT format, operation, CASE WHEN (format = 'AVIF' AND operation IN ('still_decode', 'still_encode', 'sequence_decode', 'sequence_encode')) OR (operation = 'sequence_decode' AND format NOT IN ('PNG', 'GIF', 'WEBP', 'TIFF'))
  OR (operation = 'sequence_encode' AND format NOT IN ('GIF', 'WEBP', 'TIFF')) THEN 'NotImplemented' WHEN format = 'WEBP' AND operation LIKE '%decode' THEN 'Vp8Tables' WHEN format = 'WEBP' AND operation LIKE '%encode' THEN 'LosslessOnly' END AS reason FROM f, o)
SELECT format, operation, CASE WHEN reason IS NULL THEN 'ManifestBounded' WHEN reason = 'NotImplemented' THEN 'Unavailable' ELSE 'Restricted' END AS capability, reason FROM r""")
def capability_matrix(spark, sf_dir):
    return catalog.capabilities(spark)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{m}')" for f, ms in catalog.ENCODABLE.items() for m in ms) + ") t(format, mode)")
def encodable_modes(spark, sf_dir):
    return spark.createDataFrame([(f, m) for f, ms in catalog.ENCODABLE.items() for m in ms], "format string, mode string")


@query(f"WITH {_FORMATS}, s AS (SELECT * FROM (VALUES ('HeaderOnly', 1), ('Structure', 2), ('FullPixels', 3)) t(requested, n)) SELECT format, s.requested, have.n >= s.n AS provided FROM f JOIN s have ON have.requested = f.verification_scope, s")
def verification_scope(spark, sf_dir):
    wanted = spark.createDataFrame([(s,) for s in catalog.SCOPES], "requested string")
    return catalog.formats(spark).crossJoin(F.broadcast(wanted)).select("format", "requested", catalog.provides(F.col("verification_scope"), F.col("requested")).alias("provided"))


@query(f"WITH {_MODES} SELECT * FROM m")
def mode_dimension(spark, sf_dir):
    return catalog.modes(spark)


@query(f"WITH {_MODES} SELECT p_partkey, mode, CAST(CASE WHEN mode = 'L1' THEN (p_size + 7) // 8 * (p_partkey % 97 + 1) ELSE p_size * (p_partkey % 97 + 1) * bytes_per_pixel END AS BIGINT) AS decoded_bytes FROM part, m")
def transfer_layout(spark, sf_dir):
    """Raster lengths of canvases p_size x (p_partkey % 97 + 1) in each mode (the 15 modes are a literal table)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*(F.lit(m[0]) for m in catalog.MODES))).alias("mode"))
    return rows.select("p_partkey", "mode", catalog.transfer_bytes(F.col("mode"), F.col("p_size"), F.col("p_partkey") % 97 + 1).alias("decoded_bytes"))


_CANVAS = "c AS (SELECT p_partkey, (p_partkey * 37) % 5000 AS encoded, CASE p_partkey % 9 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'GIF' WHEN 3 THEN 'BMP' WHEN 4 THEN 'WEBP' WHEN 5 THEN 'TIFF' WHEN 6 THEN 'ICO' WHEN 7 THEN 'AVIF' END AS format, (p_partkey * 11) % 900 AS metadata, p_size * 7 AS width, (p_partkey % 97 + 1) AS height, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 13 END AS frames FROM part)"


def _canvases(spark, sf_dir):
    k = F.col("p_partkey")
    fmt = F.get(F.array(*(F.lit(x) for x in ("JPEG", "PNG", "GIF", "BMP", "WEBP", "TIFF", "ICO", "AVIF"))), (k % 9).cast("int"))
    return table(spark, sf_dir, "part").select(k, (k * 37 % 5000).alias("encoded"), fmt.alias("format"), (k * 11 % 900).alias("metadata"), (F.col("p_size") * 7).alias("width"), (k % 97 + 1).alias("height"), F.when(k % 5 != 0, k % 13).alias("frames"))


POLICY = policy.DecodePolicy(4000, ("JPEG", "PNG", "GIF", "BMP", "WEBP", "TIFF"), 700, 300, 80, 15_000, 40_000, 10)
_CHECKS = (("EncodedBytes", 4000, "encoded"), None, ("MetadataBytes", 700, "metadata"), ("Width", 300, "width"), ("Height", 80, "height"), ("Pixels", 15_000, "width * height"), ("PrimaryDecodedBytes", 40_000, "width * height * 3"), ("FrameCount", 10, "frames"))


def _cases(pick) -> str:
    out = []
    for c in _CHECKS:
        if c is None:
            out += [f"WHEN format IS NULL THEN {pick('UnknownFormat', None, 'NULL')}", f"WHEN format IN ('ICO', 'AVIF') THEN {pick('PolicyDenied', None, 'NULL')}"]
        else:
            out.append(f"WHEN {c[2]} > {c[1]} THEN {pick('LimitExceeded', c[0], c[2])}")
    return "CASE " + " ".join(out) + " END"


@query(f"""WITH {_CANVAS} SELECT p_partkey, {_cases(lambda k, r, o: f"'{k}'")} AS kind, {_cases(lambda k, r, o: f"'{r}'" if r else 'NULL')} AS resource, CAST({_cases(lambda k, r, o: o)} AS BIGINT) AS observed FROM c""")
def policy_first_failure(spark, sf_dir):
    c = {x: F.col(x) for x in ("encoded", "format", "metadata", "width", "height", "frames")}
    f = policy.first_failure(POLICY, c["encoded"], c["format"], c["metadata"], c["width"], c["height"], c["width"] * c["height"] * 3, c["frames"])
    return _canvases(spark, sf_dir).select("p_partkey", f.alias("f")).select("p_partkey", "f.kind", "f.resource", "f.observed")


@query(f"WITH {_CANVAS} SELECT format, count(*) AS n FROM c WHERE format IN ('PNG', 'GIF') GROUP BY format")
def policy_allow_list(spark, sf_dir):
    allowed = spark.createDataFrame([("PNG",), ("GIF",)], "format string")
    return _canvases(spark, sf_dir).join(F.broadcast(allowed), "format", "left_semi").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CANVAS} SELECT p_partkey, frames IS NULL OR frames <= 10 AS frames_pass, CASE WHEN encoded > 3000 THEN encoded END AS output_excess, CASE WHEN metadata < encoded THEN metadata END AS trailing_at FROM c")
def frame_count_limit(spark, sf_dir):
    passes = F.col("frames").isNull() | (F.col("frames") <= 10)
    return _canvases(spark, sf_dir).select("p_partkey", passes.alias("frames_pass"), policy.output_failure(3000, F.col("encoded"))["observed"].alias("output_excess"), policy.trailing_diagnostic(F.col("metadata"), F.col("encoded")).alias("trailing_at"))


@query(f"WITH {_CANVAS} SELECT p_partkey, width > 0 AND height > 0 AS nonzero, width * height <= 178956970 AS pixels_ok, width <= 16384 AND height <= 16384 AS sides_ok, encoded = width * height * 3 AS length_ok FROM c")
def raster_validate(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    return _canvases(spark, sf_dir).select("p_partkey", ((w > 0) & (h > 0)).alias("nonzero"), (w * h <= catalog.MAX_PIXELS).alias("pixels_ok"), ((w <= catalog.MAX_SIDE) & (h <= catalog.MAX_SIDE)).alias("sides_ok"), (F.col("encoded") == catalog.transfer_bytes(F.lit("Rgb8"), w, h)).alias("length_ok"))


_KEYNAMES = ("quality", "optimize", "progressive", "colour", "compression", "interlace")
_OPTIONS = "o AS (SELECT user_id % 500 AS case_id, CASE WHEN user_id % 2 = 0 THEN 'PNG' ELSE 'JPEG' END AS format, (['" + "', '".join(_KEYNAMES) + "'])[event_id % 6 + 1] AS key, CASE WHEN event_id % 3 = 0 THEN 'Yes' WHEN event_id % 3 = 1 THEN props ELSE CAST(event_id % 120 AS VARCHAR) END AS value, event_id FROM events)"


def _options(spark, sf_dir):
    e = F.col("event_id")
    value = F.when(e % 3 == 0, "Yes").when(e % 3 == 1, F.col("props")).otherwise((e % 120).cast("string"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("case_id"), F.when(F.col("user_id") % 2 == 0, "PNG").otherwise("JPEG").alias("format"), F.get(F.array(*(F.lit(k) for k in _KEYNAMES)), (e % 6).cast("int")).alias("key"), value.alias("value"), e)


_KNOWN = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{k}')" for f, ks in catalog.OPTION_KEYS.items() for k in ks) + ") t(format, key))"


@query(f"WITH {_OPTIONS} SELECT case_id, format, key, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 1")
def option_duplicate_keys(spark, sf_dir):
    return options.duplicate_keys(_options(spark, sf_dir))


@query(f"WITH {_OPTIONS}, {_KNOWN} SELECT DISTINCT case_id, o.format, o.key FROM o ANTI JOIN k ON o.format = k.format AND o.key = k.key")
def option_unknown_keys(spark, sf_dir):
    return options.unknown_keys(_options(spark, sf_dir)).select("case_id", "format", "key").distinct()


@query(f"""WITH {_OPTIONS}, {_KNOWN}, d AS (SELECT case_id, min(key) AS dup FROM (SELECT case_id, format, key FROM o GROUP BY ALL HAVING count(*) > 1) GROUP BY case_id), u AS (SELECT case_id, min(o.key) AS un FROM o ANTI JOIN k ON o.format = k.format AND o.key = k.key GROUP BY case_id)
SELECT DISTINCT o.case_id, CASE WHEN dup IS NOT NULL THEN 'duplicate ' || dup WHEN un IS NOT NULL THEN 'unknown ' || un END AS error FROM o LEFT JOIN d ON d.case_id = o.case_id LEFT JOIN u ON u.case_id = o.case_id""")
def option_first_error(spark, sf_dir):
    return options.first_error(_options(spark, sf_dir))


@query(f"WITH {_OPTIONS} SELECT event_id, CASE WHEN lower(value) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(value) IN ('false', '0', 'no', 'off') THEN false END AS flag, CASE WHEN regexp_matches(value, '^[0-9]+$') AND TRY_CAST(value AS BIGINT) BETWEEN 0 AND 100 THEN TRY_CAST(value AS BIGINT) END AS number, CASE WHEN regexp_matches(value, '^([0-9A-Fa-f]{{2}})*$') THEN upper(value) END AS hex_bytes FROM o")
def option_value_parse(spark, sf_dir):
    v = F.col("value")
    return _options(spark, sf_dir).select("event_id", options.parse_bool(v).alias("flag"), options.parse_number(v, 0, 100).alias("number"), F.hex(options.parse_hex(v)).alias("hex_bytes"))
