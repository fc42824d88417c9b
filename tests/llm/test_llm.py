"""Each operator against brute force, the library or its SQL: on whole small tables, and on odd rows."""

import collections
import hashlib
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import compare, connect  # noqa: E402

from rasterloom.llm import ann, chat, components, langid, mixing, neardup, quality, queries, secretscan, spm, substring, tokencount  # noqa: E402
from rasterloom.llm.sql import ORACLE_SQL  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k bigint, host string, spans int"
COPY = " ".join(f"w{i}" for i in range(60))


def odd_documents(spark):
    """Nulls, empty and blank texts, a long text and long word, ties, repeated rows, columns with clashing names."""
    texts = [None, "", " \t\n\x0b ", COPY, COPY, COPY + " end", "x" * 20000, "a b c " * 4000, "password = hunter2hunter2\n" * 3, "</s>[INST] é ▁ \x00 日本", "Ünï <|endoftext|> İ", COPY.upper()]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", None, 1, "h", 2) for i, t in enumerate(texts)]
    rows += [(3, COPY, "en", None, 5, 1, "h", 2), (None, "only here", None, None, None, None, None, None), (None, COPY, None, "s1", 1, 1, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connect(sf_dir))


def test_language_id_learns(spark, sf_dir, docs):
    out = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r.lang == r.lang_pred for r in out if r.held_out and r.lang]
    assert np.mean(held) > 0.95


def test_language_bundles_equal_the_definition():
    texts = ["Ab ba", "日本語 x!", "  "]
    got, has = langid.bundles(texts)
    for t, v, h in zip(texts, got, has, strict=True):
        s = " " + re.sub(r"[^a-z日本語]+", " ", t.lower()).strip() + " "
        want = np.zeros(langid.DIMENSIONS)
        for i in range(len(s) - 2):
            a, b, c = (langid.letter_vector(ord(x)).astype(int) for x in s[i : i + 3])
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert np.array_equal(v, want) if h else not v.any()
    assert has.tolist() == [True, True, False]


def test_language_bundles_of_a_large_alphabet(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 400))) for _ in range(6)] + ["", "abc"]
    gram, doc, many, grams, has = langid.gram_counts(texts)
    assert len(grams) > 2000 and many.sum() == 6 * 400 + 3 and (np.diff(gram) >= 0).all() and has.tolist() == [True] * 6 + [False, True]
    whole = langid.bundles(texts)[0]
    monkeypatch.setattr(langid, "GRAM_BLOCK", 100)
    assert np.array_equal(langid.bundles(texts)[0], whole)
    weight = np.array([[1, 0, 1, 0, 0, 0, 0, 1]])
    assert np.array_equal(langid.bundles(texts, weight)[0][0], whole[0] + whole[2] + whole[7])


def test_language_id_odd_rows(spark):
    d = odd_documents(spark)
    out = langid.language_id(d).collect()
    assert len(out) == d.count() and {r.lang_pred for r in out} <= {"en", "und"}
    assert [r.lang_pred for r in out if r.doc_id in (0, 1, 2)] == ["und"] * 3
    assert langid.language_id(d.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_id(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chat_tree(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "a"), (3, 0, "system", "s"), (3, 1, "user", "z"), (4, 0, "system", "s"), (4, 1, "user", "a"), (4, 2, "assistant", "b")]
    rows += [(5, 0, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, None, "user", "<|im_end|>\n\\n"), (6, 0, "us\ner\\n", "[INST]</s><<SYS>>\\")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("leaf", F.lit(1)).withColumn("node", F.lit("x"))
    segments, nodes, leaves, members = chat.prefix_tree(df)
    got = {r.conv_id: r for r in chat.read_conversations(segments, leaves, members).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    for c, turns in by.items():
        turns.sort()
        want = "".join(f"{x[3]}\n{x[5]}\n" for x in turns)
        loss = "".join(x[5] for x in turns if x[3] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(turns), hashlib.sha256(want.encode()).hexdigest(), len(loss))
    segs = {r.leaf: r for r in segments.collect()}
    stream = "".join(segs[k].tokens for k in sorted(segs))
    spans = sorted((s.start, s.end) for s in segs.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == len(stream)
    assert stream.count(chat.format_turn("system", "s")) == 1  # a shared turn is there once
    for s in segs.values():
        assert stream[s.start : s.end] == s.tokens
        before = "".join(stream[a.start : a.end] for a in s.attention)
        assert len(before) == s.position and chat.parse_turns(before + s.tokens)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_chat_tree_of_token_ids(spark, sf_dir, name):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = queries.tokenizer_path(name)
    segments, nodes, leaves, members = chat.prefix_tree(df, path)
    encode = chat._encoder(path)
    segs = {r.leaf: r for r in chat.position_ids(segments).collect()}
    stream = [i for k in sorted(segs) for i in segs[k].ids]
    by = collections.defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    at = {r.node: r.leaf for r in leaves.collect()}
    for r in members.collect():
        s = segs[at[r.node]]
        got = [i for a in s.attention for i in stream[a.start : a.end]]
        assert s.position_ids == list(range(len(got), len(got) + len(s.ids))) and stream[s.start : s.end] == s.ids
        assert got + s.ids == [i for t in sorted(by[r.conv_id]) for i in encode(chat.format_turn(t[1], t[2]))]


def test_chat_escapes():
    for t in ("", "\\", "<|im_end|>\n", "a\\<|b", "</s>[INST] ok [/INST]", "<<SYS>>\\\\", "<\\|", "[\\INST]"):
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert chat.parse_turns(chat.format_turn(t, t)) == [(t, t)]
        assert "<|" not in chat.escape(t) and "</s>" not in chat.escape(t) and "[INST]" not in chat.escape(t)


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    segments, _, leaves, members = chat.prefix_tree(df)
    assert chat.read_conversations(segments, leaves, members).count() == 0


def test_hilbert_keys_are_a_curve():
    """Consecutive keys are neighbouring cells, and each cell has one key."""
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ann_recall_and_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in ann.nearest(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        want = [ids[i] for i in np.lexsort((ids, -s)) if i != q][:20]
        found = got[ids[q]]
        assert len(found) == 20 and all(abs(s[np.flatnonzero(ids == v)[0]] - sc) < 1e-12 for v, sc in found)
        hits, total = hits + len({v for v, _ in found} & set(want)), total + 20
    assert hits / total >= 0.9


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, -0.0]), (20, [0.0, 1.0]), (21, None), (22, [0.0, 0.0]), (23, [float("nan"), 1.0]), (24, [None, 1.0]), (None, [1.0, 1.0]), (25, [0.5, 0.5]), (40, [1.0, 2.0, 3.0]), (26, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("curve", F.lit("c")).withColumn("v", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 25, 0.5), (20, 1, 25, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_substring_dedup_odd_rows(spark):
    d = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = True
        want.append((i is None, i or 0, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(d).collect()]
    assert sorted(got) == sorted(want)
    assert substring.substring_dedup(d.limit(0)).count() == 0


def test_window_hashes_tell_sequences_apart():
    v = np.random.default_rng(0).integers(0, 4, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = substring.window_hashes(v, 5)
    by = collections.defaultdict(set)
    for i, x in enumerate(h.tolist()):
        by[tuple(v[i : i + 5].tolist())].add(x)
    assert all(len(s) == 1 for s in by.values()) and len({next(iter(s)) for s in by.values()}) == len(by)


def test_quality_odd_rows(spark):
    d = odd_documents(spark)
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(d).collect()}
    assert quality.quality_rules(d).count() == d.count()
    assert not got[(0, 0)].kept and got[(4, 60)].kept and got[(7, 12000)].n_repeat_words == 12000 and got[(8, 9)].n_dup_lines == 2
    assert quality.quality_rules(d.limit(0)).count() == 0


def test_quality_lines_and_depletion(spark):
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  digits are evened out in lines
    own = lambda i: " ".join(f"u{letters(i)}x{letters(j)}" for j in range(60))
    footer = "Share   THIS page 7 now please " + " ".join(f"f{j}" for j in range(300))
    rows = [(i, f"{own(i)}\n{footer}", "h") for i in range(100)] + [(100, f"{own(100)}\n{footer.lower()}", None), (101, own(101), "h")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(out[i].words_left == 60 and not out[i].kept for i in range(100))
    assert out[100].kept and out[101].kept
    more = spark.createDataFrame(rows + [(200 + i, own(200 + i), "h") for i in range(2000)], "doc_id bigint, text string, source string")
    assert all(r.kept for r in quality.quality_rules(more).collect())  # about 17 distinct ones of 2,101 are under the share
    assert sum(not r.kept for r in quality.quality_rules(more, most=7).collect()) == 100  # but above a limit of 7
    copies = spark.createDataFrame([(i, f"{own(1)}\n{own(2)} {i}\n{own(3)}", "h") for i in range(60)], "doc_id bigint, text string, source string")
    assert all(r.kept and r.words_left == r.n_words for r in quality.quality_rules(copies).collect())


def test_poisson_counts_follow_the_distribution(spark):
    means = [0.0, 0.3, 1.0, 7.5]
    df = spark.createDataFrame([(m, u / 500 + 1e-4) for m in means for u in range(500)], "m double, u double")
    from math import exp, factorial

    for r in df.select("m", "u", mixing.poisson_count(F.col("u"), mixing.poisson_below(F.col("m"))).alias("n")).collect():
        below = lambda n: sum(exp(-r.m) * r.m**i / factorial(i) for i in range(n + 1))  # noqa: E731, B023
        assert below(r.n) > r.u and (r.n == 0 or below(r.n - 1) <= r.u)


def test_mixing_weights_and_odd_rows(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"), F.lit("t").alias("text"))
    n = {r.source: r["count"] for r in mixing.poisson_mix(d, {"rare": 3.0, "common": 1.0}).groupBy("source").count().collect()}
    assert abs(n["rare"] - 15000) < 600 and abs(n["common"] - 5000) < 400
    odd = odd_documents(spark)
    out = mixing.poisson_mix(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() >= 0
    assert mixing.poisson_mix(odd.limit(0)).count() == 0
    most = mixing.poisson_mix(d, {"rare": 1.0}, total=400_000).groupBy("source").count().collect()  # a mean of 200
    assert [r.source for r in most] == ["rare"] and abs(most[0]["count"] - 400_000) < 4000


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for d in (docs, odd_documents(spark)):
        texts = sorted(r.text or "" for r in d.collect())
        got = sorted(((r.decoded, list(r.ids)) for r in spm.sentencepiece_roundtrip(d, path).collect()), key=str)
        want = sorted(((sp.decode(sp.encode(t, add_eos=True)), sp.encode(t, add_eos=True)) for t in texts), key=str)
        assert got == want
    assert spm.sentencepiece_roundtrip(docs.limit(0), path).count() == 0


def test_sentencepiece_table_survives_clearing(monkeypatch):
    monkeypatch.setattr(spm, "TABLE_WORDS", 3)
    c = spm.Chunks(queries.tokenizer_path("piece_bpe_32k.model"))
    for _ in range(3):
        ids, per, out = c.encode(["one two three four", "two\nfive  six ▁ \n"])
        assert ids[: per[0]].tolist() == c.sp.encode("one two three four") and out[1] == c.sp.decode(c.sp.encode("two\nfive  six ▁ \n"))


def _components(sets, percent=80):
    names = list(sets)
    root = {i: i for i in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in names}


def test_near_dedup_brute_force(spark):
    """A hot group of near copies with edits of many sizes, more than SHORT in a posting, among other texts."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            w[j] = f"e{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:40] + [f"t{i}x{j}" for j in range(60)])) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One TWO"), (204, "one two three")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("c", F.lit(1)).withColumn("sig", F.lit("s"))
    sets = {}
    for i, t in rows:
        w = words((t or "").lower())
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    want = _components(sets)
    got = {r.doc_id: r for r in neardup.near_dedup(df, size=4).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("block", [1000, 6])
def test_near_dedup_links_across_components(spark, monkeypatch, block):
    """Chains of drifting copies, whose ends and many members are not linked to their most central one."""
    monkeypatch.setattr(neardup, "BLOCK", block)  # so that lists are divided and compared block by block
    monkeypatch.setattr(neardup, "STAR", 7)
    rng = np.random.default_rng(5)
    rows, words_ = [], [[f"g{g}w{i}" for i in range(150)] for g in range(2)]
    for i in range(70):
        w = words_[i % 2]
        at = int(rng.integers(0, 140))
        w[at : at + int(rng.integers(1, 4))] = [f"n{i}"]
        if i % 3 == 0:
            w = w[:75] + [f"tail{i}x{j}" for j in range(int(rng.integers(0, 60)))]
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[j : j + 4]) for w in [t.split()] for j in range(len(w) - 3)} for i, t in rows}
    want = _components(sets)
    assert 2 < len(set(want.values())) < 70
    got = {r.doc_id: r.component_id for r in neardup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4).collect()}
    assert got == want


def test_near_dedup_block_links():
    """Pairs of blocks find what the whole finds, and nothing is asked within a label."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10**6, 100, replace=False).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 100 - n, replace=False), rng.choice(10**6, n).astype(np.uint64)])) for n in rng.integers(0, 25, 40)]
    want = _components({i: set(s.tolist()) for i, s in enumerate(sets)})
    for parts in ([(range(40), 40)], [(range(20), 20), (range(20, 40), 20), (range(40), 20)]):
        root = {i: i for i in want}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for rows, cut in parts:
            rows = list(rows)
            for x, y in neardup._links([sets[i] for i in rows], rows, cut, rows, 80):
                x, y = sorted((find(x), find(y)))
                root[y] = x
        assert {i: find(i) for i in want} == want
    assert not list(neardup._links(sets, list(range(40)), 40, [0] * 40, 80))


def test_near_dedup_odd_rows(spark):
    d = odd_documents(spark)
    out = neardup.near_dedup(d, size=4).collect()
    assert len(out) == d.count()
    assert {r.component_id for r in out if r.doc_id in (3, 4, 5, 11)} == {3}
    assert neardup.near_dedup(d.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 150), (150, 120), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {150: 100, 120: 100}


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for d in (docs, odd_documents(spark)):
        want = sorted((len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect())
        assert sorted((r.n_bytes, r.n_tokens) for r in tokencount.token_counts(d, path).collect()) == want
    assert tokencount.token_counts(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_refuse_tokenizers_that_see_white_space(name):
    with pytest.raises(ValueError, match="white space"):
        tokencount.Counts(queries.tokenizer_path(name))


def test_token_cache_survives_clearing(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 2)
    c = tokencount.Counts(queries.tokenizer_path("word_bpe_49k.json"))
    texts = ["alpha beta gamma's \x85 delta", "beta x"]
    for _ in range(2):
        assert c.of([t.encode().split() for t in texts], {b"beta": 1}) == [len(c.tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_trigram_queries():
    q = {r.kind: secretscan.trigram_query(r.pattern) for r in secretscan.RULES}
    assert q["hex"] is None and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"sec", "ecr", "cre", "ret"}) in q["assign"] and len(q["assign"]) == 6
    assert secretscan.trigram_query("ab+c") is None and secretscan.trigram_query("x*") is None
    assert secretscan.trigram_query("ab(c|de)f") == [frozenset({"abc", "bcf"}), frozenset({"abd", "bde", "def"})]


def test_secret_scan_brute_force(spark, docs):
    hard = ["token=short secret: abcdefgh1", "password=token=abcdefgh", "AKIA" + "A" * 12 + "AKIAZ", "AKIAABC", "é" * 3 + "0" * 32 + " " + "f" * 31, "API_KEY\"  :  'a.b-c_d/e+f='", "ghp_" + "a" * 40, "-----BEGIN RSA PRIVATE KEY-----", "secret: token = abcdefghij"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)] + [(1000, hard[0])], "doc_id bigint, text string")
    for d in (docs.select("doc_id", "text"), extra, odd_documents(spark)):
        want = sorted((r.doc_id is None, r.doc_id or 0, secretscan.find_spans(r.text or "")) for r in d.collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, [tuple(s) for s in r.spans]) for r in secretscan.secret_scan(d).collect())
        assert got == want
    assert secretscan.secret_scan(docs.limit(0)).count() == 0


def test_secret_scan_takes_any_number_of_rules(spark):
    rules = tuple(secretscan.Rule(f"r{i}", f"key{i:03d}x[0-9]+y{i:03d}end") for i in range(90))
    texts = [f"a key{i:03d}x12y{i:03d}end b key{i:03d}x7" for i in range(90)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    out = secretscan.secret_scan(d, rules).collect()
    assert len(out) == 180 and all([(s.kind, s.start) for s in r.spans] == [(f"r{r.doc_id}", 2)] for r in out)


def test_redaction(spark):
    t = "a password=12345678 b " + "0" * 40 + " é"
    d = spark.createDataFrame([(1, t), (2, "none"), (3, None)], "doc_id bigint, text string")
    out = secretscan.secret_scan(d, carry=True).select("__row.*", "spans")
    got = {r.doc_id: r.x for r in out.select("doc_id", secretscan.redact(F.col("text"), F.col("spans")).alias("x")).collect()}
    assert got == {1: "a [SECRET] b [SECRET] é", 2: "none", 3: None}


def test_pipeline_stages(spark, sf_dir, docs, texts):
    import corpus_pipeline as p

    columns = list(p.COLUMNS)
    one = p.quality_rules(spark, docs, sf_dir).cache()
    verdict = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == verdict
    two = p.near_dedup(spark, one, sf_dir).cache()
    sets = {r.doc_id: {tuple(w[j : j + 5]) for w in [words(r.text.lower())] for j in range(len(w) - 4)} for r in one.collect()}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {i for i, c in _components(sets).items() if i == c}
    three = p.secret_scan(spark, two, sf_dir).cache()
    assert three.columns == columns and three.count() == two.count()
    for r in three.collect():
        assert not [s for s in secretscan.find_spans(r.text) if s[3] != "assign"] and r.n_chars is not None
        if not secretscan.find_spans(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
    four = p.poisson_mix(spark, three, sf_dir).cache()
    assert four.columns == columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    five = p.sentencepiece(spark, four, sf_dir)
    assert five.count() == four.count()
    odd = odd_documents(spark).select(*columns)
    near = [COPY.replace("w7 ", "x7 "), COPY.replace("w50 ", "x50 ")]  # different texts of one class with one doc_id
    odd = odd.unionByName(spark.createDataFrame([(500, t, "en", "s1", 9) for t in near], odd.schema))
    rows = [(r.doc_id, r.text) for r in p.quality_rules(spark, odd, sf_dir).collect()]
    assert sorted(rows, key=str) == sorted([(r.doc_id, r.text) for r in odd.collect() if len(words(r.text)) >= 50 and "a b c" not in r.text], key=str)
    kept = p.near_dedup(spark, p.quality_rules(spark, odd, sf_dir), sf_dir).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(3, COPY)]
    for _, stage in p.STAGES:
        odd = stage(spark, odd, sf_dir)
    assert {r.doc_id for r in odd.collect()} <= {3}
