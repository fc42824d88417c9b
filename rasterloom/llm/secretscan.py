"""Secret scans by a trigram inverted index, in SQL functions alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser

from rasterloom.llm.common import small_table


@dataclass(frozen=True)
class Rule:
    """kind: name in the results. pattern: leftmost non-overlapping matches. value_chars: least length of
    group `group` for a match to count, judged after matching."""

    kind: str
    pattern: str
    group: int = 0
    value_chars: int = 0


#: The base kinds in their order. A run of [A-Z0-9] or [0-9a-f] is taken whole by its first match, so that
#: the least length may stand in the pattern; for `assign` it may not, as a short match hides later starts.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
SMALL_CLASS = 5


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams that each match of the pattern satisfies; None if there is none.

    The parse tree is that of Python's own parser, re._parser, which is private: Python 3.11 to 3.13 have it.

    The parse tree is walked with a list of alternatives, each a list of literal fragments. Literals, small
    classes and branches grow the last fragment; whatever can vary freely closes it."""

    def grow(alts: list[tuple], tree) -> list[tuple]:
        for op, arg in tree:
            if op is C.LITERAL:
                alts = [(*a[:-1], a[-1] + chr(arg)) for a in alts]
            elif op is C.BRANCH:
                alts = [b for branch in arg[1] for b in grow(alts, branch)]
            elif op is C.SUBPATTERN:
                alts = grow(alts, arg[-1])
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= SMALL_CLASS:
                alts = [(*a[:-1], a[-1] + chr(c)) for a in alts for _, c in arg]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = arg
                literal = all(o is C.LITERAL for o, _ in inner)
                if (low, high) == (0, 1) and literal:
                    alts = alts + grow(alts, inner)
                elif low == high and literal and low * len(inner) <= 16:
                    for _ in range(low):
                        alts = grow(alts, inner)
                elif low > 0:
                    alts = [(*a, "") for a in grow(alts, inner)]
                else:
                    alts = [(*a, "") for a in alts]
            elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
                pass
            else:
                alts = [(*a, "") for a in alts]
            if len(alts) > 64:
                alts = [("",)]
        return alts

    sets = {frozenset(f[i : i + 3].lower() for f in a for i in range(len(f) - 2)) for a in grow([("",)], _parser.parse(pattern))}
    return None if frozenset() in sets else sorted(sets, key=sorted)


def queries_of(rules: tuple[Rule, ...]) -> dict[int, list[frozenset[str]] | None]:
    return {i: trigram_query(r.pattern) for i, r in enumerate(rules)}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(k, trigram): which of the trigrams that some rule asks for each document of docs(k, text) holds."""
    low = docs.select("k", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)))
    return low.select("k", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(k, rules): which rules' Boolean trigram queries each document satisfies; None if no rule has one.

    The queries are a small table (a row for each rule, alternative and trigram), joined to the postings; an
    alternative whose count of distinct trigrams is complete makes the document a candidate. A document's set
    of trigrams is at most those that the rules name; all steps after it stay in its partition."""
    clauses = [(i, j, t, len(s)) for i, q in queries_of(rules).items() if q for j, s in enumerate(q) for t in sorted(s)]
    if not clauses:
        return None
    table = small_table(docs.sparkSession, clauses, "rule int, alternative int, trigram string, need int")
    # Rows repeated whole have one k, so trigrams are made distinct first.
    held = postings(docs, sorted({c[2] for c in clauses})).groupBy("k").agg(F.collect_set("trigram").alias("trigrams"))
    hits = held.select("k", F.explode("trigrams").alias("trigram")).join(F.broadcast(table), "trigram")
    met = hits.groupBy("k", "rule", "alternative", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    return met.groupBy("k").agg(F.collect_set("rule").alias("rules"))


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match in turn: characters before it since the last one, of the match, and of its value."""
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    if not rule.group:
        return F.transform(sizes, lambda x: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.lit(True).alias("ok")))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return F.zip_with(sizes, values, lambda x, v: F.struct(x["g"].alias("g"), x["h"].alias("h"), (F.length(v) >= rule.value_chars).alias("ok")))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """Spans of secrets in each whole text.

    In: docs(doc_id, text, any more). Out: doc_id and spans, array<struct<start, kind_no, end, kind>> sorted, in
    code points with the end exclusive, rule by rule leftmost non-overlapping; with carry, the columns of
    docs in a struct __row too. One row per input row; a null text counts as empty. Rules with a Boolean
    trigram query are verified in its candidates alone, the others in every text."""
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")] if carry else []
    docs = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *rest)
    found = candidates(docs.select("k", "text"), rules)
    rows = docs.withColumn("rules", F.lit(None).cast("array<int>")) if found is None else docs.join(found, "k", "left")
    same = Window.partitionBy("k").orderBy("k")
    rows = rows.withColumn("copy", F.row_number().over(same))
    queries = queries_of(rules)
    none = F.array().cast("array<struct<g:int,h:int,ok:boolean>>")
    each = []
    for i, r in enumerate(rules):
        pieces = _pieces(F.col("text"), r)
        if queries[i]:
            pieces = F.when(F.array_contains("rules", i), pieces).otherwise(none)
        each.append(pieces.alias(f"m{i}"))
    rows = rows.select("k", "copy", "doc_id", *(["__row"] if carry else []), *each)
    # Places are running sums over a text's matches: a window over them, within the task that has the text.
    def numbered(i: int) -> Column:
        return F.transform(F.col(f"m{i}"), lambda x, n: F.struct(F.lit(i).alias("kind_no"), n.alias("n"), x["g"].alias("g"), x["h"].alias("h"), x["ok"].alias("ok")))

    matches = F.concat(*(numbered(i) for i in range(len(rules))))
    rows = rows.select("k", "copy", "doc_id", *(["__row"] if carry else []), F.posexplode_outer(matches).alias("p", "m"))
    kept = [F.when(F.coalesce("p", F.lit(0)) == 0, F.col("__row")).alias("__row")] if carry else []  # once, not with each match
    rows = rows.select("k", "copy", "doc_id", *kept, "m.*")
    order = Window.partitionBy("k", "copy", "kind_no").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("g") + F.col("h")).over(order))
    names = F.array(*(F.lit(r.kind) for r in rules))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("h")).alias("start"), "kind_no", "end", F.get(names, F.col("kind_no")).alias("kind")))
    out = [F.first("__row", ignorenulls=True).alias("__row")] if carry else []
    rows = rows.groupBy("k", "copy").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"), *out)
    return rows.select("doc_id", *(["__row"] if carry else []), "spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each maximal stretch of spans replaced by mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))


def find_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """The same by brute force, for tests: (start, rule number, end, kind), sorted."""
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern.replace("(?i:", "(?ai:"), text):
            if len(m.group(r.group)) >= r.value_chars:
                out.append((m.start(), i, m.end(), r.kind))
    return sorted(out)
