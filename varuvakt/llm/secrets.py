"""Secrets in texts, found through a trigram index.

Each rule's expression gives a Boolean trigram query: a disjunction of sets of
trigrams (in lower case) that any match holds. The index keeps, for the trigrams of all queries, the documents that hold them;
postings are intersected per alternative, and the expressions verify only the candidates. A rule of which some
alternative has no trigram is run over every text.

Everything is Column expressions and joins; texts are never shuffled unless the candidates outgrow a broadcast, which Spark
decides by the size of their stored table.

Cases: a null text is an empty one. Rows with the same or no doc_id share their candidates, which are verified row by row. An
empty table gives no rows; other columns are left behind by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re._constants as op
import re._parser as expressions

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import columns_of, fresh, stored, texts_of
from varuvakt.llm.spans import bound, match_spans, no_spans, part_of, pieces_of, running

#: A key up to its END line, none beginning or ending before it; without one, the header, its fields and the base64 lines that follow,
#: of which the last may be short. Lines may be quoted, commented or joined by written-out line ends. Possessive loops do not recurse.
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:\\[nrt]|[\s\"',#*>|])++(?:Proc-Type|DEK-Info):[^\r\n\\\"']*+)*+"
    r"(?:(?:(?:\\[nrt]|[\s\"',#*>|])++[A-Za-z0-9+/=]{20,}+)++"
    r"(?:[ \t\"',+]*+(?:\\r|\r)?+(?:\\n|\n)[ \t\"',#*>|]*+[A-Za-z0-9+/=]++(?=[ \t\"',]*(?:\\[nrt]|[\r\n]|$)))?+)?+)"
)
#: Fixed rules: kind, expression, group whose length counts, least length. The first three are the base.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", PEM, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("login", r"://[^\s:/@]+:[^\s:/@]{3,}@[A-Za-z0-9]", 0, 0),
)
BASE = 3
#: Alternatives up to which an expression is written out, and members up to which a class is.
MOST_ALTERNATIVES, MOST_MEMBERS = 512, 6
REDACTED = "[SECRET]"


def alternatives(tree) -> list[tuple[str | None, ...]]:
    """Ways to read an expression: characters, and None where anything may stand."""
    ways: list[tuple[str | None, ...]] = [()]
    for kind, value in tree:
        if kind is op.LITERAL:
            here = [(chr(value),)]
        elif kind is op.SUBPATTERN:
            here = alternatives(value[3])
        elif kind is op.BRANCH:
            here = [way for branch in value[1] for way in alternatives(branch)]
        elif kind is op.IN and len(value) <= MOST_MEMBERS and all(k is op.LITERAL for k, _ in value):
            here = [(chr(v),) for _, v in value]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            once = alternatives(inner)
            if most == 1 and least == 0:
                here = [(), *once]
            elif least == 0:
                here = [(None,)]
            elif least == most and least * len(once) <= 8 and len(once) == 1:
                here = [once[0] * least]
            else:
                here = [way + (None,) + way for way in once] if least > 1 and len(once) == 1 else [way + (None,) for way in once]
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            here = [()]
        else:
            here = [(None,)]
        ways = [a + b for a in ways for b in here]
        if len(ways) > MOST_ALTERNATIVES:
            return [(None,)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, one of which all lie in the lower-cased text around any match; empty if there is no such query."""
    query = set()
    for way in alternatives(expressions.parse(pattern)):
        runs = "".join("\n\n" if c is None else c.lower() for c in way).split("\n\n")
        grams = frozenset(run[k : k + 3] for run in runs for k in range(len(run) - 2))
        if not grams:
            return []
        query.add(grams)
    return sorted((q for q in query if not any(other < q for other in query)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over the lower-cased texts."""
    lower = F.lower("text")  # holds every ASCII lower-cased trigram
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("__lower"), t))
    return texts_of(docs).select("doc_id", lower.alias("__lower")).select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """doc_id, rules: bit r is set where all trigrams of an alternative of rule r have postings of the document."""
    clauses = [(r, c, gram, len(grams)) for r, query in queries.items() for c, grams in enumerate(query) for gram in sorted(grams)]
    needed = index.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, need int")
    met = index.distinct().join(F.broadcast(needed), "trigram").groupBy("doc_id", "rule", "clause").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return met.where("n = need").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))


def with_spans(docs: DataFrame, name: str, rules=RULES) -> DataFrame:
    """``docs`` with a further column: per rule an array of struct(start, end, match), in the rules' order."""
    queries = {r: query for r, (_, pattern, _, _) in enumerate(rules) if (query := trigram_query(pattern))}
    grams = sorted({g for query in queries.values() for clause in query for g in clause})
    key, held = fresh(docs, "candidate"), fresh(docs, "held")
    found = stored(candidates(trigram_index(docs, grams), queries).select(F.col("doc_id").alias(key), F.col("rules").alias(held)), "secret-candidates")
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    text = F.coalesce("text", F.lit(""))

    def spans(r: int) -> Column:
        _, pattern, group, least = rules[r]
        every = match_spans(text, pattern)
        if least:
            every = F.filter(every, lambda s: F.length(F.regexp_extract(s["match"], pattern, group)) >= least)
        if r not in queries:
            return F.when(F.regexp_like(text, F.lit(pattern)), every).otherwise(no_spans())
        return F.when(F.col(held).bitwiseAND(F.lit(1 << r)) != 0, every).otherwise(no_spans())

    return joined.withColumn(name, F.array(*map(spans, range(len(rules))))).drop(key, held)


def listed(spans: Column, rules) -> Column:
    """kind:start:end by start, then rule, comma-joined."""
    flat = F.flatten(F.transform(spans, lambda own, r: F.transform(own, lambda s: F.struct(s["start"], r.alias("rule"), s["end"]))))
    names = F.array(*[F.lit(rule[0]) for rule in rules])
    return F.array_join(F.transform(F.array_sort(flat), lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = with_spans(texts_of(docs), "found", rules)
    counts = [F.size(F.get("found", F.lit(r))).cast("long").alias(f"n_{rules[r][0]}") for r in range(BASE)]
    base = listed(F.slice("found", 1, BASE), rules)
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; ``n_chars``, where it is there and known, counts the new text."""
    columns = docs.columns
    spans = fresh(docs, "spans")
    flat = F.array_sort(F.transform(F.flatten(spans), lambda s: F.struct(s["start"], s["end"])))

    def step(at: Column, s: Column) -> Column:
        # What stands between the spans, and whether a mark follows it: a span inside earlier ones gets none.
        cut = F.struct(at.alias("start"), F.greatest(s["start"] - at, F.lit(0)).alias("length"), ((s["start"] >= at) & (s["end"] > at)).alias("marked"))
        return F.struct(F.greatest(at, s["end"]).alias("state"), cut.alias("out"))

    end = F.struct(F.length("text").alias("start"), F.lit(0).alias("end"))  # the rest of the text, without a mark
    cuts = running(F.concat(flat, F.array(end)), F.lit(0), step, "struct<start:int,length:int,marked:boolean>")
    clean = bound(
        pieces_of(F.col("text")),
        lambda pieces: F.array_join(F.transform(cuts, lambda c: F.concat(part_of(pieces, c["start"], c["length"]), F.when(c["marked"], REDACTED).otherwise(""))), ""),
    )
    rows = with_spans(docs, spans, rules)
    found = F.size(F.flatten(spans)) > 0
    changed = {"text": F.when(found, clean).otherwise(F.col("text"))}
    if "n_chars" in columns:
        counted = F.length(clean).cast(dict(docs.dtypes)["n_chars"])
        changed["n_chars"] = F.when(found & F.col("n_chars").isNotNull(), counted).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(*columns_of(columns))
