"""Mixing of sources to target weights by raking, in DataFrame operations only (operator 4).

Tokens are summed per cell (source, language, topic). Iterative proportional fitting scales the cells'
weights to the target share of every source, language and topic in turn, where no cell can give more tokens
than it has. The fitted weight of a cell against its tokens gives the probability with which its documents
are kept, and a fixed hash of doc_id draws the documents. Only the cells are raked; documents are read once to
count and once to draw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

MARGINS = ("source", "lang", "topic")
#: Markers of a topic, in order; a text with none is prose. Used where documents have no column topic.
TOPICS: Mapping[str, Sequence[str]] = {"legal": ("rights reserved", "icense"), "contact": ("@", "http"), "table": ("|",)}
OTHER_TOPIC = "prose"
#: Target share of a margin's value: its share of tokens to this power, normalised.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
WORD = r"[^ \t\n\x0B\f\r]+"
FRACTION = 0.5
#: Rounds of fitting at most, and steps for each margin in one.
ROUNDS, STEPS = 10, 2
#: Fitting ends when no share is further from what is wanted.
TOLERANCE = 1e-9
#: Cells up to this many are broadcast; beyond, they are joined with salted keys.
BROADCAST_CELLS = 200_000
SALTS = 32

Targets = Mapping[str, Mapping[str, float]]


def added(docs: DataFrame) -> dict[str, str]:
    """Names of the columns that come to docs: mix_source, mix_lang, mix_topic, mix_tokens, mix_draw, mix_rate, each
    with _ added where docs has a column of that name."""
    return {c: fresh(f"mix_{c}", docs.columns) for c in (*MARGINS, "tokens", "draw", "rate")}


def described(docs: DataFrame, topics: Mapping[str, Sequence[str]] = TOPICS) -> DataFrame:
    """docs with the columns of added() but the rate. Nulls are the value "unknown", a null text has no tokens; a
    null doc_id draws like 0. Repeated rows draw alike. A column topic is taken as it is; without one, a text's
    topic is the first of topics that one of its markers names."""
    text, names = F.coalesce("text", F.lit("")), added(docs)
    topic = F.lit(OTHER_TOPIC)
    for name, markers in reversed(topics.items()):
        found = F.lit(False)
        for m in markers:
            found = found | F.contains(text, F.lit(m))
        topic = F.when(found, name).otherwise(topic)
    if "topic" in docs.columns:
        topic = F.coalesce(F.col("topic").cast("string"), F.lit("unknown"))
    x = F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.lit(2**31)) * 2654435761 % 2**32
    x = x.bitwiseXOR(F.shiftright(x, 16)) * 73244475 % 2**32
    x = x.bitwiseXOR(F.shiftright(x, 16)) * 73244475 % 2**32
    named = {names[c]: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang")}
    return docs.withColumns(named | {names["topic"]: topic, names["tokens"]: F.regexp_count(text, F.lit(WORD)).cast("long"), names["draw"]: x / 2.0**32})


def _level(values: DataFrame) -> float:
    """The factor at which sum(least(most, factor * target)) is one, for values(target, most); 0 where they hold less."""
    factor, known = 1.0, -1
    while True:
        full = F.col("target") * factor >= F.col("most")
        r = values.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("target"))).alias("free")).first()
        if not r["free"] or r["n"] == known:
            return factor if r["free"] else float("inf")
        factor, known = (1 - r["used"]) / r["free"], r["n"]


def bounded(scratch: Scratch, cells: DataFrame, fraction: float = FRACTION, targets: Targets | None = None, rounds: int = ROUNDS, temper: Mapping[str, float] = TEMPER) -> DataFrame:
    """source, lang, topic, tokens, weight, and want_* and target_* of each margin, for cells(source, lang, topic, tokens).

    A weight is the share of the budget, `fraction` of all tokens, and at most the cell's tokens. targets gives
    shares by margin and value; a margin without is tempered. Values that have a target but no tokens are left
    out and the rest normalised; values with tokens but no target get 0. A value whose target is over all its
    tokens is wanted whole and the others in proportion (want_*). Cells at their bound stay there and the others
    take what they leave. gaps() tells what is missed where the margins together ask for too much.
    """
    cells = cells.filter("tokens > 0")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("bound", F.col("tokens") / F.lit(fraction * total)).withColumn("raw", F.col("tokens") / F.lit(float(total)))
    for m in MARGINS:
        values = cells.groupBy(m).agg(F.sum("tokens").alias("n"))
        share: Column = F.pow(F.col("n") / F.lit(float(total)), F.lit(temper[m]))
        if targets and m in targets:
            known = F.create_map(*[F.lit(v) for pair in targets[m].items() for v in pair])
            share = F.coalesce(known[F.col(m)].cast("double"), F.lit(0.0))
        values = scratch.table(values.select(m, share.alias("share"), (F.col("n") / F.lit(fraction * total)).alias("most")), f"shares-{m}")
        norm = values.agg(F.sum("share")).first()[0] or 1.0
        values = values.withColumn("target", F.col("share") / F.lit(norm))
        level = _level(values)
        want = F.col("most") if level == float("inf") else F.least("most", F.lit(level) * F.col("target"))
        out = out.join(values.select(m, F.col("target").alias(f"target_{m}"), want.alias(f"want_{m}")), m)
    # Few cells are raked in one task, without shuffles; beyond that, those of a margin's value meet in one.
    few = cells.count() <= BROADCAST_CELLS
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    out = together(scratch.table(out, "bounds"))
    given, full = F.least("bound", "raw"), F.col("raw") >= F.col("bound")
    for k in range(rounds):
        for m in MARGINS:
            for _ in range(STEPS):
                own = Window.partitionBy(m)
                sums = {"given": F.sum(given).over(own), "used": F.sum(F.when(full, F.col("bound")).otherwise(0.0)).over(own), "free": F.sum(F.when(full, 0.0).otherwise(F.col("raw"))).over(own)}
                want = F.col(f"want_{m}")
                factor = F.when(F.col("given") > want, want / F.col("given")).when(F.col("free") > 0, (want - F.col("used")) / F.col("free")).otherwise(1.0)
                out = out.withColumns(sums).withColumn("raw", F.col("raw") * factor).drop(*sums)
        out = together(scratch.table(out, f"raked-{k}"))
        if k and gaps(out.withColumn("weight", given), "want").filter(F.abs("gap") > TOLERANCE).isEmpty():
            break
    return out.select(*MARGINS, "tokens", given.alias("weight"), *[f"want_{m}" for m in MARGINS], *[f"target_{m}" for m in MARGINS])


def gaps(cells: DataFrame, of: str = "target") -> DataFrame:
    """margin, value, target (or want), drawn, gap of bounded(): shares of the budget, asked for and expected."""
    parts = [cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"{of}_{m}").alias(of), F.sum("weight").alias("drawn")) for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("gap", F.col("drawn") - F.col(of))


def mixed(scratch: Scratch, docs: DataFrame, fraction: float = FRACTION, targets: Targets | None = None, rounds: int = ROUNDS, topics: Mapping[str, Sequence[str]] = TOPICS) -> DataFrame:
    """The documents drawn, with all their columns and those of added().

    The expected tokens are `fraction` of all, in shares of bounded(). Texts without tokens have no weight and
    are kept with probability 1. An empty table gives an empty one.
    """
    names = added(docs)
    keys, rate, marked = [names[m] for m in MARGINS], names["rate"], described(docs, topics)
    cells = marked.groupBy(*[F.col(names[m]).alias(m) for m in MARGINS]).agg(F.sum(names["tokens"]).alias("tokens"))
    cells = scratch.table(cells, "cells")
    budget = fraction * (cells.agg(F.sum("tokens")).first()[0] or 0)
    rates = bounded(scratch, cells, fraction, targets, rounds).withColumn("rate", F.least(F.lit(1.0), F.lit(budget) * F.col("weight") / F.col("tokens")))
    rates = scratch.table(rates.select(*[F.col(m).alias(names[m]) for m in MARGINS], F.col("rate").alias(rate)), "rates")
    if rates.count() <= BROADCAST_CELLS:
        joined = marked.join(F.broadcast(rates), keys, "left")
    else:
        salt = fresh("mix_salt", marked.columns)
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, salt], "left").drop(salt)
    joined = joined.withColumn(rate, F.coalesce(rate, F.lit(1.0)))
    return joined.filter((F.col(names["tokens"]) == 0) | (F.col(names["draw"]) < F.col(rate))).select(*docs.columns, *names.values())


def mixed_rows(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability of the documents drawn."""
    docs = docs.select("doc_id", "text", "source", "lang")
    rate = F.when(F.col("mix_tokens") == 0, 1.0).otherwise(F.round("mix_rate", 5))
    return mixed(scratch, docs).select("doc_id", *[F.col(f"mix_{m}").alias(m) for m in MARGINS], F.col("mix_tokens").alias("n_tokens"), rate.alias("probability"))


def oracle(table: str = "documents", fraction: float = FRACTION, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, ending in a CTE drawn(all columns of the table, mix_*)."""
    topic = " ".join(f"WHEN {' OR '.join(f"contains(coalesce(text, ''), '{m}')" for m in ms)} THEN '{t}'" for t, ms in TOPICS.items())
    mix = "(xor({x}, {x} >> 16) * 73244475) % 4294967296"
    steps = [
        f"seeded AS (SELECT *, ((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648 * 2654435761) % 4294967296 AS x0 FROM {table})",
        f"mixed1 AS (SELECT *, {mix.format(x='x0')} AS x1 FROM seeded)",
        f"mixed2 AS (SELECT *, {mix.format(x='x1')} AS x2 FROM mixed1)",
        f"""marked AS (SELECT *, coalesce(source, 'unknown') AS mix_source, coalesce(lang, 'unknown') AS mix_lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS mix_topic,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS mix_tokens, x2 / 4294967296.0::DOUBLE AS mix_draw FROM mixed2)""",
        "cells AS (SELECT mix_source AS source, mix_lang AS lang, mix_topic AS topic, sum(mix_tokens)::DOUBLE AS tokens FROM marked GROUP BY ALL HAVING sum(mix_tokens) > 0)",
    ]
    for m in MARGINS:
        # The values whose target is over all they have are the first ones by most / target.
        steps += [
            f"values_{m} AS (SELECT {m}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {TEMPER[m]}::DOUBLE) AS share, sum(tokens) / ({fraction}::DOUBLE * (SELECT sum(tokens) FROM cells)) AS most FROM cells GROUP BY {m})",
            f"aims_{m} AS (SELECT *, share / sum(share) OVER () AS target FROM values_{m})",
            f"levels_{m} AS (SELECT *, (1 - coalesce(sum(most) OVER before, 0)) / (1 - coalesce(sum(target) OVER before, 0)) AS level FROM aims_{m} WINDOW before AS (ORDER BY most / target, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"wants_{m} AS (SELECT {m}, target AS target_{m}, least(most, (SELECT arg_min(level, most / target) FROM levels_{m} WHERE level * target < most) * target) AS want_{m} FROM aims_{m})",
        ]
    steps.append(f"w0 AS MATERIALIZED (SELECT *, tokens / ({fraction}::DOUBLE * (SELECT sum(tokens) FROM cells)) AS bound, tokens / (SELECT sum(tokens) FROM cells) AS raw FROM cells JOIN wants_source USING (source) JOIN wants_lang USING (lang) JOIN wants_topic USING (topic))")
    k = 0
    for m in [m for _ in range(rounds) for m in MARGINS for _ in range(STEPS)]:
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (given, used, free) REPLACE (raw * CASE WHEN given > want_{m} THEN want_{m} / given WHEN free > 0 THEN (want_{m} - used) / free ELSE 1.0 END AS raw) FROM (SELECT *, sum(least(bound, raw)) OVER own AS given, "
            f"sum(CASE WHEN raw >= bound THEN bound ELSE 0 END) OVER own AS used, sum(CASE WHEN raw >= bound THEN 0 ELSE raw END) OVER own AS free FROM w{k} WINDOW own AS (PARTITION BY {m})))"
        )
        k += 1
    steps.append(f"rates AS (SELECT source AS mix_source, lang AS mix_lang, topic AS mix_topic, least(1.0::DOUBLE, {fraction}::DOUBLE * (SELECT sum(tokens) FROM cells) * least(bound, raw) / tokens) AS mix_rate FROM w{k})")
    steps.append("drawn AS (SELECT * FROM marked LEFT JOIN rates USING (mix_source, mix_lang, mix_topic) WHERE mix_tokens = 0 OR mix_draw < mix_rate)")
    return "WITH " + ",\n".join(steps)


ORACLE = oracle() + "\nSELECT doc_id, mix_source AS source, mix_lang AS lang, mix_topic AS topic, mix_tokens AS n_tokens, CASE WHEN mix_tokens = 0 THEN 1.0::DOUBLE ELSE round(mix_rate, 5) END AS probability FROM drawn"
