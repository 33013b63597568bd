"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides. SQL functions only.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Documents
with the same votes are counted together, so that expectation-maximisation
works on at most 3 to the power of the rules' number of patterns, whatever the
corpus. It estimates how often each rule votes what on clean and on junk
documents (its accuracy for either class) and the share of clean ones; a
vote not given is no evidence. A document is kept if its posterior probability of being clean is at least half.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import WORD, stored, table

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rounds of EM; pseudo-observations of the vote shares below, as a share of all documents.
ROUNDS, STRENGTH = 30, 0.01
#: A rule calls at most this share of clean documents bad, by its design; keeps EM from explaining one kind of junk as clean.
MOST_FALSE_ALARMS = 0.01
#: Shares of bad, no and good votes that a rule is held to have at the start, on clean and on junk documents.
CLEAN_VOTES, JUNK_VOTES = (0.002, 0.30, 0.698), (0.15, 0.25, 0.60)
#: Rule -> (bad, good) as SQL over the measures; neither: it abstains.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "capitals": ("n_capitals > 0.3 * word_chars", "n_capitals < 0.15 * word_chars"),
    "exclamations": ("n_exclamations > 0.2 * n_words", "n_exclamations < 0.05 * n_words"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    "vocabulary": ("n_words between 50 and 2000 and n_distinct < 0.3 * n_words", "n_words between 50 and 2000 and n_distinct > 0.5 * n_words"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 11 * n_words", "word_chars between 3.5 * n_words and 6.5 * n_words"),
    "endings": ("n_lines >= 3 and n_ended < 0.3 * n_lines", "n_ended >= 0.8 * n_lines"),
}


def _let(value: str, name: str, use: str) -> str:
    """SQL for use with name bound to value, which is evaluated once for a row."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _repeated() -> str:
    """SQL over words w: words in windows of three that occur twice or more.

    Windows are told apart by a 64-bit hash. Only texts with a repeated one
    sort them with their places; runs of equal hashes give the starts, and each
    start covers three words less what the next one covers too.
    """
    windows = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    placed = "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))"
    starts = "sort_array(filter(transform(s, (y, k) -> if((k > 0 and s[k - 1].x = y.x) or (k + 1 < size(s) and s[k + 1].x = y.x), y.i, null)), y -> y is not null))"
    covered = "aggregate(sequence(1, size(p)), 0L, (n, k) -> n + if(k = size(p), 3, least(3, p[k] - p[k - 1])))"
    return _let(windows, "h", f"if(size(array_distinct(h)) = size(h), 0L, {_let(placed, 's', _let(starts, 'p', covered))})")


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs and a struct __m of the measures; null is the empty text."""
    text = "coalesce(text, '')"
    pattern = WORD.replace("\\", "\\\\")
    without = lambda chars: f"length({text}) - length(translate({text}, '{chars}', ''))"
    words = _let(f"regexp_extract_all({text}, '{pattern}', 0)", "w", f"struct(size(w) as n_words, size(array_distinct(w)) as n_distinct, {_repeated()} as n_repeat_words)")
    lines = _let(f"filter(split({text}, '\\n'), x -> x rlike '{pattern}')", "x", "struct(size(x) as n_lines, size(x) - size(array_distinct(x)) as n_dup_lines, size(filter(x, y -> y rlike '[.!?…:\"]\\\\s*$')) as n_ended)")
    out = docs.select(*keep, F.expr(words).alias("__w"), F.expr(lines).alias("__l"), F.expr(f"""struct(
        length(translate({text}, ' \\t\\n\\u000b\\u000c\\r', '')) as word_chars, {without("#*$%&|<>")} as n_symbols,
        {without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} as n_capitals, {without("!")} as n_exclamations)""").alias("__c"))  # fmt: skip
    fields = [f"{struct}.{name}" for struct, names in {"__w": ("n_words", "n_distinct", "n_repeat_words"), "__l": ("n_lines", "n_dup_lines", "n_ended"), "__c": ("word_chars", "n_symbols", "n_capitals", "n_exclamations")}.items() for name in names]
    return out.select(*keep, F.struct(*[F.col(x).cast("long").alias(x.split(".")[1]) for x in fields]).alias("__m"))


def votes() -> str:
    """SQL over the measures: the rules' votes in order."""
    return "array(" + ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end" for bad, good in RULES.values()) + ")"


def posteriors(patterns: DataFrame) -> DataFrame:
    """(votes, n) -> (votes, posterior of clean), by EM in one row's higher-order functions.

    The shares of votes start from, and are drawn towards, CLEAN_VOTES and
    JUNK_VOTES; this keeps the two classes from changing places. An empty table
    gives an empty result.
    """
    shares = lambda x: "array(" + ", ".join(f"{y}D" for y in x) + ")"
    rules = f"sequence(1, {len(RULES)})"
    init = f"struct(0.8D as clean, transform({rules}, j -> {shares(CLEAN_VOTES)}) as c, transform({rules}, j -> {shares(JUNK_VOTES)}) as b)"
    odds = f"aggregate({rules}, ln(s.clean / (1 - s.clean)), (t, j) -> t + if(x.v[j - 1] = 0, 0D, ln(element_at(s.c[j - 1], x.v[j - 1] + 2) / element_at(s.b[j - 1], x.v[j - 1] + 2))))"
    posterior = f"1 / (1 + exp(-({odds})))"
    weighed = f"transform(ps, x -> struct(x.v as v, x.n * {posterior} as c, x.n as n))"
    total = lambda field: f"aggregate(q, 0D, (t, x) -> t + {field})"
    vote_shares = lambda part, prior, most: f"transform({rules}, j -> transform(array(-1, 0, 1), k -> least(if(k = -1, {most}D, 1D), (aggregate(q, 0D, (t, x) -> t + if(x.v[j - 1] = k, {part}, 0D)) + {STRENGTH}D * m * element_at({shares(prior)}, k + 2)) / ({total(part)} + {STRENGTH}D * m))))"
    step = _let(weighed, "q", f"struct(({total('x.c')} + {STRENGTH}D * m) / (m + 2 * {STRENGTH}D * m) as clean, {vote_shares('x.c', CLEAN_VOTES, MOST_FALSE_ALARMS)} as c, {vote_shares('(x.n - x.c)', JUNK_VOTES, 1.0)} as b)")
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("ps"), F.greatest(F.sum("n"), F.lit(1)).cast("double").alias("m"))
    fitted = rows.select("ps", F.expr(f"aggregate(sequence(1, {ROUNDS}), {init}, (s, r) -> {step})").alias("s"))
    return fitted.select(F.expr(f"explode(transform(ps, x -> struct(x.v as votes, {posterior} as posterior)))").alias("p")).select("p.*")


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, the measures (struct __m), votes, posterior, base_failed and kept.

    An empty or null text fails the base rules. Repeated rows count as often as
    they occur, and each is judged for itself; a posterior of one half is clean.
    Texts are measured whole at any length. An empty table gives an empty result.
    """
    seen = measures(docs, keep).select(*keep, "__m", *[F.col("__m")[x].alias(f"__m_{x}") for x in ("n_words", "n_repeat_words")])
    names = {f.name for f in seen.schema["__m"].dataType}
    voted = re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", r"__m.\1", votes())
    failed = (F.col("__m_n_words") < LEAST_WORDS) | (100 * F.col("__m_n_repeat_words") > MOST_REPEATED * F.col("__m_n_words"))
    seen = stored(seen.withColumn("__votes", F.expr(voted)), "quality")
    # What the base rules reject is decided; the rules are weighed on the rest.
    found = posteriors(seen.groupBy(F.col("__votes").alias("votes")).agg(F.sum((~failed).cast("long")).alias("n")))
    # At most 3 to the power of the rules' number of rows.
    out = seen.join(F.broadcast(found.withColumnsRenamed({"votes": "__v", "posterior": "__posterior"})), F.col("__votes") == F.col("__v"))
    return out.select(*keep, "__m", F.col("__votes"), F.col("__posterior"), failed.alias("__base_failed"), (~failed & (F.col("__posterior") >= 0.5)).alias("__kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged for documents: nulls, ties, repeats, long texts and empty tables as stated there.

    The vocabulary rule abstains on texts of over 2,000 words, where few distinct words are no sign of junk.
    """
    found = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [F.col("__m")[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *base, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def _oracle() -> str:
    """The same measures, rules and rounds of EM as a chain of tables: patterns and rules as rows."""
    names = list(RULES)
    vote = lambda bad, good: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    start = ", ".join(f"({j}, {v}, {CLEAN_VOTES[v + 1]}::DOUBLE, {JUNK_VOTES[v + 1]}::DOUBLE)" for j in range(len(names)) for v in (-1, 0, 1))
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)",
        r"w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d)",
        "g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))",
        "again AS (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1)",
        "rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g JOIN again USING (r, g), range(0, 3) t(k) GROUP BY r)",
        r"""m AS MATERIALIZED (SELECT r, doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(rep.n, 0) AS n_repeat_words, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines,
          len(list_filter(x, lambda y: regexp_matches(y, '[.!?…:"]\s*$'))) AS n_ended, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
          length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
          length(text) - length(replace(text, '!', '')) AS n_exclamations FROM d JOIN w USING (r) LEFT JOIN rep USING (r))""",
        f"v AS MATERIALIZED (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, [{', '.join(vote(*RULES[x]) for x in names)}] AS votes FROM m)",
        "p AS MATERIALIZED (SELECT votes, count(*) FILTER (WHERE NOT base_failed) AS n FROM v GROUP BY votes)",
        f"u AS MATERIALIZED (SELECT votes, n, j, votes[j + 1] AS k FROM p, range(0, {len(names)}) t(j))",
        "size AS (SELECT greatest(sum(n), 1)::DOUBLE AS m FROM p)",
        f"s0 AS MATERIALIZED (SELECT * FROM (VALUES {start}) AS t(j, k, c, b))", "c0 AS (SELECT 0.8::DOUBLE AS clean)",
    ]
    posterior = lambda i: f"SELECT votes, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln(clean / (1 - clean))) + sum(CASE WHEN k = 0 THEN 0 ELSE ln(c / b) END)))) AS q FROM u JOIN s{i} USING (j, k), c{i} GROUP BY votes"
    for i in range(ROUNDS):
        ctes += [
            f"q{i} AS MATERIALIZED ({posterior(i)})",
            f"""s{i + 1} AS MATERIALIZED (SELECT z.j, z.k, least(CASE WHEN z.k = -1 THEN {MOST_FALSE_ALARMS} ELSE 1 END, (coalesce(any_value(a.c), 0) + {STRENGTH} * any_value(m) * any_value(z.c)) / (any_value(t.c) + {STRENGTH} * any_value(m))) AS c,
              (coalesce(any_value(a.b), 0) + {STRENGTH} * any_value(m) * any_value(z.b)) / (any_value(t.b) + {STRENGTH} * any_value(m)) AS b
              FROM s0 AS z LEFT JOIN (SELECT j, k, sum(u.n * q) AS c, sum(u.n * (1 - q)) AS b FROM u JOIN q{i} USING (votes) GROUP BY j, k) AS a ON a.j = z.j AND a.k = z.k, (SELECT sum(n * q) AS c, sum(n * (1 - q)) AS b FROM q{i}) AS t, size GROUP BY z.j, z.k)""",
            f"c{i + 1} AS MATERIALIZED (SELECT (sum(n * q) + {STRENGTH} * any_value(m)) / (any_value(m) + 2 * {STRENGTH} * any_value(m)) AS clean FROM q{i}, size)",
        ]
    ctes.append(f"last AS MATERIALIZED ({posterior(ROUNDS)})")
    base = ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return f"WITH {', '.join(ctes)} SELECT doc_id, {base}, base_failed, NOT base_failed AND q >= 0.5 AS kept FROM v JOIN last USING (votes)"


ORACLE_SQL = _oracle()
