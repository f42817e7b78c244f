"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Each document gets signals (symbol density, share of upper-case letters, mean
word length, repeated lines, repeated words, table bars, exclamation marks). A
rule rejects when its signal passes a cutoff. The cutoffs are not guessed:
labelled good documents that pass the base rules form a holdout in each stratum: one row for each text, however
many documents are copies of it, in two halves by a digest of the text, so that no text that chose a
cutoff also certifies it. On the first half each rule takes the strictest cutoff that rejects at most
``alpha`` divided by the number of rules. The second half, which chose nothing, certifies
the rules together: at level 0 all have their cutoffs, at each further level all are one
step of their grids more lenient (a rule beyond its grid is off). A level is eligible only if the exact binomial test rejects
"the rules together reject ``alpha`` of the good documents, or more" at level ``delta`` divided by the number
of hypotheses (strata x levels, Bonferroni). Of the eligible levels the strictest is used; a stratum
without one has no rules but the base, so clean documents stay. So with probability
1 - ``delta`` the rules together reject less than ``alpha`` of the good documents of
every stratum at once.

Defined cases: null text counts as empty (0 words, base failed); a null stratum
is the stratum ``''``; labels without a document, or with null quality, count
for nothing; repeated labels count once for each (doc_id, quality); repeated
documents are judged alike, each on its own row, and count once in the holdout; an
empty table gives an empty result; extra columns are carried if they are named, but for those
called __q_*, __cuts, __s, __stratum, __base_failed or __kept, whose place the results take.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Fixed by the contract of the base rules.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Largest allowed share of a stratum's good documents that all rules together reject, and the error level over all strata.
ALPHA, DELTA = 0.02, 0.05

#: Rule -> cutoffs from strict to lenient; a document is rejected when its signal is above the cutoff.
GRID: dict[str, list[float]] = {
    "symbols_per_word": [0.05, 0.1, 0.25, 0.5, 1.0, 2.0],
    "upper_share": [0.2, 0.3, 0.5, 0.7, 0.9],
    "mean_word_chars": [6.5, 7.0, 8.0, 10.0, 15.0],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5, 0.8],
    "repeat_word_share": [0.05, 0.1, 0.15],
    "marks_per_word": [0.2, 0.5, 0.8, 1.5],
}
#: Steps of leniency that are tested.
LEVELS = max(map(len, GRID.values()))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _repeat_starts(pairs: Column, n: Column) -> Column:
    """Ascending positions of the windows whose hash occurs twice or more. pairs: a column of sorted (h, p)."""

    def twice(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.try_element_at(pairs, F.greatest(i, F.lit(1)))["h"] == x["h"])
        after = (i < n - 1) & (F.try_element_at(pairs, i + 2)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["p"]))


def with_metrics(docs: DataFrame, text_col: str, prefix: str = "__q_") -> DataFrame:
    """Add the base metrics and the signals as columns with ``prefix``."""
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(f"{p}w", _words(text))
    df = df.withColumn(f"{p}n_words", F.size(f"{p}w").cast("long"))
    w = F.col(f"{p}w")
    # Windows as hashes of the words' hashes: one pass over the words, one over the positions.
    df = df.withColumn(f"{p}h", F.transform(w, lambda x: F.xxhash64(x)))
    h = F.col(f"{p}h")
    df = df.withColumn(
        f"{p}g",
        F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
                lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(WINDOW)]),
            ),
        ),
    )
    g = F.col(f"{p}g")
    # A column of its own: inside a lambda an expression would be evaluated for each element.
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn(f"{p}r", F.when(F.size(F.array_distinct(g)) < F.size(g), pairs))
    df = df.withColumn(f"{p}k", F.size(f"{p}r"))
    df = df.withColumn(f"{p}s", _repeat_starts(F.col(f"{p}r"), F.col(f"{p}k")))
    s = F.col(f"{p}s")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(f"{p}l", lines)
    covered = F.aggregate(
        s,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    joined = F.array_join(w, "")
    count_of = lambda chars: F.length(joined) - F.length(F.translate(joined, chars, ""))
    upper = F.length(F.regexp_replace(joined, r"[^\p{Lu}]", ""))
    df = df.withColumns(
        {
            f"{p}word_chars": F.length(joined).cast("long"),
            f"{p}n_symbols": count_of(SYMBOLS).cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
            f"{p}n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            f"{p}n_lines": F.size(f"{p}l").cast("long"),
            f"{p}n_marks": count_of("!|").cast("long"),
            f"{p}n_upper": upper.cast("long"),
            f"{p}text": F.md5(text.cast("binary")),
        }
    )
    return df.drop(*[f"{p}{x}" for x in "whgrksl"])


def signals(prefix: str = "__q_") -> dict[str, Column]:
    c = lambda x: F.col(prefix + x)
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "symbols_per_word": share(c("n_symbols"), c("n_words")),
        "upper_share": share(c("n_upper"), c("word_chars")),
        "mean_word_chars": share(c("word_chars"), c("n_words")),
        "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
        "repeat_word_share": share(c("n_repeat_words"), c("n_words")),
        "marks_per_word": share(c("n_marks"), c("n_words")),
    }


def base_failed(prefix: str = "__q_") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * n)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly summed in log space; only for k < n * p."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("t"), (n * math.log1p(-p)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    ks = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(ks, start, step, lambda a: a["s"]))


def fit_cutoffs(spark: SparkSession, scored: DataFrame, labels: DataFrame, id_col: str, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(__stratum, rule, cutoff): the cutoffs of each stratum's strictest certified level."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__id")).distinct()
    held = scored.join(good, scored[id_col] == good["__id"], "left_semi").where(~base_failed())
    half = F.conv(F.substring("__q_text", 1, 2), 16, 10).cast("int") % 2
    held = held.select(F.coalesce(F.col(stratum), F.lit("")).alias("__stratum"), "__q_text", half.alias("half"), *[x.alias(rule) for rule, x in signals().items()])
    # Copies of one text are one row: their signals are equal.
    held = materialize(spark, held.distinct().drop("__q_text"), "holdout")
    each = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("at"), (F.col(rule) > float(cut)).alias("out")) for rule, cuts in GRID.items() for i, cut in enumerate(cuts)]
    counts = held.where("half = 0").select("__stratum", F.explode(F.array(*each)).alias("x")).groupBy("__stratum", "x.rule", "x.at").agg(F.count("*").alias("n"), F.count_if("x.out").alias("k"))
    chosen = counts.where(F.col("k") <= F.col("n") * F.lit(alpha / len(GRID))).groupBy("__stratum", "rule").agg(F.min("at").alias("at"))
    chosen = materialize(spark, chosen, "rule-choice")  # strata x rules rows
    # One entry for each rule.
    picks = chosen.groupBy("__stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "at"))).alias("at"))

    def out(level: int) -> Column:
        cut = lambda rule: _cutoff(rule, F.try_element_at("at", F.lit(rule)) + level)
        return reduce(or_, [F.coalesce(F.col(rule) > cut(rule), F.lit(False)) for rule in GRID])

    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), out(i).alias("out")) for i in range(LEVELS)]))
    tested = held.where("half = 1").join(picks, "__stratum").select("__stratum", levels.alias("x")).groupBy("__stratum", "x.level").agg(F.count("*").alias("n"), F.count_if("x.out").alias("k"))
    tested = materialize(spark, tested, "rule-levels")  # strata x levels rows
    hypotheses = max(1, tested.count())
    tail = F.when(F.col("k") < F.col("n") * alpha, binomial_tail(F.col("k"), F.col("n"), alpha))
    passed = tested.where(tail <= F.lit(delta / hypotheses)).groupBy("__stratum").agg(F.min("level").alias("level"))
    at = F.col("at") + F.col("level")
    cutoff = reduce(lambda x, rule: x.when(F.col("rule") == rule, _cutoff(rule, at)), GRID, F)
    return chosen.join(passed, "__stratum").select("__stratum", "rule", cutoff.alias("cutoff")).where("cutoff IS NOT NULL")


def _cutoff(rule: str, at: Column) -> Column:
    """The rule's cutoff at a place of its grid, null beyond it."""
    return F.try_element_at(F.array(*[F.lit(float(x)) for x in GRID[rule]]), (at + 1).cast("int"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The ``carry`` columns of each document, its metrics (``__q_*``), ``__base_failed`` and ``__kept``.

    The signals are written once to the shared folder: fitting reads the labelled
    rows of that table, applying reads all of it. The cutoffs have at most
    rules x strata rows; Spark broadcasts them when they are small and joins by
    stratum otherwise.
    """
    names = [n for n in dict.fromkeys([*carry, id_col, stratum]) if not n.startswith("__q_") and n not in ("__cuts", "__s", "__stratum", "__base_failed", "__kept")]
    scored = materialize(spark, _scored(docs, names, text_col), "quality")
    cuts = fit_cutoffs(spark, scored, labels, id_col, stratum).groupBy("__stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cuts"))
    cuts = materialize(spark, cuts, "cutoffs")
    out = scored.withColumn("__s", F.coalesce(F.col(stratum), F.lit(""))).join(cuts, F.col("__s") == F.col("__stratum"), "left")
    hit = F.lit(False)
    for rule, value in signals().items():
        hit = hit | F.coalesce(value > F.try_element_at("__cuts", F.lit(rule)), F.lit(False))
    return out.withColumn("__base_failed", base_failed()).withColumn("__kept", ~(base_failed() | hit))


def _scored(docs: DataFrame, names: list[str], text_col: str) -> DataFrame:
    df = with_metrics(docs.select(*dict.fromkeys([*names, text_col])), text_col)
    return df.select(*names, *[c for c in df.columns if c.startswith("__q_")])


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    carry = [c for c in docs.columns if not c.startswith("__q_") and c not in ("__cuts", "__s", "__stratum", "__base_failed", "__kept")]
    return judge(spark, docs, labels, carry).where("__kept").select(*carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = judge(spark, docs.select("doc_id", "text", "lang"), labels, ["doc_id"])
    metrics = [F.col(f"__q_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *metrics, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def _oracle() -> str:
    grid = ",\n".join(f"('{rule}', {i}, {float(cut)!r}::DOUBLE)" for rule, cuts in GRID.items() for i, cut in enumerate(cuts))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d
), win AS (
  SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS p, w FROM w WHERE len(w) >= {WINDOW}
), keyed AS (
  SELECT rid, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM win
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM keyed) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p + k) AS n_repeat_words FROM twice, range({WINDOW}) AS r(k) GROUP BY rid
), m AS (
  SELECT rid, doc_id, stratum, md5(text) AS same, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(text, '[^!|]', '', 'g')) AS n_marks,
         length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep USING (rid)
), s AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         n_symbols / greatest(n_words, 1) AS symbols_per_word, n_upper / greatest(word_chars, 1) AS upper_share,
         word_chars / greatest(n_words, 1) AS mean_word_chars, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
         n_repeat_words / greatest(n_words, 1) AS repeat_word_share, n_marks / greatest(n_words, 1) AS marks_per_word
  FROM m
), grid(rule, step, cutoff) AS (VALUES
{grid}
), v AS (
  UNPIVOT (SELECT rid, doc_id, stratum, same, base_failed, {', '.join(GRID)} FROM s)
  ON {', '.join(GRID)} INTO NAME rule VALUE x
), held AS (
  SELECT DISTINCT stratum, same, rule, x, ('0x' || substr(same, 1, 2))::INTEGER % 2 AS half FROM v
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), counts AS (
  SELECT stratum, rule, step, count(*) AS n, count_if(x > cutoff)::BIGINT AS k FROM held JOIN grid USING (rule) WHERE half = 0 GROUP BY ALL
), chosen AS (
  SELECT stratum, rule, min(step) AS step FROM counts WHERE k <= n * {ALPHA / len(GRID)!r}::DOUBLE GROUP BY ALL
), hit AS (
  SELECT h.same, h.stratum, level, bool_or(coalesce(x > cutoff, false)) AS gone
  FROM held h JOIN chosen c ON h.stratum = c.stratum AND h.rule = c.rule CROSS JOIN range({LEVELS}) AS r(level)
  LEFT JOIN grid g ON g.rule = c.rule AND g.step = c.step + level
  WHERE half = 1 GROUP BY ALL
), tested AS (
  SELECT stratum, level, count(*) AS n, count_if(gone)::BIGINT AS k FROM hit GROUP BY ALL
), tail AS (
  SELECT stratum, level,
         (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
          FROM (SELECT unnest(range(0, k + 1)) AS i)) AS p
  FROM tested WHERE k < n * {ALPHA}
), passed AS (
  SELECT stratum, min(level) AS level FROM tail WHERE p <= {DELTA} / (SELECT count(*) FROM tested) GROUP BY ALL
), cuts AS (
  SELECT c.stratum, c.rule, cutoff FROM chosen c JOIN passed p ON c.stratum = p.stratum JOIN grid g ON g.rule = c.rule AND g.step = c.step + p.level
), out AS (
  SELECT DISTINCT rid FROM v JOIN cuts USING (stratum, rule) WHERE x > cuts.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM out) AS kept
FROM s
"""


ORACLE_SQL = _oracle()
