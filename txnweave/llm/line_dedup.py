"""Line dedup by a log-template tree. DataFrame functions only.

Every line with a word descends a tree of fixed depth: first by its token
count, then by its ``depth`` leading tokens (a token with a digit counts as the
wildcard ``<*>``). The path is the leaf. In a leaf, a token position is constant
where the same token stands there in at least ``min_docs`` of the leaf's
occurrences, otherwise it is generalised to ``<*>``; the outcome is the line's template. A
template is recurring if lines of at least ``min_docs`` different documents
have it and at least ``min_constant`` of its positions are constant. This is the
order-free form of the parse: token counts replace one-by-one matching against
the groups of a leaf, so the same input gives the same templates in any order
and on any number of executors.

A line of at least ``long_tokens`` tokens is a passage of its own: two documents are
enough for its template, and where too few of its positions are constant, the
template is the line's own tokens. Where exactly two documents have it, it goes
unless the long lines that these two alone share hold a third or more of the
words (in lines of at least ``min_tokens``) of either: then one is a version of
the other, which is for the comparison of whole documents to settle, and taking
its lines away would hide that.

The first line of a recurring template stays (smallest document id, then line
number), all its other lines are dropped. Lines of fewer than ``min_tokens``
tokens are too short to tell a template from chance and always stay.

Equal lines are counted together before their tokens are dealt out, so a line
that a third of all documents share costs one row a task.

Defined cases: null text stays null and an empty text stays empty, with 0 lines;
blank lines stay; a repeated row (same id and text) is one document, and its
rows get the same outcome; rows with one id and different texts are different
documents of which the smaller text comes first; a null id sorts first; an empty
table gives an empty result; extra columns are kept as they are, but for __n_lines and
__n_dropped, whose place the results take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

DEPTH, MIN_DOCS, MIN_CONSTANT, MIN_TOKENS = 3, 3, 0.7, 4
LONG_TOKENS, LONG_DOCS = 50, 2
#: Two documents that share so large a part (one in VERSION) of the words of either are versions of each other.
VERSION = 3
WILD = "<*>"
_BLANK = r"[\x20\x09-\x0D]+"


def _mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), WILD).otherwise(token)


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_tokens: int, depth: int) -> DataFrame:
    """(id, key, no, n, leaf, exact, line): one row for each line of at least min_tokens tokens."""
    lines = docs.select(F.col(id_col).alias("id"), _key(F.col(text_col)).alias("key"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    tokens = F.split(F.trim(F.regexp_replace("line", _BLANK, " ")), " ")
    lines = lines.withColumn("tokens", tokens).withColumn("n", F.size("tokens")).where(F.col("n") >= min_tokens)
    head = [_mask(F.element_at("tokens", i + 1)) for i in range(depth)]
    lines = lines.select("id", "key", "no", "n", F.array_join("tokens", " ").alias("line"), F.xxhash64("n", *head).alias("leaf"))
    return lines.select("id", "key", "no", "n", "leaf", F.xxhash64("line").alias("exact"), "line")


def _without_versions(every: DataFrame, totals: DataFrame) -> DataFrame:
    """``totals`` without the templates of two documents that are versions of each other."""
    pairs = totals.where(F.col("docs") == LONG_DOCS).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    sides = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    placed = every.select(F.struct("id", "key").alias("doc"), "no", "n").join(sides, "doc", "left_semi")
    sizes = placed.distinct().groupBy("doc").agg(F.sum("n").alias("words"))
    both = pairs.join(sizes.select(F.col("doc").alias("a"), F.col("words").alias("wa")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("words").alias("wb")), "b")
    versions = both.where(VERSION * F.col("shared") >= F.least("wa", "wb")).select("a", "b", F.lit(LONG_DOCS).cast("long").alias("docs"))
    return totals.join(versions, ["a", "b", "docs"], "left_anti")


def recurring_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """(id, key, no, docs, first): every line of a recurring template."""
    depth = min(depth, min_tokens)
    long = F.col("n") >= long_tokens
    enough = F.when(long, LONG_DOCS).otherwise(min_docs)
    # Tokenised once; all that follows reads this table.
    every = materialize(spark, _lines(docs, id_col, text_col, min_tokens, depth), "lines")
    # Leaves that enough lines share. What is alone in its leaf needs no template.
    shared = every.groupBy("leaf", "n").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select("leaf")
    busy = every.groupBy("leaf", "exact").agg(F.count("*").alias("c")).join(shared, "leaf", "left_semi")
    # Aggregated before the join: a line that many documents share is one row a task.
    texts = every.groupBy("leaf", "exact").agg(F.first("line").alias("line"))
    distinct = materialize(spark, texts.join(busy, ["leaf", "exact"]), "line-texts")
    tokens = F.split("line", " ")
    # The leading tokens are the leaf's own: constant where they are no wildcard, and never a key of the join below.
    at = distinct.select("leaf", "exact", "c", F.posexplode(F.transform(F.slice(tokens, depth + 1, F.size(tokens)), _mask)).alias("p", "token")).where(F.col("token") != WILD)
    at = at.withColumn("token", F.xxhash64("token"))
    common = at.groupBy("leaf", "p", "token").agg(F.sum("c").alias("c")).where(F.col("c") >= min_docs).drop("c")
    fixed = at.drop("c").join(common, ["leaf", "p", "token"])
    # The template of a line: its leaf, how many positions are constant, and order-free digests of (position, token).
    forms = fixed.groupBy("leaf", "exact").agg(F.count("*").alias("constant"), F.bit_xor(F.xxhash64("p", "token")).alias("x"), F.sum(F.xxhash64("token", "p") % 1000000007).alias("y"))
    heads = F.size(F.filter(F.slice(tokens, 1, depth), lambda t: ~t.rlike("[0-9]")))
    sizes = distinct.select("leaf", "exact", F.size(tokens).alias("n"), heads.alias("heads"))
    none = F.lit(0).cast("long")
    template = F.xxhash64(F.coalesce("x", none), F.coalesce("y", none), F.coalesce("constant", none))
    known = F.col("heads") + F.coalesce("constant", F.lit(0)) >= min_constant * F.col("n")
    forms = sizes.join(forms, ["leaf", "exact"], "left").where(known | long)
    forms = forms.select("leaf", "exact", F.when(known, template).otherwise(F.xxhash64("exact", F.lit("itself"))).alias("form"))
    forms = materialize(spark, forms, "line-forms")
    found = materialize(spark, every.select("id", "key", "no", "n", "leaf", "exact").join(forms, ["leaf", "exact"]).select("id", "key", "no", "n", "leaf", "form"), "line-templates")
    order = F.struct(F.col("id"), F.col("key"), F.col("no"))
    per_doc = found.groupBy("leaf", "n", "form", "id", "key").agg(F.min("no").alias("no"))
    doc = F.struct("id", "key")
    totals = per_doc.groupBy("leaf", "n", "form").agg(F.count("*").alias("docs"), F.min(order).alias("first"), F.min(doc).alias("a"), F.max(doc).alias("b")).where(F.col("docs") >= enough)
    totals = materialize(spark, totals, "line-recurring")
    # A table of its own: the join then has the lines of a hot template split over tasks.
    totals = materialize(spark, _without_versions(every, totals).select("leaf", "form", "docs", "first"), "line-totals")
    return found.join(totals, ["leaf", "form"]).select("id", "key", "no", "docs", (order == F.col("first")).alias("first"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of ``docs`` with repeated template lines taken out of ``text_col``; adds __n_lines, __n_dropped."""
    lines = recurring_lines(spark, docs, id_col, text_col, **options).where(~F.col("first"))
    drops = lines.groupBy("id", "key").agg(F.collect_set("no").alias("no"))
    carry = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    own = {c: f"c{i}" for i, c in enumerate(carry)}
    given = docs.select(*carry).toDF(*own.values())
    id_, text = F.col(own[id_col]), F.col(own[text_col])
    out = given.withColumn("k", _key(text)).join(drops, id_.eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left")
    out = out.withColumn("lines", F.split(text, "\n"))
    # A row of marks by line number keeps the filter linear in the number of lines.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("no"))
    new = F.when(F.col("no").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1)), "\n"))
    counts = [F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("lines", "no")]
    return out.select(*[new if c == text_col else F.col(x) for c, x in own.items()], *counts).toDF(*carry, "__n_lines", "__n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = drop_recurring_lines(spark, docs)
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_dropped")).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


#: Windows over the templates keep the first line; ids and texts are unique in the oracle's tables.
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS no, unnest(s) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), t AS (
  SELECT doc_id, no, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') AS w FROM l
), m AS (
  SELECT doc_id, no, len(w) AS n, array_to_string(w, ' ') AS itself, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{WILD}' ELSE x END) AS w
  FROM t WHERE len(w) >= {MIN_TOKENS}
), leafed AS (
  SELECT *, n || chr(10) || array_to_string(w[1:{DEPTH}], ' ') AS leaf FROM m
), tok AS (
  SELECT doc_id, no, n, leaf, unnest(range(n)) AS p, unnest(w) AS token FROM leafed
), often AS (
  SELECT *, count(*) OVER (PARTITION BY leaf, p, token) AS c FROM tok
), form AS (
  SELECT doc_id, no, leaf, n, count_if(c >= {MIN_DOCS} AND token <> '{WILD}') AS constant,
         string_agg(CASE WHEN c >= {MIN_DOCS} THEN token ELSE '{WILD}' END, ' ' ORDER BY p) AS template
  FROM often GROUP BY ALL
), known AS (
  SELECT doc_id, no, n, CASE WHEN constant >= {MIN_CONSTANT} * n THEN leaf || chr(10) || template ELSE chr(10) || itself END AS template
  FROM form JOIN (SELECT doc_id, no, itself FROM leafed) USING (doc_id, no)
  WHERE constant >= {MIN_CONSTANT} * n OR n >= {LONG_TOKENS}
), ranked AS (
  SELECT doc_id, no, n, template, row_number() OVER (PARTITION BY template ORDER BY doc_id, no) AS r,
         count(DISTINCT doc_id) OVER (PARTITION BY template) AS docs
  FROM known
), two AS (
  SELECT template, n, min(doc_id) AS a, max(doc_id) AS b FROM ranked WHERE docs = {LONG_DOCS} AND n >= {LONG_TOKENS} GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(n) AS words FROM m GROUP BY ALL
), versions AS (
  SELECT a, b FROM (SELECT a, b, sum(n) AS shared FROM two GROUP BY ALL) JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE {VERSION} * shared >= least(x.words, y.words)
), gone AS (
  SELECT doc_id, no FROM ranked WHERE docs >= CASE WHEN n >= {LONG_TOKENS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END AND r > 1
  AND template NOT IN (SELECT template FROM two SEMI JOIN versions USING (a, b))
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.no) AS n_dropped,
         string_agg(raw, chr(10) ORDER BY l.no) FILTER (WHERE gone.no IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.no = gone.no GROUP BY ALL
) x ON d.doc_id = x.doc_id
"""
