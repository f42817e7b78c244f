"""Training and benchmark sets: prompts, splits, samples, augmentation, evaluation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import let
from . import ranges


def unit_hash(key: Column, seed: str) -> Column:
    """[0, 1) by a digest of seed and key: the same on any engine and partitioning."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order, by a partial aggregate (no window over a hot key)."""
    columns = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min(columns).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def split(df: DataFrame, key: str, ratio: float, seed: str = "42") -> DataFrame:
    """Adds split = train | valid by hash threshold: no sort, no shuffle."""
    return df.withColumn("split", F.when(unit_hash(F.col(key), seed) < ratio, "train").otherwise("valid"))


def exact_split(df: DataFrame, key: str, ratio: float, seed: str = "42") -> DataFrame:
    """Exactly floor(n x ratio) train rows, the smallest hashes; the rank is a distributed one."""
    return ranges.exact_split(df, [unit_hash(F.col(key), seed), F.col(key)], ratio)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n in an order, by ranges that are written once (see ``ranges``)."""
    return ranges.global_rank(df, order, name)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """At most n rows a group, the smallest hashes. Groups are cut within salts first."""
    h = unit_hash(F.col(key), seed)
    salted = df.withColumn("__h", h).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(32)))
    first = salted.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__salt").orderBy("__h", key))).where(F.col("__r") <= n)
    return first.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h", key))).where(F.col("__r") <= n).drop("__h", "__salt", "__r")


def prompt(text: Column) -> Column:
    return F.concat(F.lit("Extract financial entities from this message.\n\nMessage: "), F.substring(text, 1, 1500), F.lit("\n\nOutput JSON:\n"))


def chat(text: Column, answer: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit("You extract financial entities and answer in JSON.")), turn("user", text), turn("assistant", answer))


#: Fields as a prompt describes them.
FIELD_DESCRIPTIONS = {
    "amount": "amount (as a number)",
    "type": 'type ("debit" or "credit")',
    "date": "date (DD-MM-YYYY format)",
    "account": "account (number or last 4 digits)",
    "reference": "reference (UPI/transaction ID)",
    "vpa": "vpa (UPI address like user@bank)",
    "merchant": "merchant (vendor name)",
    "category": "category (food/shopping/transport/etc)",
}
#: Formats that have a prefix of their own.
FORMATS = ["BANK_STATEMENT", "PHONEPE", "GPAY", "PAYTM"]


def field_prompt(field: str, text: Column) -> Column:
    """Asks for one field."""
    if field not in FIELD_DESCRIPTIONS:
        raise ValueError(f"no field {field}")
    return F.concat(F.lit(f'Give only the {FIELD_DESCRIPTIONS[field]} of this transaction, or "unknown".\n\nTransaction: '), text, F.lit(f"\n\n{field.capitalize()}:"))


def fields_prompt(fields: list[str], text: Column) -> Column:
    """Asks for some fields as JSON; for all of them if none is named."""
    if not fields:
        return prompt(text)
    wanted = ", ".join(FIELD_DESCRIPTIONS.get(f, f) for f in fields)
    return F.concat(F.lit(f"Extract only these fields from the transaction: {wanted}\n\nAnswer with a JSON object, null for what is not there.\n\nTransaction:\n"), text, F.lit("\n\nJSON output:"))


def format_prompt(kind: str, text: Column) -> Column:
    """The prompt of a statement row or an app's message, with the format's prefix."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}")
    what = "bank statement row" if kind == "BANK_STATEMENT" else "transaction"
    return F.concat(F.lit(f"[{kind}] Extract financial entities from this {what}:\n\n"), text)


def weighted_choice(key: Column, weights: dict[str, float], seed: str) -> Column:
    """One of the choices, by the hash's place among the cumulative weights."""
    total, reach, out = sum(weights.values()), 0.0, F
    names = [*weights]
    for name in names[:-1]:
        reach += weights[name]
        out = out.when(unit_hash(key, seed) < reach / total, name)
    return out.otherwise(names[-1]) if len(names) > 1 else F.lit(names[0])


def assemble(phrases: list[Column], values: dict[str, Column]) -> Column:
    """Phrases (nulls left out) with one blank between them, {placeholders} filled, blanks and punctuation tidied."""
    text = F.concat_ws(" ", *phrases)
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return F.trim(F.regexp_replace(F.regexp_replace(text, " +", " "), r" ([.,])", "$1"))


#: Fixed values of the noise steps: abbreviations, spacings, typos, each with its alternatives.
ABBREVIATIONS = {
    "Account": ["A/c", "Acc", "Acct", "a/c"],
    "Reference": ["Ref", "Ref.", "ref"],
    "Transaction": ["Txn", "txn", "Trans"],
    "Available": ["Avl", "Avail", "avl"],
    "Balance": ["Bal", "bal", "Bal."],
    "Credited": ["Cr", "cr", "Cr."],
    "Debited": ["Dr", "dr", "Dr."],
    "Number": ["No", "No.", "Num"],
}
SPACINGS = [(". ", "."), (": ", ":"), ("Rs. ", "Rs."), ("Rs ", "Rs"), (", ", ",")]
TYPOS = {
    "debited": ["debitd", "debite", "debitted"],
    "credited": ["creditd", "credite", "creditted"],
    "transaction": ["transction", "transcation", "transacton"],
    "available": ["availble", "avialable", "availabel"],
    "balance": ["balace", "balnce", "balanc"],
}
#: Synonyms of the augmentation.
SYNONYMS = {
    "debited": ["withdrawn", "deducted", "paid", "transferred", "sent"],
    "credited": ["received", "deposited", "added", "transferred"],
    "transaction": ["payment", "transfer", "txn"],
    "account": ["A/c", "Acc", "Acct", "a/c"],
    "reference": ["Ref", "UTR", "Txn ID"],
    "available": ["Avl", "remaining", "left"],
    "balance": ["Bal", "amt"],
}
EDGE_WEIGHTS = {"failed_txn": 5.0, "pending_txn": 3.0, "large_amount": 2.0, "small_amount": 2.0, "unicode": 4.0, "credit": 1.5}


def one_of(values: list[str], key: Column, seed: str) -> Column:
    """One of the values by hash."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(unit_hash(key, seed) * len(values)) + 1).cast("int"))


def add_noise(text: Column, key: Column, level: float = 1.0) -> Column:
    """Abbreviations, spacing, case, the cut at 160 characters, typos and punctuation: each step by a coin
    whose chance grows with ``level``, each word in it by one of its own. What a coin leaves out is replaced by nothing."""

    def coin(*chances: tuple[str, float]) -> Column:
        out = F.lit(True)
        for step, chance in chances:
            out = out & (unit_hash(key, step) < chance)
        return out

    def first(out: Column, on: Column, pattern: str, value: Column) -> Column:
        # The pattern is a literal, so that it isn't compiled anew each time the coin turns.
        return let(out, lambda x: F.when(on, F.regexp_replace(x, F.lit(f"(?s)^(.*?){pattern}"), F.concat(F.lit("$1"), value))).otherwise(x))

    def swap(out: Column, on: Column, old: str, new: str) -> Column:
        return F.replace(out, F.when(on, F.lit(old)).otherwise(F.lit("")), F.lit(new))

    out = text
    for word, short in ABBREVIATIONS.items():
        out = first(out, coin(("abbr", 0.5 * level), (f"abbr {word}", 0.5)), word, one_of(short, key, f"abbr which {word}"))
    for old, new in SPACINGS:
        out = swap(out, coin(("space", 0.3 * level), (f"space {old}", 0.3)), old, new)
    upper, lower = coin(("case", 0.2 * level), ("upper", 0.3)), coin(("case", 0.2 * level), ("lower", 0.1))
    out = let(out, lambda x: F.when(upper, F.upper(x)).when(lower, F.lower(x)).otherwise(x))
    out = let(out, lambda x: F.when(coin(("cut", 0.1 * level)) & (F.length(x) > 160), F.concat(F.substring(x, 1, 157), F.lit("..."))).otherwise(x))
    for word, wrong in TYPOS.items():
        out = first(out, coin(("typo", 0.05 * level), (f"typo {word}", 0.2)), f"(?i:{word})", one_of(wrong, key, f"typo which {word}"))
    out = swap(out, coin(("stop", 0.2 * level), (".", 0.3)), ".", "")
    return swap(out, coin(("stop", 0.2 * level), (",", 0.2)), ",", "")


TECHNIQUES = ["synonym", "noise", "case", "cut", "reorder"]


def with_synonyms(text: Column, key: Column, chance: float = 0.3) -> Column:
    """Words (without . , ; : around them) by a synonym, each by its own coin; a capital stays one."""
    table = F.create_map(*[x for w, s in SYNONYMS.items() for x in (F.lit(w), F.array(*[F.lit(v) for v in s]))])

    def turned(word: Column, i: Column) -> Column:
        place = F.concat(key.cast("string"), F.lit("-"), i.cast("string"))
        choices = F.try_element_at(table, F.btrim(F.lower(word), F.lit(".,;:")))
        new = F.element_at(choices, (F.floor(unit_hash(place, "synonym which") * F.size(choices)) + 1).cast("int"))
        new = F.when(word.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 100))).otherwise(new)
        return F.when(choices.isNotNull() & (unit_hash(place, "synonym") < chance), new).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), turned), " ")


def variants(df: DataFrame, text_col: str, key_col: str, factor: int = 6) -> DataFrame:
    """(key, copy_no, variant_kind, is_augmented, variant_text): each row, and factor - 1 copies by the techniques in turn."""
    text, key = F.col(text_col), F.col(key_col)
    made = {
        "synonym": lambda k: with_synonyms(text, k),
        "noise": lambda k: add_noise(text, k),
        "case": lambda k: F.when(unit_hash(k, "copy case") < 0.5, F.upper(text)).otherwise(F.lower(text)),
        "cut": lambda k: F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text),
        "reorder": lambda k: F.array_join(F.reverse(F.split(text, r"\. ")), ". "),
    }
    row = lambda i, kind, t: F.struct(F.lit(i).alias("copy_no"), F.lit(kind).alias("variant_kind"), F.lit(i > 0).alias("is_augmented"), t.alias("variant_text"))
    each = [row(0, "original", text)]
    for i in range(1, factor):
        kind = TECHNIQUES[(i - 1) % len(TECHNIQUES)]
        each.append(row(i, kind, made[kind](F.concat(key.cast("string"), F.lit(f"/{i}")))))
    return df.select(key_col, F.explode(F.array(*each)).alias("v")).select(key_col, "v.*")


def review_queues(labelled: DataFrame, urgent: float = 0.5) -> DataFrame:
    """The rows that wait for a review, with queue = urgent (low confidence) or normal."""
    return labelled.where(~F.col("verified")).withColumn("queue", F.when(F.col("confidence") < urgent, "urgent").otherwise("normal"))


def apply_reviews(labelled: DataFrame, decisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Decisions (key, action, at, notes, some fields): rejected rows go; verified ones take what the decision corrects, confidence 1, its time and notes."""
    named = decisions.select(F.col(key).alias("__key"), "action", F.col("at").alias("verified_at"), "notes", *[F.col(f).alias(f"__{f}") for f in fields if f in decisions.columns])
    joined = labelled.join(named, F.col(key) == F.col("__key"), "left").where("action IS NULL OR action != 'reject'")
    done = F.coalesce(F.col("action") == "verify", F.lit(False))
    new = {f: F.coalesce(F.when(done, F.col(f"__{f}")), F.col(f)) for f in fields if f in decisions.columns}
    new |= {"verified": F.col("verified") | done, "confidence": F.when(done, 1.0).otherwise(F.col("confidence"))}
    stamp = [F.when(done, F.col(c)).alias(c) for c in ("verified_at", "notes")]
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in labelled.columns], *stamp)


def mask_entities(text: Column, values: dict[str, Column]) -> Column:
    """Replace the first amount, account, date, reference and address by given values."""
    patterns = {
        "amount": r"(?:Rs\.?|INR|₹)\s*[\d,]+(?:\.\d+)?",
        "account": r"(?:XX|\*\*)\d{4}",
        "date": r"\d{2}[-/]\d{2}[-/]\d{2,4}",
        "reference": r"\d{12}",
        "vpa": r"[a-zA-Z0-9._-]+@[a-zA-Z]+",
    }
    out = text
    for name, value in values.items():
        out = F.regexp_replace(out, F.lit(f"(?s)^(.*?){patterns[name]}"), F.concat(F.lit("$1"), F.regexp_replace(value, F.lit(r"([\\$])"), F.lit(r"\\$1"))))
    return out


def edge_weight(tags: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    return F.aggregate(tags, F.lit(1.0), lambda a, t: a * F.coalesce(F.try_element_at(table, t), F.lit(1.0)))


def oversample(df: DataFrame, key: str, weight: str, size: int | None = None) -> DataFrame:
    """Exactly ``size`` rows (as many as there are, if not given), each row floor or ceil of its expected times."""
    return ranges.systematic_sample(df, key, F.col(weight), size)


def bigrams(df: DataFrame, text_col: str) -> DataFrame:
    """(w1, w2, w3, n): transitions of word pairs."""
    words = df.select(F.filter(F.split(F.lower(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).where(F.size("w") >= 3)
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(*[F.element_at("w", i + k).alias(f"w{k + 1}") for k in range(3)]))
    return words.select(F.explode(three).alias("t")).groupBy("t.w1", "t.w2", "t.w3").agg(F.count("*").alias("n"))


def running_balance(df: DataFrame, account: str, order: list[str], signed: Column, opening: Column) -> DataFrame:
    """Opening plus the sum of signed amounts so far, for each account; an account of any size is summed in many tasks."""
    summed = ranges.prefix_sums(df.withColumn("__opening", opening), [account], [F.col(c) for c in order], {"__moved": signed})
    return summed.withColumn("balance", F.col("__opening") + F.col("__moved")).drop("__opening", "__moved")


def evaluate(df: DataFrame, fields: list[str], expected: str, predicted: str) -> DataFrame:
    """(group columns kept) each row's fields as rows: field, expected, predicted, correct. Only expected fields count."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{expected}{f}").cast("string").alias("want"), F.col(f"{predicted}{f}").cast("string").alias("got")) for f in fields])
    long = df.withColumn("__e", F.explode(each)).where("__e.want IS NOT NULL AND __e.want != ''")
    return long.select("*", F.col("__e.field").alias("field"), F.lower("__e.want").eqNullSafe(F.lower("__e.got")).alias("correct")).drop("__e")
