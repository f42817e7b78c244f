"""Rule, weight, template and layout tables, the result store and reports."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from txnweave import formats, sources
from txnweave.functions import normalize
from txnweave.operators import reports, rule_tables, statements, store, templates


def brute(texts, rules):
    out = Counter()
    for i, text in texts:
        if text is None:
            out[(i, None, None, None, None, None)] += 1
            continue
        hit = sorted((o, k, lab, w) for o, k, lab, w, name in rules if k in text or (name is not None and text and text in name))
        scores = defaultdict(float)
        first = {}
        for o, _, lab, w in hit:
            scores[lab] += w
            first.setdefault(lab, o)
        best = min(scores, key=lambda lab: (-scores[lab], first[lab])) if scores else None
        out[(i, hit[0][0] if hit else None, hit[0][2] if hit else None, len(hit), best, scores[best] if best else None)] += 1
    return out


def random_rules(rng, n, letters="abcde", longest=7):
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))), f"l{rng.randrange(9)}", float(rng.randrange(1, 5)), "".join(rng.choice(letters) for _ in range(12)) if rng.random() < 0.3 else None) for i in rng.sample(range(10 * n), n)]


RULES = "ord long, keyword string, label string, weight double, name string"


@pytest.mark.parametrize("block", [200_000, 70])
def test_rules_equal_brute_force(spark, monkeypatch, block):
    """Also in several blocks."""
    monkeypatch.setattr(rule_tables, "BLOCK_RULES", block)
    rng = random.Random(1)
    rules = random_rules(rng, 300)
    texts = [(i, "".join(rng.choice("abcdefg") for _ in range(rng.randrange(25)))) for i in range(120)] + [(500, None), (501, ""), (502, "abc"), (502, "abc")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = rule_tables.with_rules(df, "text", spark.createDataFrame(rules, RULES))
    assert Counter((r.id, r.first_rule, r.first_label, r.n_rules, r.best_label, r.best_score) for r in got.collect()) == brute(texts, rules)


def test_hundred_thousand_rules(spark):
    rng = random.Random(2)
    rules = [(i, f"{rng.randrange(16**5):05x}", f"l{i % 50}", 1.0, None) for i in range(100_000)]
    texts = [(i, "".join(rng.choice("0123456789abcdef") for _ in range(40))) for i in range(60)]
    got = rule_tables.with_rules(spark.createDataFrame(texts, "id long, text string"), "text", spark.createDataFrame(rules, RULES))
    assert Counter((r.id, r.first_rule, r.first_label, r.n_rules, r.best_label, r.best_score) for r in got.collect()) == brute(texts, rules)


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    got = rule_tables.with_rules(df, "text", spark.createDataFrame([], RULES)).collect()
    assert [(r.n_rules, r.first_rule, r.best_label) for r in sorted(got)] == [(0, None, None), (None, None, None)]


def test_weighted_choice(spark):
    weights = spark.createDataFrame([("a", None, "x", 1.0), ("a", None, "y", 3.0), ("a", None, "never", 0.0), ("b", "t", "z", 0.001), ("b", "t", "w", 999.0)], "bank string, type string, choice string, weight double")
    n = 40_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("bank"), F.when(F.col("id") % 10 == 9, "t").alias("type"), ((F.col("id") * 7919) % n / float(n)).alias("u"))
    got = {(r.bank, r.choice): r["count"] for r in rule_tables.weighted_choice(rows, ["bank", "type"], F.col("u"), weights).groupBy("bank", "choice").count().collect()}
    assert sum(got.values()) == n
    assert abs(got[("a", "x")] / 36_000 - 0.25) < 0.001 and ("a", "never") not in got and got[("b", "w")] >= 3999
    ends = spark.createDataFrame([("a", None, 0.0), ("a", None, 0.25), ("a", None, 0.9999999999999999), ("q", None, 0.5)], "bank string, type string, u double")
    assert [r.choice for r in rule_tables.weighted_choice(ends, ["bank", "type"], F.col("u"), weights).orderBy("bank", "u").collect()] == ["x", "y", "y", None]


def test_values_are_filled_once(spark):
    row = spark.range(1).select(templates.fill(F.lit("{a} and {b}, {unknown} {a}"), {"a": F.lit("{b}"), "b": F.lit(None).cast("string")}).alias("x")).first()
    assert row.x == "{b} and , {unknown} {b}"


def test_every_language_and_kind(spark):
    rows = [(k, n) for k in ("debit", "credit", "otp", "balance") for n in formats.LANGUAGES] + [("nothing", "hindi"), ("debit", None)]
    df = spark.createDataFrame(rows, "kind string, language string")
    values = {"bank": F.lit("HDFC"), "amount": F.lit(1234.5), "balance": F.lit(7), "account": F.lit("00991234"), "date": F.to_date(F.lit("2024-03-09")), "vpa": F.lit("a@b"), "ref": F.lit("123456789012"), "sender": F.lit("S"), "otp": F.lit("000777")}
    plain = {(r.kind, r.language): r.text for r in templates.render_languages(df, "kind", "language", values, templates.language_templates(spark)).collect()}
    known = {(k, n): t for k, n, t in formats.LANGUAGE_TEMPLATES}
    want = {"bank": "HDFC", "amount": "1234.50", "balance": "7.00", "account": "1234", "date": "09-03-2024", "vpa": "a@b", "ref": "123456789012", "sender": "S", "otp": "000777"}
    for kind, language in rows:
        template = known.get((kind, language), known.get((kind, "english")))
        assert plain[(kind, language)] == (template and template.format(**want))
    native = templates.render_languages(df, "kind", "language", values, templates.language_templates(spark), native=F.lit(True))
    turned = native.withColumn("back", normalize.ascii_digits(F.col("text"))).collect()
    assert all(r.back == plain[(r.kind, r.language)] for r in turned)
    assert all((r.text != plain[(r.kind, r.language)]) == (r.language in formats.DIGITS and r.text is not None) for r in turned)
    with pytest.raises(ValueError, match="sender"):
        templates.render_languages(df, "kind", "language", {k: v for k, v in values.items() if k != "sender"}, templates.language_templates(spark))


def test_every_layout_parses_back(spark):
    """Each layout's own parser reads the facts that the layout shows, for debits and credits, negative balances and odd names."""
    facts = []
    for source, xs in formats.LAYOUTS.items():
        for no, layout in enumerate(xs):
            for kind in ("debit", "credit"):
                for amount, balance, name in (("1,234.50", "-90,001.00", "Pizza Hut"), ("5", "7.00", "A-1 Shop & Co. (2)"), ("12.00", "1", "X")):
                    t, a = formats.TYPE_WORDS.get(source, ("", "")), formats.ACTION_WORDS.get(source, ("", ""))
                    i = 0 if kind == "credit" else 1
                    values = {"date": "09/03/2024", "time": "11:45", "desc": name, "merchant": name, "amount": amount, "debit": amount if kind == "debit" else "", "credit": amount if kind == "credit" else "", "balance": balance, "wallet_balance": balance, "ref": "ORD123", "status": "Failed", "upi_id": "x.y@ok", "direction": "from", "type_text": t[i], "action": a[i]}
                    has = lambda *names: any("{%s}" % n in layout for n in names)
                    shown = has("amount") or (kind == "debit" and has("debit")) or (kind == "credit" and has("credit"))
                    typed = has("type_text", "action") or (kind == "debit" and has("debit")) or (kind == "credit" and has("credit"))
                    want = (no, "09/03/2024", name, float(amount.replace(",", "")) if shown else None, kind if typed else None, float(balance.replace(",", "")) if has("balance", "wallet_balance") else None, "ORD123" if has("ref") else None, "Failed" if has("status") else None)
                    facts.append((source, layout.format(**values), want))
    df = spark.createDataFrame([(i, s, line) for i, (s, line, _) in enumerate(facts)] + [(9999, "hdfc", "no layout"), (9998, "nobody", "x"), (9997, None, None)], "i long, source string, line string")
    got = {r.i: tuple(r)[3:] for r in templates.parse_statement_rows(df, "source", "line", templates.layouts(spark)).collect()}
    for i, (source, line, want) in enumerate(facts):
        assert got[i] == want, (source, line)
    assert got[9999] == got[9998] == got[9997] == (None,) * 8


def test_store_keeps_results(spark, tmp_path):
    seen = []

    def compute(df):
        rows = df.withColumn("amount", F.length("text").cast("double"))
        seen.append(sorted(r.text for r in rows.collect()))
        return rows

    kept = store.ResultStore(spark, f"file://{tmp_path}/s", "amount double", buckets=4)
    first = spark.createDataFrame([("one",), ("Two ",), ("two",), (None,)], "text string")
    assert {r.reused for r in kept.results(first, compute).collect()} == {False}
    more = spark.createDataFrame([("ONE",), ("three",)], "text string")
    again = store.ResultStore(spark, f"file://{tmp_path}/s", "amount double", buckets=4)
    assert sorted((r.amount, r.reused) for r in again.results(more, compute).collect()) == [(3.0, True), (5.0, False)]
    assert seen[1] == ["three"] and len(seen[0]) == 2
    assert again.read().count() == 3

    def fails(df):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        kept.results(spark.createDataFrame([("four",)], "text string"), fails)
    assert kept.read().count() == 3
    number, parts = kept._newest()
    with pytest.raises(store.ConcurrentCommit):
        kept._commit(number, parts)
    for i in range(store.MOST_PARTS + 1):  # parts are written as one now and then
        kept.results(spark.createDataFrame([(f"more {i}",)], "text string"), compute)
    assert kept.read().count() == 3 + store.MOST_PARTS + 1 and len(kept._newest()[1]) < store.MOST_PARTS
    plan = kept._looked_up(first.select(F.lit("k").alias("content_key")), kept._newest()[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_report(spark):
    rows = [(i, f"t{i % 90}", i % 3 != 0, None if i % 10 == 1 else 1.0, None if i % 10 == 4 else "debit", "food" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, txn boolean, amount double, type string, category string")
    got = reports.validation_report(df, "id", F.col("text"), F.col("txn"), {"amount": F.col("amount"), "type": F.col("type")}, {"category": F.col("category")}).collect()
    by = {(r.section, r.name): (r.n, r.share) for r in got if r.section != "issue"}
    txn = [r for r in rows if r[2]]
    flawed = [(r[0], f) for r in txn for f, v in (("amount", r[3]), ("type", r[4])) if v is None]
    assert by[("records", "total")][0] == 100 and by[("records", "transactions")][0] == len(txn) and by[("records", "unique_texts")][0] == 90
    assert by[("warning", "duplicate_rate")][0] == 10 and by[("valid", "false")][0] == len({i for i, _ in flawed})
    assert by[("category", "food")][1] == pytest.approx(sum(r[5] == "food" for r in txn) / len(txn)) and ("category", "unknown") in by
    assert [(r.n, r.name) for r in got if r.section == "issue"] == [(i, f"Missing {f}") for i, f in sorted(flawed)][:20]
    nothing = {(r.section, r.name): r.n for r in reports.validation_report(df.where("false"), "id", F.col("text"), F.col("txn"), {"amount": F.col("amount")}, {"type": F.col("type")}).collect()}
    assert nothing[("records", "total")] == 0 and nothing[("valid", "true")] == 0


def test_export_order(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 4 != 0) for i in range(200)], "id long, verified boolean")
    for only, n in ((True, 150), (False, 200)):
        path = f"file://{tmp_path}/{only}"
        reports.export_labelled(labels, "id", F.col("id").cast("string"), F.lit("x"), path, only, 0.9)
        back = spark.read.json(path)
        assert sorted(r.place for r in back.collect()) == list(range(1, n + 1))
        assert back.where("split = 'train'").count() == int(n * 0.9) and back.where("split = 'train'").agg(F.max("place")).first()[0] == int(n * 0.9)


def test_open_tags(spark):
    say = "word " * 30
    pages = spark.createDataFrame([(1, f"<p>{say}</p><script>var a = 1; // never closed"), (2, f"<p>{say}</p><!-- open {say}"), (3, f"<NAV >menu</nav ><p>{say}</p>"), (4, None)], "i long, html string")
    got = {r.i: r.t for r in pages.select("i", sources.html_text(F.col("html")).alias("t")).collect()}
    assert got[1] == got[2] == got[3] == say.strip() and got[4] is None


def test_row_entities(spark):
    columns = "date string, description string, debit string, credit string, balance string"
    rows = [("01/02/2024", "UPI", "5.00", "7.00", "9.00"), ("", None, "", "7.00", None), (None, "x", "0.00", "", ""), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, columns)
    got = [r.e for r in df.select(statements.row_entities(*[F.col(c) for c in df.columns]).alias("e")).collect()]
    assert got == [
        {"date": "01/02/2024", "description": "UPI", "amount": "5.00", "type": "debit", "balance": "9.00"},
        {"amount": "7.00", "type": "credit"},
        {"description": "x", "amount": "0.00", "type": "debit"},
        {},
    ]


def test_corpus_text(spark):
    """Signs of money and code stay; combining marks and pictures go; all white space is one blank."""
    text = "  a\x1c\tb\u00a0c €5 £6 ¥7 {x|y\\z} 3° ~^`§ \u0939\u093f😀\u0967½ "
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(normalize.clean_corpus(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["a b c €5 £6 ¥7 {x|y\\z} 3°  \u0939\u0967½", None, ""]
