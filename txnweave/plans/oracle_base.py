"""SQL pieces for the oracle: the same messages and rules, said for another engine."""

from __future__ import annotations

from ..functions.normalize import CORPUS_SIGNS
from ..plans.messages import BANKS, HANDLES, SHOPS, TEMPLATES


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(xs: list[str]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def _render() -> str:
    filled = {
        "bank": "true_bank",
        "amt": "printf('%.2f', true_amount)",
        "commas": "format('{:,.2f}', true_amount)",
        "lakh": "printf('%.2f', round(true_amount / 100000, 2))",
        "bal": "printf('%.2f', round(true_amount * 3, 2))",
        "acct": "true_account",
        "dmy": "strftime(ts, '%d-%m-%Y')",
        "slash": "strftime(ts, '%d/%m/%y')",
        "short": "strftime(ts, '%d-%m-%y')",
        "month": "strftime(ts, '%d %b %Y')",
        "dashed": "strftime(ts, '%d-%b-%y')",
        "shop": "shop",
        "shopname": "replace(upper(shop), '.', ' ')",
        "handle": "handle",
        "ref": "true_reference",
        "otp": "lpad((msg_id % 1000000)::VARCHAR, 6, '1')",
    }
    text = f"({array([t for _, t in TEMPLATES])})[variant + 1]"
    for name, value in filled.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


MSG = f"""fact AS (
  SELECT o_orderkey AS msg_id, o_custkey AS cust_id, o_orderdate AS ts, o_orderkey % {len(TEMPLATES)} AS variant,
         ({array([t or '' for t, _ in TEMPLATES])})[o_orderkey % {len(TEMPLATES)} + 1] AS true_type,
         round(o_totalprice, 2) AS true_amount, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS true_account,
         lpad(o_orderkey::VARCHAR, 12, '0') AS true_reference, ({array(BANKS)})[o_custkey % {len(BANKS)} + 1] AS true_bank,
         ({array(SHOPS)})[(o_orderkey // {len(TEMPLATES)}) % {len(SHOPS)} + 1] AS shop, ({array(HANDLES)})[o_orderkey % {len(HANDLES)} + 1] AS handle
  FROM orders
), msg AS (
  SELECT *, {_render()} AS text, 'VM-' || upper(true_bank) || 'BK' AS sender,
         CASE WHEN variant % 3 = 0 THEN true_bank || ' transaction alert' ELSE '' END AS subject
  FROM fact
)"""


def first(text: str, pattern: str, group: int = 1, ignore_case: bool = True) -> str:
    return f"nullif(regexp_extract({text}, {lit(('(?i)' if ignore_case else '') + pattern)}, {group}), '')"


def by_priority(text: str, patterns: list[tuple[str, int]], ignore_case: bool = True) -> str:
    return "coalesce(" + ", ".join(first(text, p, 1, ignore_case) for p, _ in sorted(patterns, key=lambda x: -x[1])) + ", NULL)"


def in_order(text: str, patterns: list[str], ignore_case: bool = True) -> str:
    return by_priority(text, [(p, 0) for p in patterns], ignore_case)


def rlike(text: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({text}, {lit(('(?i)' if ignore_case else '') + pattern)})"


def has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def first_label(text: str, rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(text, w)} THEN {lit(k)}" for k, w in rules.items()) + " END"


def digits_only(c: str) -> str:
    return f"nullif(regexp_replace({c}, '[^0-9]', '', 'g'), '')"


def norm_date(c: str) -> str:
    formats = ["%d-%m-%Y", "%d-%m-%y", "%d/%m/%Y", "%d/%m/%y", "%d %b %Y", "%d %b %y", "%d %B %Y", "%d %B %y", "%Y-%m-%d", "%d.%m.%Y", "%d.%m.%y"]
    return f"strftime(coalesce({', '.join(f"CASE WHEN {'' if '%Y' in f else 'NOT '}regexp_matches({c}, '[0-9]{{4}}') THEN try_strptime({c}, {lit(f)}) END" for f in formats)}), '%d-%m-%Y')"


def clean_corpus(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), {lit(rf'[^\p{{L}}\p{{N}}_ {CORPUS_SIGNS}]')}, '', 'g'))"
