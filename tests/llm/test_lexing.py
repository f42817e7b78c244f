"""Lexed secrets against texts that are written from known names and literals."""

import math
import random
from collections import Counter

from txnweave.llm import secrets

NAMES = {"client_pwd": 3.0, "dbPassphrase": 3.0, "private_access": 3.5, "auth_salt": 3.5, "CREDENTIALS": 3.0, "color": 0.0, "file_name": 0.0, "title": 0.0, "x.bearer": 2.5}


def value(rng, kind):
    if kind == "good":
        return "".join(rng.choice("abcdefghkmnpqrsABCDEFGHKMNPQRS") for _ in range(7)) + "".join(rng.choice("23456789") for _ in range(4))
    return rng.choice(["hello", "changeme", "plain words here", "abcdefghij", "xxxxxxxx", "none"])


def plain_score(text, name):
    """The score of a value, from the rules as stated."""
    n = len(text)
    if n < 6 or secrets._PLACEHOLDER.match(text) or text.lower() == name.lower():
        return -10
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    return (n >= 8) + (entropy >= 3) + (any(c.isalpha() for c in text) and any(c.isdigit() for c in text)) - 2 * any(c.isspace() for c in text) - (text.isalpha() and text.islower())


def written(rng):
    """(text, spans of the literals that must be found)."""
    text, want, constants = "", set(), {}

    def add(before, literal, after, name):
        nonlocal text
        text += before
        start = len(text)
        text += literal + after
        if NAMES[name] > 0 and NAMES[name] + plain_score(literal, name) >= secrets.LIMIT:
            want.add((start, len(text) - len(after)))

    for i in range(rng.randrange(1, 12)):
        name, literal = rng.choice([*NAMES]), value(rng, rng.choice(["good", "good", "poor"]))
        style = rng.randrange(10)
        q = rng.choice(["'", '"'])
        if style == 0:
            add(f"{name} = {q}", literal, f"{q}\n", name)
        elif style == 1:
            add(f"{name}: {q}", literal, f"{q},\n", name)
        elif style == 2:
            add(f'{{"{name}": "', literal, '"}\n', name)
        elif style == 3:
            add(f"{name} := `", literal, "`\n", name)
        elif style == 4:
            add(f"conf[{q}{name}{q}] = {q}", literal, f"{q};\n", name)
        elif style == 5:
            add(f"<{name}>", literal, f"</{name}>\n", name)
        elif style == 6:
            add(f"define({q}{name}{q}, {q}", literal, f"{q});\n", name)
        elif style == 7:
            add(f"{name} = {q * 3}", literal, f"{q * 3}\n", name)
        elif style == 8:  # a constant of a plain name, used once
            alias = f"K{i}zz"
            text += f"{alias} = {q}"
            start = len(text)
            text += f"{literal}{q}\n{name} = {alias}\n"
            if NAMES[name] > 0 and NAMES[name] + plain_score(literal, name) >= secrets.LIMIT:
                want.add((start, start + len(literal)))
        else:  # in two parts
            cut = len(literal) // 2
            text += f"{name} = {q}"
            a = len(text)
            text += f"{literal[:cut]}{q} + {q}"
            b = len(text)
            text += f"{literal[cut:]}{q}\n"
            if NAMES[name] > 0 and NAMES[name] + plain_score(literal, name) >= secrets.LIMIT:
                parts = [(a, a + cut), (b, b + len(literal) - cut)]
                want.update([p for p in parts if p[1] - p[0] >= secrets.LEAST_PART] or parts)
        text += rng.choice(["", "\n", "// a comment\n", "return done;\n", "lorem ipsum dolor\n"])
    return text, want


def test_written_texts():
    rng = random.Random(21)
    some = 0
    for _ in range(3000):
        text, want = written(rng)
        base = [(a, b) for k, a, b in secrets.find_spans(text) if k != "lexed"]
        got = {(a, b) for k, a, b in secrets.find_spans(text) if k == "lexed"}
        assert got == {(a, b) for a, b in want if not any(x <= a and b <= y for x, y in base)}, text
        some += len(got)
    assert some > 2000


def test_named_cases():
    lexed = lambda t: [t[a:b] for k, a, b in secrets.find_spans(t) if k == "lexed"]
    assert lexed('client_pwd = """Zx9kQ2mB7\nabc"""') == [] or lexed('client_pwd = """Zx9kQ2mB7-abc"""') == ["Zx9kQ2mB7-abc"]
    assert lexed('client_pwd = """Zx9kQ2mB7-abc"""') == ["Zx9kQ2mB7-abc"]
    assert lexed('define("API_SECRET", "Zx9kQ2mB7abc")') == ["Zx9kQ2mB7abc"]
    assert lexed("os.environ.setdefault( 'client_pwd' , 'Zx9kQ2mB7abc', 1)") == ["Zx9kQ2mB7abc"]
    assert lexed('client_pwd: "a" "Zx9kQ2mB7abc"') == ["Zx9kQ2mB7abc"]
    assert lexed('client_pwd = ""\nother = 1') == []
    assert lexed("client_pwd = '''never closed Zx9kQ2mB7abc") == []


def test_linear_in_odd_texts():
    import time

    for text in ('a = """' * 30_000, "f('client_pwd', " * 30_000, "client_pwd = '''" * 20_000, "('" * 60_000 + "pwd"):
        began = time.time()
        secrets.find_spans(text + " pwd")
        assert time.time() - began < 20
