"""Licence labels: none from prose, expressions as a plain evaluator has them,
and time in proportion to the text."""

import itertools
import random
import time

import pytest

from corpusmill.llm.licenses import PRECEDENCE, STRICTNESS, is_identifier, machine, parse, scan

FOUND = machine()


def labels(text):
    return sorted(scan(text.encode(), FOUND).labels)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The license expression is described below", []),
        ("license expression: see the file", []),
        ("SPDX-License-Identifier: MIT OR Apache-2.0 and more", ["apache-2.0", "mit"]),
        ("license expression: mit dem Fahrrad nach Hause", []),
        ("license expression: mit", ["mit"]),
        ("# SPDX-License-Identifier: mit */\ntext", ["mit"]),
        ('{"license-expression": "BSD-3-Clause"}', ["bsd-3-clause"]),
        ("SPDX-License-Identifier: LicenseRef-Own-1 AND Foo-1.2-or-later", ["foo-1.2-or-later", "licenseref-own-1"]),
        ("SPDX-License-Identifier: nothing known", ["expression-invalid"]),
        ("SPDX-License-Identifier:\nMIT", ["expression-invalid"]),
        ("SPDX license identifier text MIT", []),
        ("SPDX-License-Identifier: GPL-2.0+ WITH the sea", ["gpl-2.0+"]),
    ],
)
def test_no_label_from_prose(text, expected):
    assert labels(text) == expected


def plain(tokens):
    """Recursive descent: or, and, with."""

    def level(k):
        if k == 3:
            if tokens[0] == "(":
                tokens.pop(0)
                out = level(0)
                tokens.pop(0)
                return out
            name = tokens.pop(0).lower()
            return {name}, STRICTNESS[max((f for f in STRICTNESS if name == f or name.startswith(f"{f}-")), key=len)]
        op = ["or", "and", "with"][k]
        ids, strict = level(k + 1)
        while tokens and tokens[0].lower() == op:
            tokens.pop(0)
            if op == "with":
                ids, strict = ids | {f"exception:{tokens.pop(0).lower()}"}, max(strict - 1, 0)
                continue
            more, other = level(k + 1)
            ids, strict = ids | more, {"or": min, "and": max}[op](strict, other)
        return ids, strict

    return level(0)


def test_expressions_equal_a_plain_evaluator():
    rng = random.Random(2)
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "BSD-2-Clause", "CC-BY-SA-4.0", "MPL-2.0", "0BSD"]

    def made(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice(names)
            return [name, rng.choice(["WITH", "with"]), "Classpath-exception-2.0"] if rng.random() < 0.2 else [name]
        inner = list(itertools.chain(*[[*made(depth - 1), rng.choice(["OR", "AND", "or", "and"])] for _ in range(rng.randint(1, 3))], made(depth - 1)))
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(500):
        tokens = made(3)
        terms, end = parse((text := " ".join(tokens)).encode())
        assert (set(terms.ids), terms.strictness) == plain(list(tokens)) and end == len(text)


def test_operators_are_no_identifiers():
    assert not any(map(is_identifier, [*PRECEDENCE, "see", "is", "more", "the", "python-based", "mit", "4.0"]))


def test_a_line_of_tags_takes_linear_time():
    text = b"SPDX-License-Identifier: MIT; " * 20_000
    start = time.time()
    found = scan(text, FOUND)
    assert len(found.expressions) == 20_000 and set(found.labels) == {"mit"} and time.time() - start < 5
