"""What the methods add to the base results, against brute force: generated
personal data and licence notices."""

import random
import re

import numpy as np

from corpusmill.llm import licenses, pii

PARTS = ["token=04dbebab91ab85687d33eeaaf9ac699e1188f962 ", "secret = 'aGVsbG8gd29ybGQgaGVsbG8='", "account 1234567890", "1234567890 pieces ", "IBAN DE89370400440532013000 ", "SSN 123-45-6789", "call 555-010-9999 ", "(030) 123-4567 ", "phone 0301 1234 5678", "internationalisation ", "a/path/with/many/parts/in/it ", "MAX_RETRY_COUNT_VALUE=other", "é🙂 ", "\n", "words of prose ", "4539148803436467 "]


def test_generated_spans_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = set()
    for r in pii.pii_report(df).collect():
        expected = []
        for kind, pattern in pii.GENERATORS.items():
            trees, least = pii.models()[kind]
            for m in re.finditer(pattern, texts[r["doc_id"]]):
                before = texts[r["doc_id"]][max(m.start() - 32, 0) : m.start()]
                if trees.logit(np.array([[f(m[0], before) for _, _, f in pii.FEATURES]], float))[0] >= least:
                    expected.append(f"{kind}:{m.start()}:{m.end()}")
        got = [s for s in r["spans"].split(",") if s and s.split(":")[0] in pii.GENERATORS]
        assert got == expected
        seen |= {s.split(":")[0] for s in got}
    assert seen == set(pii.GENERATORS)


def test_notices_equal_brute_force():
    rng = random.Random(3)
    found = licenses.machine()
    phrases = {**{p: label for p, (label, _) in licenses.NOTICES.items()}, **licenses.BASE}
    words = sorted({w for p in phrases for w in p.split()} | {"the", "other"})
    for _ in range(400):
        own = []
        while len(own) < 30:
            own += rng.choice(list(phrases)).split() if rng.random() < 0.3 else [rng.choice(words)]
        text = "".join(w.upper() + rng.choice([" ", ", ", "\n", "-"]) if rng.random() < 0.3 else w + " " for w in own)
        expected = {label for p, label in phrases.items() if f" {p} " in f" {' '.join(own)} "}
        s = licenses.scan(text.encode(), found)
        assert set(s.labels) == expected and s.words == len(own)
        assert len(s.base) == sum(own[k : k + len(p.split())] == p.split() for p in licenses.BASE for k in range(len(own)))
