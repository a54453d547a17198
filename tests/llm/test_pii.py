"""Operator 6 against brute force (base spans) and on planted spans."""

import hashlib
import random
import re

from sitelens.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(df, rows):
    got = pii.personal_digest(pii.personal_spans(df)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id in (None, 6):  # ids that stand for several texts
            continue
        base = brute_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans.startswith(",".join(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in BASE]
    return got


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(4)
    parts = [*"0123456789", *"ab.@-+ ()%_é\U0001f600,", "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "4111111111111111",
             "4111 1111-1111 1111", "000.", "@x.y", "256.1.1.1", "Mr. John Smith", "call 555-123-4567 ", "123-45-6789"]
    rows = [(i + 10, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(800)]
    long_runs = ["9" * 30_000, "a" * 30_000, "a@b" + ".c" * 20_000, "1 " * 20_000, "+1" + "(" * 30_000, "1." * 9_999]
    rows += list(enumerate(long_runs, 5000))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_further_spans_by_agreement_of_labelers(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(10, 210):
        number = f"{rnd.randint(2, 8)}{rnd.randint(10, 99)}-555-{rnd.randint(1000, 9999)}"
        rows.append((i, rnd.choice([
            f"please call {number} today", f"Dr. Maria Weber wrote to a{i}@mail.example.com", f"ssn 523-45-{rnd.randint(1000, 9999)} on file",
            f"order #{rnd.randrange(10**9, 10**10)} shipped", f"build v{rnd.randrange(10**10, 10**11)} failed", "nothing here",
        ])))
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    texts = dict(rows)
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",")} for r in got}
    personal = [i for i, t in rows if t.startswith(("please", "Dr", "ssn"))]
    clean = [i for i, t in rows if t.startswith(("order", "build", "nothing"))]
    assert sum(bool(kinds[i] & {"local", "person", "ssn"}) for i in personal) >= 0.9 * len(personal)
    assert not any(kinds[i] - {""} for i in clean), [texts[i] for i in clean if kinds[i] - {""}][:3]


def test_estimates_recover_reliable_labelers(spark):
    rnd = random.Random(5)
    quality = {"pattern": 0.95, "check": 0.9, "gazetteer": 0.85, "context": 0.6, "place": 0.5}
    rows = []
    for _ in range(4000):
        truth = rnd.random() < 0.4
        rows.append(tuple((1 if truth else -1) * (1 if rnd.random() < q else -1) for q in quality.values()) + (1.0,))
    votes = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in quality) + ", n double")
    votes = votes.groupBy(*quality).agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    _, found = pii.estimate(votes)
    assert abs(found["share"] - 0.4) < 0.05
    for k, q in quality.items():
        assert abs(found["chance"][k, 1, 1] - q) < 0.08


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()])
    assert pii.personal_digest(pii.personal_spans(no_docs)).count() == 0
