"""Pseudonyms against the same permutations written out, and odd tables."""

import datetime
import hashlib

from pyspark.sql import functions as F

from lakeweave.llm import pii

KEY = "k"


def feistel(left, right, a, b, kind):
    for i in range(pii.ROUNDS):
        x, m = (right, a) if i % 2 == 0 else (left, b)
        y = int(hashlib.sha256(f"{KEY}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16) % m
        left, right = ((left + y) % a, right) if i % 2 == 0 else (left, (right + y) % b)
    return left, right


def date(day):
    start = datetime.date(1900, 1, 1)
    n = (day - start).days
    left, right = feistel(n // 487, n % 487, 150, 487, "date")
    return start + datetime.timedelta(left * 487 + right)


def ip(s):
    n = [int(x) for x in s.split(".")]
    left, right = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "ip")
    return ".".join(map(str, (left // 256, left % 256, right // 256, right % 256)))


def card(d):
    left, right = feistel(int(d[:7]), int(d[7:15]), 10**7, 10**8, "card16")
    body = f"{left:07d}{right:08d}"
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body))
    return body + str(-total % 10)


def phone(d):
    left, right = feistel(int(d[:3]) - 200, int(d[3:]) - 2_000_000, 800, 8_000_000, "phone")
    return str(left + 200), str(right + 2_000_000)


def test_values_are_those_of_the_written_permutation(spark):
    days = [datetime.date(1900, 1, 1), datetime.date(1999, 2, 28), datetime.date(2000, 2, 29), datetime.date(2099, 12, 31)]
    ips, cards, phones = ["0.0.0.0", "10.1.2.3", "255.255.255.255"], ["4111111111111111", "5500005555555559"], ["9885552485", "2002000000"]
    rows, want = [], []
    for x in days:
        rows += [f"on {x.isoformat()}.", f"on {x:%d/%m/%Y}."]
        want += [f"on {date(x).isoformat()}.", f"on {date(x):%d/%m/%Y}."]
    rows += [f"ip {x} up" for x in ips] + [f"pay {x}" for x in cards] + [f"call {x[:3]}-{x[3:6]}-{x[6:]}" for x in phones]
    want += [f"ip {ip(x)} up" for x in ips] + [f"pay {card(x)}" for x in cards] + [f"call {a}-{b[:3]}-{b[3:]}" for a, b in map(phone, phones)]
    df = spark.createDataFrame(list(enumerate(rows)) * 2, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = pii.pseudonymise(df, KEY, count_column="n").collect()
    assert len(got) == 2 * len(rows) and all(r.text == want[r.doc_id] and r.n == 1 for r in got)
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0
