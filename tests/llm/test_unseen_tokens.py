"""The secret models on tokens whose words, shapes and alphabets training never saw."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from rollstats.llm import secrets

#: Identifiers in shapes that the training identifiers do not have.
SHAPES = [
    lambda a, b, c, n: f"{a}_{n}_{b}_{n % 7}_{c}", lambda a, b, c, n: f"{a.capitalize()}-{b.capitalize()}-{c}", lambda a, b, c, n: f"__{a}_{b}_{c}__",
    lambda a, b, c, n: f"v{n % 20}/{a}/{b}/{c}{n % 10}", lambda a, b, c, n: f"{a}{b[:3].upper()}{c.capitalize()}", lambda a, b, c, n: f"{2000 + n % 30}-{1 + n % 12:02}-{1 + n % 28:02}-{a}-{b}",
    lambda a, b, c, n: f"{a.upper()}_{b.upper()}_{n}", lambda a, b, c, n: f"{a}={n}/{b}={c}", lambda a, b, c, n: f"{a}{n % 100}{b.capitalize()}{c}", lambda a, b, c, n: f"{a[:3].upper()}-{n}-{b}-{c}",
]
#: Alphabets that the training strings do not have: base 32, upper hex, base 58, base 64 for URLs with padding, base 32 without look-alikes, letters.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    _UPPER + "234567", "0123456789ABCDEF", re.sub("[0OIl]", "", "0123456789" + _UPPER + _LOWER), _UPPER + _LOWER + "0123456789-_=", re.sub("[ilou]", "", "0123456789" + _LOWER), _UPPER + _LOWER,
]


def test_precision_and_recall_on_unseen_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odds = secrets.fit(secrets.scan(docs.where("doc_id % 2 = 0")))
    rng = random.Random(3)
    texts = [r.text for r in docs.where("doc_id % 2 = 1").where(F.col("text").isNotNull()).select("text").limit(300).collect()]
    words = [w.lower() for t in texts for w in re.findall("[A-Za-z]{3,}", t)]
    found = lambda x: secrets.is_random(odds, x, secrets.MIN_SCORE, secrets.MIN_MEAN)
    ordinary = [s for s in (f(*rng.sample(words, 3), rng.randint(0, 9999)) for f in SHAPES for _ in range(400)) if len(s) >= secrets.MIN_TOKEN]
    strings = ["".join(rng.choice(a) for _ in range(rng.randint(20, 48))) for a in ALPHABETS for _ in range(400)]
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    strings += ["-".join(map(hexes, (8, 4, 4, 4, 12))) for _ in range(400)]
    right, wrong = sum(map(found, strings)), sum(map(found, ordinary))
    assert len(ordinary) > 2000 and right / len(strings) > 0.97 and right / (right + wrong) > 0.97
    assert np.isfinite(odds).all()
