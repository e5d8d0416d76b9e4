"""The estimation and the classifier of personal data against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmith.llm import pii
from tests.llm.test_contracts import FOLDER, docs  # noqa: F401


def em(patterns, rounds=pii.ROUNDS):
    """Anchored expectation-maximisation over ``[(kind, anchor, votes, n)]``."""
    n_labelers, kinds = 5, len(pii.ALL_KINDS)
    prior, hit, miss = [0.5] * kinds, [0.8] * n_labelers, [0.2] * n_labelers

    def beliefs():
        out = []
        for kind, anchor, votes, _ in patterns:
            yes, no = prior[kind], 1 - prior[kind]
            for i in range(n_labelers):
                voted = votes >> i & 1
                yes *= hit[i] if voted else 1 - hit[i]
                no *= miss[i] if voted else 1 - miss[i]
            out.append(yes / (yes + no) if anchor == 2 else float(anchor))
        return out

    for _ in range(rounds):
        p = beliefs()
        rows = list(zip(patterns, p))
        for k in range(kinds):
            own = [(x[3], b) for x, b in rows if x[0] == k and x[1] == 2]
            prior[k] = (sum(n * b for n, b in own) + 1) / (sum(n for n, _ in own) + 2)
        right, wrong = sum(x[3] * b for x, b in rows), sum(x[3] * (1 - b) for x, b in rows)
        hit = [(sum(x[3] * b for x, b in rows if x[2] >> i & 1) + 1) / (right + 2) for i in range(n_labelers)]
        miss = [(sum(x[3] * (1 - b) for x, b in rows if x[2] >> i & 1) + 1) / (wrong + 2) for i in range(n_labelers)]
    return beliefs()


@pytest.mark.parametrize("seed", range(4))
def test_estimates(spark, seed):
    chance = random.Random(seed)
    cells = {(chance.randrange(5), chance.randrange(3), chance.randrange(32)) for _ in range(60)}
    patterns = [(*c, chance.randint(1, 500)) for c in sorted(cells)]
    frame = spark.createDataFrame([(patterns,)], "patterns array<struct<kind:int,anchor:int,votes:int,n:bigint>>")
    got = frame.select(F.inline(pii.estimate(F.col("patterns")))).collect()
    assert [tuple(r)[:3] for r in got] == [p[:3] for p in patterns]
    assert [r.p for r in got] == pytest.approx(em(patterns), abs=1e-9)


def test_estimates_without_candidates(spark):
    frame = spark.createDataFrame([([],)], "patterns array<struct<kind:int,anchor:int,votes:int,n:bigint>>")
    assert frame.select(F.inline(pii.estimate(F.col("patterns")))).collect() == []


def features(match, before, after):
    shape = re.sub("[0-9]", "0", re.sub("[a-z]+", "a", match.lower()))
    word = re.search(r"([^\W_]+)(?:[^\w]|_)*$", before.lower())
    return "s" + shape, "l" + str(len(match)), "w" + (word[1] if word else ""), "b" + before[-1:] + "|" + after


def test_classifier(spark):
    texts = [
        "write to ann@example.com or bob@site.org, ip 10.0.0.1 or 999.1.1.1 or 1.2.3.4",
        'token = "0123456789abcdef0123456789abcdef01234567" and secret: alllettershere',
        "card 4111 1111 1111 1111 not 4111 1111 1111 1112; call +49 30 1234567 or 555-123-4567",
        "see carl (at) example [dot] net, +1 555 123 4567, fax 555.987.6543, password=x1y2z3x1y2z3x1y2z3x1",
    ] * 3
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.candidates(docs_)[1]
    rows = spans.select("*", pii._anchor().alias("anchor"), pii._votes().alias("votes")).collect()
    kinds = {k: i for i, k in enumerate(pii.ALL_KINDS)}
    counts = Counter((kinds[r.kind], r.anchor, r.votes) for r in rows)
    told = dict(zip(counts, em([(*c, n) for c, n in counts.items()])))
    right, wrong = defaultdict(float), defaultdict(float)
    seen = []
    for r in rows:
        p = told[kinds[r.kind], r.anchor, r.votes]
        own = features(r.match, r.before, r.after)
        seen.append((r, own))
        for key in [(r.kind,), *((r.kind, f) for f in own)]:
            right[key] += p
            wrong[key] += 1 - p
    want = {}
    for r, own in seen:
        share = (right[r.kind,] + 0.5) / (right[r.kind,] + wrong[r.kind,] + 1)
        prior = math.log(share / (1 - share))
        weights = [math.log((right[r.kind, f] + share) / (wrong[r.kind, f] + 1 - share)) for f in own]
        logit = prior + sum(w - prior for w in weights)
        want[r.row_no, r.kind, r.base, r.start] = 1 / (1 + math.exp(-logit))
    got = {(r.row_no, r.kind, r.base, r.start): r.p for r in pii.classify(spans).collect()}
    assert got.keys() == want.keys() and {k for _, k, _, _ in got} == set(pii.ALL_KINDS)
    for key, p in want.items():
        assert got[key] == pytest.approx(p, abs=1e-9)


def test_base_spans_are_believed_and_secrets_are_found(spark, docs):  # noqa: F811
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    spans = pii.candidates(table)[1]
    means = pii.classify(spans).where("strict").groupBy("kind").agg(F.avg("p").alias("p")).collect()
    assert means and all(r.p >= 0.9 for r in means)
    secret = F.concat(F.col("text"), F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('"'))
    planted = table.withColumn("text", F.when(F.col("doc_id") % 10 == 0, secret).otherwise(F.col("text")))
    for r in pii.report(planted).collect():
        start = len(docs[r.doc_id]) + len(' token = "')
        assert (f"secret:{start}:{start + 40}" in r.spans) == (r.doc_id % 10 == 0)


def test_clean_text_gains_nothing(spark):
    texts = ["An authority on tokens: nobody. The key is here; a password is secret = no", "v1.2.3 of 12-05-2020, 10:30:45"]
    docs_ = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    assert all(r.spans == [] for r in pii.report(docs_).collect())
