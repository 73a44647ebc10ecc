"""Fingerprints against a second implementation of the draws, one term and sample at a time."""

import math
import re
from collections import Counter

import xxhash

from millrace.llm import sampling

from . import awkward

LOW = 0xFFFFFFFF


def spark_hash(first: bytes, then: bytes | None = None) -> int:
    """xxhash64 of one or two columns: each is the seed of the next."""
    h = xxhash.xxh64_intdigest(first, seed=42)
    return h if then is None else xxhash.xxh64_intdigest(then, seed=h)


def draw(term: int, weight: int, k: int) -> tuple[float, int]:
    """The order key of a term and weight in sample k, and what the sample then is."""
    at = lambda n: spark_hash(term.to_bytes(8, "little"), n.to_bytes(4, "little", signed=True))
    h, g = at(k), at(-1 - k)
    part = lambda i: ((h >> i & ((1 << 21) - 1)) + 0.5) / (1 << 21)
    r, b = -math.log(part(0) * part(21)), part(42)
    c = -math.log(((g & LOW) + 0.5) / (1 << 32) * (((g >> 32) + 0.5) / (1 << 32)))
    t = math.floor(math.log(weight) / r + b)
    y = math.exp(r * (t - b))
    return c / (y * math.exp(r)), (h % (1 << 62) + t * 0x9E3779B1) & LOW


def brute_fingerprint(text: str) -> str:
    words = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)
    terms = {spark_hash(w.encode()): n for w, n in words.items()}
    return "".join(f"{min(draw(t, n, k) for t, n in terms.items())[1] if terms else 0:08x}" for k in range(sampling.SAMPLES))


def test_draws(spark):
    docs = awkward.frame(spark, 30).filter("doc_id < 60 or doc_id in (201, 202, 203)")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    for r in sampling.fingerprints(docs).collect():
        want, got = pieces(brute_fingerprint(texts[r.doc_id])), pieces(r.fingerprint)
        assert len(got) == sampling.SAMPLES
        # The order key is kept in steps of 2**-24; a tie within one may fall the other way.
        assert sum(a != b for a, b in zip(want, got, strict=True)) <= 1


def test_most_draws_take_no_logarithm(spark):
    """Of a text of 1,000 words few draws are left, the least of each sample among them."""
    terms = {spark_hash(f"w{i}".encode()): 1 + (i % 7 == 0) for i in range(875)}
    signed = lambda t: t - (1 << 64) if t >> 63 else t
    most = sampling.REACH / sum(terms.values())
    rows = [(signed(t), n, math.log(n), most, math.log(most), k) for t, n in terms.items() for k in range(16)]
    table = spark.createDataFrame(rows, "term long, weight int, lw double, most double, edge double, at int")
    left = sampling.with_draws(table, ["at"]).collect()
    assert len(left) < len(rows) / 8
    least = {k: min(r.s for r in left if r.at == k) & LOW for k in range(16)}
    want = {k: min(draw(t, n, k) for t, n in terms.items())[1] for k in range(16)}
    assert sum(least[k] != want[k] for k in want) <= 1


def test_texts_are_shuffled_once(spark, sf_dir):
    """Both uses of the neighbours are of one plan, so that Spark makes one shuffle of the texts."""
    from millrace.llm.sampling import fingerprints

    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("REPARTITION_BY_NUM") - final.count("ReusedExchange") <= 1 and "ReusedExchange" in final


def test_texts_are_split_once(spark):
    """No filter below the explode of words splits each text again."""
    out = sampling.fingerprints(awkward.frame(spark, 30).filter("doc_id < 60"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "split(" in line]
