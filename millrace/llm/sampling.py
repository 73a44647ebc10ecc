"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

For a term with weight w, sample number k draws r and c from Gamma(2, 1) and b from
U(0, 1), all fixed by (term, k): t = floor(ln w / r + b), and the term whose
ln c - r (t - b) - r is least is sampled, with its t. Two texts agree in a sample with
the probability of their generalised Jaccard similarity, sum min(w) / sum max(w).

Terms are words, weights their numbers of occurrences. Texts are shuffled once, to
buckets of neighbouring doc_ids; each bucket also gets the first document of the next
one, so that "the next document" needs no join. A text and its edited text share the
draws of a term with equal weights. The least a of a text of n words is exponential with
mean 1 / n, so draws that are surely above ``REACH`` / n are dropped before their
logarithms are taken. A draw within the limit is less than all that are dropped.

The likeness of two fingerprints is a mean of 128 draws: its standard error is
sqrt(j (1 - j) / 128), 0.044 at a similarity of 0.5 and 0.035 at 0.8.

Skew: buckets hold equal numbers of rows; a text's terms never leave its bucket; a very
long text is many terms, whose draws are met one row at a time.

Defined results: a null text is empty; texts without words have the fingerprint of
zeros, alike to one another (likeness 1) and unlike all others; rows with equal
doc_ids follow one another by text, rows with null doc_id come first; one document
alone is its own next; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shuffle_partitions

#: Fixed value: what separates words, as in [^\x20\x09-\x0D]+.
GAPS = r"[\x20\x09-\x0D]+"
SAMPLES = 128
#: Draws of a text of n words count up to a = REACH / n. The least is above that with a probability of exp(-REACH), 2e-16;
#: the job then fails instead of giving another sample.
REACH = 36.0
_STEP = float(1 << 21)
_HALF = float(1 << 32)


def _uniform(h: Column, at: int) -> Column:
    """A number in (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / _STEP


def _hashes(term: Column, k: Column) -> tuple[Column, Column]:
    return F.xxhash64(term, k), F.xxhash64(term, -1 - k)


def _gammas(h: Column, g: Column) -> tuple[Column, Column, Column]:
    """What r and c are the negative logarithms of, and b."""
    word = lambda at: (F.shiftrightunsigned(g, at).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) / _HALF
    return _uniform(h, 0) * _uniform(h, 21), word(0) * word(32), _uniform(h, 42)


def _order(q: Column, p: Column, b: Column, lw: Column) -> tuple[Column, Column]:
    """ln a, and t, of a draw."""
    r = -F.ln(q)
    t = F.floor(lw / r + b)
    return F.ln(-F.ln(p)) - r * (t - b + 1.0), t


def _sample(h: Column, y: Column, t: Column) -> Column:
    """One long whose minimum over a text's terms is the sample: the order key ln a in the upper half, in steps of
    2**-24, bits of a hash of (term, k) and of t in the lower."""
    up = F.floor((F.least(F.greatest(y, F.lit(-63.9)), F.lit(63.9)) + 64.0) * float(1 << 24)) - (1 << 30)
    low = (h.bitwiseAND(F.lit((1 << 62) - 1)) + t * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(up, 32).bitwiseOR(low)


def with_draws(terms: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and s: the draws of a term (column ``at`` numbers them) with a <= ``most``, whose logarithm
    is ``edge``; ``lw`` is that of ``weight``, and rows where it is null stay, once, with a null.

    Most draws are told to be above ``most`` without a logarithm: -ln p >= 4 (1 - p**(1/4)), and exp(-r (1 - b)) is a
    weighted geometric mean of q = exp(-r) and 1, at least their harmonic one (taken of fourth roots); for weights above
    1, a >= -ln p q / w. Steps whose columns are used more than once name the partition (times 0), so that Spark does
    not work them out anew at each use.
    """
    now = F.spark_partition_id() * 0
    of = ["weight", "lw", "most", "edge"]
    hashed = terms.select(*keep, *of, *[(c + now).alias(n) for n, c in zip("hg", _hashes(F.col("term"), F.col("at")), strict=True)])
    drawn = hashed.select(*keep, *of, "h", *[(c + now).alias(n) for n, c in zip("qpb", _gammas(F.col("h"), F.col("g")), strict=True)])
    root = lambda c: F.sqrt(F.sqrt(c))
    most = F.col("most") * 1.000001
    alone = F.col("lw").isNull() & (F.col("at") == 0)
    # First the looser and cheaper bound, a >= (1 - p) q / w; the roots are taken once, of what it leaves.
    rough = drawn.filter(alone | ((1.0 - F.col("p")) * F.col("q") <= most * F.col("weight")))
    mean = F.when(F.col("lw") == 0.0, (1.0 - F.col("b")) / root(F.col("q")) + F.col("b")).otherwise(root(F.col("weight") / F.col("q")))
    rooted = rough.select(*keep, *of, *"hqpb", (mean + now).alias("m"), (4.0 * (1.0 - root(F.col("p"))) + now).alias("c"))
    near = rooted.filter(alone | (F.col("c") <= most * F.col("m") * F.col("m") * F.col("m") * F.col("m")))
    y, t = _order(*map(F.col, "qpb"), F.col("lw"))
    keys = near.select(*keep, "lw", "edge", "h", (y + now).alias("y"), (t + now).alias("t"))
    return keys.filter(F.col("lw").isNull() | (F.col("y") <= F.col("edge"))).select(*keep, _sample(*map(F.col, "hyt")).alias("s"))


def by_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, and next_text: the text of the next document in ascending doc_id.

    ``bucket`` and ``ghost`` say where a row lies and whether it is the copy of the next
    bucket's first row, which has its own text but no next one. Borders and first rows
    of the buckets (four to a shuffle partition) are literals, so that plans of one shuffle are equal and Spark reuses it.
    """
    one = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    n = shuffle_partitions(docs.sparkSession)
    buckets = 4 * n  # several to a partition, so that partitions even out
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = keyed.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    cuts = sorted({int(c) for c in cuts})
    # Two levels, so that a row is compared with about 2 * sqrt(n) borders.
    wide = max(1, int(len(cuts) ** 0.5))
    low = F.lit(-(1 << 63))
    key = F.coalesce("doc_id", low)
    borders, coarse = F.col("_borders"), F.col("_coarse")
    keyed = keyed.withColumns({"_borders": one(cuts), "_coarse": one(cuts[::wide])})
    first = F.size(F.filter(coarse, lambda c: c <= key))
    part = F.slice(borders, F.greatest(F.lit(1), (first - 1) * wide + 1), F.lit(wide))
    bucket = F.when(first == 0, 0).otherwise((first - 1) * wide + F.size(F.filter(part, lambda c: c <= key)))
    # The smallest doc_id of each bucket that has rows: a row a bucket.
    heads = keyed.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min(F.coalesce("doc_id", low)).alias("head")).orderBy("bucket").collect()
    if not heads:
        return keyed.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(False).alias("ghost"), F.lit(False).alias("wrap"))
    before = {h["head"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}
    # The head is looked up in the row's own bucket; its copy goes to the bucket before.
    slots, to = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)  # a bucket without rows is never looked up
    for h in heads:
        slots[h["bucket"]], to[h["bucket"]] = h["head"], before[h["head"]]
    at = F.col("bucket") + 1
    is_head = F.coalesce("doc_id", low) == F.element_at(one(slots), at)
    copy = F.struct(F.element_at(one(to), at).cast("int").alias("bucket"), F.lit(True).alias("ghost"))
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("ghost"))
    wrap = F.col("_to.ghost") & (F.col("bucket") == F.lit(heads[0]["bucket"]))
    return (
        keyed.withColumn("bucket", bucket)
        .select("doc_id", "text", "bucket", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("_to"))
        .select("doc_id", "text", F.col("_to.bucket").alias("_b"), F.col("_to.ghost").alias("ghost"), wrap.alias("wrap"))
        .withColumnRenamed("_b", "bucket")
        .filter("bucket is not null")  # always so; a join would put it into one of two plans of this shuffle, which then are not one
        .repartition(n, "bucket")
    )


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``next_text``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = Window.partitionBy("bucket").orderBy("wrap", "ghost", "doc_id", "text")
    rows = (
        by_neighbours(docs)
        .withColumn("place", F.row_number().over(order))
        .withColumn("next_text", F.lead("text").over(order))
    )
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("kind"), edited(F.col("text"), F.col("next_text")).alias("body")),
    )
    versions = F.when(F.col("ghost"), F.slice(both, 1, 1)).otherwise(both)
    bodies = rows.select("bucket", "place", F.explode(versions).alias("_v")).select("bucket", "place", "_v.kind", F.split("_v.body", GAPS).alias("words"))
    # The text's words, two less for the empty ones at its ends: less only makes the limit of its draws wider.
    sized = bodies.select("bucket", "place", "kind", "words", F.greatest(F.size("words") - 2, F.lit(1)).alias("total"))
    # There is always a word. For explode Spark would filter by size(words) below the split, and split each text for that once more.
    terms = sized.select("bucket", "place", "kind", "total", F.explode_outer("words").alias("word"))
    # An empty word stands for "no word here": it keeps the row and has no weight.
    term = F.when(F.col("word") != "", F.xxhash64("word"))
    times = lambda kind: F.count(F.when(F.col("kind") == kind, F.lit(1)))
    counted = terms.groupBy("bucket", "place", term.alias("term")).agg(times(0).alias("w0"), times(1).alias("w1"), F.min("total").alias("total"))
    # Sides: 1 the text, 2 the edited text, 3 both alike.
    entry = lambda w, side: F.struct(F.col(w).alias("weight"), F.lit(side).alias("side"))
    entries = F.when(F.col("w0") == F.col("w1"), F.array(entry("w0", 3))).otherwise(F.filter(F.array(entry("w0", 1), entry("w1", 2)), lambda e: e["weight"] > 0))
    weighed = counted.select("bucket", "place", "term", "total", F.explode(entries).alias("_e"))
    now = F.spark_partition_id() * 0  # else Spark takes the logarithms behind the explode, once for each draw
    lw = F.when(F.col("term").isNotNull(), F.ln(F.col("_e.weight").cast("double")) + now)
    most = REACH / F.col("total")
    logs = weighed.select(
        "bucket", "place", "term", F.col("_e.side").alias("side"), F.col("_e.weight").alias("weight"), lw.alias("lw"), (most + now).alias("most"), (F.ln(most) + now).alias("edge")
    )
    drawn = with_draws(logs.select("*", F.explode(F.array(*map(F.lit, range(samples)))).alias("at")), ["bucket", "place", "side", "at"])
    least = lambda side: F.min(F.when(F.col("side").isin(side, 3), F.col("s")))
    sampled = drawn.groupBy("bucket", "place", "at").agg(least(1).alias("own"), least(2).alias("changed"))
    # A sample with its number above it, so that sorted longs are the fingerprint; nulls are not collected.
    numbered = lambda c: F.collect_list(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))))
    listed = sampled.groupBy("bucket", "place").agg(numbered("own").alias("own"), numbered("changed").alias("changed"))
    lower = lambda c: F.transform(F.sort_array(c), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    lost = F.raise_error(F.lit("a text has no draw within REACH; raise it"))
    whole = lambda c: F.when(F.size(c) == samples, lower(c)).when(F.size(c) == 0, F.array_repeat(F.lit(0), samples)).otherwise(lost)
    side = listed.select(F.col("bucket").alias("_b"), F.col("place").alias("_p"), *[whole(c).alias(c) for c in ("own", "changed")])
    side = side.withColumn("following", F.lead("own").over(Window.partitionBy("_b").orderBy("_p")))
    facts = rows.filter(~F.col("ghost")).select(
        "bucket",
        "place",
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode(edited(F.col("text"), F.col("next_text")), "UTF-8"), 256).alias("edited_sha256"),
    )
    beside = facts.join(side, (F.col("_b") == F.col("bucket")) & (F.col("_p") == F.col("place")))
    shown = lambda c: F.translate(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""), "ABCDEF", "abcdef")
    alike = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(samples)
    return beside.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        alike(F.col("own"), F.col("changed")).alias("near_edited"),
        alike(F.col("own"), F.col("following")).alias("near_next"),
    )
