"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's word stream is cut into blocks of (nearly) equal length. Seats of the
mix are given to sources, and then to the shards of each source, by highest quotients
``votes / (2 * seats + 1)``; inside a shard a seeded permutation of its blocks says
which of them get the seats. All of it is built-in Spark expressions.

Scale: documents are read twice (sizes are stored after the first reading) and are
shuffled once, by (source, shard), as three integers a document. A source is cut into
about the square root of its document count of shards, so a source that holds a third
of all rows is spread over many tasks at any size. The table of sources has a row a
source.

Defined results: a null text has size 0; a null source is a source of its own, sorted
last; rows with size 0 take nothing; repeated doc_ids are documents of their own; an
empty table gives an empty result. Columns other than the three named are not needed
and clashing ones are kept out by the projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import arrays
from millrace.llm.jaccard import small
from millrace.session import stored

#: What counts as a word, and the repeating weights of sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Large primes; multiplying by one of them permutes the blocks of a shard.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, group: list[str], votes: str, house: str, out: str) -> DataFrame:
    """Seats by Sainte-Laguë for each party; a group of parties shares ``house`` seats.

    Starts from votes / divisor rounded to the nearest whole, which is right up to a few
    seats, then hands out (or takes back) the difference by highest (lowest) quotient.
    A party can differ from the start by at most its share of half the number of
    parties and one more, so only so many quotients are ranked: linear in parties.
    """
    by = Window.partitionBy(*group)
    x = (
        parties.withColumn("_v", F.sum(votes).over(by))
        .withColumn("_k", F.count(F.lit(1)).over(by))
        .withColumn("_share", F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(F.lit(0.0)))
        .withColumn("_s", F.floor(F.col("_share") * F.col(house) + 0.5).cast("long"))
        .withColumn("_d", (F.col(house) - F.sum("_s").over(by)).cast("long"))
        .withColumn("_most", (F.ceil(F.col("_share") * F.col("_k") / 2) + 1).cast("long"))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    add = (F.col("_d") > 0) & (F.col("_share") > 0)
    cut = (F.col("_d") < 0) & (F.col("_s") > 0)
    steps = F.when(add, F.sequence(F.lit(0), F.col("_most"))).when(
        cut, F.sequence(F.lit(0), F.least(F.col("_most"), F.col("_s") - 1))
    )
    tries = x.select("*", F.explode(steps).alias("_j")).withColumn(
        "_q",
        F.when(F.col("_d") > 0, -F.col(votes) / (2 * (F.col("_s") + F.col("_j")) + 1)).otherwise(
            F.col(votes) / (2 * (F.col("_s") - F.col("_j")) - 1)
        ),
    )
    order = Window.partitionBy(*group).orderBy("_q", votes, "_order", "_j")
    won = (
        tries.withColumn("_order", F.xxhash64(*[F.col(c) for c in parties.columns]))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= F.abs("_d"))
        .groupBy("_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    seats = F.col("_s") + F.signum("_d").cast("long") * F.coalesce("_n", F.lit(0))
    return x.join(won, "_id", "left").select(*parties.columns, seats.alias(out))


def source_targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight`` and ``target``: weights repeat in code-point order (null last), targets sum
    to ``share`` of all sizes, none above ``most`` times its source's size.

    Sorted by size / weight, the sources that meet their limit come first. A source is
    not limited if what the limited ones before it leave, dealt by weight among the
    rest, is below its limit.
    """
    # One row a source; a null sorts after every string because isNull sorts first.
    order = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(order) - 1
    x = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    full = Window.partitionBy()
    poorest = full.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    x = (
        x.withColumn("_goal", share * F.sum("source_size").over(full))
        .withColumn("_limit", most * F.col("source_size"))
        .withColumn("_before", F.coalesce(F.sum("_limit").over(poorest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_after", F.sum("weight").over(poorest.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_goal") - F.col("_before")) / F.col("_after"))
        .withColumn("_free", F.col("_level") * F.col("weight") < F.col("_limit"))
    )
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(
        poorest.rowsBetween(Window.unboundedPreceding, 0)
    )
    return x.withColumn(
        "target", F.least(F.col("_limit"), F.coalesce(level * F.col("weight"), F.col("_limit"))).cast("double")
    ).drop("_goal", "_limit", "_before", "_after", "_level", "_free")


def mix_plan(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = 64,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """For every document: size, its source's size and target, where it lies in its shard
    (``start``), and the shard's ``words``, ``blocks``, ``seats``, ``step``, ``shift``.

    Columns in ``carry`` come along, named ``__<column>``. Block i of a shard covers words [i * words // blocks, (i + 1) * words // blocks).
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    shards = F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long")
    sources = stored(
        source_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size"), shards.alias("_shards")), share, most, weights
        ),
        "mix-sources",
    )
    place = lambda rows: rows.join(
        small(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "_shards"))
    placed = place(sized)
    cut = placed.groupBy("_source", "shard").agg(F.sum("size").alias("words")).withColumn(
        "blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("long")
    )
    cut = stored(cut, "mix-shards")
    # Targets in blocks of the source's own average length, then seats for sources.
    own = cut.groupBy("_source").agg(F.sum("blocks").alias("_blocks"))
    parties = sources.join(own, F.col("source").eqNullSafe(own["_source"]), "left").select(
        "source",
        F.when(F.col("source_size") > 0, F.col("_blocks") * F.col("target") / F.col("source_size")).otherwise(0.0).alias("votes"),
        F.col("_blocks"),
    )
    parties = parties.withColumn("house", F.round(F.sum("votes").over(Window.partitionBy())).cast("long")).withColumn("_all", F.lit(1))
    seated = apportion(parties, ["_all"], "votes", "house", "source_seats").withColumn(
        "source_seats", F.least("source_seats", F.ceil(most * F.col("_blocks")).cast("long"))
    )
    seated = seated.select(F.col("source").alias("_key"), "source_seats")
    shard_parties = cut.join(seated, F.col("_source").eqNullSafe(F.col("_key"))).drop("_key")
    quotas = apportion(shard_parties, ["_source"], "blocks", "source_seats", "seats").withColumn(
        "seats", F.least("seats", F.floor(most * F.col("blocks")).cast("long"))
    )
    draw = F.xxhash64("_source", "shard", F.lit(seed))
    quotas = quotas.select(
        F.col("_source").alias("_qs"),
        F.col("shard").alias("_qh"),
        "words",
        "blocks",
        "seats",
        F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(draw, F.lit(len(PRIMES))) + 1).cast("int")).alias("step"),
        F.when(F.col("blocks") > 0, F.pmod(F.shiftrightunsigned(draw, 3), "blocks")).otherwise(0).alias("shift"),
    )
    quotas = stored(quotas, "mix-quotas")
    before = Window.partitionBy("_source", "shard").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    if carry:
        extra = [F.col(f"`{c}`").alias(f"__{c}") for c in carry]
        placed = place(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra))
    return (
        placed.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(small(quotas), F.col("_source").eqNullSafe(F.col("_qs")) & (F.col("shard") == F.col("_qh")))
        .select("doc_id", "source", "size", "source_size", "target", "shard", "start", "words", "blocks", "seats", "step", "shift", *[f"`__{c}`" for c in carry])
    )


def block_times(i: Column) -> Column:
    """How often block ``i`` of the row's shard is taken: seats // blocks, and once more for those
    the seeded permutation puts first."""
    place = F.pmod(F.pmod(F.col("step"), F.col("blocks")) * i + F.col("shift"), F.col("blocks"))
    return F.floor(F.col("seats") / F.col("blocks")).cast("long") + F.when(
        place < F.pmod(F.col("seats"), F.col("blocks")), 1
    ).otherwise(0)


def block_pieces() -> Column:
    """The row's blocks as structs: from, to (word positions in the document), times."""
    first = F.floor(F.col("start") * F.col("blocks") / F.col("words")).cast("long") - 1
    last = F.floor((F.col("start") + F.col("size") - 1) * F.col("blocks") / F.col("words")).cast("long") + 1
    edge = lambda i: F.floor((i * F.col("words")) / F.col("blocks"))
    lo = lambda i: F.greatest(F.lit(0), edge(i).cast("long") - F.col("start"))
    hi = lambda i: F.least(F.col("size"), edge(i + 1).cast("long") - F.col("start"))
    blocks = F.sequence(F.greatest(F.lit(0), first).cast("long"), F.least(last, F.col("blocks") - 1).cast("long"))
    pieces = F.transform(blocks, lambda i: F.struct(lo(i).alias("lo"), hi(i).alias("hi"), block_times(i).alias("times")))
    return F.when(F.col("size") > 0, F.filter(pieces, lambda p: p["hi"] > p["lo"])).otherwise(
        F.array().cast("array<struct<lo:bigint,hi:bigint,times:bigint>>")
    )


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted), source, shard."""
    taken = F.aggregate(block_pieces(), F.lit(0).cast("long"), lambda a, p: a + (p["hi"] - p["lo"]) * p["times"])
    return mix_plan(docs, **options).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard"
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once with the words that are taken
    at least once, again with those taken at least twice, and so on; runs of taken blocks keep
    their white space and are set apart by a line break. Documents of which nothing is taken go."""
    columns = docs.columns
    plan = mix_plan(docs, carry=tuple(columns), **options).select(*[f"`__{c}`" for c in columns], block_pieces().alias("pieces"))
    plan = plan.filter(F.exists("pieces", lambda p: p["times"] > 0))
    text = columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, "__text"):
            data, offsets = arrays.text_bytes(batch.column(text))
            starts, ends, cut = arrays.words(data, offsets)
            data, rows, texts = data.tobytes(), [], []
            for i, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for copy in range(1, max(p["times"] for p in own) + 1):
                    spans: list[list[int]] = []
                    for p in own:
                        if p["times"] >= copy:
                            if spans and spans[-1][1] == p["lo"]:
                                spans[-1][1] = p["hi"]
                            else:
                                spans.append([p["lo"], p["hi"]])
                    rows.append(i)
                    texts.append(b"\n".join(data[starts[cut[i] + a] : ends[cut[i] + b - 1]] for a, b in spans))
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            taken[text] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(taken, names=columns)

    return plan.mapInArrow(cut_out, fields)
