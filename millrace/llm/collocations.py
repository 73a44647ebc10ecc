"""Phrase collocations: exact phrase counts by counting quotient filters, then scores.

Texts lie in chunks (about ``CHUNK`` bytes). Words are counted first: a chunk sends its
distinct words, a part of the words sums them by the words themselves and answers
with an id for each that is frequent. The chunks then hold ids, 0 for a word that is not
frequent and between pieces. For n = 2, 3, 4 a chunk counts its n-grams of which both
(n-1)-grams are frequent (no others can be), permutes and splits them by range, and
sends a counting quotient filter to each part; a part merges its sorted filters and
answers with a bit an entry. Chunks stay where they are (bucketed); filters and answers move.

Counts of all phrases seen often enough are exact, and both parts of a phrase are seen
as often as the phrase itself, so scores need nothing else.

Defined results: null texts are empty, a null lang is ``und``; rows are texts of their own,
repeated ones too, whatever their doc_id; a very long text is a chunk of its own;
columns of other names are ignored; scores that tie go by count, then by phrase in byte
order; an empty table gives no rows. More than 2**32 - 1 frequent words are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import arrays, chunks
from millrace.llm import quotient_filters as qf
from millrace.llm.scans import looked_up
from millrace.session import shuffle_partitions, stored

CHUNK = 3 << 20
LONGEST = 4
#: Bytes that end a piece.
BREAKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
LOWER = np.arange(256).astype(np.uint8)
LOWER[65:91] += 32
#: Blanks and breaks alike part words.
SPLIT = LOWER.copy()
SPLIT[[0x09, *np.flatnonzero(BREAKS)]] = 0x20
WORD = "struct<word:binary,lang:string,id:long,total:long>"
GRAM = "struct<w1:long,w2:long,w3:long,w4:long,total:long>"


class Shard:
    """A chunk's words: distinct (word, lang) with counts, the place of each occurrence among them, and breaks."""

    def __init__(self, chunk: chunks.Chunk) -> None:
        data = LOWER[chunk.data]
        starts, ends, cut = arrays.words(SPLIT[chunk.data], chunk.offsets)
        stops = np.concatenate(([0], np.cumsum(BREAKS[chunk.data])))
        owner = np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(cut))
        langs = pc.fill_null(chunk.rest.field("lang"), "und").dictionary_encode()
        self.langs, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        lang = code[owner] if len(owner) else np.zeros(0, np.int64)
        self.fresh = np.ones(len(starts), bool)  # the first of a piece
        self.fresh[1:] = (owner[1:] != owner[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])
        hashes = arrays.spans_hash(arrays.BYTE_VALUES[data], starts, ends) + lang.astype(np.uint64) * np.uint64(qf.ROUNDS[1])
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if not same(data, starts, ends, lang, first[place]):
            first, place = told_apart(data, starts, ends, lang)
        self.words = [data[s:e].tobytes() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.lang = [self.langs[i] for i in lang[first].tolist()]
        self.place, self.count, self.hash = place, np.bincount(place, minlength=len(first)), hashes[first]

    def by_lang(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for name, n in zip(self.lang, self.count.tolist(), strict=True):
            out[name] = out.get(name, 0) + n
        return out


def same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word equals another one, byte by byte."""
    sizes = ends - starts
    if not np.array_equal(sizes, sizes[other]) or not np.array_equal(lang, lang[other]):
        return False
    return np.array_equal(data[arrays.ragged(starts, sizes)], data[arrays.ragged(starts[other], sizes)])


def told_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences and places by the words themselves, for a chunk in which two hashes are equal."""
    seen: dict[tuple, int] = {}
    first, place = [], []
    for i, key in enumerate(zip(lang.tolist(), [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True)):
        if key not in seen:
            seen[key] = len(first)
            first.append(i)
        place.append(seen[key])
    return np.array(first, np.int64), np.array(place, np.int64)


def parts_by_word(words: pa.Array, parts: int) -> np.ndarray:
    """The part of each word, the same in every chunk."""
    data, offsets = arrays.text_bytes(words)
    return (arrays.mixed(arrays.spans_hash(arrays.BYTE_VALUES[data], offsets[:-1], offsets[1:])) % np.uint64(parts)).astype(np.int64)


def in_parts(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def sent_words(s: Shard, parts: int) -> list[tuple[int, pa.RecordBatch, np.ndarray]]:
    """For each part: its words with languages and counts, and their places in the shard."""
    words = pa.array(s.words, pa.binary())
    order, cut = in_parts(parts_by_word(words, parts), parts)
    t = pa.RecordBatch.from_arrays([words, pa.array(s.lang, pa.string()).dictionary_encode(), pa.array(s.count)], names=["word", "lang", "count"])
    return [(p, t.take(pa.array(own)), own) for p in np.flatnonzero(np.diff(cut)).tolist() if len(own := order[cut[p] : cut[p + 1]])]


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def facts_with(rows: list[tuple], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """Facts, with one more row (no home) that carries ``more``."""
    home, chunk, part, data = zip(*rows, (None, None, None, None), strict=True)
    empty = lambda a: pa.ListArray.from_arrays(pa.array([0] * (len(rows) + 1) + [len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [pa.array(home, pa.int64()), pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary()), *map(empty, more.values())],
        names=["home", "chunk", "part", "data", *more],
    )


def answered_words(t: pa.Table, parts: int, least: int) -> pa.Table:
    """A part of the words: ids (from 1; part + 1, part + 1 + parts, ...) of those seen ``least`` times, 0 for the others."""
    rows = list(zip(*[t.column(n).to_pylist() for n in ("home", "chunk", "part", "data")], strict=True))
    sent = [pa.ipc.open_stream(r[3]).read_next_batch() for r in rows]
    words = pa.concat_arrays([b.column(0) for b in sent])
    langs = pa.concat_arrays([b.column(1).dictionary_decode() for b in sent]).dictionary_encode()
    named = words.dictionary_encode()
    key = named.indices.to_numpy().astype(np.int64) * max(1, len(langs.dictionary)) + langs.indices.to_numpy()
    count = np.concatenate([b.column(2).to_numpy() for b in sent])
    kinds, first, back = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, back, count)
    often = total >= least
    ids = np.where(often, (np.cumsum(often) - 1) * parts + rows[0][2] + 1, 0)
    cut = np.cumsum([0] + [b.num_rows for b in sent])
    out = [(*r[:3], chunks.squeezed(ids[back[x:y]].astype("<i8").tobytes())) for r, x, y in zip(rows, cut[:-1], cut[1:], strict=True)]
    at = pa.array(first[often])
    made = pa.StructArray.from_arrays([words.take(at), langs.dictionary_decode().take(at), pa.array(ids[often]), pa.array(total[often])], names=["word", "lang", "id", "total"])
    return pa.Table.from_batches([facts_with(out, {"words": made})])


class Sequence:
    """A chunk's ids (0: not frequent, or a break), and the n-grams among them that can be frequent."""

    def __init__(self, ids: np.ndarray, bits: int, parts: int) -> None:
        self.ids, self.bits, self.parts = ids, bits, parts
        self.starts = np.flatnonzero(ids)  # where a frequent (n-1)-gram starts; n - 1 = 1 so far
        self.n = 1

    def up(self) -> tuple[qf.Counts, np.ndarray]:
        """The next level's counts and the place of each of its starts among them."""
        self.n += 1
        live = np.zeros(len(self.ids) + 1, bool)
        live[self.starts] = True
        self.starts = self.starts[live[self.starts + 1]]
        a, b = qf.widths(self.n, self.bits)
        ids = np.stack([self.ids[self.starts + i] for i in range(self.n)], axis=1) if len(self.starts) else np.zeros((0, self.n), np.int64)
        return qf.counted(*qf.permuted(*qf.packed(ids, self.bits), a, b), a, b)

    def keep(self, often: np.ndarray, place: np.ndarray) -> None:
        self.starts = self.starts[often[place]]

    def quotient(self, n: int) -> int:
        """Bits of the quotient: a quotient for each entry of a full chunk, so far as the left lane has bits."""
        return min(qf.widths(n, self.bits)[0], 20)

    def sent(self, c: qf.Counts) -> list[tuple[int, bytes]]:
        a, b = qf.widths(self.n, self.bits)
        part = qf.parts_of(c.left, a, self.parts)
        cut = np.searchsorted(part, np.arange(self.parts + 1))
        return [(p, qf.encoded(qf.Counts(c.left[x:y], c.right[x:y], c.count[x:y]), a, b, self.quotient(self.n))) for p in np.flatnonzero(np.diff(cut)).tolist() for x, y in [(cut[p], cut[p + 1])]]


def answered_grams(t: pa.Table, n: int, bits: int, least: int) -> pa.Table:
    """A part of the n-grams: a bit for each entry of each filter, and the frequent n-grams."""
    a, b = qf.widths(n, bits)
    rows = list(zip(*[t.column(k).to_pylist() for k in ("home", "chunk", "part", "data")], strict=True))
    q = min(a, 20)
    total, places = qf.merged([qf.decoded(r[3], a, b, q) for r in rows], a, b)
    often = total.count >= least
    out = [(*r[:3], np.packbits(often[p]).tobytes()) for r, p in zip(rows, places, strict=True)]
    ids = qf.unpacked(*qf.restored(total.left[often], total.right[often], a, b), n, bits)
    wide = [pa.array(ids[:, i]) if i < n else pa.array(np.zeros(len(ids), np.int64)) for i in range(LONGEST)]
    made = pa.StructArray.from_arrays([*wide, pa.array(total.count[often])], names=["w1", "w2", "w3", "w4", "total"])
    return pa.Table.from_batches([facts_with(out, {"grams": made})])


def answers(s: Sequence, c: qf.Counts, facts: dict[int, bytes]) -> np.ndarray:
    """The bits of all parts one after another, as the entries are."""
    part = qf.parts_of(c.left, qf.widths(s.n, s.bits)[0], s.parts)
    cut = np.searchsorted(part, np.arange(s.parts + 1))
    got = [np.unpackbits(np.frombuffer(facts[p], np.uint8), count=int(cut[p + 1] - cut[p])).astype(bool) for p in np.flatnonzero(np.diff(cut)).tolist()]
    return np.concatenate(got) if got else np.zeros(0, bool)


def _ids_table(bodies: DataFrame, answers_of: DataFrame, parts: int) -> DataFrame:
    """home, chunk, body: each chunk as its sequence of ids, with a 0 between pieces; bucketed like the chunks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks.chunks_in(batches):
            s = Shard(chunk)
            known = np.zeros(len(s.words), np.int64)
            for p, _, own in sent_words(s, parts):
                known[own] = np.frombuffer(chunks.opened(chunk.facts[p]), "<i8")
            at = np.arange(len(s.place)) + np.cumsum(s.fresh)  # a break before the first word of each piece
            ids = np.zeros(int(at[-1]) + 2 if len(at) else 1, np.int64)
            ids[at] = known[s.place]
            yield pa.RecordBatch.from_arrays([pa.array([chunk.home]), pa.array([chunk.number]), pa.array([chunks.squeezed(ids.astype("<u4").tobytes())], pa.binary())], names=["home", "chunk", "body"])

    return chunks.bucketed(chunks.with_facts(bodies, answers_of).mapInArrow(encode, "home long, chunk long, body binary"), "phrase_ids")


def phrase_counts(docs: DataFrame, least: int = 30, chunk_bytes: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (word, lang, id, total), frequent phrases of 2 to 4 words (w1..w4, total; 0 where there is
    no word), and n words of each lang."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    bodies = chunks.chunk_table(plain, "phrases", ("lang",), chunk_bytes)
    size = bodies.agg(F.sum(F.element_at("cuts", -1).cast("long"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // (32 << 20)))
    facts = "home long, chunk long, part int, data binary"

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks.chunks_in(batches):
            s = Shard(chunk)
            yield facts_with([(chunk.home, chunk.number, p, ipc(b)) for p, b, _ in sent_words(s, parts)], {"langs": pa.array(list(s.by_lang().items()), pa.struct([("lang", pa.string()), ("n", pa.int64())]))})

    sent = stored(bodies.mapInArrow(send_words, facts + ", langs array<struct<lang:string,n:long>>"), "phrase-words")
    n_words = sent.filter("home is null").select(F.explode("langs").alias("l")).groupBy("l.lang").agg(F.sum("l.n").alias("n"))
    got = sent.filter("home is not null").drop("langs").groupBy("part").applyInArrow(lambda t: answered_words(t, parts, least), f"{facts}, words array<{WORD}>")
    got = stored(got, "phrase-word-ids")
    words = got.filter("home is null").select(F.inline("words"))
    most = words.agg(F.max("id")).first()[0] or 1
    bits = max(1, int(most).bit_length())
    if bits > 32:
        raise ValueError("more frequent words than ids of 32 bits")
    sequences = _ids_table(bodies, got.filter("home is not null").select("home", "chunk", "part", "data"), parts)

    def merge(n: int):
        return lambda t: answered_grams(t, n, bits, least)

    known: DataFrame | None = None
    tables = []
    for n in range(2, LONGEST + 1):

        def send(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            for row in id_rows(batches):
                s = Sequence(row.ids, bits, parts)
                for level in range(2, n + 1):
                    c, place = s.up()
                    if level < n:
                        s.keep(answers(s, c, {p - level * parts: d for p, d in row.facts.items() if p // parts == level}), place)
                yield chunks.fact_batch([(row.home, row.number, p, d) for p, d in s.sent(c)])

        asked = chunks.with_facts(sequences, known) if known is not None else sequences
        replies = asked.mapInArrow(send, facts).groupBy("part").applyInArrow(merge(n), f"{facts}, grams array<{GRAM}>")
        replies = stored(replies, f"phrase-{n}")
        tables.append(replies.filter("home is null").select(F.inline("grams")))
        now = replies.filter("home is not null").select("home", "chunk", (F.col("part") + n * parts).alias("part"), "data")
        known = now if known is None else known.unionByName(now)
    grams = tables[0]
    for t in tables[1:]:
        grams = grams.unionByName(t)
    return words, stored(grams, "phrase-counts"), n_words


class id_rows:  # noqa: N801
    """Rows of the table of ids: home, number, ids, facts by part."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self):
        for batch in self.batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            for i in range(batch.num_rows):
                self.home, self.number = get("home")[i].as_py(), get("chunk")[i].as_py()
                self.ids = np.frombuffer(chunks.opened(get("body")[i].as_py()), "<u4").astype(np.int64)
                self.facts = chunks.facts_of(batch, i, self.number)
                yield self


KEY = ["w1", "w2", "w3", "w4"]


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: tuple[int, int] = (80, 100), chunk_bytes: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words seen ``least`` times.

    A phrase is scored by its weakest cut; one that lies in a longer phrase with at least
    ``covered`` of its count is dropped. All products are decimals of 38 digits.
    """
    words, grams, n_words = phrase_counts(docs, least, chunk_bytes)
    words = stored(words, "phrase-dictionary")
    zero = F.lit(0).cast("long")
    size = F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).otherwise(2)
    grams = grams.withColumn("size", size)

    # Longer phrases tell what they hold; a held phrase keeps the greatest count.
    w = F.array(*KEY)
    held = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.slice(w, s, m)))),
        lambda x: F.size(x) > 1,
    )
    of = lambda words_of, i: F.coalesce(F.get(words_of, F.lit(i)), zero).alias(KEY[i])
    longer = grams.filter("size > 2").select("total", F.explode(held).alias("x")).select("total", *[of(F.col("x"), i) for i in range(4)])
    most = longer.groupBy(*KEY).agg(F.max("total").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    left = grams.join(most, KEY, "left").filter(F.col("most").isNull() | (wide("most") * covered[1] < wide("total") * covered[0])).drop("most")
    left = stored(left, "phrase-left")

    # Counts of both parts of every cut; of a part asked for by many phrases by broadcast.
    counts = grams.select(*KEY, F.col("total").alias("count"), F.lit(None).cast("string").alias("lang")).unionByName(
        words.select(F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), F.col("total").alias("count"), "lang")
    )
    cuts = left.select(*KEY, "total", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    whole = F.struct(*KEY)
    part = lambda start, n: F.struct(*[of(F.slice(w, start, n), i) for i in range(4)])
    asked = cuts.select(whole.alias("g"), "total", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("p")), F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("p")))).alias("x"))
    asked = stored(asked.select("g", "total", "k", "x.side", "x.p.*"), "phrase-cuts")
    needed = asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight")).join(counts, KEY)
    met = looked_up(asked, needed, KEY, "weight", asked.count())
    both = met.groupBy("g", "total", "k").agg(F.max(F.when(F.col("side") == 0, F.col("count"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("count"))).alias("r"), F.max(F.when(F.col("side") == 0, F.col("lang"))).alias("lang"))
    both = both.withColumn("score", exact_score(F.col("total"), F.col("l") + F.col("r")))
    best = both.groupBy("g", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.max("lang").alias("lang"))
    best = best.select("g.*", F.col("total").alias("a"), "b.score", "b.l", "b.r", "lang")
    # All that can be among the first by score and count; phrases settle the rest.
    fit = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    few = stored(best.withColumn("_r", F.rank().over(fit)).filter(F.col("_r") <= top).drop("_r"), "phrase-best")
    spelled = few.select(F.struct(*few.columns).alias("row"), F.posexplode(F.filter(w, lambda x: x > 0)).alias("i", "id"))
    spelled = stored(spelled, "phrase-spelled")
    names = spelled.groupBy("id").agg(F.count(F.lit(1)).alias("weight")).join(words.select("id", "word"), "id")
    named = looked_up(spelled, names, ["id"], "weight", spelled.count())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.decode("word", "UTF-8").alias("word")))), lambda x: x["word"]), " ")
    done = named.groupBy("row").agg(text.alias("phrase")).select("row.*", "phrase")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = done.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def exact_score(a, both):
    """floor(2000000 * a / both): an integer division of decimals of 38 digits."""
    return F.call_function("div", a.cast("decimal(30,0)") * F.lit(2000000).cast("decimal(7,0)"), both.cast("decimal(38,0)")).cast("long")
