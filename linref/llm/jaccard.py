"""Exact Jaccard links between word-shingle sets, by adaptive multi-match prefixes, and their components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linref.llm._shared import cut, gram_hashes, mix, release, sieve, sifted, signed, slices, starts_of_grams, tidy, unused, word_hashes
from linref.llm.components import components

WORDS, PERCENT = 5, 75
#: Prefixes are built for up to so many required matches: 1, 2 or 4, as a node's estimated candidates exceed these numbers.
MOST_MATCHES, COSTS = 4, (64, 512)
#: A token of more nodes than this is split by the sizes of the sets that may meet at it, into bands that are so much wider each.
HOT, BAND = 64, 1.2
#: At most so many frequent shingles are ordered by their frequency, and so broadcast (16 bytes each); the rest is ordered by hash.
ORDERED = 500_000
#: Buckets by which a pair's overlap is bounded.
BUCKETS = 256
#: Shingles are counted so many at a time.
COUNTED = 2_000_000
#: What the first pass over the texts gives: of each row its key and set (df null), and the counts of shingles that are frequent among some thousand rows.
NAMES = ["doc_id", "rid", "n_shingles", "k", "token", "df"]
#: Bits of a set's sketch, 64 to a column.
SKETCH = [f"s{i}" for i in range(8)]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, and the rows they belong to, sorted by row and hash."""
    words, rows = word_hashes(data, offsets, fold=True)
    grams = gram_hashes(words, n)
    at, row = starts_of_grams(rows, n)
    values = grams[at]
    few = np.flatnonzero((np.diff(rows) < n) & (np.diff(rows) > 0))
    if len(few):  # fewer words: the whole sequence is the one shingle
        values = np.concatenate([values, np.array([gram_hashes(words[rows[i] : rows[i + 1]], rows[i + 1] - rows[i])[0] ^ np.uint64(rows[i + 1] - rows[i]) for i in few], np.uint64)])
        row = np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        values, row = values[order], row[order]
    ends = np.searchsorted(row, np.arange(len(rows)))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]


def _keys(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and key of each row's set; equal sets have equal keys."""
    size = np.bincount(row, minlength=n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
    ends = np.cumsum(size)
    return size, mix(sums[ends] - sums[ends - size] + size.astype(np.uint64))


def _sketches(values: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
    """Of each row's set whether an odd number of its shingles falls on each bit: two sketches differ in no more bits than their sets in shingles."""
    bits = 64 * len(SKETCH)
    odd = np.bincount(row * bits + (mix(values) % np.uint64(bits)).astype(np.int64), minlength=n * bits).astype(np.uint8) & 1
    packed = np.packbits(odd).view(np.uint64).reshape(n, len(SKETCH))
    return [signed(np.ascontiguousarray(packed[:, i])) for i in range(len(SKETCH))]


def _summaries(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            """Counts of some thousand documents at once: a frequent shingle is in two of them at least."""
            values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            found.clear()
            keep = counts >= 2
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, signed(values[keep]), pa.array(counts[keep].astype(np.int64)), *[none] * len(SKETCH)], NAMES + SKETCH)

        for part, data, offsets in slices(batches, "text"):
            values, row = _sets(data, offsets, n)
            found.append(values)
            size, key = _keys(values, row, part.num_rows)
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(size.astype(np.int64)), signed(key), none, none, *_sketches(values, row, part.num_rows)], NAMES + SKETCH)
            if sum(map(len, found)) > COUNTED:
                yield frequent()
        yield frequent()

    return run


def _prefixes(n: int, percent: int, frequent, some=None):
    """The prefix of each row's set; some: a sieve of the tokens that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = frequent.value
        seen = np.zeros(1 << 23, bool)  # whether any frequent shingle starts with these 23 bits
        seen[tokens >> np.uint64(41)] = True
        for part, data, offsets in slices(batches, "text"):
            values, row = _sets(data, offsets, n)
            size, key = _keys(values, row, part.num_rows)
            order = np.zeros(len(values), np.int64)
            maybe = np.flatnonzero(seen[values >> np.uint64(41)])
            if len(maybe):
                at = np.searchsorted(tokens, values[maybe])
                at[at == len(tokens)] = 0
                order[maybe] = np.where(tokens[at] == values[maybe], rank[at], 0)
            # Rare shingles first, by hash, then the others by frequency.
            often = np.flatnonzero(order)
            often = often[np.argsort(row[often] * np.int64(1 << 32) + order[often], kind="stable")]
            rare = np.flatnonzero(order == 0)
            sort = np.concatenate([rare, often])
            sort = sort[np.argsort(row[sort], kind="stable")]
            values, row = values[sort], row[sort]
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            # A partner holds at least percent of this set, so with l matches wanted the prefix is l - 1 longer.
            least = -(-size * percent // 100)
            keep = place < (size - least + MOST_MATCHES)[row]
            if some is not None:
                keep &= sifted(some.value, values)
            own = np.bincount(row, order[sort] == 0, minlength=part.num_rows) / np.maximum(size, 1)  # a set of few rare shingles is in the middle of its copies
            yield pa.RecordBatch.from_arrays([signed(values[keep]), signed(key[row[keep]]), pa.array(size[row[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array((own[row[keep]] * 1000).astype(np.int16))],
                                             ["token", "k", "n", "place", "rare"])

    return run


def _of_rids(some):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sifted(some.value, batch.column("rid").to_numpy().view(np.uint64))))

    return run


def _full(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            values, row = _sets(data, offsets, n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(pa.array(ends), signed(values))], ["k", "s"])

    return run


def _bucket_counts(n: int):
    """How many of a set's shingles fall into each of BUCKETS by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            values, row = _sets(data, offsets, n)
            counts = np.bincount(row * BUCKETS + (values % np.uint64(BUCKETS)).astype(np.int64), minlength=part.num_rows * BUCKETS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BUCKETS), pa.array(counts))], ["k", "h"])

    return run


def _possible(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets can be similar enough: two sets share no more than the lesser count of each bucket. That is a small part of the
    sets, so pairs that share a phrase by chance go before whole sets are shuffled."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    both = pairs.join(counts.select(F.col("k").alias("a"), F.col("h").alias("h1")), "a").join(counts.select(F.col("k").alias("b"), F.col("h").alias("h2")), "b")
    both = both.select("a", "b", total(F.zip_with("h1", "h2", lambda x, y: F.least(x, y))).alias("o"), total("h1").alias("x"), total("h2").alias("y"))
    return both.where(F.lit(100) * F.col("o") >= percent * (F.col("x") + F.col("y") - F.col("o"))).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Each pair fetches a's set, then b's; a hot b is split by Spark's skew join."""
    left = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("s1")), "a")
    both = left.join(sets.select(F.col("k").alias("b"), F.col("s").alias("s2")), "b")
    shared = F.size(F.array_intersect("s1", "s2"))
    return both.select("a", "b", shared.alias("o"), F.size("s1").alias("x"), F.size("s2").alias("y")).where(F.lit(100) * F.col("o") >= percent * (F.col("x") + F.col("y") - F.col("o"))).select("a", "b")


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, rid, n_shingles, component_id, c) of every row; see component_digest. rid hashes key and text.

    c is the component's own key, null for rows without words; component_id is a label that unlinked components may share."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), body).alias("rid"), body.alias("text"))
    first = cut(docs.mapInArrow(tidy(_summaries(words)), ", ".join(f"{c} long" for c in NAMES + SKETCH)))
    light = first.where("df is null").select(*NAMES[:4])
    # Equal sets are one node; its copies are never paired.
    nodes = light.where("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("label"), F.min("rid").alias("rid"))
    sketches = first.where("df is null and n_shingles > 0").select("k", *SKETCH).dropDuplicates(["k"])
    top = first.where("df is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(ORDERED).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    by_value = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[by_value], (len(tokens) - by_value).astype(np.uint32)))

    kind = "token long, k long, n int, place int, rare short"
    counted = docs.select("text").mapInArrow(tidy(_prefixes(words, percent, frequent)), kind).groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    many = cut(counted)
    some = sieve(many)
    prefix = docs.select("text").mapInArrow(tidy(_prefixes(words, percent, frequent, some)), kind)
    shared = cut(prefix.join(many, "token", "left_semi").distinct())
    release(many)
    frequent.destroy()
    some.destroy()
    postings = cut(shared.join(shared.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "token"))
    release(shared)

    def of_nodes(pairs: DataFrame, made, kind: str) -> DataFrame:
        """What a function makes of the texts of all nodes in the pairs."""
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(nodes.select("k", "rid"), "k").select("rid", "k"))
        some = sieve(wanted.select("rid"))
        texts = docs.select("rid", "text").mapInArrow(tidy(_of_rids(some)), "rid long, text string")
        out = cut(texts.join(wanted, "rid").dropDuplicates(["k"]).select("k", "text").mapInArrow(tidy(made), kind))
        release(wanted)
        some.destroy()
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        counts = of_nodes(pairs, _bucket_counts(words), "k long, h array<int>")
        possible = cut(_possible(pairs, counts, percent))
        sets = of_nodes(possible, _full(words), "k long, s array<long>")
        found = cut(_verify(possible, sets, percent))
        release(pairs, counts, possible, sets)
        return found

    # Each node of a token is paired with the token's hub alone, the set with the smallest share of rare shingles: copies that were each
    # changed a little are mostly linked to the least changed one. What is linked by a hub need not be paired again. A pair that shares
    # tokens of other hubs too may be missed here; it waits for the last step.
    hubs = postings.groupBy("token").agg(F.min(F.struct("rare", F.xxhash64("k").alias("r"), "k", "n", "place")).alias("hub"))
    near = postings.join(hubs, "token").select(F.col("k").alias("k1"), F.col("n").alias("n1"), F.col("place").alias("place1"), F.col("hub.k").alias("k2"), F.col("hub.n").alias("n2"), F.col("hub.place").alias("place2"))
    near = _enough(near.where("k1 != k2"), F.lit(MOST_MATCHES), percent)
    links = verified(near)
    comp = _labels(postings, links)
    links = cut(links.unionByName(verified(_open_pairs(postings, comp, sketches, percent))).distinct())
    release(postings, comp)
    comp = components(links).select(F.col("node").alias("k"), F.col("component").alias("c"))

    named = nodes.select("k", "label").join(comp, "k", "left").withColumn("c", F.coalesce("c", "k"))
    least = cut(named.groupBy("c").agg(F.min("label").alias("component_id")))
    of_key = named.join(least, "c").select("k", "component_id", F.col("c").alias("own"))
    out = light.join(of_key, "k", "left")
    return out.select("doc_id", "rid", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("own")).alias("c"))


def _slack(n1, n2, percent: int):
    """How many shingles of a set of n1 may be missing in a linked set of n2: with l matches wanted, places up to this plus l - 1 count."""
    return n1 - F.ceil((n1 + n2) * percent / (100 + percent)).cast("int")


def _open_pairs(postings: DataFrame, comp: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of nodes of different components that share as many prefix tokens as the pair needs.

    A place p in a's prefix can only meet sets up to a size at which the pair's own prefix still reaches p. At a hot token a node is
    therefore dealt to the bands of partner sizes that its place allows, and does not occur where all its partners would have to be
    smaller than linked sets are: what shares nothing but the common core of a group of copies is never paired there. Within a token and
    its bands, nodes of the component that most of them are in are paired with the others only. Copies of
    one text that were each changed elsewhere share its tokens without being linked; their sketches keep such a pair from becoming a row."""
    # Only tokens at which nodes of different components meet are left. Those that the very same nodes hold (the shingles of one passage,
    # mostly) are one group, at which a pair meets once, with the places of all its tokens in their order.
    every = cut(postings.join(comp, "k"))
    nodes = F.xxhash64(F.bit_xor(F.xxhash64("k")), F.bit_xor(F.xxhash64("k", F.lit(1))), F.count("*"))
    mixed = every.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), nodes.alias("g")).where("c1 != c2").select("token", "g")
    held = every.join(mixed, "token").groupBy("g", "k", "n", "c", "df").agg(F.sort_array(F.collect_list(F.struct("token", "place"))).alias("held"))
    at = cut(held.withColumn("places", F.col("held.place")).withColumn("place", F.array_min("places")).drop("held"))
    release(every)
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    least = F.ceil(F.col("n") * percent / 100).cast("int")

    def dealt(rows: DataFrame, matches) -> DataFrame:
        """Rows with the bands they meet others in; only places that count with so many matches."""
        most = F.floor((F.col("n") + matches - 1 - F.col("place")) * (100 + percent) / percent).cast("int") - F.col("n")
        top = F.least(most, F.floor(F.col("n") * 100 / percent).cast("int"))
        rows = rows.withColumn("most", top).where(F.col("most") >= least)
        meets = F.when(F.col("df") > HOT, F.sequence(band(least), band(F.col("most")))).otherwise(F.array(F.lit(-1)))
        rows = rows.withColumn("other", F.explode(meets)).withColumn("own", F.when(F.col("df") > HOT, band(F.col("n"))).otherwise(-1))
        return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    key = ["g", "lo", "hi"]
    one = dealt(at, F.lit(1))
    mixed = one.groupBy(*key).agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("rows")).where("c1 != c2")
    # Estimated candidate cost of each node at one match: where it is high, more matches are asked of a longer prefix.
    costs = one.join(mixed.select(*key, "rows"), key).groupBy("k").agg(F.sum((F.col("rows") - 1) * F.size("places")).alias("cost"))
    level = F.when(F.col("cost") < COSTS[0], 1).when(F.col("cost") < COSTS[1], 2).otherwise(MOST_MATCHES)
    groups, at = at, cut(dealt(at.join(costs.select("k", level.alias("l")).join(sketches, "k"), "k"), F.col("l")).select(*key, "own", "k", "n", "place", "places", "l", "c", *SKETCH))
    release(groups)
    of_component = at.groupBy(*key, "c").agg(F.count("*").alias("rows"))
    major = of_component.groupBy(*key).agg(F.max_by("c", F.struct("rows", "c")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select(*key, "major")
    met_at, at = at, cut(at.join(major, key).withColumn("rest", F.col("c") != F.col("major")).drop("major"))
    release(met_at)
    names = ["k", "n", "place", "places", "l", "c", "own", *SKETCH]
    # Sets of n1 and n2 that are linked differ in so many shingles at most.
    differ = sum(F.bit_count(F.col(f"{s}1").bitwiseXOR(F.col(f"{s}2"))) for s in SKETCH)
    alike = F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("n1") + F.col("n2"))
    rest = at.where("rest").select(*key, *[F.col(x).alias(f"{x}1") for x in names])
    others = at.select(*key, "rest", *[F.col(x).alias(f"{x}2") for x in names])
    met = rest.join(others, key).where((F.col("c1") != F.col("c2")) & (~F.col("rest") | (F.col("k1") < F.col("k2"))) & (F.least("own1", "own2") == F.col("lo")) & (F.greatest("own1", "own2") == F.col("hi")) & alike)
    return _enough(met, F.least("l1", "l2"), percent)


def _enough(met: DataFrame, matches, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, that share as many tokens as wanted, or all that a link needs, in the prefixes that count for that number.

    met: (k1, n1, place1, k2, n2, place2) of each token that a pair shares; or of each group of tokens, with the least places and all, in
    the same order, as arrays places1 and places2."""
    need = F.least(matches, F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent)).cast("int"))
    to1, to2 = _slack(F.col("n1"), F.col("n2"), percent) + need, _slack(F.col("n2"), F.col("n1"), percent) + need
    m = F.lit(1)
    if "places1" in met.columns:
        m = F.aggregate(F.zip_with("places1", "places2", lambda x, y: ((x < to1) & (y < to2)).cast("int")), F.lit(0), lambda s, x: s + x)
    met = met.where((F.lit(100) * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (F.col("place1") < to1) & (F.col("place2") < to2) & (m > 0))
    found = met.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), need.alias("need"), m.alias("m")).groupBy("a", "b").agg(F.sum("m").alias("m"), F.first("need").alias("need"))
    return found.where("m >= need").select("a", "b")


def _labels(postings: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links).select(F.col("node").alias("k"), F.col("component").alias("c"))
    return cut(postings.select("k").distinct().join(comp, "k", "left").select("k", F.coalesce("c", "k").alias("c")))


def component_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the size of its shingle set and the least key that its links reach, itself included.

    Shingles are five consecutive words, A-Z lower-cased; fewer words are one shingle. Two rows link when their sets' Jaccard
    similarity is at least 0.75. Null, empty or blank text: empty set, linked with nothing. Equal sets are always linked. Repeated
    keys and rows: each row has its own result, and a component's id is the least key in it. Null key: kept, its rows link as any.
    Empty table: no rows. Other columns are ignored."""
    return similar_components(df, key, text).select("doc_id", "n_shingles", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component: the one of the least key, by its hash if that is repeated, null keys first.

    Rows without words (null, empty, blank) all stay. Of identical rows one stays. Empty table: no rows. Columns of any name are kept."""
    rid, one = unused(df, "rid"), unused(df, "one")
    found = cut(similar_components(df, key, text).select("doc_id", "rid", "n_shingles", "c"))
    best = found.where("n_shingles > 0").groupBy("c").agg(F.min_by("rid", F.struct("doc_id", "rid")).alias(rid)).select(rid, F.lit(True).alias(one))
    bare = found.where("n_shingles = 0").select(F.col("rid").alias(rid)).distinct().withColumn(one, F.lit(False))
    kept = df.withColumn(rid, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))).join(best.unionByName(bare), rid)
    # Identical rows share a hash; of those one stays.
    once = kept.where(F.col(one)).dropDuplicates([rid])
    return once.unionByName(kept.where(~F.col(one))).select(*df.columns)
