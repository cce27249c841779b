"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A text's paragraphs are its lines. A paragraph's likeness lanes come from its runs of up to four words, counted from its start.
RUNS = r"(?:[^ \t-\r]+[ \t]*+){1,4}"
IDENTITY_LANES, PAIRS = 8, 64
_LOW = (1 << 32) - 1


def _lanes() -> list[str]:
    return [f"id{i}" for i in range(IDENTITY_LANES)] + ["runs"] + [f"lane{i}" for i in range(PAIRS)]


def lanes(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per distinct key with the summed lanes of its text.

    Identity lanes: each paragraph adds its 32 bits of the paragraph's SHA-256 per lane, modulo 2^32 (256 bits in all, and equality is independent of the
    paragraphs' order). Likeness lanes: each run of words adds 0 or 1 per lane; two lanes of 32 bits share a long. Both are sums, so
    inserting or deleting a paragraph adds or subtracts its own lanes (add and subtract). A text that is empty has one
    empty paragraph and no runs."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(body, "\n", -1), lambda p: F.struct(F.lit(True).alias("whole"), p.alias("piece")))
    runs = F.transform(F.regexp_extract_all(body, F.lit(RUNS), F.lit(0)), lambda p: F.struct(F.lit(False).alias("whole"), F.rtrim(p).alias("piece")))
    pieces = df.select(*key, F.explode(F.concat(lines, runs)).alias("p")).select(*key, "p.whole", F.xxhash64("p.piece").alias("p1"), F.when(F.col("p.whole"), F.sha2(F.encode("p.piece", "UTF-8"), 256)).alias("digest"))
    pieces = pieces.withColumn("p2", F.xxhash64("p1", F.lit(1)))
    mask = F.lit((1 << 32) + 1)
    sums = [F.sum(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"id{i}") for i in range(IDENTITY_LANES)]
    sums.append(F.sum(F.when(~F.col("whole"), F.lit(1))).alias("runs"))
    for i in range(PAIRS):
        bits = F.shiftrightunsigned(F.col("p1" if i < 32 else "p2"), i % 32).bitwiseAND(mask)
        sums.append(F.sum(F.when(~F.col("whole"), bits)).alias(f"lane{i}"))
    out = pieces.groupBy(*key).agg(*sums)
    return out.select(*key, *[(F.col(c).bitwiseAND(F.lit(_LOW)) if c.startswith("id") else F.coalesce(F.col(c), F.lit(0))).alias(c) for c in _lanes()])


def add(a: dict[str, Column], b: dict[str, Column], sign: int = 1) -> dict[str, Column]:
    """Lanes of the union of two multisets of paragraphs; sign -1: of the difference."""
    return {c: F.pmod(a[c] + sign * b[c], F.lit(1 << 32)) if c.startswith("id") else a[c] + sign * b[c] for c in _lanes()}


def as_text(row: Column) -> Column:
    """The fingerprint of a struct of lanes as hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(row[c])), 8 if c.startswith("id") or c == "runs" else 16, "0") for c in _lanes()])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two structs of lanes: 1 for equal fingerprints, else an estimate of the cosine of the two multisets of runs.

    A run's lanes are fair coin flips that are independent of other runs', so centred sums multiply, in the mean, as the
    multisets do; with 128 lanes the standard error is below 0.09."""
    def centred(r: Column) -> list[Column]:
        n = r["runs"].cast("double")
        return [2.0 * half.cast("double") - n for i in range(PAIRS) for half in (F.shiftrightunsigned(r[f"lane{i}"], 32), r[f"lane{i}"].bitwiseAND(F.lit(_LOW)))]

    pairs = F.arrays_zip(F.array(*centred(a)).alias("x"), F.array(*centred(b)).alias("y"))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    dot = F.aggregate(pairs, zero, lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy")),
                      lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(0.0))
    same = reduce(lambda x, y: x & y, [a[c] == b[c] for c in _lanes()])
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot)))


def neighbours(ids: DataFrame, rows_per_bucket: int = 10_000, most_buckets: int = 100_000) -> DataFrame:
    """Each distinct id with the next and the previous one in ascending order, the last followed by the first.

    Ids are dealt to ranges of about as many ids each, however they are spread, and lead and lag run within a range; what lies beyond its edge
    comes from the least and greatest id of the neighbouring ranges, a table of one row per range."""
    from linref.llm._shared import cut

    n = ids.count()
    ranges = min(most_buckets, max(1, n // rows_per_bucket))
    bucketed = cut(ids.repartitionByRange(ranges, "doc_id").withColumn("b", F.spark_partition_id()))
    edges = bucketed.groupBy("b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    low, high = bucketed.agg(F.min("doc_id"), F.max("doc_id")).first()
    over = Window.orderBy("b")  # one row per range
    edges = edges.select("b", F.coalesce(F.lead("least").over(over), F.lit(low)).alias("edge_next"), F.coalesce(F.lag("most").over(over), F.lit(high)).alias("edge_previous"))
    within = Window.partitionBy("b").orderBy("doc_id")
    return bucketed.withColumn("n", F.lead("doc_id").over(within)).withColumn("p", F.lag("doc_id").over(within)).join(F.broadcast(edges), "b").select(
        "doc_id", F.coalesce("n", "edge_next").alias("next_id"), F.coalesce("p", "edge_previous").alias("previous_id"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness; see lanes and likeness.

    Edited: the last floor(n/2) code points give way to the first as many (or all) of the next text by ascending key, the first after
    the last. Null text: empty. Equal texts have equal fingerprints. Repeated keys: each distinct (key, text) has one result, the next
    text is that of the next key, by its least hash when that has several; repeated rows give repeated results. A single row is its
    own next. Null key: no order, so there is a fingerprint but no edited text and no likeness (null). Empty table: no rows. Other columns
    are ignored."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = df.select(F.col(key).alias("doc_id"), body.alias("text"))
    docs = every.where("doc_id is not null")
    light = docs.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n_chars"))
    light = light.groupBy("doc_id", "h").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    one = light.groupBy("doc_id").agg(F.min("h").alias("lead_h"), F.max("n_chars").alias("most_chars"))
    order = neighbours(one.select("doc_id"))
    # What each key's leading text lends to the texts of the key before it.
    lent = one.select(F.col("doc_id").alias("previous_id"), (F.floor(F.col("most_chars") / 2)).cast("int").alias("lend"))
    lend = order.join(lent, "previous_id").join(one.select("doc_id", "lead_h"), "doc_id").select("doc_id", "previous_id", "lead_h", "lend")
    keyed = docs.withColumn("h", F.xxhash64("text"))
    # Both uses of the texts are dealt out by doc_id alone, so that Spark shuffles them once: an equality would become a key of the join.
    heads = keyed.join(lend, "doc_id").where(F.col("h").bitwiseXOR(F.col("lead_h")) == 0).select(F.col("previous_id").alias("doc_id"), F.expr("left(text, lend)").alias("head"))
    if light.where("copies > 1").limit(1).count():
        heads, keyed = heads.dropDuplicates(["doc_id"]), keyed.dropDuplicates(["doc_id", "h"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = keyed.join(heads, "doc_id").select("doc_id", "h", "text", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.left("head", half)).alias("edited"))
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    texts = both.select("doc_id", "h", n.cast("long").alias("n_chars"), sha.alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("edit", "t"))
    own = ["doc_id", "h", "n_chars", "edited_sha256"]
    summed = lanes(texts, [*own, "edit"], "t").select(*own, "edit", F.struct(*_lanes()).alias("f"))
    rows = summed.groupBy(*own).agg(*[F.first(F.when(F.col("edit") == e, F.col("f")), True).alias(c) for e, c in ((0, "f"), (1, "g"))])
    from linref.llm._shared import cut

    rows = cut(rows)
    following = rows.join(one.select("doc_id", F.col("lead_h").alias("h")), ["doc_id", "h"]).select(F.col("doc_id").alias("next_id"), F.col("f").alias("next_f"))
    out = rows.join(order.select("doc_id", "next_id"), "doc_id").join(following, "next_id").join(light.select("doc_id", "h", "copies"), ["doc_id", "h"])
    loose = every.where("doc_id is null").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("h"), "text")
    unkeyed = lanes(loose.dropDuplicates(["h"]).select("h", F.char_length("text").cast("long").alias("n_chars"), "text"), ["h", "n_chars"], "text").join(loose.groupBy("h").agg(F.count("*").alias("copies")), "h")
    none = F.lit(None)
    unkeyed = unkeyed.select(none.cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_chars", none.cast("string").alias("edited_sha256"), as_text(F.struct(*_lanes())).alias("fingerprint"), none.cast("string").alias("edited_fingerprint"),
                             none.cast("double").alias("near_edited"), none.cast("double").alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    out = out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("g")).alias("edited_fingerprint"),
                      likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
                      F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return out.unionByName(unkeyed)
