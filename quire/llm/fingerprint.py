"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles (A-Z and other letters lower-cased; with
fewer words, the whole sequence is the one shingle). Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and the number of distinct shingles. Built-in functions only.

Defined cases: a null text is an empty one; an empty sketch resembles an empty one by 1 and others by 0; repeated rows
are rows of their own (equal texts have equal sketches); an empty table gives no rows; extra columns are ignored;
null ids come last in the descending order of doc_id; rows of equal id are ordered by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import GAP, partitions

K = 64
SHINGLE = 5
_LEAST = -(1 << 63)
#: Text of a range of ids, about, and ranges at most (a range is sorted, and can spill, in one task).
RANGE_BYTES = 64 << 20
MOST_RANGES = 1 << 16


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    hashed = df.withColumn("_words", F.transform(F.array_remove(F.split(F.lower(F.col(text)), GAP), ""), lambda w: F.xxhash64(w)))
    w, n = F.col("_words"), F.size("_words")
    whole = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))
    shingles = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))
    return hashed.withColumn(out, bottom(shingles, k)).drop("_words")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the sets' intersection over union; exact while both fit in a sketch."""
    both = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(both) == 0, 0.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's shingles that b has."""
    r = resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k)))


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, carried: list[str], ranges: int | None = None) -> DataFrame:
    """docs (with _k, the order, and _t, which settles ties) with next_<c>, for each c in carried, of the next row by descending
    (_k, _t); after the last comes the first.

    Rows are dealt by ranges of _k, as many as the texts' bytes ask for, and where one _k fills several ranges by _t; a range also
    gets the first rows of the one after it.
    """
    if not ranges:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = min(MOST_RANGES, max(4 * partitions(docs.sparkSession), size // RANGE_BYTES))
    marks = docs.agg(F.percentile_approx("_k", F.lit([i / ranges for i in range(1, ranges)] or [0.5]), max(10_000, 4 * ranges))).first()[0] or []
    known = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # one literal, however long
    steps = [1 << i for i in reversed(range(max(1, len(marks)).bit_length()))]

    def below(test):
        """How many marks come before the first that fails the test, by halving."""
        look = lambda acc, s: F.coalesce(test(F.get(known(marks, "long"), acc + s - 1)), F.lit(False))
        return F.aggregate(F.lit(steps), F.lit(0), lambda acc, s: F.when(look(acc, s), acc + s).otherwise(acc)) if marks else F.lit(0)

    ranged = docs.withColumn("_low", below(lambda m: m < F.col("_k"))).withColumn("_same", below(lambda m: m <= F.col("_k")) - F.col("_low"))
    part = F.floor((F.col("_t").cast("double") / 2.0**64 + 0.5) * F.col("_same")).cast("int")
    ranged = ranged.withColumn("_range", F.col("_low") + F.greatest(F.lit(0), F.least(part, F.col("_same") - 1))).drop("_low", "_same")
    heads = {r["_range"]: (r["m"]["_k"], r["m"]["_t"]) for r in ranged.groupBy("_range").agg(F.max(F.struct("_k", "_t")).alias("m")).collect()}  # `ranges` rows
    if not heads:
        return ranged.select(*docs.columns, *(F.col(c).alias(f"next_{c}") for c in carried))
    order = sorted(heads)
    give = {low: high for low, high in zip(order, order[1:])}  # a range's head also goes to the next higher range
    slots = range(order[-1] + 1)
    at = lambda of, kind="long": F.get(known([of(r) for r in slots], kind), F.col("_range"))
    head = (F.col("_k") == at(lambda r: heads.get(r, (_LEAST, 0))[0])) & (F.col("_t") == at(lambda r: heads.get(r, (_LEAST, 0))[1]))
    to = at(lambda r: give.get(r, -1), "int")
    top = (F.col("_range") == order[-1]) & head
    places = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("extra")), F.when(head & (to >= 0), F.struct(to.alias("r"), F.lit(1).alias("extra"))), F.when(top, F.struct(F.lit(order[0]).alias("r"), F.lit(2).alias("extra"))))
    dealt = ranged.withColumn("_place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    w = Window.partitionBy("_place.r").orderBy("_place.extra", F.desc("_k"), F.desc("_t"))
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).filter(F.col("_place.extra") == 0)
    return out.select(*docs.columns, *(f"next_{c}" for c in carried))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).withColumn("_t", F.xxhash64("text"))
    pairs = with_next(with_sketch(rows, "text", "sketch", k), ["text", "sketch"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    done = with_sketch(pairs.withColumn("_edited", edited), "_edited", "edited_sketch", k)
    return done.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
