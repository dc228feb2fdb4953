"""Operator 10: document fingerprints by consistent weighted sampling, by SQL functions alone.

A text's weighted terms are its pairs of neighbouring words with their counts. As weights are whole numbers, a
term of weight w is w elements (term, 1) to (term, w), and a sample is one element of a text, each as likely as
any other: a term is drawn in proportion to its weight, and what two texts both hold is drawn from both by the
same rule. Two texts agree in a sample with the probability of their generalised Jaccard similarity, sum of
smaller weights over sum of larger ones.

Each element visits all K samples, one in each round, in an order of its own. A sample is the element that visits
it in the earliest round, the one with the least hash if there are several. So later rounds change nothing once
each sample was visited, and a text of many elements needs one or two of K rounds: the work is that of its length
and K ln K, not their product.

Nothing is exploded; a row's fingerprints are made inside the row.

Defined cases: a null text is empty; a text of one word has that word as its term; one without words
has no samples, is like another without words (1) and unlike any other (0). Rows with equal ids are
fingerprinted one by one; the next document is then the one with the next smaller different id
(null comes last), and of several rows with that id the one whose text has the smallest SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, once, table, text_of
from tessera.llm.quality import words

#: A likeness has a standard error of at most 0.062 at 0.5 and 0.049 at 0.8.
SAMPLES = 66
#: Bits of a sample that are kept.
BITS = 24
#: One text in e^7 needs more rounds than it is given first.
MARGIN = 7


def slots_of(samples: int) -> int:
    """The smallest prime that isn't below samples: steps of any size visit all of so many slots."""
    n = max(samples, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def terms(text: Column) -> Column:
    """Hashes of a text's terms, repeats included."""
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    return once(words(text), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(F.transform(w, lambda x: F.xxhash64(x))))


def elements(s: Column) -> Column:
    """Different hashes for the repeats in a sorted array of terms: a term's own for the first, one of term and number for each other."""

    def others(r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (F.get(r, i) != F.get(r, i - 1)))
        runs = once(starts, lambda p: F.transform(p, lambda at, k: F.struct(F.get(r, at).alias("h"), (F.coalesce(F.get(p, k + 1), F.size(r)) - at).alias("n"))))
        return F.when(F.size(r) == 0, r).otherwise(F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(F.lit(2), x["n"] + 1), lambda j: F.xxhash64(x["h"], j)))))

    return F.concat(F.array_distinct(s), once(F.filter(s, lambda x, i: x == F.get(s, i - 1)), others))


def enough(n: Column, samples: int) -> Column:
    """Rounds after which n elements have visited all samples, but for one text in e^MARGIN; never more than visit all for certain."""
    slots = slots_of(samples)
    return F.least(F.lit(slots), F.ceil(F.lit(slots * (math.log(samples) + MARGIN)) / F.greatest(n, F.lit(1))).cast("int"))


def visits(found: Column, samples: int, rounds: Column) -> Column:
    """A number for each element and round, of which a sample's least is the sample: slot, round, hash of both.

    An element visits slot (a + round b) mod p, a and b its own, p prime: over all rounds every slot once, any two
    slots in rounds that are any two different ones. Slots beyond the samples are passed over.
    """
    slots = slots_of(samples)
    width = slots.bit_length()
    a = lambda x: F.shiftrightunsigned(x, 2)
    b = lambda x: F.shiftrightunsigned(x, 33) % (slots - 1) + 1
    first = lambda place: F.shiftleft(F.coalesce(place % slots, F.lit(0).cast("long")), 63 - width)
    last = lambda h: h.bitwiseAND((1 << 63 - 2 * width) - 1)

    at_once = F.transform(found, lambda x: first(a(x)).bitwiseOR(last(F.xxhash64(x))))
    numbers = F.sequence(F.lit(1).cast("long"), rounds.cast("long") - 1)
    one = lambda i, shifted: F.transform(found, lambda x: first(a(x) + i * b(x)).bitwiseOR(shifted).bitwiseOR(last(F.xxhash64(x, i))))
    later = F.flatten(F.transform(numbers, lambda i: once(F.shiftleft(i, 63 - 2 * width), lambda shifted: one(i, shifted))))
    return F.when(rounds > 1, F.concat(at_once, later)).otherwise(at_once)


def least(v: Column, samples: int) -> Column:
    """The least of each sample's numbers, of all in their order: those whose slot, the highest bits, isn't that of the one before."""
    slot = 1 << 63 - slots_of(samples).bit_length()
    return F.filter(v, lambda x, i: F.coalesce(x.bitwiseXOR(F.get(v, i - 1)) >= slot, F.lit(True)) & (x < samples * slot))


def fingerprints(df: DataFrame, keys: list[str], first: str, second: str, samples: int = SAMPLES) -> DataFrame:
    """For each row its keys and the fingerprints of the texts first and second, binary, three bytes a sample.

    A step's arrays are columns, read more than once by the step after, so that each is computed once and sorted by
    compiled code.
    """
    texts, at = (first, second), range(2)
    sorted_terms = df.select(*keys, *(F.sort_array(terms(F.col(c))).alias(f"_s{k}") for k, c in enumerate(texts)))
    found = sorted_terms.select(*keys, *(elements(F.col(f"_s{k}")).alias(f"_e{k}") for k in at))
    seen = found.select(*keys, *(f"_e{k}" for k in at), *(F.sort_array(visits(F.col(f"_e{k}"), samples, enough(F.size(f"_e{k}"), samples))).alias(f"_v{k}") for k in at))
    drawn = seen.select(*keys, *(f"_e{k}" for k in at), *(least(F.col(f"_v{k}"), samples).alias(f"_d{k}") for k in at))

    def written(k: int) -> Column:
        every = once(F.sort_array(visits(F.col(f"_e{k}"), samples, F.lit(slots_of(samples)))), lambda v: least(v, samples))
        whole = F.when(F.size(f"_d{k}") == samples, F.col(f"_d{k}")).otherwise(every)
        return F.unhex(F.array_join(F.transform(whole, lambda x: F.lpad(F.hex(x.bitwiseAND((1 << BITS) - 1)), BITS // 4, "0")), ""))

    return drawn.select(*keys, *(written(k).alias(c) for k, c in enumerate(texts)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples, from 0 to 1."""
    width = BITS // 8
    # spelt out: beside another likeness, a lambda over the samples' numbers counted some twice and others not at all
    same = sum((F.substring(a, i * width + 1, width) == F.substring(b, i * width + 1, width)).cast("int") for i in range(samples))
    return F.when(a.isNull() | b.isNull(), F.when(a.isNull() & b.isNull(), 1.0).otherwise(0.0)).when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(same / F.lit(float(samples)))


def written_out(fingerprint: Column, samples: int = SAMPLES) -> Column:
    return F.when(F.length(fingerprint) == 0, "-" * (samples * BITS // 4)).otherwise(F.lower(F.hex(fingerprint)))


def following(df: DataFrame, doc: str, measure: Column) -> DataFrame:
    """For each distinct id, from the largest: doc, next (after the last: the first), measure (the largest of its rows).

    The ids are dealt by range; inside a range a window finds the next one, and a table with a row for
    each range the first one of the range after.
    """
    ids = df.groupBy(F.col(doc).alias("_d")).agg(F.max(measure).alias("_m"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(ids.repartitionByRange(parts, F.col("_d").desc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    inside = dealt.withColumn("_at", F.struct(F.col("_d").isNull().alias("null"), F.col("_d").alias("d")))
    order = Window.partitionBy("_p").orderBy(F.col("_d").desc_nulls_last())
    heads = inside.groupBy("_p").agg(F.max_by("_at", F.struct(~F.col("_d").isNull(), F.col("_d"))).alias("_first"))
    across = Window.orderBy("_p")  # a row for each range
    heads = heads.select("_p", F.coalesce(F.lead("_first").over(across), F.first("_first").over(across)).alias("_after"))
    return inside.withColumn("_next", F.lead("_at").over(order)).join(F.broadcast(heads), "_p").select(
        F.col("_d").alias(doc), F.coalesce("_next", "_after")["d"].alias("_next"), F.col("_m").alias("_measure")
    )


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    after = following(docs, "doc_id", F.floor(F.char_length("text") / 3))
    # an id as two columns that are never null: what is dealt by them stays dealt for the join
    key = lambda c, name: [F.coalesce(F.col(c), F.lit(0)).alias(f"{name}_id"), F.col(c).isNull().alias(f"{name}_null")]
    same = lambda a, b: (F.col(f"{a}_id") == F.col(f"{b}_id")) & (F.col(f"{a}_null") == F.col(f"{b}_null"))
    # sampling takes far longer than reading: its tasks are as many as the session says, not as few as the bytes allow
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed_docs = docs.select(*key("doc_id", "own"), "text").repartition(parts, "own_id", "own_null")
    wanted = after.select(*key("_next", "next"), *key("doc_id", "for"), "_measure")
    # texts are told apart by a 64-bit hash here; rows between stages hold no long strings
    heads = keyed_docs.join(wanted, same("own", "next")).select(
        "for_id", "for_null", F.struct(F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("next_key"), F.left("text", F.col("_measure").cast("int")).alias("head")).alias("rep")
    )
    heads = heads.groupBy("for_id", "for_null").agg(F.min("rep").alias("rep"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    # own_id and own_null stay: the texts are dealt by them, so their samples are reduced where they are
    edited = keyed_docs.join(heads, same("own", "for")).select(
        "own_id", "own_null", F.col("rep.next_key").alias("_next_key"), "text", n.alias("n_chars"), F.concat(F.left("text", n - third), F.left("rep.head", third)).alias("edited")
    )
    keys = ["own_id", "own_null", "n_chars", "_text_key", "_edited", "_next_key"]
    keyed = edited.select("own_id", "own_null", "n_chars", F.xxhash64("text").alias("_text_key"), F.unhex(F.sha2("edited", 256)).alias("_edited"), "_next_key", F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"))
    found = checkpointed(fingerprints(keyed, keys, "fingerprint", "edited_fingerprint"))
    # equal texts have equal fingerprints: the next document's is looked up by its text's hash
    of_text = found.groupBy(F.col("_text_key").alias("_key")).agg(F.first("fingerprint").alias("_next_print"))
    return found.join(of_text, found["_next_key"] == of_text["_key"], "left").select(
        F.when(~F.col("own_null"), F.col("own_id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.lower(F.hex("_edited")).alias("edited_sha256"),
        written_out(F.col("fingerprint")).alias("fingerprint"),
        written_out(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
    )
