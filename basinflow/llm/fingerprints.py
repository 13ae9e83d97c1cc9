"""Document fingerprints from closed syncmers.

Anchors are k-mers of ``K`` words. A k-mer is chosen if the least hash among its
inner substrings of ``S`` words lies at an edge (first or last), which depends on
nothing outside the k-mer: a text that is moved or edited elsewhere keeps the
anchors of its unchanged parts, about one in two k-mers. A document starts with
K - 1 blank words, so short texts have anchors too.

The fingerprint is the whole list of anchors in text order, each with its distance in
words from the one before: nothing is left out of it. Two texts are matched by
position: a *link* is two neighbouring anchors at their distance, so a link that both
texts have is a stretch of words that lies alike in both, wherever it begins. The
likeness is the share of words in common links among the words of all distinct links
of both.

Everything is JVM-side and within a row, so nothing is grouped. ``edit_chain``
needs each document's successor: documents are cut into ranges of doc_id, a
document at the head of a range is also sent to the range before it, and each
range is read in order. The cuts and heads, one number per range, pass through
the driver; no text does.

Defined results: a null text counts as empty; empty or blank texts have an empty
fingerprint, alike 1 to each other and 0 to any other; documents that share a
doc_id or have none are ordered by (doc_id, nulls lowest, text hash) and keep their
rows; a lone document is its own successor; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm.common import keyed_documents, let, parallelism, read_table, with_doc_id

K, S = 5, 2
#: Bits of a fingerprint's value that hold the distance. With K 5 and S 2 two neighbouring anchors are never 15 words apart, so none is cut off.
GAP = 4
#: Ranges per shuffle partition, so that hashing them to partitions comes out even.
RANGES = 4
#: Cuts are searched in two steps of about this many.
FAN = 128


def words(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(out, " ", -1), "")


def _edge_kmers(text: Column, with_position: bool) -> Column:
    """The chosen k-mers in text order: their hashes, or (position, hash)."""
    span = K - S

    def chosen(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(h[i], h[i + 1]))
        return let(inner, lambda s: pick(h, s))

    def pick(h: Column, s: Column) -> Column:
        def at_edge(i: Column) -> Column:
            return F.least(s[i], s[i + span]) <= F.least(s[i + 1], s[i + span - 1])

        def item(i: Column) -> Column:
            value = F.xxhash64(s[i], s[i + 2], h[i + 4]).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.struct(i.cast("long").alias("position"), value.alias("hash")) if with_position else value

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - K), at_edge), item)

    hashes = F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), F.transform(words(text), lambda w: F.xxhash64(w)))
    kind = "array<struct<position:bigint,hash:bigint>>" if with_position else "array<bigint>"
    return let(hashes, lambda h: F.when(F.size(h) >= K, chosen(h)).otherwise(F.array().cast(kind)))


def anchor_list(text: Column) -> Column:
    """array<long>: every anchor in text order, its hash and below it the distance from the one before (or the start)."""

    def with_gap(a: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            gap = x["position"] - F.when(i == 0, F.lit(-1).cast("long")).otherwise(a[F.greatest(i - 1, F.lit(0))]["position"])
            return F.shiftleft(x["hash"], GAP).bitwiseOR(F.least(gap, F.lit((1 << GAP) - 1).cast("long")))

        return F.transform(a, value)

    return let(_edge_kmers(text, True), with_gap)


def fingerprint_text(anchors: Column) -> Column:
    """Nine lower-case hex digits for each anchor: eight of its hash, one of its distance."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 9, "0")), "")


def links(anchors: Column) -> Column:
    """array<long>: the distinct pairs of neighbouring anchors, hashed, with their distance in the lowest bits."""
    gap = (1 << GAP) - 1

    def link(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.shiftright(anchors[F.greatest(i - 1, F.lit(0))], GAP))
        return F.xxhash64(before, x).bitwiseAND(F.lit(~gap)).bitwiseOR(x.bitwiseAND(F.lit(gap)))

    return F.array_distinct(F.transform(anchors, link))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of links: the share of words in common links."""
    gap = (1 << GAP) - 1

    def words_in(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda n, v: n + v.bitwiseAND(F.lit(gap)))

    def share(shared: Column) -> Column:
        union = words_in(a) + words_in(b) - shared
        return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)

    return let(words_in(F.array_intersect(a, b)), share)


def syncmer_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash): every anchor; ``position`` is the word at which its k-mer ends."""
    return docs.select("doc_id", F.explode(_edge_kmers(F.col("text").cast("string"), True)).alias("a")).select("doc_id", "a.position", "a.hash")


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``value``."""
    if not cuts:
        return F.lit(0)
    coarse, fine = F.lit(cuts[FAN - 1 :: FAN]) if len(cuts) >= FAN else None, F.lit(cuts)
    block = F.size(F.filter(coarse, lambda c: c < value)) if coarse is not None else F.lit(0)
    return let(block, lambda b: b * FAN + F.size(F.filter(F.slice(fine, b * FAN + 1, FAN), lambda c: c < value)))


def with_successor(keyed: DataFrame, carry: list[str]) -> DataFrame:
    """Each row with the ``carry`` columns of the row of the next lower ``doc`` as next_<name>; the last gets the first's."""
    spark = keyed.sparkSession
    ranges = RANGES * parallelism(spark)
    fractions = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("doc", fractions, 20 * ranges)).first()[0] or []))
    ranged = keyed.withColumn("_range", _range_of(F.col("doc"), cuts))
    heads = {r["_range"]: r["head"] for r in ranged.groupBy("_range").agg(F.max("doc").alias("head")).collect()}  # a number per range
    if not heads:
        return keyed.select("*", *[F.lit(None).cast(keyed.schema[c].dataType).alias(f"next_{c}") for c in carry])
    used = sorted(heads)
    above = {r: used[i + 1] if i + 1 < len(used) else used[0] for i, r in enumerate(used)}
    size = used[-1] + 1
    head = F.lit([heads.get(r, 0) for r in range(size)])
    guest_of = F.lit([above.get(r, 0) for r in range(size)])
    top = used[-1]
    home = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"), F.lit(False).alias("wrap"))
    guest = F.struct(guest_of[F.col("_range")].alias("r"), F.lit(True).alias("guest"), (F.col("_range") == top).alias("wrap"))
    places = F.when(head[F.col("_range")] == F.col("doc"), F.array(home, guest)).otherwise(F.array(home))
    placed = ranged.withColumn("_place", F.explode(places))
    order = Window.partitionBy("_place.r").orderBy(F.col("_place.wrap"), F.col("doc").desc(), F.col("_place.guest").desc())
    led = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return led.where("NOT _place.guest").drop("_range", "_place")


def edit_chain(docs: DataFrame) -> DataFrame:
    """Each document against a half-edited copy of itself and against its successor (contract of op5)."""
    keyed, plain = keyed_documents(docs)
    first = keyed.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    first = first.withColumn("anchors", anchor_list(F.col("text")))
    pairs = with_successor(first, ["text", "anchors"])
    n = F.length("text").cast("int")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("doc", n.cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    made = made.withColumn("edited_anchors", anchor_list(F.col("edited")))
    near = F.transform(F.array("edited_anchors", "next_anchors"), lambda other: likeness(F.col("own"), links(other)))
    done = made.withColumn("own", links(F.col("anchors"))).select(
        "doc",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("anchors")).alias("fingerprint"),
        fingerprint_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        near.alias("near"),
    )
    done = done.select("doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))
    return with_doc_id(done, keyed, plain)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_chain(read_table(spark, sf_dir, "documents"))
