"""Operator 2: SimHash document fingerprints, by DataFrame operations only.

The terms of a text vote, as often as they occur, with their weights on 128
signed bits: a set bit of the term's hash counts for, a clear one against; the fingerprint has the
signs.  Votes for two bits travel in one long, as halves that cannot overflow,
so a document needs 64 sums, made while its terms are generated.

Fingerprints within a Hamming radius r are found by permuted block tables: of
``r + spare`` blocks, at least ``spare`` are equal in any such pair; for each
choice of ``spare`` blocks a table sorted (here: joined) by just those blocks
holds every pair that has them equal.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded, drop, materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Seeds of the two 64-bit halves of a term's hash.
SEEDS = (42, 1042)
#: A term weighs its length, up to this.
HEAVIEST = 4
#: Rows of a range of documents within which neighbours are found, and the most ranges.
RANGE_ROWS, RANGES = 500, 65_536
#: Fingerprints of a table that share the chosen blocks beyond which halves of the other blocks must be shared, too; and those of one part of a key.
CROWD, PART = 1024, 512


def _terms(text: Column) -> Column:
    """The lower-case words of a text, each as often as it occurs."""
    return F.split(F.lower(text), SPACES)


def _hash(term: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), term)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per distinct ``keys``: keys, high and low (64 bits each).

    ``keys`` should tell rows apart; texts of rows that share them vote
    together.  A null or blank text, without terms, has all bits clear.  Case
    is folded; a bit is set if more than half the weight is for it.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    told = rows.select(*[F.col(k).alias(v) for k, v in names.items()], F.explode_outer(_terms(F.coalesce(text, F.lit("")))).alias("_term"))
    weight = F.least(F.length("_term"), F.lit(HEAVIEST)).cast("long")
    hashed = told.select(*names.values(), weight.alias("_w"), *[_hash(F.col("_term"), s).alias(f"_h{i}") for i, s in enumerate(SEEDS)])
    both = F.lit(0x0000000100000001)
    sums = [
        F.sum(F.shiftrightunsigned(f"_h{i}", b).bitwiseAND(both) * F.col("_w")).alias(f"_s{i}_{b}")
        for i in range(len(SEEDS))
        for b in range(32)
    ]
    votes = hashed.groupBy(*names.values()).agg(F.sum("_w").alias("_all"), *sums)

    def half(i: int) -> Column:
        bits = []
        for b in range(32):
            total = F.col(f"_s{i}_{b}")
            for at, count in ((b, total.bitwiseAND(F.lit(0xFFFFFFFF))), (b + 32, F.shiftrightunsigned(total, 32))):
                bits.append(F.shiftleft((count * 2 > F.col("_all")).cast("long"), at))
        out = bits[0]
        for x in bits[1:]:
            out = out.bitwiseOR(x)
        return out

    return votes.select(*[F.col(v).alias(k) for k, v in names.items()], half(0).alias("high"), half(1).alias("low"))


def shown(high: Column, low: Column) -> Column:
    """A fingerprint as 32 lower-case hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (high, low)]))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(*halves: Column) -> Column:
    """Part of the bits that two fingerprints share, 0 to 1."""
    return F.lit(1.0) - distance(*halves) / F.lit(128.0)


def _bits(high: Column, low: Column, a: int, b: int) -> list[Column]:
    """Bits a to b of a fingerprint, counted from the lowest, as one number or two."""
    parts = []
    for half, base in ((low, 0), (high, 64)):
        x, y = max(a, base) - base, min(b, base + 64) - base
        if x < y:
            mask = (1 << (y - x)) - 1
            parts.append(F.shiftrightunsigned(half, x).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)))
    return parts


def near_fingerprints(prints: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """All pairs of distinct fingerprints at most ``radius`` bits apart.

    ``prints`` has high and low; returns high_a, low_a, high_b, low_b and bits,
    each pair once.  Equal fingerprints are one row here, as copies need no
    table; nulls and further columns are ignored.  One block table is joined
    for each choice of ``spare`` of the ``radius + spare`` blocks.  Where many
    share the chosen blocks, two halves of other blocks must be equal as well:
    of ``2 * radius`` halves ``radius`` bits leave ``radius`` equal, two of
    them within the first or within the second half of these halves.  What is
    still frequent is dealt out in parts by its measured count.
    """
    if radius < 3:  # two of the halves need not be equal then in one part
        return near_fingerprints(prints, 3, spare).filter(F.col("bits") <= radius)
    count = radius + spare
    cuts = [round(i * 128 / count) for i in range(count + 1)]
    halves = [(a, (a + b) // 2, b) for a, b in zip(cuts, cuts[1:])]
    distinct = materialize(prints.select("high", "low").filter("high is not null and low is not null").distinct(), "prints")
    high, low = F.col("high"), F.col("low")
    choices = list(combinations(range(count), spare))
    tables = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[x for i in chosen for x in _bits(high, low, cuts[i], cuts[i + 1])]).alias("key")) for t, chosen in enumerate(choices)]
    rows = distinct.select("high", "low", F.explode(F.array(*tables)).alias("x")).select("high", "low", "x.t", "x.key")
    often = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
    rows = materialize(rows.join(often, ["t", "key"]), "tables")
    drop(often)
    found = _met(rows.filter(F.col("n") <= CROWD), radius)
    if rows.filter(F.col("n") > CROWD).limit(1).count():
        finer = F.lit(None).cast("array<bigint>")
        for t, chosen in enumerate(choices):
            left = [(x, y) for i in range(count) if i not in chosen for x, y in ((halves[i][0], halves[i][1]), (halves[i][1], halves[i][2]))]
            middle = len(left) // 2
            twos = [*combinations(left[:middle], 2), *combinations(left[middle:], 2)]
            keys = F.array(*[F.xxhash64("key", F.lit(k), *_bits(high, low, *one), *_bits(high, low, *two)) for k, (one, two) in enumerate(twos)])
            finer = F.when(F.col("t") == t, keys).otherwise(finer)
        crowd = rows.filter(F.col("n") > CROWD).select("high", "low", "t", F.explode(finer).alias("key"))
        often = materialize(crowd.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "parts")
        found = found.union(_met(crowd.join(often, ["t", "key"]), radius))
    return found.distinct()


def _met(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs of rows (high, low, t, key, n) of one key that are near; each key in as many parts as its count asks for."""
    parts = F.ceil(F.col("n") / PART)
    left = rows.withColumn("salt", F.pmod(F.xxhash64("high", "low"), parts)).select("t", "key", "salt", F.col("high").alias("high_a"), F.col("low").alias("low_a"))
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("t", "key", "salt", F.col("high").alias("high_b"), F.col("low").alias("low_b"))
    bits = distance(F.col("high_a"), F.col("low_a"), F.col("high_b"), F.col("low_b"))
    pairs = left.join(right, ["t", "key", "salt"]).filter("struct(high_a, low_a) < struct(high_b, low_b)").withColumn("bits", bits)
    return pairs.filter(F.col("bits") <= radius).select("high_a", "low_a", "high_b", "low_b", "bits")


def near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(high, low, n_near): how many other fingerprints are within the radius, of those that have any."""
    pairs = near_fingerprints(prints, radius)
    sides = F.explode(F.array(*[F.struct(F.col(f"high_{x}").alias("high"), F.col(f"low_{x}").alias("low")) for x in "ab"]))
    return pairs.select(sides.alias("p")).groupBy("p.high", "p.low").agg(F.count("*").alias("n_near"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with its range, its number in it, and the text of the next row by doc_id.

    Columns: doc_id, text, range, nth, next_text, ghost.  After the last row
    comes the first; every range ends with a ghost, a copy of the row that
    follows it, so one exchange by range finds all neighbours.  Equal doc_ids
    are ordered by hash of their text.  Rows without doc_id are left out.
    """
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    splits = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)) if ranges > 1 else []
    splits = sorted({int(s) for s in splits})
    table = F.from_json(F.lit(str(splits)), "array<bigint>") if splits else None

    def range_of(doc_id: Column) -> Column:
        if table is None:
            return F.lit(0)
        steps = max(1, len(splits).bit_length())
        halved = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
                F.when(F.get(table, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= doc_id, F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi")))
                .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
            ),
            lambda s: s["lo"],
        )
        return halved

    rows = docs.withColumn("range", range_of(F.col("doc_id")))
    firsts = rows.groupBy("range").agg(F.min("doc_id").alias("first"))
    turn = Window.orderBy("range")
    # at most one row for each range: the range before it, or the last one for the first
    firsts = firsts.select(
        F.coalesce(F.lag("range").over(turn), F.max("range").over(Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"), "first"
    )
    ghosts = docs.join(F.broadcast(firsts), F.col("doc_id") == F.col("first")).select("doc_id", "text", F.col("before").alias("range"), F.lit(1).alias("ghost"))
    order = Window.partitionBy("range").orderBy("ghost", "doc_id", F.xxhash64("text"))
    rows = rows.select("doc_id", "text", "range", F.lit(0).alias("ghost")).unionByName(ghosts)
    return rows.withColumns({"nth": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def edited(text: Column, other: Column) -> Column:
    """The text whose last floor(n / 2) code points are replaced by the first as many of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of their edited texts, and both likenesses; one row per row with a doc_id.

    ``docs`` has doc_id and text; a null text counts as empty; other columns
    are ignored.  Repeated rows stand side by side; a single row is its own
    next.  Two texts without terms are alike.  n_near is the number of other
    fingerprints of the table within three bits, found by the block tables.
    """
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, edited(F.col("text"), F.coalesce("next_text", F.lit("")))))
    rows = rows.select(
        "range", "nth", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("x"),
    )
    rows = rows.select("range", "nth", "ghost", "doc_id", "n_chars", "edited_sha256", "x.kind", "x.body").filter("body is not null")
    keys = ["range", "nth", "ghost", "doc_id", "n_chars", "edited_sha256", "kind"]
    prints = materialize(fingerprints(rows, keys, "body"), "fingerprints")
    of = lambda kind, half: F.max(F.when(F.col("kind") == kind, F.col(half)))
    both = prints.groupBy(*keys[:-1]).agg(of(0, "high").alias("high"), of(0, "low").alias("low"), of(1, "high").alias("e_high"), of(1, "low").alias("e_low"))
    order = Window.partitionBy("range").orderBy("nth")
    both = both.withColumns({"n_high": F.lead("high").over(order), "n_low": F.lead("low").over(order)}).filter("ghost = 0")
    near = bounded(materialize(near_counts(prints.filter("kind = 0")), "near").select(F.col("high").alias("_high"), F.col("low").alias("_low"), "n_near"))
    both = both.join(near, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")), "left")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("high"), F.col("low")).alias("fingerprint"), shown(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
        likeness(*map(F.col, ("high", "low", "e_high", "e_low"))).alias("near_edited"),
        likeness(*map(F.col, ("high", "low", "n_high", "n_low"))).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
