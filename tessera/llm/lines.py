"""Line dedup: MinHash over character shingles, high-recall banding, exact Jaccard, distributed union-find.

Everything is DataFrame code. Equal lines are one row before anything else, so a line that a third of all documents hold
is one row too. A line's shingles are all its overlapping runs of SHINGLE characters (the line itself if it is shorter),
as 64-bit hashes; their order is one random permutation, and the least ones are the line's MinHash signature. A band is a
hash of the signature with the ROWS - 1 that follow it; two lines of Jaccard similarity s share one with probability
s**ROWS. Of the FIRST least hashes those divisible by EVERY begin a band, which gives 1 - (1 - 0.8**4 / 4)**56 = 0.998 at the
threshold. Lines with fewer than FIRST begin one at every hash: of c shared and d other hashes in order, some ROWS shared
ones are neighbours once c > 3 d + 3, so at similarity 0.8 no link is lost from c = 13 on. Shorter lines have exact keys: two
lines of similarity SIMILARITY, the smaller of n shingles, share at least two of their first n - ceil(SIMILARITY n) + 2 hashes.

The members of a band bucket are compared with single lines of it, never all with all: in each of a few rounds a bucket draws
some members, and those of other components are compared with them unless they were before. What a round joins is not
compared again, so groups of copies cost one comparison a line and bucket, and each round's work is linear in the members.
The rounds only make the rest small. Buckets that still hold several components are then met exactly: those of at most SMALL
members by all their pairs across components, the lines of larger ones by their shingles, the rarest first, of which two
similar lines share one of the first n - ceil(SIMILARITY n) + 1. So no link of a bucket is lost.

Each line that shares a bucket has a sketch of WORDS * 64 bits, in which each of its distinct shingles turns one bit over. Two
lines differ in at least as many shingles as their sketches do in bits, so a pair whose sketches differ in too many is not
similar: it is neither made by the prefixes nor are its texts fetched. This leaves out no similar pair.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, materialize, settle

SHINGLE, ROWS, SIMILARITY = 9, 4, 0.8
#: Bands begin among so many least hashes, at one in EVERY of them; lines with fewer begin one at each.
FIRST, EVERY = 56, 4
#: Lines with fewer shingles meet by exact keys; lines that can be similar to one of them have both kinds.
FEW = 16
#: How many of its members a bucket draws in each round, for all its others to be compared with.
DRAWS = (2, 8)
#: Buckets of at most so many members are met by all their pairs in the end, larger ones by prefixes.
SMALL = 16
#: Longs in the sketch of a line.
WORDS = 16
#: How many times the hashes that a signature needs are sorted for it.
SPARE = 1.6


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def shingles(line: Column) -> Column:
    """Hashes of the line's overlapping shingles, with repeats; in UTF-16 each begins at a known byte."""
    last = lambda b: F.greatest(F.lit(1), F.octet_length(b) - (2 * SHINGLE - 1))
    return let(F.encode(line, "UTF-16BE"), lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(2)), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * SHINGLE)))))


def _prefix(s: Column, shared: int) -> Column:
    """The first elements of s, of which a set of similarity SIMILARITY shares so many if it is ordered alike."""
    return F.slice(s, F.lit(1), (F.size(s) - F.ceil(F.size(s) * SIMILARITY - 1e-9) + shared).cast("int"))


def _least(hashes: Column) -> Column:
    """The distinct hashes in order, or, of many, at least the FIRST + ROWS least: those under a bound that SPARE times so many pass."""
    n, enough = F.size(hashes), FIRST + ROWS
    bound = (F.lit(float(SPARE * enough)) / n * 2.0**64 - 2.0**63).cast("long")
    every = lambda h: F.sort_array(F.array_distinct(h))
    few = let(bound, lambda top: F.array_distinct(F.filter(hashes, lambda h: h < top)))
    return F.when(n <= SPARE * enough, every(hashes)).otherwise(let(few, lambda h: F.when(F.size(h) >= enough, F.sort_array(h)).otherwise(every(hashes))))


def band_keys(line: Column) -> Column:
    """The keys of a line: exact ones if it has few shingles, bands if it has enough."""

    def bands(s: Column) -> Column:
        begins = lambda i: (F.size(s) < FIRST) | (F.get(s, i).bitwiseAND(F.lit(EVERY - 1).cast("long")) == 0)
        at = F.filter(F.sequence(F.lit(0), F.least(F.size(s) - ROWS, F.lit(FIRST - 1))), begins)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(s, i + j) for j in range(ROWS)]))

    def exact(s: Column) -> Column:
        return F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.xxhash64(x, y))))

    none = F.array().cast("array<long>")

    def keys(s: Column) -> Column:
        few = F.when(F.size(s) < 2, s).when(F.size(s) * SIMILARITY < FEW, let(_prefix(s, 2), exact)).otherwise(none)
        return F.concat(few, F.when(F.size(s) >= FEW, bands(s)).otherwise(none))

    return let(let(shingles(line), _least), keys)


class Texts(NamedTuple):
    """lines(id, line) and sketches(id, n, w): how many distinct shingles a line has, and its sketch."""

    lines: DataFrame
    sketches: DataFrame


def _sketches(lines: DataFrame) -> DataFrame:
    """sketches of Texts, of lines(id, line)."""
    spread = lines.select("id", F.explode(F.array_distinct(shingles(F.col("line")))).alias("h"))
    bit, word = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.expr("shiftright(h, 6)").bitwiseAND(F.lit(WORDS - 1))
    words = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]
    return spread.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.array(*words).alias("w"))


def _near(m: Column, v: Column, n: Column, w: Column) -> Column:
    """Whether two lines of m and n shingles and the sketches v and w may reach SIMILARITY: similar ones always may."""
    differ = sum((F.bit_count(F.get(v, i).bitwiseXOR(F.get(w, i))) for i in range(1, WORDS)), F.bit_count(F.get(v, 0).bitwiseXOR(F.get(w, 0))))
    return differ * (1 + SIMILARITY) <= (m + n) * (1 - SIMILARITY) + 1e-9


def _similar(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b, more) whose exact Jaccard similarity reaches SIMILARITY."""
    sided = pairs.join(texts.sketches.toDF("a", "m", "v"), "a").join(texts.sketches.toDF("b", "n", "w"), "b")
    m, n = F.col("m"), F.col("n")
    sized = sided.where((F.least(m, n) >= SIMILARITY * F.greatest(m, n)) & _near(m, F.col("v"), n, F.col("w"))).drop("v", "w")
    both = sized.join(texts.lines.toDF("b", "t"), "b").join(texts.lines.toDF("a", "s"), "a")
    shared = F.size(F.array_intersect(shingles(F.col("s")), shingles(F.col("t"))))
    return both.where(shared * (1 + SIMILARITY) >= SIMILARITY * (m + n)).select(*pairs.columns)


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, id, component) of the buckets whose members are in more than one component."""
    placed = members.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return materialize(placed.join(several, "key"), "open")


def _met(rows: DataFrame, draws: int) -> DataFrame:
    """Pairs (a, b, ca, cb) across components, a > b, of members of rows(key, id, component) with their keys' drawn members.

    A key draws so many of its members: as many aggregates, so a hot key is combined before the shuffle and its members are
    joined with few rows. Of the partners that a member meets in its keys, it keeps as many, those that share most keys; what
    this leaves out is left to _rest.
    """
    drawn = lambda i: F.min(F.struct(F.xxhash64("key", "id", F.lit(draws + i)).alias("h"), "id", "component"))
    table = rows.groupBy("key").agg(*[drawn(i).alias(f"y{i}") for i in range(draws)])
    partners = F.array_distinct(F.array(*[F.struct(F.col(f"y{i}.id").alias("y"), F.col(f"y{i}.component").alias("cy")) for i in range(draws)]))
    met = rows.join(table.select("key", F.explode(partners).alias("p")), "key").select("id", "component", "p.*").where("component <> cy")
    met = met.groupBy("id", "component", "y", "cy").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.xxhash64("id", "y")))
    met = met.select("*", best.alias("r")).where(F.col("r") <= draws)
    up = F.col("id") > F.col("y")
    pick = lambda p, q: F.when(up, F.col(p)).otherwise(F.col(q))
    return met.select(pick("id", "y").alias("a"), pick("y", "id").alias("b"), pick("component", "cy").alias("ca"), pick("cy", "component").alias("cb")).distinct()


def _rest(rows: DataFrame, texts: Texts) -> DataFrame:
    """Pairs (a, b, ca, cb) across components, a > b, with all similar ones of each bucket of rows(key, id, component)."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    small = materialize(rows.join(sizes.where(F.col("n") <= SMALL).select("key").hint("merge"), "key"), "small")
    large = materialize(rows.join(sizes.where(F.col("n") > SMALL).select("key").hint("merge"), "key").select("id", "component").distinct(), "large")
    x, y = small.toDF("key", "a", "ca"), small.toDF("other", "b", "cb")
    pairs = x.join(y.hint("merge"), (x["key"] == y["other"]) & (x["a"] > y["b"]) & (x["ca"] != y["cb"])).select("a", "b", "ca", "cb")
    return pairs.union(_by_prefix(large, texts)).distinct()


def _by_prefix(rows: DataFrame, texts: Texts) -> DataFrame:
    """Pairs (a, b, ca, cb) across components, a > b, with all that are similar among the lines of rows(id, component).

    A prefix filter: the shingles of a line are ordered by how many of these lines hold them. Those that no other line holds
    come first and need no join; so lines of a hot bucket that differ enough meet nobody. What is left of two lines from the
    shingle on where they meet bounds what they share, and their sketches what they do not, both within the join.
    """
    spark = rows.sparkSession
    open_ = texts.lines.join(rows.hint("merge"), "id")
    held = materialize(open_.select("id", F.explode(F.array_distinct(shingles(F.col("line")))).alias("h")), "shingles")
    settle(spark)
    several = materialize(held.groupBy("h").agg(F.count("*").cast("int").alias("f")).where("f > 1"), "several")
    settle(spark)
    shared = materialize(held.join(several.hint("merge"), "h"), "shared")
    discard(held)
    discard(several)
    settle(spark)
    each = Window.partitionBy("id")
    ranked = shared.select("*", F.row_number().over(each.orderBy("f", "h")).alias("r"), F.count("*").over(each).cast("int").alias("c"))
    sized = texts.sketches.join(rows.hint("merge"), "id").hint("merge")
    first = F.col("r") <= F.col("c") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    prefix = materialize(ranked.join(sized, "id").where(first).select("h", "id", "component", "n", "w", "c", "r"), "prefix")
    discard(shared)
    settle(spark)
    x, y = prefix.toDF("h", "a", "ca", "m", "v", "c", "r"), prefix.toDF("g", "b", "cb", "n", "w", "d", "q")
    most = F.least("r", "q") + F.least(F.col("c") - F.col("r"), F.col("d") - F.col("q"))
    enough = most * (1 + SIMILARITY) >= SIMILARITY * (F.col("m") + F.col("n")) - 1e-9
    near = enough & _near(F.col("m"), F.col("v"), F.col("n"), F.col("w"))
    return x.join(y.hint("merge"), (x["h"] == y["g"]) & (x["a"] > y["b"]) & (x["ca"] != y["cb"]) & near).select("a", "b", "ca", "cb")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups(node, component) after links between components (ca, cb) were added."""
    upper = materialize(connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "lines"), "upper")
    moved = groups.join(upper.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left")
    alone = upper.join(groups.select("node"), "node", "left_anti").select("node", "component")
    return materialize(moved.select("node", F.coalesce("above", "component").alias("component")).union(alone), "groups")


def _grouped(members: DataFrame, texts: Texts) -> DataFrame:
    """(node, component) of the lines that have a link inside the buckets members(key, id)."""
    spark = members.sparkSession
    groups = spark.createDataFrame([], "node long, component long")
    rows = members.select("key", "id", F.col("id").alias("component"))
    met = spark.createDataFrame([], "a long, b long")
    for draws in (*DRAWS, None):
        found = _met(rows, draws) if draws else _rest(rows, texts)
        pairs = materialize(found.join(met.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        links = materialize(_similar(pairs, texts), "links")
        if not links.isEmpty():
            groups = _merged(groups, links)
        met = met.union(pairs.select("a", "b"))
        settle(spark)
        if draws:
            rows = _open(rows.select("key", "id"), groups)
    return groups


def classes(docs: DataFrame) -> DataFrame:
    """line_md5, n (occurrences), first_doc_id, kept_md5, kept: one row for each distinct trimmed line that is not blank.

    kept_md5 names the line that stays for the whole class: the one whose smallest doc_id is least, then the least digest.
    Null text has no lines; a null doc_id comes after all others; repeated rows add occurrences; lines may be of any length
    (a line's shingles are one array); other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long"), F.explode(F.split("text", "\n")).alias("line")).select("doc_id", trimmed(F.col("line")).alias("line")).where("line <> ''")
    one = every.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"))
    lines = materialize(one.select(F.monotonically_increasing_id().alias("id"), "line", F.md5("line").alias("line_md5"), "n", "first_doc_id", band_keys(F.col("line")).alias("keys")), "lines")
    settle(spark)
    keyed = lines.select("id", F.explode("keys").alias("key"))
    several = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    settle(spark)
    members = materialize(keyed.join(several, "key"), "members")
    settle(spark)
    candidates = lines.select("id", "line").join(members.select("id").distinct(), "id", "left_semi")
    texts = materialize(candidates, "texts")
    settle(spark)
    sketches = materialize(_sketches(texts), "sketches")
    settle(spark)
    groups = _grouped(members, Texts(texts, sketches))
    narrow = lines.select("id", "line_md5", "n", "first_doc_id")
    linked = materialize(narrow.join(groups.withColumnRenamed("node", "id"), "id"), "linked")
    order = F.struct(F.coalesce("first_doc_id", F.lit(2**63 - 1)).alias("d"), "line_md5")
    best = linked.groupBy("component").agg(F.min(order).alias("best")).select("component", F.col("best.line_md5").alias("kept_md5"))
    stand_ins = materialize(linked.select("id", "component").join(best, "component").select("id", "kept_md5"), "stand_ins")
    kept = F.coalesce("kept_md5", "line_md5")
    return narrow.join(stand_ins, "id", "left").select("line_md5", "n", "first_doc_id", kept.alias("kept_md5"), (kept == F.col("line_md5")).alias("kept"))


def clean(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """(doc_id, text): documents without lines that another line stands for; of equal lines the first occurrence stays.

    Trimmed lines of fewer than least_chars characters always stay. The first occurrence is in the smallest doc_id, then
    the first line. A doc_id names one text; null text stays null.
    """
    table = classes(docs).select(F.col("line_md5").alias("_line"), "first_doc_id", "kept")
    rows = docs.select(F.col("doc_id").cast("long"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "raw")).dropDuplicates(["doc_id", "pos"])
    rows = rows.withColumn("line", F.when(F.char_length(trimmed(F.col("raw"))) >= least_chars, F.md5(trimmed(F.col("raw")))))
    joined = rows.join(table, rows["line"] == table["_line"], "left")
    home = joined.where("kept and doc_id = first_doc_id").groupBy("line").agg(F.min("pos").alias("_first")).withColumnRenamed("line", "_home")
    joined = joined.join(home, F.col("line") == F.col("_home"), "left")
    stays = F.col("_line").isNull() | (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("pos") == F.col("_first")))
    text = F.transform(F.array_sort(F.collect_list(F.when(stays, F.struct("pos", "raw")))), lambda x: x["raw"])
    return joined.groupBy("doc_id").agg(F.when(F.count("raw") > 0, F.array_join(text, "\n")).alias("text"))
