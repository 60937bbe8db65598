"""Document fingerprints as invertible Bloom lookup sketches, in SQL functions alone.

The distinct paragraphs (lines) of a text, each with the number of times it occurs, are hashed to 64-bit digests. A sketch has three
tables of cells; a digest enters one cell of each, which keeps a count, the exclusive or of the digests and that of their
checks. Only cells in use are kept, in order of place. The fingerprint of a text is its sketch of the first size at which it peels itself, so it lists all its
digests.

Two sketches subtract cell by cell, in small tables at first, into which larger ones fold, as each size divides the next; peeling takes the cells that hold one
digest, removes those digests from the other tables and goes on, until nothing is left and the digests that differ are known on either side. If peeling
stops early, the difference is made again in tables eight times as large. The likeness of any two texts follows from their fingerprints alone, as structs or
as written: it is the Jaccard index of the digests, from the counts and the peeled differences.
The order of paragraphs does not count, so texts that differ in order alone have equal fingerprints too.

Results: a null text is empty (one empty paragraph); two empty texts have likeness 1; documents with a null id come first in the
order of ids, those with equal ids are ordered by the hash of the text, then by the text; the one row of a table of one is its own next; a very long text or paragraph is
taken whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import doc_text, literal_array
from pulsegrid.llm.decontam import let, run_ends

#: Cells of each of the three tables at first, the factor between sizes, and the sizes tried from the one that has room, before digests are listed as they are.
LEAST, FACTOR, ATTEMPTS = 8, 8, 6
#: Groups of neighbouring ids for each partition of a shuffle.
GROUPS = 4
CELLS = "array<struct<at:bigint,n:int,key:bigint,check:bigint>>"
FOUND = "array<struct<digest:bigint,sign:int>>"
SKETCH = f"struct<size:bigint,cells:{CELLS}>"
PEELED = f"struct<done:boolean,size:bigint,cells:{CELLS},found:{FOUND}>"


def digests(text: Column) -> Column:
    """Sorted digests of the distinct paragraphs with their multiplicities."""

    def of(s: Column) -> Column:  # s: sorted hashes; a run's last place tells its length
        return let(run_ends(s), lambda e: F.transform(e, lambda at, j: F.xxhash64(F.element_at(s, at), at - F.coalesce(F.get(e, j - 1), F.lit(0)))))

    return let(F.sort_array(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p))), lambda s: F.sort_array(of(s)))


def entered(found: Column, size: Column, sign: int = 1) -> Column:
    """The three cells of each digest, with its own sign times ``sign``."""

    def cell(x: Column, t: int) -> Column:
        at = F.pmod(F.xxhash64(x["digest"], F.lit(t)), size) + size * t
        return F.struct(at.alias("at"), (x["sign"] * sign).alias("n"), x["digest"].alias("key"), F.xxhash64(x["digest"]).alias("check"))

    return F.flatten(F.transform(found, lambda x: F.array(*(cell(x, t) for t in range(3))))).cast(CELLS)


def gathered(cells: Column) -> Column:
    """One cell for each place, in order: counts add up, digests and checks combine; cells of nothing go."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def together(s: Column, first: Column, last: Column) -> Column:
        add = lambda a, c: F.struct((a["n"] + c["n"]).alias("n"), a["key"].bitwiseXOR(c["key"]).alias("key"), a["check"].bitwiseXOR(c["check"]).alias("check"))
        many = let(F.aggregate(F.slice(s, first, last - first + 1), none, add), lambda a: F.struct(F.element_at(s, last)["at"].alias("at"), a["n"].alias("n"), a["key"].alias("key"), a["check"].alias("check")))
        return F.when(first == last, F.element_at(s, last)).otherwise(many)

    def of(s: Column) -> Column:
        merge = lambda e: F.transform(e, lambda last, j: together(s, F.coalesce(F.get(e, j - 1), F.lit(0)) + 1, last))
        ends = let(F.transform(s, lambda c: c["at"]), lambda at: let(run_ends(at), merge))
        return F.filter(ends, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))

    return let(F.sort_array(cells), lambda s: F.when(F.size(s) == 0, s).otherwise(of(s))).cast(CELLS)


def peeled(cells: Column, size: Column) -> Column:
    """``rest`` of a sketch after peeling (empty if it worked) and the ``found`` digests with their signs."""
    state = f"struct<rest:{CELLS},found:{FOUND},stuck:boolean>"

    def step(acc: Column, _: Column) -> Column:
        pure = F.filter(acc["rest"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == F.xxhash64(c["key"])))
        alone = lambda ps, sign: signed(F.array_distinct(F.transform(F.filter(ps, lambda c: c["n"] == sign), lambda c: c["key"])), sign)
        some = let(pure, lambda ps: F.concat(alone(ps, 1), alone(ps, -1)))
        off = lambda x: F.struct(gathered(F.concat(acc["rest"], entered(x, size, -1))).alias("rest"), F.concat(acc["found"], x).alias("found"), (F.size(x) == 0).alias("stuck")).cast(state)
        return F.when(acc["stuck"] | (F.size(acc["rest"]) == 0), acc).otherwise(let(some, off))

    rounds = F.ceil(F.log2(F.size(cells) + 2.0)).cast("int") * 3 + 3  # a sketch with room takes fewer; one that takes more counts as stuck
    start = F.struct(cells.alias("rest"), F.array().cast(FOUND).alias("found"), F.lit(False).alias("stuck")).cast(state)
    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)


def first_that_peels(found: Column, least: Column) -> Column:
    """The sketch of signed digests in the first size, from ``least`` on, at which it peels: ``size``, ``cells`` and what was ``found``."""

    def attempt(state: Column, _: Column) -> Column:
        made = lambda cells: let(peeled(cells, state["size"]), lambda p: F.struct((F.size(p["rest"]) == 0).alias("done"), F.when(F.size(p["rest"]) == 0, state["size"]).otherwise(state["size"] * FACTOR).alias("size"), cells.alias("cells"), p["found"].alias("found")).cast(PEELED))
        return F.when(state["done"], state).otherwise(let(gathered(entered(found, state["size"])), made))

    start = F.struct(F.lit(False).alias("done"), least.cast("long").alias("size"), F.array().cast(CELLS).alias("cells"), F.array().cast(FOUND).alias("found")).cast(PEELED)
    return F.aggregate(F.array(*map(F.lit, range(ATTEMPTS))).cast("array<int>"), start, attempt)


def signed(of: Column, sign: int) -> Column:
    return F.transform(of, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign"))).cast(FOUND)


def size_for(n: Column) -> Column:
    """The least size whose three tables have room for so many digests."""
    steps = F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / (2.0 * LEAST)) / 3), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.lit(LEAST).cast("long"), steps * 3)


def sketch(of: Column) -> Column:
    """The fingerprint of digests: ``size`` of a table and the ``cells`` in use. Should no size tried peel, the size is 0 and every digest has a cell of its own."""
    plain = F.transform(of, lambda d, i: F.struct(i.cast("long").alias("at"), F.lit(1).alias("n"), d.alias("key"), F.xxhash64(d).alias("check"))).cast(CELLS)
    exact = F.struct(F.lit(0).cast("long").alias("size"), plain.alias("cells")).cast(SKETCH)
    return let(first_that_peels(signed(of, 1), size_for(F.size(of))), lambda s: F.when(s["done"], F.struct(s["size"].alias("size"), s["cells"].alias("cells")).cast(SKETCH)).otherwise(exact))


def n_digests(s: Column) -> Column:
    """Number of digests in a sketch: all of them are counted in each table."""
    return F.aggregate(s["cells"], F.lit(0), lambda n, c: n + F.when((s["size"] == 0) | (c["at"] < s["size"]), c["n"]).otherwise(0))


def listed(s: Column) -> Column:
    """The digests that a sketch holds."""
    keys = lambda found: F.transform(found, lambda x: x["digest"])
    return F.when(s["size"] == 0, F.transform(s["cells"], lambda c: c["key"])).otherwise(keys(peeled(s["cells"], s["size"])["found"]))


def folded(s: Column, size: Column, sign: int) -> Column:
    """The cells of a sketch in tables of a size that divides its own, counts times ``sign``."""
    at = lambda c: F.floor(c["at"] / s["size"]).cast("long") * size + F.pmod(F.pmod(c["at"], s["size"]), size)
    return F.transform(s["cells"], lambda c: F.struct(at(c).alias("at"), (c["n"] * sign).alias("n"), c["key"].alias("key"), c["check"].alias("check"))).cast(CELLS)


def difference(a: Column, b: Column) -> Column:
    """Whether one sketch less the other peels, and what was ``found``: digests of the first alone (sign 1) and of the second alone (sign -1).

    The difference is folded to tables that have room for what the numbers of digests differ by at least, and made again eight times as large as long as it does not
    peel, up to the smaller of both sketches.
    """
    most = F.least(a["size"], b["size"])
    least = F.least(size_for(F.abs(n_digests(a) - n_digests(b))), most)
    tries = F.when(most == 0, F.lit(0)).otherwise(F.round(F.log2(most / F.greatest(least, F.lit(1))) / 3).cast("int") + 1)
    start = F.struct((a == b).alias("done"), least.alias("size"), F.array().cast(FOUND).alias("found")).cast(f"struct<done:boolean,size:bigint,found:{FOUND}>")

    def attempt(state: Column, _: Column) -> Column:
        made = lambda p: F.struct((F.size(p["rest"]) == 0).alias("done"), (state["size"] * FACTOR).alias("size"), p["found"].alias("found"))
        left = gathered(F.concat(folded(a, state["size"], 1), folded(b, state["size"], -1)))
        return F.when(state["done"], state).otherwise(let(left, lambda cells: let(peeled(cells, state["size"]), made)))

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(64)), F.lit(1), tries), start, attempt)


def with_difference(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The rows with the digests that tell two sketches apart. Where subtracting fails, as for texts with little in common, both sketches list their digests."""
    tried = rows.withColumn(name, difference(F.col(a), F.col(b)))
    open_ = ~F.col(f"{name}.done")
    lists = tried.withColumns({f"__{c}": F.when(open_, listed(F.col(c))) for c in (a, b)})
    exact = F.concat(signed(F.array_except(f"__{a}", f"__{b}"), 1), signed(F.array_except(f"__{b}", f"__{a}"), -1))
    return lists.withColumn(name, F.when(open_, exact).otherwise(F.col(f"{name}.found"))).drop(f"__{a}", f"__{b}")


def written(s: Column) -> Column:
    """A sketch as text: the size, then place, count, digests and checks of each cell in hexadecimal."""
    cell = lambda c: F.concat_ws(":", F.hex(c["at"]), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"]))
    return let(s, lambda x: F.concat_ws(" ", F.hex(x["size"]), F.array_join(F.transform(x["cells"], cell), " ")))


def parsed(text: Column) -> Column:
    """A written sketch as it was."""
    number = lambda hexadecimal: F.conv(hexadecimal, 16, -10).cast("long")
    cell = lambda x: let(F.split(x, ":"), lambda p: F.struct(number(p[0]).alias("at"), number(p[1]).cast("int").alias("n"), number(p[2]).alias("key"), number(p[3]).alias("check")))
    of = lambda p: F.struct(number(p[0]).alias("size"), F.transform(F.slice(p, F.lit(2), F.size(p) - 1), cell).cast(CELLS).alias("cells")).cast(SKETCH)
    return let(F.split(text, " "), of)


def likeness(a: Column, found: Column) -> Column:
    """Jaccard index of the digests of two sketches, from the first and what tells them apart."""
    mine = n_digests(a) - F.size(F.filter(found, lambda x: x["sign"] == 1))
    return let(mine, lambda both: (both / (F.size(found) + both)).cast("double"))


def in_groups(rows: DataFrame, n: int) -> DataFrame:
    """The rows with ``h``, the hash of the text, and ``part``: groups of neighbouring ids of about equal size, in order.

    Bounds come from percentiles of the ids, one for each group. Rows without an id, and those of an id that fills groups alone, are dealt by ranges of the
    hash, so that no group holds them all.
    """
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []  # one number for each group
    table = literal_array(bounds, "bigint")
    hot = sorted({x for x, y in zip(bounds, bounds[1:], strict=False) if x == y})
    steps = F.sequence(F.lit(0), F.lit(max(len(bounds), 1).bit_length()))

    def search(acc: Column, _: Column) -> Column:  # bisection for the number of bounds up to the id
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.element_at(table, mid + 1) <= F.col("doc_id")
        return F.when(acc["low"] < acc["high"], F.struct(F.when(right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(mid).alias("high"))).otherwise(acc)

    upto = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), search)["low"] if bounds else F.lit(0)
    alone = F.array_contains(literal_array(hot, "bigint"), F.col("doc_id")) if hot else F.lit(False)
    share = F.floor((F.shiftright("h", 32) + (1 << 31)) * n / (1 << 32)).cast("int")
    group = F.when(F.col("doc_id").isNull(), F.struct(F.lit(-1).alias("range"), share.alias("share")))
    group = group.when(alone, F.struct((upto * 2 - 1).alias("range"), share.alias("share"))).otherwise(F.struct((upto * 2).alias("range"), F.lit(0).alias("share")))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("part", group)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``, the text of the next id; after the last comes the first.

    Texts are shuffled once, by groups of neighbouring ids; only the first text of a group is sent to the group before.
    """
    spark = docs.sparkSession
    rows = doc_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = in_groups(rows, GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))).repartition("part")
    order = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "h", "text")
    inner = parts.select("part", "doc_id", "text", F.lead("text").over(order).alias("inner"))
    heads = parts.groupBy("part").agg(F.min_by("text", F.struct("doc_id", "h", "text")).alias("head"))
    by_part = Window.orderBy("part")  # the keys of the groups alone, some for each partition of a shuffle
    keys = heads.select("part").select(F.col("part").alias("after"), F.lag("part").over(by_part).alias("before"), F.max("part").over(Window.partitionBy()).alias("last"))
    follows = keys.select("after", F.coalesce("before", "last").alias("part")).join(heads.select(F.col("part").alias("after"), "head"), "after").select("part", "head")
    return inner.join(follows, "part", "left").select("doc_id", "text", F.coalesce("inner", "head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document with its edited text, the written sketches of both and the likeness to the edited and the next text, which follow from sketches alone."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = with_next(docs).select("doc_id", "text", "next_text", F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter)).alias("edited"))
    marked = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", *(digests(F.col(c)).alias(f"{c}_digests") for c in ("text", "edited", "next_text")))
    made = marked.select("doc_id", "n_chars", "edited", *(sketch(F.col(f"{c}_digests")).alias(name) for c, name in (("text", "text"), ("edited", "changed"), ("next_text", "next"))))
    apart = with_difference(with_difference(made, "text", "changed", "differing"), "text", "next", "differing_next")
    return apart.select(
        "doc_id",
        "n_chars",
        "edited",
        written(F.col("text")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("differing")).alias("near_edited"),
        likeness(F.col("text"), F.col("differing_next")).alias("near_next"),
        "differing",
    )
