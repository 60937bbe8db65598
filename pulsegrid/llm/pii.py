"""Personal data by fixed patterns and by bootstrapped contextual extraction, in SQL functions alone.

Patterns give the base findings: e-mail addresses, IP addresses, payment cards and telephone numbers. They seed the rest: the
one or two words before a finding are a lexical pattern; every identifier-like token (with a digit or an at sign) after a pattern is
an instance of it. Pattern and instance scores are computed in turn over the graph of both: a pattern's is the share of
confidence among its distinct instances (plus one for doubt), an instance's the chance that one of its patterns is right. Support of a
pattern are its distinct instances of high score, so that those discovered in one round confirm further patterns in the next. Instances of
patterns with a high score and enough support, themselves of high score and with the digits of an identifier, are added as
``found``.

Places in a text come from running sums in two levels, and spans are compared by bisection, so a very long text full of numbers takes little more
than its length. Texts without a token are not joined with what is found, and what is found joins by pattern and value, so neither empty texts nor a common
context word gather in one task.

Results: a null text counts as empty; spans are in code points, end exclusive; a very long text is read whole, and its words before a finding however far they are;
equal texts are learnt from once, and each row, repeated or with a null id, gets the spans of its text; ties do not arise as scores are compared with
thresholds only; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, doc_text
from pulsegrid.llm.decontam import let

KINDS = ("email", "ip", "card", "phone")
# The patterns. Possessive repeats and the looks behind find the same matches without trying again inside a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

#: From the end of what is before a token backwards: its last word or two.
WORDS_BACK = r"^[^\p{L}\p{N}]*+\p{L}+(?:[^\p{L}\p{N}]+\p{L}+)?"

#: Rounds of scoring end when no pattern's score rises by more.
SETTLED = 1e-3
PATTERN_SCORE, PATTERN_SEEDS, INSTANCE_SCORE = 0.85, 5, 0.85
SPANS = "array<struct<start:int,end:int,value:string,before:string>>"


def running(lengths: Column) -> Column:
    """The sum of the lengths before each one, in blocks of about the square root of their number."""

    def scan(xs: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def in_blocks(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda i: F.slice(xs, i * width + 1, width))
        starts = lambda bs: scan(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x)), F.lit(0))
        return let(blocks, lambda bs: let(starts(bs), lambda at: F.flatten(F.transform(bs, lambda b, i: scan(b, F.get(at, i))))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, in_blocks))


def located(text: Column, pattern: str, words: bool = False) -> Column:
    """All matches with their place and, if ``words``, the two words before, back to the last match."""

    def spans(pieces: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: F.char_length(F.get(pieces, i)) + F.char_length(h))

        def one(at: Column, h: Column, i: Column) -> Column:
            piece = F.get(pieces, i)
            start = F.get(at, i) + F.char_length(piece)
            before = F.reverse(F.regexp_extract(F.reverse(piece), WORDS_BACK, 0)) if words else F.lit("")
            return F.struct(start.alias("start"), (start + F.char_length(h)).alias("end"), h.alias("value"), before.alias("before"))

        return let(running(lengths), lambda at: F.transform(hits, lambda h, i: one(at, h, i))).cast(SPANS)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPANS)).otherwise(let(F.split(text, pattern, -1), lambda pieces: spans(pieces, hits))))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether any of the spans, which are in order and apart, lies over ``[start, end)``; by bisection for the last one that begins before the end."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        left = F.get(spans, mid)["start"] < end
        return F.when(acc["low"] < acc["high"], F.struct(F.when(left, mid + 1).otherwise(acc["low"]).alias("low"), F.when(left, acc["high"]).otherwise(mid).alias("high"))).otherwise(acc)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step)["low"]
    return F.when(F.size(spans) == 0, False).otherwise(let(found, lambda k: F.coalesce(F.get(spans, k - 1)["end"] > start, F.lit(False))))


def _is_ip(value: Column) -> Column:
    return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _is_card(value: Column) -> Column:
    def luhn(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            n = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return total + F.when(n > 9, n - 9).otherwise(n)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(F.regexp_replace(value, r"[^0-9]", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def _is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(9, 15)


def base_spans(rows: DataFrame) -> DataFrame:
    """The rows with an array of spans for each kind and one of ``tokens``."""
    text, none = F.col("text"), F.array().cast(SPANS)
    digit = text.rlike("[0-9]")
    looked = rows.withColumns(
        {
            "email": F.when(text.contains("@"), located(text, EMAIL)).otherwise(none),
            "ip": F.when(digit, located(text, IP)).otherwise(none),
            "card": F.when(digit, located(text, CARD)).otherwise(none),
            "phone": F.when(text.contains("+") & digit, located(text, PHONE)).otherwise(none),
            "tokens": F.when(digit | text.contains("@"), located(text, TOKEN, words=True)).otherwise(none),
        }
    )
    return looked.withColumns(
        {
            "ip": F.filter("ip", lambda s: _is_ip(s["value"])),
            "card": F.filter("card", lambda s: _is_card(s["value"])),
            "phone": F.filter("phone", lambda s: _is_phone(s["value"])),
        }
    )


def instances(spans: DataFrame) -> DataFrame:
    """Tokens with the pattern before them, whether they overlap a base span and whether they look like an identifier; one row for each text and place."""
    over = lambda t: functools.reduce(Column.__or__, (overlaps(F.col(kind), t["start"], t["end"]) for kind in KINDS))
    tokens = F.transform("tokens", lambda t: F.struct(t.alias("t"), over(t).alias("seed")))
    each = spans.where(F.size("tokens") > 0).select("text_key", F.explode(tokens).alias("x")).select("text_key", "x.t.*", "x.seed")
    core = F.regexp_extract("value", r"[\p{L}\p{N}](?s:.*[\p{L}\p{N}])?", 0)
    words = F.regexp_extract(F.lower("before"), r"((?:\p{L}+[^\p{L}\p{N}]+)?\p{L}+)[^\p{L}\p{N}]*$", 1)
    return (
        each.withColumns({"start": F.col("start") + F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*", 0)), "value": core, "pattern": F.regexp_replace(words, r"[^\p{L}]+", " ")})
        .where((F.col("pattern") != "") & (F.col("value") != ""))
        .select("text_key", "start", (F.col("start") + F.char_length("value")).alias("end"), "value", "pattern", "seed", (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 4).alias("identifier"))
        .dropDuplicates(["text_key", "start"])
    )


def bootstrap(graph: DataFrame, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (with their support) and of instances, from edges ``pattern``, ``value``, ``seed``.

    Scores only rise from round to round; rounds go on until no pattern rises by more than ``settled``, so discovered instances support patterns as often as it takes.
    """
    scores, before = graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score")), None
    while True:
        patterns = cut_lineage(graph.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("pattern_score"), F.sum((F.col("score") >= INSTANCE_SCORE).cast("int")).alias("support")))
        doubt = F.sum(F.log1p(-F.least(F.col("pattern_score"), F.lit(0.999)) * (F.col("pattern_score") >= 0.5).cast("int")))
        scores = cut_lineage(graph.join(patterns, "pattern").groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt)).alias("score")))
        if before is not None:
            rise = patterns.join(before.select("pattern", F.col("pattern_score").alias("was")), "pattern").agg(F.max(F.col("pattern_score") - F.col("was"))).first()[0]  # one row
            if rise is None or rise <= settled:
                return patterns, scores
        before = patterns


def found(spans: DataFrame) -> DataFrame:
    """``text_key`` and the sorted ``found`` spans of the texts where bootstrapping discovers any."""
    seen = cut_lineage(instances(spans))
    graph = cut_lineage(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    patterns, scores = bootstrap(graph)
    good = patterns.where((F.col("pattern_score") >= PATTERN_SCORE) & (F.col("support") >= PATTERN_SEEDS)).select("pattern")
    sure = scores.where(F.col("score") >= INSTANCE_SCORE).select("value")
    sound = graph.select("pattern", "value").join(good, "pattern", "left_semi").join(sure, "value", "left_semi")
    new = seen.where(~F.col("seed") & F.col("identifier")).join(sound, ["pattern", "value"], "left_semi")
    return new.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, the arrays of base spans by kind and the ``found`` ones."""
    rows = doc_text(docs).withColumn("text_key", F.md5("text"))
    spans = cut_lineage(base_spans(rows).select("doc_id", "text_key", *KINDS, "tokens"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    with_tokens = F.size("tokens") > 0
    joined = spans.where(with_tokens).join(found(spans), "text_key", "left").select("doc_id", *KINDS, F.coalesce("found", none).alias("found"))
    return joined.unionByName(spans.where(~with_tokens).select("doc_id", *KINDS, none.alias("found")))


def joined(*kinds: str) -> Column:
    """``kind:start:end`` of the spans of several kinds, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*(of(k) for k in kinds)), ",")
