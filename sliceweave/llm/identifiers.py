"""Personal data: fixed forms, and identifiers found by the contexts these induce (bootstrapped extraction).

Four forms (mail, address, card and phone number) are found by one regular expression each. They are the seeds. Every
token that looks like an identifier (a mail sign, or ``DIGITS`` digits) is an instance, and the words around it, with the coarse
form of the token, are its lexical patterns. Patterns and instances are the two sides of a graph. In each round a pattern is
as sure of a kind as the share of its instances that are known to be of it, and an instance is as sure as its patterns
together; seeds stay sure. Patterns that are sure enough at the end mark the tokens that stand in them and in no seed.

Only DataFrame functions are used. A text is cut into gaps and hits in one pass of each expression; positions are running
sums of their lengths in a window over the hits of one text. Scores are whole thousandths, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.llm.common import fresh, stored

#: Kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
#: Digits of a token without a mail sign that make it an instance.
DIGITS = 5
#: Rounds of the graph, and thousandths of sureness from which a pattern lends its sureness, and from which it marks tokens.
ROUNDS, LENDS, MARKS = 3, 500, 800
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Expressions without nested repeats: what repeats in groups is taken as far as it goes, by what must follow its end.
# A hit begins at the start of a run of its first class, or where the hit before it ends.
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++\.{_HOST}(?:[A-Za-z0-9.-]*?)(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]*?(?=[ -]{2}|[ -]?(?:[^0-9 -]|\z))",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
#: What a text must have for a form to occur in it.
NEEDS = {"email": "@", "phone": "+"}
#: Signs around a token that do not belong to it.
_OUTER = "\"'`()[]{}<>,;:!?.|=*#_/\\~^&%$-"
_SPAN = "struct<kind:string,at:int,gap:int,hit:string,left:string,right:string>"


def valid(kind: str, hit: Column) -> Column:
    """Whether a hit of a form counts."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":  # by number: zeros in front do not count
        parts = F.transform(F.split(hit, "\\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def hits(text: Column, kind: str) -> Column:
    """Hits of one form, from the left: number, length of the gap before, hit, and for tokens up to two words on either side."""
    whole = F.lit(rf"(?s)(.*?)({FORMS[kind]}|\z)")
    found = F.struct(*[F.regexp_extract_all(text, whole, i).alias(name) for i, name in ((1, "gaps"), (2, "hits"))])
    words = lambda gap, form: F.lower(F.regexp_extract(gap, form, 0))

    def one(h: Column, i: Column) -> Column:
        if kind == "token":
            left, right = words(h["gap"], r"(?<!\S)(?:\S++\s++)?\S++(?=\s*+\z)"), words(F.coalesce(h["after"], F.lit("")), r"\A\s*+\S++(?:\s++\S++)?")
        else:
            left = right = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.char_length(h["gap"]).alias("gap"), h["hit"].alias("hit"), left.alias("left"), right.alias("right"))

    def listed(f: Column) -> Column:
        gaps = f["gaps"]
        zipped = F.arrays_zip(gaps.alias("gap"), f["hits"].alias("hit"), F.slice(gaps, 2, F.size(gaps)).alias("after"))
        return F.filter(F.transform(zipped, one), lambda h: h["hit"] != "")

    each = F.flatten(F.transform(F.array(found), listed))  # an array of one, so that the text is cut once, not once per hit
    some = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9@]" if kind == "token" else "[0-9]")
    return F.when(some, each).otherwise(F.array().cast(f"array<{_SPAN}>"))


def spans_and_tokens(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (``row`` and its ``hits``): the valid spans of the forms (``row``, ``kind``, ``start``, ``end``), and the
    tokens (also ``seed``, the kind of a span that covers part of one, and ``core``, ``form``, ``left``, ``right``)."""
    each = rows.select("row", F.inline("hits")).repartition("row")  # all that follows is grouped by row
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("hit")
    each = each.withColumn("start", F.col("gap") + F.coalesce(F.sum(F.col("gap") + size).over(before), F.lit(0))).withColumn("end", F.col("start") + size)
    counts = F.lit(False)
    for kind in KINDS:
        counts = F.when(F.col("kind") == kind, valid(kind, F.col("hit"))).otherwise(counts)
    token = F.col("kind") == "token"
    each = each.where(token | counts)
    # A span covers a token if it begins before the token's end and ends after its start; tokens come first at one place.
    upto = Window.partitionBy("row").orderBy(F.when(token, F.col("end")).otherwise(F.col("start")), F.when(token, 0).otherwise(1), "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(~token, F.struct(F.col("end").alias("upto"), F.col("kind").alias("seed")))).over(upto)
    each = each.withColumn("_last", last)
    inner = F.ltrim("hit", F.lit(_OUTER))
    core = F.rtrim(inner, F.lit(_OUTER))
    first = F.col("start") + size - F.char_length(inner)
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    size_of = F.when(digits < 10, "short").when(digits < 14, "number").otherwise("long")
    form = F.when(core.contains("@"), "mail").when(core.rlike("[A-Za-z]"), "mixed").when(core.contains("."), "dotted").otherwise(size_of)
    found = each.select("row", "kind", F.when(token, first).otherwise(F.col("start")).alias("start"), F.when(token, first + F.char_length(core)).otherwise(F.col("end")).alias("end"),
                        F.when(F.col("_last.upto") > F.col("start"), F.col("_last.seed")).alias("seed"), F.when(token, core).alias("core"),
                        F.when(token, form).alias("form"), "left", "right")
    many = F.col("core").contains("@") | (F.length(F.regexp_replace("core", "[^0-9]", "")) >= DIGITS)
    found = stored(found.where((F.col("kind") != "token") | many), "found")
    return found.where("kind <> 'token'").select("row", "kind", "start", "end"), found.where("kind = 'token'").drop("kind")


def patterns(token: DataFrame) -> Column:
    """Digests of the lexical patterns of a token: two words before it, one on either side, two words after it.

    A side with no word between the token and another token with digits, or the border of the text, gives no pattern.
    """
    before, after = F.regexp_extract("left", r"(?<!\S)\S++(?=\s*+\z)", 0), F.regexp_extract("right", r"\A\s*+(\S++)", 1)
    known = {"left": F.col("left") != "", "right": F.col("right") != ""}
    kinds = (("before", ["left"], known["left"]), ("around", [before, after], known["left"] & known["right"]), ("after", ["right"], known["right"]))
    texts = [F.when(some, F.regexp_replace(F.concat_ws(" ", F.lit(kind), "form", *words), r"\s+", " ")) for kind, words, some in kinds]
    return F.transform(F.array_compact(F.array(*texts)), lambda t: F.md5(t.cast("binary")))


def sure_patterns(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``, ``kind`` and ``sure`` (thousandths) of the patterns that are sure enough to mark tokens.

    With n instances of a pattern, its sureness of a kind is the sum of theirs by n + 1, so four seeds alone make it mark. An
    instance that is no seed has what its patterns leave of doubt multiplied. Several kinds: the surest, ties by name.
    """
    instance = F.md5(F.col("core").cast("binary")).alias("instance")
    graph = stored(tokens.select(instance, F.explode(patterns(tokens)).alias("pattern")).distinct(), "graph")
    seeds = stored(tokens.where("seed is not null").groupBy(instance).agg(F.min("seed").alias("kind")), "seeds")
    sizes = stored(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "sizes")
    scores = sure_of = seeds.select("instance", "kind", F.lit(1000).cast("long").alias("score"))
    for step in range(rounds):
        summed = graph.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        sure = summed.join(sizes, "pattern").select("pattern", "kind", F.expr("total div (n + 1)").alias("sure")).where(F.col("sure") >= LENDS)
        sure = stored(sure, "sure")
        if step < rounds - 1:
            doubt = F.floor(-F.log(1 - F.col("sure") / 1000) * 1_000_000)
            lent = graph.join(sure, "pattern").groupBy("instance", "kind").agg(F.sum(doubt).alias("doubt")).join(seeds.select("instance"), "instance", "left_anti")
            lent = lent.select("instance", "kind", F.least(F.floor(1000 * (1 - F.exp(-F.col("doubt") / 1_000_000))), F.lit(999)).alias("score"))
            scores = stored(sure_of.unionByName(lent), "scores")
    best = sure.where(F.col("sure") >= MARKS).groupBy("pattern").agg(F.min(F.struct((-F.col("sure")).alias("less"), "kind")).alias("best"))
    return best.select("pattern", F.col("best.kind").alias("kind"), (-F.col("best.less")).alias("sure"))


def discovered(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``row``, ``kind``, ``start`` and ``end`` of the tokens outside all seeds that stand in a sure pattern."""
    free = tokens.where("seed is null").select("row", "start", "end", F.explode(patterns(tokens)).alias("pattern"))
    met = free.join(sure_patterns(tokens, rounds), "pattern")
    best = met.groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("sure")).alias("less"), "kind")).alias("best"))
    return best.select("row", F.col("best.kind").alias("kind"), "start", "end")


def find(df: DataFrame, keep: list[str], text_column: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` of every row with the spans of its whole text, and the names of the two columns added: ``base`` and
    ``all``, arrays of (start, rank of the kind in ``KINDS``, end), sorted; code points, end exclusive.

    ``all`` adds to the spans of the forms the tokens that sure patterns mark. Null and empty texts have no spans; repeated
    rows each have theirs; an empty table gives an empty result. Other columns are left out.
    """
    made = {name: fresh(df, name) for name in ("base", "all")}
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    found = F.concat(*[hits(text, kind) for kind in FORMS])
    kept = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), *kept, found.alias("hits")), "hits")
    base, tokens = spans_and_tokens(rows.where(F.size("hits") > 0))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    each = base.select("*", F.lit(True).alias("own")).union(discovered(tokens, rounds).select("*", F.lit(False)))
    span = F.struct("start", rank.alias("kind"), "end")
    listed = each.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("all")).withColumnRenamed("row", "_row")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    met = rows.drop("hits").join(listed, F.col("row") == F.col("_row"), "left")
    return met.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *[F.coalesce(F.col(n), none).alias(made[n]) for n in made]), made


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long")


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"] - 1), s["start"], s["end"])), ",")
