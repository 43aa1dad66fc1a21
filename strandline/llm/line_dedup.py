"""Near-duplicate lines by a segment-partition edit join, with built-in DataFrame operations only.

Distinct lines come first, each with the place of its first occurrence. A line is split into ``max_edits`` + 1 even
segments: a line within ``max_edits`` edits has one of them unchanged, at nearly the same place. So the segments are
indexed by (length of the line, number of the segment, characters), and each line probes, for the lengths a little
below its own, only the substrings whose place can agree. Semi-joins leave the few lines that share a key with another
one. These are joined; candidates whose letter counts differ by more than the edits could make them are left out while they
are found, the others are verified by a banded bit-parallel edit distance in code points: for each number of edits a word of
bits holds which of the diagonals around the main one are reached.

A segment that more than SHARED different lines have (a template's) would join all of them pair by pair. Such lines meet by it only
together with what else they must share: characters are dealt into groups; an edit touches two groups at most, so
of two groups more than all edits can touch, two have left the same sequence of characters in both lines. No pair is lost.

Shorter lines than the edits are meant for can take part by exact comparison only: they are grouped like all others, and
left out of the segments.

Lines with over a quarter of a partition's share of all occurrences are few by pigeonhole: their decisions are
broadcast, so that no task gets all occurrences of a frequent line.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import erase, free_names, shuffle_partitions, written

MAX_EDITS, MIN_CHARS, HOT_SHARE = 2, 20, 4
#: Lines of the index that may meet by one segment; more are parted by the characters of their lines.
SHARED = 128
#: Groups of characters that lines with such a segment must share.
ALIKE = 3
#: Candidates whose counts of these are too far apart are no candidates.
LETTERS = " aeioundrstlhcm"
LINE = ["h1", "h2"]
#: A line without such a character is empty.
INK = r"[^\s\x0B]"


def _segment(length: Column, number: Column, max_edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a line's segment ``number`` (from 1): the last ones are a character longer."""
    parts = max_edits + 1
    short = F.floor(length / parts).cast("int")
    longer = F.pmod(length, F.lit(parts))
    extra = F.greatest(number - 1 - (parts - longer), F.lit(0))
    return short * (number - 1) + extra + 1, short + (number > parts - longer).cast("int")


def _counts() -> Column:
    """How often each of LETTERS occurs in a line, modulo 16, as the hexadecimal digits of a long."""
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = F.col("n") - F.length(F.replace("line", F.lit(letter)))
        packed = packed.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(F.lit(15)), 4 * k))
    return packed


def _apart(x: Column, y: Column) -> Column:
    """At most the sum of the differences of two lines' letter counts; an edit changes that by two or less."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        digit = lambda c: F.shiftrightunsigned(c, 4 * k).bitwiseAND(F.lit(15))  # noqa: B023, E731
        d = (digit(x) - digit(y)).bitwiseAND(F.lit(15))
        total = total + F.least(d, 16 - d)
    return total


def _lookups(max_edits: int) -> list[tuple[int, int, int]]:
    """(less, number, shift): a line probes, for lines shorter by ``less`` characters, the substring ``shift`` from the place
    of their segment ``number``, as far as the edits before and after the segment allow. Of two lines of one length either
    finds the other, so that shifts to one side are enough."""
    return [
        (less, i, shift)
        for less in range(max_edits + 1)
        for i in range(1, max_edits + 2)
        for shift in range(max(1 - i, less - (max_edits + 1 - i)), min(i - 1, less + max_edits + 1 - i) + 1)
        if less or shift >= 0
    ]


def _keys(lines: DataFrame, lookups: list[tuple[int, int, int]], max_edits: int, **kept: str) -> DataFrame:
    """The columns ``kept`` (new name: name) and key, the hash of a line's substring, for each of ``lookups``. Rows are multiplied first, so that one small
    expression serves all lookups; lines of one-byte characters are cut as bytes, which need no counting."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("less"), F.lit(b).alias("i"), F.lit(c).alias("shift")) for a, b, c in lookups])).alias("at")
    plain = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary")).alias("plain")
    rows = lines.select(*[F.col(c).alias(k) for k, c in kept.items()], "line", "n", plain, each)
    start, size = _segment(F.col("n") - F.col("at.less"), F.col("at.i"), max_edits)
    rows = rows.withColumns({"start": start + F.col("at.shift"), "size": size}).filter("start >= 1 and start + size - 1 <= n")
    text = F.when(F.col("plain").isNull(), F.substring("line", F.col("start"), F.col("size")).cast("binary")).otherwise(F.substring("plain", F.col("start"), F.col("size")))
    return rows.select(*kept, F.xxhash64(F.col("n") - F.col("at.less"), F.col("at.i"), text).alias("key"))


def _candidates(named: DataFrame, max_edits: int, shared: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs a, b (hashes of lines, the lesser first) that can be within ``max_edits``, some more than once, and the written tables
    that they are read from."""
    segments, lookups = [(0, i, 0) for i in range(1, max_edits + 2)], _lookups(max_edits)
    index, probe = _keys(named, segments, max_edits, a="h1", ca="counts"), _keys(named, lookups, max_edits, b="h1", cb="counts")
    alike = (F.col("a") != F.col("b")) & (_apart(F.col("ca"), F.col("cb")) <= 2 * max_edits)
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    hot = written(index.groupBy("key").count().filter(F.col("count") > shared).select("key"), "hot-segments")
    if hot.isEmpty():
        return index.join(probe.hint("merge"), "key").filter(alike).select(*pair), [hot]
    cold = index.join(hot, "key", "left_anti").join(probe.join(hot, "key", "left_anti").hint("merge"), "key").filter(alike)

    ids = index.join(hot, "key", "left_semi").select(F.col("a").alias("h1")).union(probe.join(hot, "key", "left_semi").select("b")).distinct()
    parted = written(named.join(ids, "h1", "left_semi").withColumn("groups", _groups(2 * max_edits + ALIKE)), "parted-lines")
    index = _keys(parted, segments, max_edits, a="h1", ca="counts", ga="groups").join(hot, "key", "left_semi")
    probe = _keys(parted, lookups, max_edits, b="h1", cb="counts", gb="groups").join(hot, "key", "left_semi")
    index, probe = _by_groups(index, "ga", max_edits), _by_groups(probe, "gb", max_edits).drop("last")
    # a pair meets by the first groups that it shares, not by all
    same = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x, k: x & (k < F.col("last"))))
    met = index.join(probe.hint("merge"), "key").filter(alike & (same == ALIKE - 1))
    return cold.select(*pair).union(met.select(*pair)), [hot, parted]


def _groups(n: int) -> Column:
    """For each of ``n`` groups of characters the hash of those in the line, in their order. Code points are dealt in turn, so that
    letters as well as digits are spread evenly."""
    chars = F.transform(F.split("line", ""), lambda c: F.struct(c.alias("c"), F.pmod(F.ascii(c), F.lit(n)).alias("g")))
    of = lambda dealt, g: F.xxhash64(F.array_join(F.transform(F.filter(dealt, lambda x: x["g"] == g), lambda x: x["c"]), ""))
    return F.flatten(F.transform(F.array(chars), lambda dealt: F.array(*[of(dealt, g) for g in range(n)])))


def _by_groups(rows: DataFrame, groups: str, max_edits: int) -> DataFrame:
    """``rows`` once for each ALIKE groups (the last of them in column last), which go into the key."""
    choices = [F.array(*map(F.lit, c)) for c in combinations(range(2 * max_edits + ALIKE), ALIKE)]
    each = F.explode(F.array(*choices)).alias("some")
    rows = rows.select("*", each).withColumn("last", F.get("some", F.lit(ALIKE - 1)))
    return rows.withColumn("key", F.xxhash64("key", "some", *[F.get(groups, F.get("some", F.lit(k))) for k in range(ALIKE)])).drop("some")


def within(a: str, b: str, max_edits: int) -> Column:
    """Whether the lines in columns ``a`` and ``b``, of lengths that differ by ``max_edits`` or less, are within so many edits.

    Bit ``j - i + max_edits`` of word ``d`` is set if the first i characters of ``a`` become the first j of ``b`` by d edits or
    less. A character of ``a`` moves all diagonals at once: equal ones stay, with an edit more also others, or neighbours.
    """
    width, every = 2 * max_edits + 1, (1 << (2 * max_edits + 1)) - 1

    def step(left: Column, right: Column, reached: Column, i: Column) -> Column:
        own, match = F.get(left, i), F.lit(0)
        for k in range(width):
            match = match.bitwiseOR(F.when(F.get(right, i + (k - max_edits)) == own, F.lit(1 << k)).otherwise(F.lit(0)))
        return F.when(reached[f"d{max_edits}"] == 0, reached).otherwise(F.struct(*_advance(reached, match, max_edits, every)))

    def alike(left: Column, right: Column) -> Column:
        start = F.struct(*[F.lit(((1 << d + 1) - 1) << max_edits & every).alias(f"d{d}") for d in range(max_edits + 1)])
        last = F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, lambda reached, i: step(left, right, reached, i))
        return F.call_function("shiftright", last[f"d{max_edits}"], F.size(right) - F.size(left) + max_edits).bitwiseAND(F.lit(1)) == 1

    # of an array of one pair, so that lines are split into characters once and not in each step
    return F.exists(F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))), lambda pair: alike(pair["a"], pair["b"]))


def _advance(reached: Column, match: Column, max_edits: int, every: int) -> list[Column]:
    words = []
    for d in range(max_edits + 1):
        now = reached[f"d{d}"].bitwiseAND(match)
        if d:
            fewer = reached[f"d{d - 1}"]
            now = now.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(words[-1], 1).bitwiseAND(F.lit(every)))
        words.append(now.alias(f"d{d}"))
    return words


def _place() -> Column:
    """An occurrence's place in the order by id and line; without an id it comes last."""
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("no")
    return F.coalesce(place.cast("decimal(38,0)"), F.lit("9" * 37).cast("decimal(38,0)"))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, exact_short: bool = False) -> DataFrame:
    """The lines of at least ``min_chars`` characters, with ``exact_short`` all that are not empty: doc_id, no (from 0), line,
    n, and two hashes as its key."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("no", "line"))
    wanted = F.col("n") >= min_chars
    lines = lines.withColumn("n", F.length("line")).filter(wanted | F.col("line").rlike(INK) if exact_short else wanted)
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def line_decisions(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_short: bool = False, shared: int = SHARED) -> DataFrame:
    """For each distinct line: h1, h2, count, first (its first occurrence's place), later (a line within ``max_edits``
    edits has its first occurrence before this one's), links (such lines before or after). Lines of less than ``min_chars``
    characters, there with ``exact_short``, have no links."""
    if min_chars <= max_edits:
        raise ValueError("lines must be longer than the edits between them")
    every = occurrences(docs, id_col, text_col, min_chars, exact_short)
    lines = every.groupBy(*LINE, "line", "n").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("count"))
    lines = written(lines.withColumn("at", F.struct("first", "h1", "h2")), "distinct-lines")

    # Lines that share a key with another one.
    long = lines.filter(F.col("n") >= min_chars) if exact_short else lines
    segments, lookups = [(0, i, 0) for i in range(1, max_edits + 2)], _lookups(max_edits)
    index, probe = _keys(long, segments, max_edits, a="h1"), _keys(long, lookups, max_edits, b="h1")
    probing = probe.alias("p").join(index.hint("merge").alias("i"), F.expr("p.key = i.key and p.b != i.a"), "left_semi")
    probing = written(probing, "probing")
    found = index.join(probing.select("key").distinct(), "key", "left_semi").select(F.col("a").alias("h1"))
    ends = found.union(probing.select("b")).distinct()
    named = lines.join(ends.hint("merge"), "h1", "left_semi").select("h1", "line", "n", "at", _counts().alias("counts"))
    named = written(named, "candidate-lines")

    pairs, tables = _candidates(named, max_edits, shared)
    pairs = pairs.distinct()
    left = pairs.join(named.select(F.col("h1").alias("a"), F.col("line").alias("la"), F.col("at").alias("pa")), "a")
    both = left.join(named.select(F.col("h1").alias("b"), F.col("line").alias("lb"), F.col("at").alias("pb")), "b")
    linked = both.filter(within("la", "lb", max_edits))
    linked = linked.select(F.explode(F.array(F.struct(F.col("pa").alias("own"), (F.col("pb") < F.col("pa")).alias("later")), F.struct(F.col("pb").alias("own"), (F.col("pa") < F.col("pb")).alias("later")))).alias("e"))
    linked = written(linked.groupBy(F.col("e.own.h1").alias("h1"), F.col("e.own.h2").alias("h2")).agg(F.bool_or("e.later").alias("later"), F.count(F.lit(1)).alias("links")), "linked")
    erase(probing, named, *tables)
    return lines.select(*LINE, "first", "count").join(linked, LINE, "left").select(*LINE, "first", "count", F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("links", F.lit(0)).alias("links"))


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_short: bool = False) -> DataFrame:
    """doc_id, dropped (the numbers of its repeated lines, ascending) for each document that has any.

    A line is repeated if the same line, or one within ``max_edits`` edits (code points), occurs before it: in a
    document with a smaller id, or higher up in its own. Lines of less than ``min_chars`` characters are
    repeated only with ``exact_short``, and then only by the same line; lines of white space alone never are, if they are short.
    Null and empty texts have none. Rows with equal ids count as one document; rows without an id come after all others
    and count as one place. An empty table gives an empty result; other columns are not looked at.
    """
    decided = line_decisions(docs, max_edits, min_chars, id_col, text_col, exact_short)
    decided = written(decided.filter("later or count > 1"), "lines")  # others stay wherever they are
    every = occurrences(docs, id_col, text_col, min_chars, exact_short).select("doc_id", "no", *LINE)
    rows = decided.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    share = max(1, rows // (HOT_SHARE * shuffle_partitions(docs.sparkSession)))
    hot = F.broadcast(decided.filter(F.col("count") > share))  # fewer than HOT_SHARE * partitions + 1
    frequent = every.join(hot, LINE)
    others = every.join(hot.select(*LINE), LINE, "left_anti").join(decided.filter(F.col("count") <= share), LINE)
    gone = frequent.unionByName(others).filter(F.col("later") | (_place() != F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("no")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the texts that are left without their repeated lines (other columns as they are), and all the
    documents that nothing is dropped from; one that is left with nothing but white space goes.

    Rows that share an id follow each other by the hash of their texts, and each loses its own lines only; of rows that share
    both, in any order, the later ones repeat all lines of the first. Ids that are no integers are ordered as they are.
    """
    place, gone, of, before = free_names(docs, "place", "dropped", "of", "before")
    shared = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") and shared.isEmpty():
        return _without(docs, repeated_lines(docs, min_chars=min_chars, id_col=id_col, text_col=text_col, **options), id_col, gone, of, text_col, docs.columns)
    order = [F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(before)]  # the last deals out equal rows
    dealt = docs.withColumn(before, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(dealt.drop(before).withColumn(place, F.monotonically_increasing_id()), "placed-rows")
    return _without(rows, repeated_lines(rows, min_chars=min_chars, id_col=place, text_col=text_col, **options), place, gone, of, text_col, docs.columns)


def _without(rows: DataFrame, found: DataFrame, id_col: str, gone: str, of: str, text_col: str, columns: list[str]) -> DataFrame:
    """``rows`` without the lines that ``found`` has for them."""
    rows = rows.join(found.select(F.col("doc_id").alias(of), F.col("dropped").alias(gone)), F.col(id_col).eqNullSafe(F.col(of)), "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, k: ~F.array_contains(gone, k))
    rows = rows.filter(F.col(gone).isNull() | F.coalesce(F.exists(left, lambda line: line.rlike(INK)), F.lit(True)))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in columns])
