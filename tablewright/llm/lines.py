"""Line dedup by a deletion-neighbourhood join, in DataFrame expressions only.

Two lines are duplicates if they are equal word for word, or if both have at least `MIN_WORDS` words and the edit distance
between their word sequences (insert, delete, replace a word) is at most the bound: 1, or with `words_per_edit` one for each
so many words of the shorter line, 1 at least. So about one word in eight may differ at most; in shorter lines one word would
be more, and they count as different. A line goes when an earlier line, by doc_id and place, is its duplicate; so the earliest
of equal lines stays. Blank lines stay always.

1. One scan hashes each line and gives its filter keys. Equal lines are merged to the earliest, pre-aggregated.
2. Filter keys, so that lines without a possible partner are read no further. Bound 1: the first and the last half of a line;
   a pair agrees in one of them. Higher bounds: a variant is the line without up to 2 b of its chunks (an edit touches two
   chunks at most), and a pair has a variant in common. All variants together have only 2 b + 1 different least chunks,
   whatever order of chunks is taken, so a variant's key is its least chunk, and the keys number 2 b + 1.
3. Bound 1: a candidate's variants are itself and itself without one word. The key is the text before and after the gap, so
   lines that share a key differ in that gap alone; only the earliest line of a key is sought, and no pairs are formed.
4. Higher bounds: the lines of a key that few have are compared. Lines of crowded keys get keys again, with pairs of words in
   place of chunks (an edit touches two), the longest in order of their frequency: a line with more pairs of its own than the
   bound allows is done, and keys are rare. Counts of words by their hash rule out most pairs before a text is moved. The others are compared with the earliest line of each of their keys. Those that this does not
   settle are compared with the other lines of their keys; those of common keys only if bits for their words leave the bound open.
5. Every match is verified: equal text around the gap, or the edit distance of the words.

Chunks end after words with certain last letters. A line with too few chunks takes its words as chunks as well; an
edit touches one of those, so b + 1 keys do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, freed, heavy_join, stored, whole

MIN_WORDS = 8
#: Gaps of the second filter for bound 1.
GAPS = 8
#: Lines of a key that are compared with each other as they are.
FEW = 8
#: Lines of a pair of words that are compared with each other as they are; of commoner ones, those whose marks leave the bound open.
REFINED = 16
#: Pairs of words of a line of bound b, the longest, that are counted: 3 b and so many.
SPARE = 4
#: Numbers of 64 bits that mark the words of a line.
MARKS = 8
#: Words of a line for one edit, in the registered queries.
WORDS_PER_EDIT = 20
#: A chunk ends after a word that ends in one of these, which many words of most languages in Latin letters do. Few, as each costs
#: a pass over the text; lines with fewer chunks than the bound needs go by words.
CHUNK_END = "nsr"


def _tabbed(text: Column) -> Column:
    """Whether the text has white space other than spaces and line feeds: one pass, where a test of each line takes four."""
    return text.rlike("[\t\u000b\f\r]")


def _normal(line: Column, tabbed: Column) -> Column:
    """The words with one space between them; tabbed: whether the line can hold other white space than spaces."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\u000b\f\r":
        odd = odd | tabbed & line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, "[\t\u000b\f\r ]+", " "))).otherwise(line)


def _first(s: Column, n: Column) -> Column:
    """The first n words of a normal line."""
    return F.call_function("substring_index", s, F.lit(" "), n)


def _last(s: Column, n: Column) -> Column:
    return _first(s, -n)


def _bind(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def _halves(s: Column, n: Column) -> Column:
    """Keys of the first and last m words for m = n/2 and (n-1)/2: a line may be the longer or the shorter of a pair."""
    def of(m: Column) -> list[Column]:
        return [F.xxhash64(F.lit("f"), m, _first(s, m)), F.xxhash64(F.lit("l"), m, _last(s, m))]

    return F.array_distinct(F.array(*of((n / 2).cast("int")), *of(((n - 1) / 2).cast("int"))))


def _token(chunk: Column, tag: str) -> Column:
    """A chunk's hash below its length, so that long chunks, which are rarer, come first in order."""
    return F.shiftleft(F.greatest(F.lit(127) - F.octet_length(chunk), F.lit(0)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(tag), chunk), 8))


def _tokens(parts: Column, tag: str) -> Column:
    return F.array_distinct(F.transform(parts, lambda c: _token(c, tag)))


def _chunks(s: Column) -> Column:
    for c in CHUNK_END:
        s = F.replace(s, F.lit(f"{c} "), F.lit(f"{c}\n"))
    return F.split(s, "\n")


def _word_pairs(s: Column) -> Column:
    """A hash of each different word with its next one, below their length, so that long ones come first in order."""
    def token(v: Column, x: Column) -> Column:
        size = F.least(F.octet_length(v) + F.octet_length(x), F.lit(127)).cast("long")
        return F.shiftrightunsigned(F.xxhash64(v, x), 8) - F.shiftleft(size, 56)

    def of(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), token)

    return F.array_distinct(_bind(F.split(s, " "), of))


def _least(tokens: Column, n: Column) -> Column:
    return F.slice(F.sort_array(tokens), F.lit(1), n)


def _filter_keys(s: Column, n: Column, per: int | None) -> Column:
    none = F.expr("cast(array() as array<bigint>)")
    if not per:
        return F.when(n >= MIN_WORDS, _halves(s, n)).otherwise(none)
    b = (n / per).cast("int")
    sparse = _least(_tokens(F.split(s, " "), "w"), b + 1)
    dense = _bind(_chunks(s), lambda c: F.concat(_least(_tokens(c, "c"), 2 * b + 1), F.when(F.size(c) > 2 * b, none).otherwise(sparse)))
    long = F.when(n > 2 * per, dense).when(n == 2 * per, F.concat(dense, _halves(s, n)))
    return long.when(n >= MIN_WORDS, _halves(s, n)).otherwise(none)


def _within(x: Column, y: Column, bound: Column) -> Column:
    """Whether the edit distance between two word lists is at most bound: each word becomes a character of its own.

    The character follows from the word's hash; words of one hash get characters by their place in the list of such words.
    """
    code = lambda w: (F.pmod(F.xxhash64(w), F.lit(0xE0000)) + 0x10000).cast("int")

    def near(known: Column) -> Column:
        twins = _bind(F.sort_array(F.transform(known, code)), lambda codes: F.filter(codes, lambda v, i: v == F.get(codes, i - 1)))

        def told(twin: Column) -> Column:
            def text(words: Column, alike: Column) -> Column:
                own = lambda w: F.when(F.array_contains(twin, code(w)), (F.array_position(alike, w) + 0xF0000).cast("int")).otherwise(code(w))
                return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(own(w)), 8, "0")), "")), "UTF-32")

            alike = F.filter(known, lambda w: F.array_contains(twin, code(w)))
            return _bind(alike, lambda a: F.call_function("levenshtein", text(x, a), text(y, a), bound))

        return _bind(twins, told)

    few = lambda own, lacking: _bind(lacking, lambda o: F.when(F.size(o) <= bound, F.size(F.filter(own, lambda w: F.array_contains(o, w))) <= bound).otherwise(False))
    apart = few(x, F.array_except(x, y)) & few(y, F.array_except(y, x))  # all places of a word that the other has not are edits
    return F.when(apart, _bind(F.array_distinct(F.concat(x, y)), near) >= 0).otherwise(False)


def _bound(n: Column, m: Column, per: int) -> Column:
    return F.floor(F.least(n, m) / per).cast("int")


def _tallies(s: Column, n: Column) -> Column:
    """Two numbers of three counts with 20 bits each: the words of the line by groups of their hash. Null for lines of too many words."""
    def number(own: Column) -> Column:
        return F.aggregate(own, F.lit(0).cast("long"), lambda so_far, h: so_far + F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(3)) * 20))

    both = _bind(F.transform(F.split(s, " "), lambda w: F.hash(w)), lambda own: F.array(number(F.filter(own, lambda h: h >= 0)), number(F.filter(own, lambda h: h < 0))))
    return F.when(n < 1 << 15, both)


def _excess(x: list[Column], y: list[Column]) -> Column:
    """By how much x's counts are above y's. All three of a number at once, in few operations, or a join's code is too long to be compiled."""
    tops = sum(1 << k for k in (19, 39, 59))

    def of(a: Column, b: Column) -> Column:
        less = a.bitwiseOR(F.lit(tops)) - b  # a top bit stays where a's count is not below b's
        above = F.shiftrightunsigned(less.bitwiseAND(F.lit(tops)), 19) * F.lit((1 << 19) - 1)
        return less.bitwiseAND(above) % F.lit((1 << 20) - 1)  # the sum of the counts

    return sum((of(a, b) for a, b in zip(x, y)), F.lit(0))


def _open(n: Column, x: list[Column], m: Column, y: list[Column], per: int) -> Column:
    """Whether lengths and tallies leave open that two lines are within the bound: an edit takes one word from each side at most."""
    bound = _bound(n, m, per)
    return (F.abs(n - m) <= bound) & F.coalesce((_excess(x, y) <= bound) & (_excess(y, x) <= bound), F.lit(True))


TALLIES = ["w0", "w1"]


def _settled(pairs: DataFrame, found: DataFrame, per: int, name: str) -> DataFrame:
    """(h1, h2) of the later line of each pair (h1, h2, g1, g2) within the bound."""
    mine = found.select("h1", "h2", "first", F.col("s").alias("x"))
    other = found.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("before"), F.col("s").alias("y"))
    within = _bind(F.array(F.split("x", " "), F.split("y", " ")), lambda w: _within(w[0], w[1], _bound(F.size(w[0]), F.size(w[1]), per)))
    both = pairs.join(mine, ["h1", "h2"]).join(other, ["g1", "g2"]).where(within)
    late = F.when(F.col("before") < F.col("first"), F.struct("h1", "h2")).otherwise(F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2")))
    return stored(both.select(late.alias("late")).select("late.h1", "late.h2").distinct(), name)


def _close_pairs(shared: DataFrame, per: int) -> DataFrame:
    """Pairs (h1, h2, g1, g2) of long lines that share a key of at most FEW lines and may be within the bound by their lengths."""
    few = shared.where((F.col("c") <= FEW) & (F.col("n") >= 2 * per)).select("key", "h1", "h2", "n")
    other = few.select("key", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("m"))
    close = F.abs(F.col("n") - F.col("m")) <= _bound(F.col("n"), F.col("m"), per)
    pairs = few.join(other, "key").where((F.struct("h1", "h2") < F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2"))) & close)
    return pairs.select("h1", "h2", "g1", "g2").distinct()


def _open_pairs(pairs: DataFrame, found: DataFrame, per: int) -> DataFrame:
    """The pairs (h1, h2, g1, g2) that tallies leave open; no text is moved for the others."""
    mine = found.select("h1", "h2", "n", *TALLIES)
    other = found.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("m"), F.array(*TALLIES).alias("y"))
    both = pairs.join(mine, ["h1", "h2"]).join(other, ["g1", "g2"])
    return both.where(_open(F.col("n"), [F.col(w) for w in TALLIES], F.col("m"), [F.get("y", F.lit(k)) for k in (0, 1)], per)).select("h1", "h2", "g1", "g2")


def _firsts(keys: DataFrame) -> DataFrame:
    """The earliest line of each token that several lines have, as `one`, and their number c."""
    return stored(keys.groupBy("token").agg(F.min(F.struct("first", "h1", "h2", "n", *TALLIES)).alias("one"), F.count(F.lit(1)).alias("c")).where("c > 1"), "line-firsts")


def _told(keys: DataFrame, firsts: DataFrame, per: int) -> DataFrame:
    """Pairs of a line with the earliest line of each of its tokens."""
    fits = _open(F.col("n"), [F.col(w) for w in TALLIES], F.col("one.n"), [F.col(f"one.{w}") for w in TALLIES], per)
    told = heavy_join(keys.select("h1", "h2", "first", "n", *TALLIES, "token"), firsts, ["token"], "c").where((F.col("one.first") < F.col("first")) & fits)
    return stored(told.select("h1", "h2", F.col("one.h1").alias("g1"), F.col("one.h2").alias("g2")).distinct(), "line-told")


def _earlier(rest: DataFrame, keys: DataFrame, per: int) -> DataFrame:
    """Pairs of a line of rest with each earlier line of its tokens, as far as tallies leave them open."""
    theirs = keys.select("token", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("before"), F.col("n").alias("m"), *[F.col(w).alias(f"y{w}") for w in TALLIES])
    close = _open(F.col("n"), [F.col(w) for w in TALLIES], F.col("m"), [F.col(f"y{w}") for w in TALLIES], per)
    return rest.join(theirs, "token").where((F.col("before") < F.col("first")) & close).select("h1", "h2", "g1", "g2").distinct()


def _marked(long: DataFrame) -> DataFrame:
    """(h1, h2, marks): MARKS numbers of 64 bits, in which each word of the line has its bit; words can share one."""
    places = F.array_distinct(F.transform(F.split("s", " "), lambda w: F.pmod(F.hash(w), F.lit(64 * MARKS))))
    powers = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])

    def number(own: Column, k: int) -> Column:
        bits = F.transform(F.filter(own, lambda v: F.shiftright(v, 6) == k), lambda v: F.get(powers, F.pmod(v, F.lit(64))))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda so_far, bit: so_far.bitwiseOR(bit))

    return long.select("h1", "h2", _bind(places, lambda own: F.array(*[number(own, k) for k in range(MARKS)])).alias("marks"))


def _alike(rest: DataFrame, keys: DataFrame, marks: DataFrame, per: int) -> DataFrame:
    """Pairs of a line of rest with each earlier line of its tokens, as far as their marks and tallies leave the bound open.

    An edit takes one word from each side at most, so one line has no more than that many bits that the other has not.
    """
    numbers = lambda name: [F.get("marks", F.lit(k)).alias(f"{name}{k}") for k in range(MARKS)]
    mine = rest.join(marks, ["h1", "h2"]).select("token", "h1", "h2", "first", "n", *TALLIES, *numbers("x"))
    theirs = keys.join(marks, ["h1", "h2"]).select("token", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("before"), F.col("n").alias("m"), *[F.col(w).alias(f"y{w}") for w in TALLIES], *numbers("y"))
    lack = lambda x, y: sum((F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in range(MARKS)), F.lit(0))
    bound = _bound(F.col("n"), F.col("m"), per)
    tallied = _open(F.col("n"), [F.col(w) for w in TALLIES], F.col("m"), [F.col(f"y{w}") for w in TALLIES], per)
    close = (F.abs(F.col("n") - F.col("m")) <= bound) & (lack("x", "y") <= bound) & (lack("y", "x") <= bound) & tallied
    return mine.join(theirs, "token").where((F.col("before") < F.col("first")) & close).select("h1", "h2", "g1", "g2")


def _far(long: DataFrame, per: int) -> DataFrame:
    """(h1, h2) of numbered lines, all with a bound of 2 or more and a crowded key, that an earlier one of them is within.

    A line has at most 2 b tokens that the other has not, and of its tokens in order of their length the first 3 b + SPARE
    are taken. Both lines take their b + SPARE least common tokens, or all, and each has at most 2 b among its own that the
    other's lack; so in order of their frequency, the lines share one among the first 2 b + 1 of each.
    """
    each = long.select("id", F.explode("tokens").alias("token"))
    often = stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "line-tokens")
    shared = heavy_join(each, often, ["token"], "c", hashed=True).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("own"))  # a line's own words
    shared = shared.join(long.select("id", "h1", "h2", "first", "n", *TALLIES, F.size("tokens").alias("all")), "id")
    spare, alone = 2 * (F.col("n") / per).cast("int"), F.col("all") - F.size("own")
    rarest = F.slice("own", F.lit(1), F.greatest(spare + 1 - alone, F.lit(0)))["token"]
    keys = stored(shared.where(alone <= spare).select("h1", "h2", "first", "n", *TALLIES, F.explode(rarest).alias("token")), "line-keys")
    dropped(often)
    freed(long)

    firsts = _firsts(keys)
    told = _told(keys, firsts, per)
    early = _settled(told, long, per, "line-early")

    # What the earliest lines do not settle meets the other lines of rare tokens, and of common ones those that are alike by their marks.
    rest = stored(heavy_join(keys.join(early, ["h1", "h2"], "left_anti"), firsts, ["token"], "c").select("h1", "h2", "first", "n", *TALLIES, "token", "c"), "line-rest")
    common = rest.where(F.col("c") > REFINED)
    theirs = stored(keys.join(common.select("token").distinct(), "token", "left_semi"), "line-common")
    marks = stored(_marked(long.join(theirs.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")), "line-marks")
    pairs = _earlier(rest.where(F.col("c") <= REFINED), keys, per).union(_alike(common, theirs, marks, per)).distinct()
    late = _settled(pairs.join(told, ["h1", "h2", "g1", "g2"], "left_anti"), long, per, "line-late")
    dropped(keys, firsts, told, rest, theirs, marks)
    freed(long)
    return early.union(late)


def _near(found: DataFrame) -> DataFrame:
    """(h1, h2) of lines that an earlier one is within one edit of."""
    n = F.col("n")

    def gaps(m: Column) -> Column:
        """GAPS gaps [a, b) of the first m words; in a line of m + 1 words a gap is one longer."""
        def one(g: Column) -> Column:
            return F.struct(F.floor(m * g / GAPS).cast("int").alias("a"), (F.floor(m * (g + 1) / GAPS) + n - m).cast("int").alias("b"), m.alias("m"), g.alias("g"))

        return F.transform(F.sequence(F.lit(0), F.lit(GAPS - 1)), one)

    cut = found.select("*", F.explode(F.concat(gaps(n), gaps(n - 1))).alias("gap"))
    around = F.xxhash64("gap.m", "gap.g", _first(F.col("s"), F.col("gap.a")), _last(F.col("s"), n - F.col("gap.b")))
    cut = stored(cut.select("h1", "h2", around.alias("shared"), "gap"), "line-gaps")
    often = stored(cut.groupBy("shared").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "line-shared")
    some = heavy_join(cut, often, ["shared"], "c").groupBy("h1", "h2").agg(F.collect_set("gap").alias("gaps"))  # at most 2 * GAPS of a line
    places = F.array_distinct(F.flatten(F.transform("gaps", lambda g: F.sequence(g["a"], F.greatest(g["b"], g["a"])))))
    near = found.join(some, ["h1", "h2"]).select("h1", "h2", "first", "s", "n", F.explode(places).alias("i"))
    tail = lambda left: F.xxhash64(_last(F.col("s"), left))
    variants = F.array(
        F.struct(tail(n - F.col("i")).alias("tail"), n.alias("left")),
        F.when(F.col("i") < n, F.struct(tail(n - F.col("i") - 1).alias("tail"), (n - 1).alias("left"))),
    )
    near = near.select("h1", "h2", "first", "i", F.xxhash64(_first(F.col("s"), F.col("i"))).alias("head"), F.explode(F.array_compact(variants)).alias("v"))
    key = ["head", "tail", "left", "i"]
    keys = stored(near.select("h1", "h2", "first", "i", "head", "v.tail", "v.left"), "line-variants")
    dropped(cut, often)
    freed(found)

    firsts = stored(keys.groupBy(*key).agg(F.min(F.struct("first", "h1", "h2")).alias("one"), F.count(F.lit(1)).alias("c")).where("c > 1"), "line-firsts")
    match = heavy_join(keys, firsts, key, "c").where("one.first < first")
    match = match.groupBy("h1", "h2").agg(F.min(F.struct(F.col("one.first").alias("first"), F.col("one.h1").alias("g1"), F.col("one.h2").alias("g2"), "i", "left")).alias("m"))
    match = match.select("h1", "h2", "m.g1", "m.g2", "m.i", "m.left")
    mine = found.select("h1", "h2", F.col("s").alias("x"))
    other = found.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("s").alias("y"))
    same = lambda f, k: f(F.col("x"), k) == f(F.col("y"), k)
    agree = same(_first, F.col("i")) & same(_last, F.col("left") - F.col("i"))
    out = stored(match.join(mine, ["h1", "h2"]).join(other, ["g1", "g2"]).where(agree).select("h1", "h2"), "line-near")
    dropped(keys, firsts)
    return out


def _removals(docs: DataFrame, per: int | None) -> DataFrame:
    """(k1, k2, cut, near): places of the lines to remove from rows (k1, k2, doc_id, text), and the number that are not equal copies."""
    order = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "k1", "k2", "at")
    lines = docs.select("k1", "k2", "doc_id", "text", _tabbed(F.col("text")).alias("tabbed")).select("k1", "k2", "doc_id", "tabbed", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(F.ltrim("line", F.lit("\t\u000b\f\r ")) != "").select("k1", "k2", "doc_id", "at", _normal(F.col("line"), F.col("tabbed")).alias("s"))
    lines = lines.withColumn("n", F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1)
    lines = lines.select("k1", "k2", "doc_id", "at", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "n", _filter_keys(F.col("s"), F.col("n"), per).alias("keys"))
    lines = stored(lines, "lines")
    unique = lines.groupBy("h1", "h2").agg(F.min(F.struct(order.alias("first"), "n", "keys")).alias("u"), F.count(F.lit(1)).alias("copies"))
    unique = stored(unique.select("h1", "h2", "u.first", "u.n", "u.keys", "copies"), "line-classes")
    freed(docs)

    keyed = unique.select("h1", "h2", "n", F.explode("keys").alias("key"))
    often = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "line-often")
    shared = stored(heavy_join(keyed, often, ["key"], "c", hashed=True), "line-shared")
    spent = []
    if per:
        pairs = stored(_close_pairs(shared, per), "line-pairs")
        crowded = stored(shared.where((F.col("c") > FEW) & (F.col("n") >= 2 * per)).select("h1", "h2").distinct(), "line-crowded")
        maybe = shared.where(F.col("n") <= 2 * per).select("h1", "h2").union(pairs.select("h1", "h2")).union(pairs.select("g1", "g2")).union(crowded)
        spent += [pairs, crowded]
    else:
        maybe = shared.select("h1", "h2")
    maybe = stored(maybe.distinct(), "line-maybe")
    dropped(shared)
    freed(docs)  # before texts are moved
    own = unique.join(maybe, ["h1", "h2"]).select("first.k1", "first.k2", F.struct("first.at", "h1", "h2", "first", "n").alias("x"))
    own = own.groupBy("k1", "k2").agg(F.collect_list("x").alias("own"))  # a text's own lines
    found = docs.select("k1", "k2", "text").join(own, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    found = found.select(F.split("text", "\n").alias("lines"), F.explode("own").alias("x")).select("x", F.expr("lines[x.at]").alias("line"))
    found = found.select("x.h1", "x.h2", "x.first", "x.n", _normal(F.col("line"), F.lit(True)).alias("s"))
    if per:
        found = found.withColumn("w", F.when(F.col("n") >= 2 * per, _tallies(F.col("s"), F.col("n")))).select("h1", "h2", "first", "n", "s", *[F.get("w", F.lit(k)).alias(w) for k, w in enumerate(TALLIES)])
    found = stored(found, "line-words")
    dropped(often, maybe)
    freed(docs)

    edited = _near(found.where(F.col("n") <= 2 * per) if per else found)
    spent.append(edited)
    freed(docs)
    if per:
        tokens = _least(_word_pairs(F.col("s")), 3 * (F.col("n") / per).cast("int") + SPARE)
        long = stored(found.join(crowded, ["h1", "h2"], "left_semi").select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "n", *TALLIES, "s", tokens.alias("tokens")), "line-long")
        spent.append(long)
        edited = stored(edited.union(_settled(_open_pairs(pairs, found, per), found, per, "line-close")).union(_far(long, per)).distinct(), "line-edited")
        spent.append(edited)
    doomed = unique.join(edited.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("copies > 1 or near")
    doomed = stored(doomed.select("h1", "h2", "first", "copies", F.coalesce("near", F.lit(False)).alias("near")), "line-doomed")
    out = heavy_join(lines.select("k1", "k2", "doc_id", "at", "h1", "h2"), doomed, ["h1", "h2"], "copies", hashed=True)
    out = out.where(F.col("near") | (order > F.col("first"))).groupBy("k1", "k2")
    out = stored(out.agg(F.collect_set("at").alias("cut"), F.size(F.collect_set(F.when(F.col("near"), F.col("at")))).alias("near")), "line-cuts")  # a text's own lines
    dropped(lines, unique, found, doomed, *spent)
    freed(docs)
    return out


def dedup(docs: DataFrame, counts: bool = True, words_per_edit: int | None = None) -> DataFrame:
    """docs with repeated and near-repeated lines taken out of `text`, and n_lines, n_removed, n_near (lines) added.

    Lines may differ in one word, or with words_per_edit (4 at least) in one for each so many words of the shorter line.

    Null texts count as empty: one blank line, nothing removed, text stays null. Null doc_ids come last in the order. Ties of
    doc_id go by a hash of the text. Rows that repeat doc_id and text are one document. A document may lose all its lines; it
    stays with empty text. Texts and lines of any length are read whole. An empty table gives an empty result. All columns of
    docs stay; n_lines, n_removed and n_near replace columns of that name. Without counts no column is added.
    """
    if words_per_edit is not None and words_per_edit < 4:
        raise ValueError("words_per_edit must be 4 at least")
    one, two, cut, near = (free_name(docs, n) for n in ("_k1", "_k2", "_cut", "_near"))
    rows = docs.withColumns({one: F.xxhash64("doc_id", "text"), two: F.xxhash64(F.lit(1), "doc_id", "text")})
    removed = _removals(rows.select(F.col(one).alias("k1"), F.col(two).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")), words_per_edit)
    removed = removed.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("cut").alias(cut), F.col("near").alias(near))
    both = rows.join(removed.hint("shuffle_hash"), [one, two], "left")  # numbers only, so texts need no sorting
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(cut, i))
    new = {"text": F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}
    if counts:
        new |= {"n_lines": (F.octet_length(whole()) - F.octet_length(F.replace(whole(), F.lit("\n"), F.lit(""))) + 1).cast("long"), "n_removed": F.coalesce(F.size(cut), F.lit(0)).cast("long"), "n_near": F.coalesce(near, F.lit(0)).cast("long")}
    return both.withColumns(new).select(*[c for c in docs.columns if c not in new or c == "text"], *[c for c in new if c != "text"])
