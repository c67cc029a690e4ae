"""Personal data: base patterns and bootstrapped contextual extraction.

DataFrame functions only. The base patterns, and published formats of keys,
give the seed entities. Words before and after an entity form lexical patterns
(left word, right word, both; a mark such as = or : belongs to the word before
it). Patterns that meet several seeds, and whose words stand seldom elsewhere,
are screened by counts over all documents; whatever fills them, of any form,
makes a bipartite graph with them whose two sides score each other for a few
rounds. Patterns of high confidence then add identifiers that no base pattern
knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, settle, settled_bytes

#: A settled table is broadcast only below this size on disk, as measured.
BROADCAST_BYTES = 8 << 20

# Fixed values of the contract: the base patterns, in listed order. The email
# pattern may start only where a run starts or the last match ended, and its
# repeats are possessive; neither changes what is found, only the time and the
# stack that long runs take.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A kind of its own for the method: seeds are published key id formats and long
#: runs that mix letters and digits.
SECRET = "secret"
_SECRET = (
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}"
    r"|(?=[A-Za-z]{0,64}[0-9])(?=[0-9]{0,64}[A-Za-z])[A-Za-z0-9]{16,256}+)(?![A-Za-z0-9])"
)
ALL_KINDS = (*KINDS, SECRET)
#: Code points of a gap in which a context word is looked for.
REACH = 60
_ENTITY = "struct<k:int,kind:string,s:int,e:int,v:string,left:string,right:string>"
# A context word, and the marks that join a name to its value.
_NAME = r"""[^\s"'<>\[\](),;=:#]"""


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1),
    )
    return (n > 0) & (total % 10 == 0)


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.try_to_number(F.lpad(bare, 4, "0"), F.lit("0000")) <= 255)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), _byte)
    if kind == "card":
        d = _only_digits(m)
        return F.length(d).between(16, 19) & F.coalesce(F.when(F.length(d).between(16, 19), luhn(d)), F.lit(False))
    if kind == "phone":
        return F.length(_only_digits(m)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column, chunk: int = 256) -> Column:
    """Sums of the elements before each one. Chunks are summed on their own,
    then moved by what lies before them, so arrays grow by short pieces only."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    last = F.floor((F.size(lengths) - 1) / chunk).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(lengths, c * chunk + 1, F.lit(chunk)), start, add))

    def join(parts: Column) -> Column:
        bases = F.aggregate(parts, start, lambda acc, x: add(acc, x["at"]))["out"]
        return _let(bases, lambda b: F.flatten(F.transform(parts, lambda x, i: F.transform(x["out"], lambda y: y + F.get(b, i)))))

    return _let(chunks, join)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, before, after>>: the leftmost non-overlapping
    matches with code point positions and up to REACH code points of the gaps
    on either side, in time that grows with the text."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(text, pattern, -1).alias("gaps")
    )

    def placed(x: Column) -> Column:
        gap = lambda i: F.get(x["gaps"], i)
        lengths = F.transform(x["found"], lambda v, i: F.char_length(gap(i)) + F.char_length(v))
        return _let(_running(lengths), lambda at: F.transform(x["found"], lambda v, i: F.struct(
            (F.get(at, i) + F.char_length(gap(i))).alias("s"),
            (F.get(at, i) + F.char_length(gap(i)) + F.char_length(v)).alias("e"),
            v.alias("v"),
            F.right(gap(i), F.lit(REACH)).alias("before"),
            F.left(gap(i + 1), F.lit(REACH)).alias("after"),
        )))

    none = F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>")
    return _let(parts, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<ENTITY>: the valid matches of a kind."""
    valid = F.filter(_matches(text, pattern), lambda x: _valid(kind, x["v"]))
    return F.transform(valid, lambda x: F.struct(
        F.lit(ALL_KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("s", "e", "v")],
        _left_key(x["before"]).alias("left"), _right_key(x["after"]).alias("right"),
    ))


def base_spans(text: Column) -> Column:
    """The base entities of a text, by kind as listed, then by start. A kind
    is looked for only where its sign occurs (@, a digit, +)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    digit = text.rlike("[0-9]")
    part = {
        "email": (F.contains(text, F.lit("@")), _EMAIL),
        "ip": (digit & text.rlike("[0-9]\\.[0-9]"), _IP),
        "card": (digit, _CARD),
        "phone": (text.rlike("\\+[0-9]"), _PHONE),
    }
    return F.concat(*[F.when(c, _spans(text, kind, p)).otherwise(_none()) for kind, (c, p) in part.items()])


def secret_seeds(text: Column) -> Column:
    """array<ENTITY> of the seeds of SECRET."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long_run = text.rlike("[A-Za-z0-9]{16}")
    return F.when(long_run & text.rlike("[0-9]"), _spans(text, SECRET, _SECRET)).otherwise(_none())


def _none() -> Column:
    return F.array().cast(f"array<{_ENTITY}>")


def _left_key(before: Column) -> Column:
    """The last word of a gap in lower case, with the mark that follows it."""
    tail = rf"""({_NAME}*+)\s*+([=:#]?)[\s"'(]*$"""
    near = F.regexp_extract(before, rf"""(?<!{_NAME}){tail}""", 0)
    return F.lower(F.concat(F.regexp_extract(near, tail, 1), F.regexp_extract(near, tail, 2)))


def _right_key(after: Column) -> Column:
    return F.lower(F.regexp_extract(after, rf"""^[\s"')]*+({_NAME}++)""", 1))


def _patterns(x: Column) -> Column:
    """array<struct<pattern, word>>: the patterns an entity's contexts make, and
    the word that each hangs on."""
    both = (x["left"] != "") & (x["right"] != "")
    made = F.array(
        F.when(x["left"] != "", F.struct(F.concat(F.lit("L|"), x["left"]).alias("pattern"), x["left"].alias("word"))),
        F.when(x["right"] != "", F.struct(F.concat(F.lit("R|"), x["right"]).alias("pattern"), x["right"].alias("word"))),
        F.when(both, F.struct(F.concat_ws("|", F.lit("B"), x["left"], x["right"]).alias("pattern"), x["left"].alias("word"))),
    )
    return F.filter(made, lambda m: m.isNotNull())


def _words(text: Column) -> Column:
    """Words as they stand in patterns: a mark belongs to the word before it."""
    joined = F.regexp_replace(text, r"""\s*+([=:#])[\s"'(]*+""", "$1 ")
    return F.split(F.lower(joined), r"""[\s"'<>\[\](),;]+""")


#: What can fill a pattern: groups of digits with single separators between
#: them, or one word.
_FILLER = r"""[+(]?[0-9][0-9().+-]*+(?: [0-9().-]++)+|[^\s"'<>\[\](),;=:#]++"""


def _slots(text: Column) -> Column:
    """array<ENTITY> of all fillers, without a kind."""
    return F.transform(_matches(text, _FILLER), lambda x: F.struct(
        F.lit(len(ALL_KINDS)).alias("k"), F.lit("").alias("kind"), *[x[c].alias(c) for c in ("s", "e", "v")],
        F.lit("").alias("left"), F.lit("").alias("right"), x["before"].alias("before"), x["after"].alias("after"),
    ))


def _fillers(docs: DataFrame, screened: DataFrame) -> DataFrame:
    """(doc_id, th, pattern, x): what stands in the screened patterns (pattern,
    word), in the documents that hold one of their words, which a join finds."""
    bare = lambda w: F.regexp_replace(w, "[=:#]+$", "")
    names = settle(screened.select(bare(F.col("word")).alias("name")).distinct(), "names")
    if settled_bytes(names) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    there = docs.select("doc_id", "th", F.explode(F.array_distinct(F.transform(_words(F.col("text")), bare))).alias("name"))
    homes = settle(there.join(names, "name").select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "homes")
    docs = docs.join(homes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi")

    def in_context(x: Column) -> Column:
        return F.transform(x, lambda y, i: F.struct(
            y["s"].alias("s"), y["e"].alias("e"), y["v"].alias("v"),
            # a gap holds no word, so the neighbours are the fillers beside it
            F.when(i > 0, F.lower(F.concat(F.get(x, i - 1)["v"], F.regexp_extract(y["before"], "([=:#])", 1)))).otherwise("").alias("left"),
            F.lower(F.coalesce(F.get(x, i + 1)["v"], F.lit(""))).alias("right"),
        ))

    slots = docs.select("doc_id", "th", F.explode(_let(_slots(F.col("text")), in_context)).alias("x"))
    met = slots.select("doc_id", "th", "x", F.explode(_patterns(F.col("x"))).alias("p")).select("doc_id", "th", "x", "p.pattern")
    return met.join(screened.select("pattern"), "pattern").select("doc_id", "th", "pattern", F.struct("x.s", "x.e", "x.v").alias("x"))


def screen(found: DataFrame, docs: DataFrame, support: int = 3, share: float = 0.3) -> DataFrame:
    """(pattern, word) worth looking at: met by at least ``support`` different
    seeds, whose number is at least ``share`` of the occurrences of the
    pattern's word in all documents."""
    seen = found.select(F.explode(F.concat("base", "secret")).alias("x"))
    seeds = (
        seen.select(F.explode(_patterns(F.col("x"))).alias("p"), F.lower("x.v").alias("value"))
        .groupBy("p.pattern", "p.word").agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= support)
    )
    seeds = settle(seeds, "supported")
    names = settle(seeds.select("word").distinct(), "context-words")
    all_words = docs.select(F.explode(_words(F.col("text"))).alias("word"))
    if settled_bytes(names) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    counts = all_words.join(names, "word").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    kept = seeds.join(counts, "word", "left").filter(F.col("n") >= share * F.coalesce("times", F.lit(0)))
    return settle(kept.select("pattern", "word"), "screened")


def bootstrap(edges: DataFrame, rounds: int = 4, confidence: float = 0.7) -> DataFrame:
    """(value, kind): what confident patterns find, from ``edges`` (pattern,
    value, kind), where seeds have a kind.

    A pattern's confidence in a kind is the summed score of its values over
    their number plus one; a value scores the best confidence among its
    patterns; seeds keep 1. Both sides are rescored ``rounds`` times.
    """
    edges = settle(edges.distinct(), "edges")
    degree = settle(edges.groupBy("pattern").agg(F.countDistinct("value").alias("n")), "degree")
    fresh = settle(edges.filter("kind = ''").select("pattern", "value"), "fresh")
    seeds = settle(
        edges.filter("kind <> ''").groupBy("pattern", "kind").agg(F.countDistinct("value").cast("double").alias("w")), "seeds"
    )
    score = None
    for _ in range(rounds):
        gained = seeds
        if score is not None:
            gained = seeds.unionByName(fresh.join(score, "value").select("pattern", "kind", F.col("score").alias("w")))
        trust = settle(
            gained.groupBy("pattern", "kind").agg(F.sum("w").alias("w")).join(degree, "pattern")
            .select("pattern", "kind", (F.col("w") / (F.col("n") + 1)).alias("c")),
            "trust",
        )
        score = settle(fresh.join(trust, "pattern").groupBy("value", "kind").agg(F.max("c").alias("score")), "score")
    best = score.filter(F.col("score") >= confidence).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("value", F.col("b.kind").alias("kind"))


def personal_data(docs: DataFrame, rounds: int = 4, confidence: float = 0.7) -> DataFrame:
    """(doc_id, th, base, added): arrays of struct<k, kind, s, e, v> for each
    input row, with code point positions, end exclusive. Null text is empty.
    Rows alike in doc_id and text get the same result. ``added`` are the seeds
    of SECRET and what confident patterns find, as far as they overlap no base
    entity, one for each place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), text.alias("text"))
    read_ = rows.select(
        "doc_id", "th",
        F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(_none()).alias("base"),
        secret_seeds(F.col("text")).alias("secret"),
    )
    found = settle(read_, "found")
    screened = screen(found, rows)
    filled = settle(_fillers(rows, screened).distinct(), "filled")
    seen = found.select(F.explode(F.concat("base", "secret")).alias("x"))
    seeds = seen.select(F.explode(_patterns(F.col("x"))).alias("p"), F.lower("x.v").alias("value"), F.col("x.kind").alias("kind")).select(
        "p.pattern", "value", "kind").join(screened.select("pattern"), "pattern").distinct()
    known = seeds.select("value").distinct()
    free = filled.select("pattern", F.lower("x.v").alias("value")).distinct().join(known, "value", "left_anti").select(
        "pattern", "value", F.lit("").alias("kind"))
    accepted = settle(bootstrap(seeds.unionByName(free), rounds, confidence), "accepted")
    k = F.array_position(F.array(*[F.lit(x) for x in ALL_KINDS]), F.col("kind")).cast("int") - 1
    more = filled.select("doc_id", "th", "x", F.lower("x.v").alias("value")).distinct().join(accepted, "value").select(
        "doc_id", "th", k.alias("k"), "kind", "x.s", "x.e", "x.v")
    flat = lambda c: found.select("doc_id", "th", F.explode(c).alias("x")).select("doc_id", "th", *[f"x.{n}" for n in _FIELDS])
    extra = settle(flat("secret").union(more).distinct(), "extra")
    homes = extra.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    at_home = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    kept = _apart(flat("base").distinct().join(homes, at_home, "left_semi"), extra)
    hits = kept.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(
        F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("added"))
    out = found.join(hits, at_home, "left")
    slim = F.transform("base", lambda x: F.struct(*[x[n].alias(n) for n in _FIELDS]))
    none = F.array().cast("array<struct<k:int,kind:string,s:int,e:int,v:string>>")
    return out.select("doc_id", "th", slim.alias("base"), F.coalesce("added", none).alias("added"))


_FIELDS = ("k", "kind", "s", "e", "v")


def _apart(base: DataFrame, extra: DataFrame) -> DataFrame:
    """The rows of ``extra`` that overlap no base span and no extra one that
    starts before them, is longer from the same start, or is of an earlier kind."""
    rows = base.withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False)))
    order = Window.partitionBy("doc_id", "th").orderBy("s", F.desc("e"), F.desc("own"), "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    marked = rows.withColumn("reached", F.max("e").over(before)).withColumn("next", F.min(F.when(F.col("own"), F.col("s"))).over(after))
    return marked.filter("NOT own AND coalesce(reached, 0) <= s AND coalesce(next, e) >= e").drop("own", "reached", "next")


def _listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts,
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
