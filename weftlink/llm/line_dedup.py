"""Near-equal lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. A line goes if a line before it, in order of
(doc_id, line number), has Jaccard similarity of at least num / den to it; the earlier
line counts whether or not it goes itself. Lines without words stay.

1. Words become longs whose numeric order is rarity: a class, from how often the words of the
   hash bucket occur in the whole corpus, above the hash. Any order gives exact results;
   rarity makes groups small. The table of classes has a fixed size.
2. Equal sets are one line from then on, the first of them; the others go.
3. Prefix filter: lines of enough overlap share one of their first n - ceil(n num/den) + 1
   words. Groups of lines with one such word are looked at by three filters: length,
   position of the word, and a 128-bit parity map whose differing bits bound the overlap.
4. In groups that may be large, by the class of their word, a line first meets only the group's
   first line and the ``LAGS`` ones before it; its most likely partner is verified on the full sets. In a
   large group of copies that settles nearly all lines at a cost linear in the group. Lines still
   open then meet every earlier line of all their groups, dealt by length, and all that pass are verified.

Sets are compared by 56-bit word hashes. Defined results: null and empty texts have no
lines with words; repeated rows are lines on their own, ordered arbitrarily among equal
(doc_id, line number); rows equal in doc_id and text are judged alike; a null doc_id
comes first; a document whose lines all go keeps its row with an empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.llm.common import WORD_BREAK, cut, discard, release, stored, table

BUCKETS = 1 << 18
_HASH = (1 << 56) - 1
#: Parity maps that judge candidate pairs, beside the one that goes with the postings.
MAPS = 4
#: Class from which on a word's group may be large (over 256 lines) and gets a first look.
OFTEN = 16
#: Lines before it that a line meets at the first look.
LAGS = 1
#: Parts of the tokens that are worked on one after the other: so much less shuffled data is on disk at once.
PASSES = 3
_LOW = (1 << 32) - 1
#: In ``place``, below the size: the line is open, and the position.
_OPEN, _POS = 1 << 31, (1 << 31) - 1
NO_ID = -(1 << 63)
HAS_WORD = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
#: So many lines may be broadcast to pick out their texts; more are joined by a shuffle.
BROADCAST_LINES = 500_000


def _key(id_col: str, text_col: str) -> list:
    """doc and copy: the id and a hash that tells apart rows of one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text).cast("long").bitwiseAND(F.lit(_LOW)).alias("copy")]


def _has_word(line):
    """As ``rlike(HAS_WORD)``, without decoding the line."""
    return F.ltrim(line, F.lit(BLANKS)) != ""


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, line) of every line that has a word; ``at`` is its number above the 32 bits of ``copy``."""
    # The text is hashed below the split; in one projection it would be hashed again for each line.
    own = docs.select(*_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = own.select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return found.where(_has_word(F.col("line"))).select("doc", F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("copy")).alias("at"), "line")


def _words(text, breaks: str = "\t\x0b\f\r"):
    """Lower-cased words of a text, with empty ones where white space meets: split at blanks alone where there is no other white space."""
    other = reduce(lambda x, y: x | y, (F.contains(text, F.lit(c)) for c in breaks))
    return F.when(other, F.split(F.lower(text), WORD_BREAK)).otherwise(F.split(F.lower(text), " "))


def _hash(word):
    return F.xxhash64(word).bitwiseAND(F.lit(_HASH))


def _hashes(line):
    """56-bit hashes of the distinct words of a line that has some."""
    return F.array_except(F.transform(_words(line), _hash), F.array(_hash(F.lit(""))))


def frequency_classes(docs: DataFrame, text_col: str) -> str:
    """Class by hash bucket, as a JSON list: twice the binary logarithm of how often the bucket's words occur.

    The list has ``BUCKETS`` numbers, whatever the corpus; all its words are counted.
    """
    text = F.replace(F.col(text_col), F.lit("\n"), F.lit(" "))
    words = docs.select(text.alias("text")).select(F.explode(_words(F.col("text"))).alias("word")).where("word <> ''")
    found = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(1).cast("long").alias("n"))
    most = every.union(found).groupBy("bucket").agg(F.max("n").alias("n"))
    # A fixed number of longs, in order of the bucket above the class, becomes one text.
    marked = most.select(F.shiftleft("bucket", 7).bitwiseOR(F.least(F.lit(127), F.floor(F.log2("n") * 2))).alias("c"))
    listed = marked.agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.bitwiseAND(F.lit(127)).cast("string")), ",").alias("c"))
    return f"[{listed.first()['c']}]"


def _codes(hashes: str, classes: str):
    """A line's word hashes as longs in order of rarity: class above the hash."""
    lookup = F.from_json(F.lit(classes), "array<bigint>")
    return F.sort_array(F.transform(hashes, lambda c: c.bitwiseOR(F.shiftleft(F.coalesce(F.get(lookup, c.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0)), 56))))


def _sketch(codes: str, k: int) -> F.Column:
    """A 64-bit parity map of the words by six bits of their hashes."""
    return F.expr(f"aggregate({codes}, 0L, (m, c) -> m ^ shiftleft(1L, int(shiftrightunsigned(c, {6 * k}) & 63)))")


def _upper_map(codes: str) -> F.Column:
    """One half of a parity map of 128 bits: the words whose hash has the bit above the six that place them. The other half is ``_sketch(codes, 0)`` without it."""
    return F.expr(f"aggregate({codes}, 0L, (m, c) -> m ^ shiftleft(shiftrightunsigned(c, 6) & 1, int(c & 63)))")


def _apart(x: str, y: str, dot: str = "."):
    """Bits in which the parity maps of two postings differ."""
    return sum((F.bit_count(F.col(f"{x}{dot}{m}").bitwiseXOR(F.col(f"{y}{dot}{m}"))) for m in ("map", "map2")), F.lit(0))


def _may_match(x: str, y: str, num: int, den: int, dot: str = "."):
    """Length, position and parity filters on two postings."""
    (nx, px), (ny, py) = ((F.shiftright(F.col(f"{s}{dot}place"), 32), F.col(f"{s}{dot}place").bitwiseAND(F.lit(_POS))) for s in (x, y))
    total = nx + ny
    fits = den * F.least(nx, ny) >= num * F.greatest(nx, ny)
    # The pair's own overlap bound: its first shared word is early enough in both, and enough words can follow it.
    least = F.ceil(total * num / (num + den))
    by_place = (px <= nx - least) & (py <= ny - least) & (F.least(px, py) + F.least(nx - px, ny - py) >= least)
    return fits & by_place & ((total - _apart(x, y, dot)) * (num + den) >= 2 * num * total)


def _asked_lines(docs: DataFrame, asked: DataFrame, few: bool, id_col: str, text_col: str) -> DataFrame:
    """The lines (doc, at, line) that are ``asked`` for (doc, at); where these are few, other documents are not split."""
    if few:
        ids = F.broadcast(asked.select(F.col("doc").alias("_doc")).distinct())
        docs = docs.select(id_col, text_col).join(ids, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col("_doc"), "left_semi")
    return _lines(docs, id_col, text_col).join(F.broadcast(asked) if few else asked, ["doc", "at"], "left_semi")


def _sets(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set, map1, ...) of the lines in pairs (x, y), which are already computed: their words, and parity maps of these.

    It is written first: else the joins' not-null filters would move below the choice of
    lines and make sets for every line of the corpus.
    """
    asked = cut(pairs.select(F.col("x.doc").alias("doc"), F.col("x.at").alias("at")).union(pairs.select("y.doc", "y.at")).distinct())
    few = asked.count() <= BROADCAST_LINES
    found = _asked_lines(docs, asked, few, id_col, text_col).select(F.struct("doc", "at").alias("id"), _hashes(F.col("line")).alias("set"))
    return stored(found.select("id", "set", *(_sketch("set", k).alias(f"map{k}") for k in range(1, MAPS + 1))), "line-found")


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for s in "xy":
        pairs = pairs.join(sets.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns)), s)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The later lines (doc, at) of those pairs that reach the threshold on the full sets."""
    common = F.size(F.array_intersect("x_set", "y_set"))
    enough = common * den >= num * (F.size("x_set") + F.size("y_set") - common)
    return cut(_with_sets(pairs, sets, "set").where(enough).select("x.doc", "x.at").distinct())


def _close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, apart): the pairs that none of the further parity maps rules out, with the bits in which the maps differ."""
    maps = [f"map{k}" for k in range(1, MAPS + 1)]
    both = _with_sets(pairs, sets.withColumn("n", F.size("set")), "n", *maps)
    bits = [F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in maps]
    total = F.col("x_n") + F.col("y_n")
    fits = (total - F.greatest(*bits)) * (num + den) >= 2 * num * total
    return cut(both.where(fits).select("x", "y", sum(bits[1:], bits[0]).alias("apart")))


def _each(spark: SparkSession):
    """The passes; what one has shuffled is let go before the next."""
    for k in range(PASSES):
        yield k
        release(spark)


FIELDS = ("doc", "at", "place", "map", "map2")


def _postings(reps: DataFrame) -> DataFrame:
    """(token, doc, at, place, map, map2) of the lines' prefixes."""
    # Size, whether the line is open, and position share one long.
    size = F.shiftleft(F.col("n").cast("long"), 32)
    if "open" in reps.columns:
        size = size.bitwiseOR(F.when(F.col("open"), F.lit(_OPEN)).otherwise(F.lit(0)).cast("long"))
    found = reps.select(F.posexplode("prefix").alias("pos", "token"), "doc", "at", size.alias("size"), "map", "map2")
    return found.select("token", "doc", "at", F.col("size").bitwiseOR(F.col("pos").cast("long")).alias("place"), "map", "map2")


def _near(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, apart): of each line, the first of its groups and the ones before it there, where they pass the filters."""
    group = Window.partitionBy("token").orderBy("doc", "at")
    row, others = F.struct(*FIELDS), [f"before{k}" for k in range(1, LAGS + 1)]
    met = postings.select(row.alias("x"), F.first(row).over(group).alias("head"), *(F.lag(row, k).over(group).alias(f"before{k}") for k in range(1, LAGS + 1))).where("before1 is not null")
    seen = (F.when(F.col(y).isNotNull() & _may_match("x", y, num, den), F.struct(_apart("x", y).alias("apart"), F.struct(f"{y}.doc", f"{y}.at").alias("y"))) for y in ("head", *others))
    near = met.select("x", F.array_distinct(F.filter(F.array(*seen), lambda y: y.isNotNull())).alias("near")).where("size(near) > 0")
    return near.select(F.struct("x.doc", "x.at").alias("x"), F.explode("near").alias("near")).select("x", "near.y", "near.apart")


def _in_groups(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (x, y) of open lines with earlier lines of their groups that pass the filters.

    A group is dealt by classes of length: the shorter of two lines goes to all classes that a longer one may be
    in, mostly its own alone, and only with its tokens that come early enough.
    """
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(_POS))
    size = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    # The word's hash and the class of length make one long, so that rows are sorted by radix.
    side = lambda df, s, size: df.select(F.shiftleft(F.col("token").bitwiseAND(F.lit(_HASH)), 6).bitwiseOR(size.cast("long")).alias("key"), *(F.col(c).alias(f"{s}_{c}") for c in FIELDS))
    early = postings.where(pos <= n - F.ceil(2 * n * num / (num + den)))
    low = side(early.select("token", *FIELDS, F.explode(F.sequence(size(n), size(F.floor(n * den / num)))).alias("len")), "s", F.col("len"))
    both = low.join(side(postings, "l", size(n)), "key")
    short, long, order = F.shiftright("s_place", 32), F.shiftright("l_place", 32), (F.col("s_doc") < F.col("l_doc")) | ((F.col("s_doc") == F.col("l_doc")) & (F.col("s_at") < F.col("l_at")))
    later = F.when(order, F.col("l_place")).otherwise(F.col("s_place"))
    wanted = ((short < long) | ((short == long) & order)) & (later.bitwiseAND(F.lit(_OPEN)) != 0)
    ident = lambda s: F.struct(F.col(f"{s}_doc").alias("doc"), F.col(f"{s}_at").alias("at"))
    pairs = both.where(wanted & _may_match("s", "l", num, den, "_"))
    return pairs.select(F.when(order, ident("l")).otherwise(ident("s")).alias("x"), F.when(order, ident("s")).otherwise(ident("l")).alias("y")).distinct()


def staying_lines(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, lines): the numbers, from 0, of the lines with words that stay in each document that has some."""
    spark = docs.sparkSession
    lines = _lines(docs, id_col, text_col)
    classes = frequency_classes(docs, text_col)
    # What the next step names twice stays a step of its own, and is made once.
    hashed = lines.select("doc", "at", _hashes(F.col("line")).alias("hashes"))
    codes = hashed.select("doc", "at", F.size("hashes").alias("n"), _codes("hashes", classes).alias("codes"), _sketch("hashes", 0).alias("every"), _upper_map("hashes").alias("map2"))
    n = F.col("n")
    prefix = F.slice("codes", 1, (n - F.ceil(n * num / den) + 1).cast("int"))
    # Two hashes of different inputs: equal sets are told by 128 bits.
    own = F.struct("doc", "at", "n", F.col("every").bitwiseXOR(F.col("map2")).alias("map"), "map2", prefix.alias("prefix"))
    marked = codes.select(F.xxhash64("codes").alias("d1"), F.xxhash64(F.lit(1), "codes").alias("d2"), own.alias("line"))
    # The first line of each set stands for it.
    reps = stored(marked.groupBy("d1", "d2").agg(F.min("line").alias("line")).select("line.*"), "line-sets")
    release(spark)
    part = lambda k: F.pmod(F.col("token"), F.lit(PASSES)) == k
    often = F.shiftright("token", 56) >= OFTEN
    near = reduce(DataFrame.union, [cut(_near(_postings(reps).where(often & part(k)), num, den)) for k in _each(spark)])
    likely = cut(near.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("best")).select("x", "best.y"))
    sets = _sets(likely, docs, id_col, text_col)
    gone = _verified(likely, sets, num, den)
    discard(sets)
    few = gone.count() <= BROADCAST_LINES
    done = F.broadcast(gone) if few else gone
    marked = reps.join(done.withColumn("gone", F.lit(True)), ["doc", "at"], "left").withColumn("open", F.col("gone").isNull())
    found = [cut(_in_groups(_postings(marked).where(part(k)), num, den)) for k in _each(spark)]
    pairs = cut(reduce(DataFrame.union, found).join(likely, ["x", "y"], "left_anti").distinct())
    sets = _sets(pairs, docs, id_col, text_col)
    pairs = _close(pairs, sets, num, den)
    release(spark)
    # The closest partner of a line settles it mostly; its other pairs are verified only if it does not.
    closest = cut(pairs.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("best")).select("x", "best.y"))
    for tried in (True, False):
        now = closest if tried else cut(pairs.select("x", "y", "x.doc", "x.at").join(gone, ["doc", "at"], "left_anti").select("x", "y").join(closest, ["x", "y"], "left_anti"))
        if not now.isEmpty():
            gone = cut(gone.union(_verified(now, sets, num, den)))
    discard(sets)
    release(spark)
    stay = reps.select("doc", "at").join(gone, ["doc", "at"], "left_anti")
    stay = stay.groupBy("doc", F.col("at").bitwiseAND(F.lit(_LOW)).alias("copy")).agg(F.sort_array(F.collect_list(F.shiftright("at", 32).cast("int"))).alias("lines"))
    stay = stored(stay, "line-stay")
    discard(reps)
    return stay


def _with_stay(docs: DataFrame, stay: DataFrame, columns: list, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(*columns, *_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return own.join(stay.withColumnRenamed("lines", "_lines"), ["doc", "copy"], "left").withColumn("_lines", F.coalesce("_lines", F.lit([]).cast("array<int>")))


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that go cut out of the text; null texts become empty."""
    stay = staying_lines(docs, num, den, id_col, text_col)
    found = _with_stay(docs, stay, [F.struct(*docs.columns).alias("_row")], id_col, text_col)
    kept = F.filter(F.split("_text", "\n"), lambda line, i: ~_has_word(line) | F.array_contains("_lines", i))
    return found.select(*(F.array_join(kept, "\n").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those with words, and how many and which (numbers from 0) of those go."""
    docs = table(spark, sf_dir, "documents")
    stay = staying_lines(docs)
    numbers = F.filter(F.transform("parts", lambda line, i: F.when(_has_word(line), i)), lambda i: i.isNotNull())
    split = docs.select("doc_id", *_key("doc_id", "text"), F.split(F.coalesce("text", F.lit("")), "\n").alias("parts"))
    own = split.select("doc_id", "doc", "copy", F.size("parts").alias("n_lines"), numbers.alias("filled"))
    found = own.join(stay, ["doc", "copy"], "left")
    gone = F.array_except("filled", F.coalesce("lines", F.lit([]).cast("array<int>")))
    return found.select("doc_id", "n_lines", F.size("filled").alias("n_filled"), F.size(gone).alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


OP2_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no from documents
), sets as (
  select row_number() over (order by doc_id, line_no) as id, doc_id, line_no, w, len(w) as n
  from (select *, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) as w from lines) where len(w) > 0
), tok as (select id, n, unnest(w) as t from sets), df as (select t, count(*) as f from tok group by t
), pre as (
  select id, n, t, pos from (select tok.*, row_number() over (partition by id order by f, t) as pos from tok join df using (t))
  where pos <= n - ceil(n * 80 / 100) + 1
), cand as (
  select distinct y.id as later, x.id as earlier from pre x join pre y on x.t = y.t and x.id < y.id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), gone as (
  select distinct later from cand join sets a on a.id = earlier join sets b on b.id = later
  where 100 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n - len(list_intersect(a.w, b.w)))
)
select d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::int as n_lines, count(s.id)::int as n_filled,
  count(g.later)::int as n_removed, coalesce(string_agg(case when g.later is not null then s.line_no end, ',' order by s.line_no), '') as removed
from documents d left join sets s on s.doc_id = d.doc_id left join gone g on g.later = s.id group by d.doc_id, d.text
"""
