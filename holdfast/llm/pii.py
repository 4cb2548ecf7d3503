"""Personal data: fixed patterns, and identifiers that their contexts give away. DataFrame functions only.

1. Four patterns find e-mail addresses, IP addresses, card and phone numbers (the base).
2. Texts are read as pieces: runs without white space, cut after = and : (`password=` is a piece of its own). A piece
   that has three digits or an at sign is an instance. Its lexical patterns are: the two pieces before it; the pieces
   before and after it; the piece before it with its own shape; its spelling (first four characters and length).
3. Patterns and instances form a graph over all documents. Instances that base spans cover are seeds, with
   score 1; so are long keys of mixed letters and digits behind the name of a credential (`password=`, `api key:`,
   `bearer`), with the kind `secret`. How a key looks alone makes it no seed. A pattern's confidence is the sum
   of its instances' scores, each as often as it occurs, over the number of times that the pattern occurs: for patterns of
   words alone anywhere in the corpus, whatever piece stands there; for those with a shape or spelling among
   instances. So whatever else stands in a pattern's place counts against it. It needs seeds with at least LEAST_SEEDS
   different texts, and an instance never supports itself: its own occurrences are taken out, on both sides, before a pattern
   speaks for it. Copies count on both sides, and both sides grow alike,
   so a corpus that is ten times as large gives the same confidence. Only patterns with a high confidence count. An
   instance that is no seed scores as its best pattern. A few rounds spread scores from seeds to patterns, to new
   instances and on to further patterns.
4. Instances with a high score are found wherever they occur, with the kind of the pattern's seeds, and so are
   the declared keys. Other long keys (hashes, file names, order numbers) are reported only where patterns say so.

How often words occur in the corpus is counted exactly, by the 64-bit hash of the pattern, for patterns of at least three
different instances that can still reach a high confidence: a pattern that some of the texts already show too often for
that is given up, so common words are counted over a few of the texts only. Before the shuffle hashes pass through a
bitmap of 2^20 bits (what the driver gets and sends at most), after it they are joined in full. Positions are code points, end exclusive. Null texts count
as empty, without spans. Rows are told apart by doc_id and a hash of the text, so rows that share an id, or have none,
keep their own spans; rows repeated in full get the same. An empty table gives an empty result. Other columns are
not read; `redact` keeps them (columns named hf_* are its own). The regular expressions are possessive and begin only
at a run's start (or where the last match ended): that changes no match but keeps them linear, and free of recursion, on
very long runs. Each is tried only on texts that have the characters it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_key

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to give a match that counts.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "other": r"[0-9@]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PIECE = r"[^\s=:]*+[=:]|[^\s=:]++"
#: A piece with three digits or an at sign; as a whole piece, and within a text.
IDENTIFIER = r"^(?:[^@]*+@|(?:[^0-9]*+[0-9]){3})"
CANDIDATE = r"(?<![^\s=:])(?=[^\s=:@]*+@|(?:[^\s=:0-9]*+[0-9]){3})[^\s=:]++[=:]?"
HEAD, TAIL = r"^[^A-Za-z0-9+@]++", r"[^A-Za-z0-9+@]++$"
#: The seeds of the kind secret: keys of 20 characters or more with three digits and three letters at least, and what the
#: two pieces before them must say.
DECLARED = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|(?:api|access|auth|private|secret|session|signing|encryption)[ _-]?keys?)[\"'\])]*\s?[=:]$|\bbearer$"
KEY = r"^(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^A-Za-z]*+[A-Za-z]){3})[A-Za-z0-9_+/-]{20,}$"

ROUNDS, ACCEPT, LEAST_SEEDS = 3, 0.6, 5
SHARES = (1, 16, 256)  # of 256 parts of the texts: those that patterns are counted over, in turn
BITS = 14  # the bitmap has 2^BITS words of 64 bits


def _luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def matches_of(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind,no,gap,match,at>> of a pattern's matches: gap counts the characters since the last match,
    from a split by the same pattern. Texts that can't have a match aren't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.char_length(F.get(gaps, i)).alias("gap"), m.alias("match")))
    return F.when(text.rlike(NEEDED[kind]), rows).otherwise(F.array().cast("array<struct<kind:string,no:int,gap:int,match:string>>"))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))


def before_after(left: Column, own: Column, right: Column) -> tuple[Column, Column]:
    """Hashes of the two patterns of words alone of the piece that stands third (two before) or second (around)."""
    return F.xxhash64(F.lit("before"), left, own), F.xxhash64(F.lit("around"), left, right)


def contexts_of(words: Column) -> Column:
    """array<struct<left,before,around,declared>> of the pieces that are instances: the piece before, both patterns
    (null where a neighbour is missing), and whether the pieces before name a credential."""

    def one(w: Column, i: Column) -> Column:
        at = lambda k: F.when(i + k >= 0, F.get(words, i + k))
        before, around = before_after(at(-2), at(-1), at(-1))[0], before_after(at(-1), at(-1), at(1))[1]
        return F.when(
            w.rlike(IDENTIFIER),
            F.struct(at(-1).alias("left"), F.when(i >= 2, before).alias("before"), F.when((i >= 1) & at(1).isNotNull(), around).alias("around"), F.concat_ws(" ", at(-2), at(-1)).rlike(DECLARED).alias("declared")),
        )

    return F.array_compact(F.transform(words, one))


def find_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rk, found, contexts), one row for each row of docs: raw matches of the base and of instances, and
    the instances' contexts in the same order."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.concat(*[matches_of(body, k, p) for k, p in (PATTERNS | {"other": CANDIDATE}).items()])
    words = F.when(body.rlike(NEEDED["other"]), pieces(body)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), found.alias("found"), words.alias("hf_words"))
    return rows.select("doc_id", "rk", "found", contexts_of(F.col("hf_words")).alias("contexts"))


def place(found: DataFrame) -> DataFrame:
    """(doc_id, rk, copies, kind, start, end, match, context) of all matches; repeated rows once, with their number."""
    rows = found.where(F.size("found") > 0).groupBy("doc_id", "rk").agg(F.first("found").alias("found"), F.first("contexts").alias("contexts"), F.count("*").alias("copies"))
    rows = rows.select("doc_id", "rk", "copies", "contexts", F.explode("found").alias("m")).select("doc_id", "rk", "copies", "m.*", F.when(F.col("m.kind") == "other", F.get("contexts", F.col("m.no"))).alias("context"))
    end = F.sum(F.col("gap") + F.char_length("match")).over(Window.partitionBy("doc_id", "rk", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "rk", "copies", "kind", (end - F.char_length("match")).alias("start"), end.alias("end"), "match", "context")


def base_spans(placed: DataFrame) -> DataFrame:
    """(doc_id, rk, kind, start, end) of the four kinds' matches that count."""
    ok = reduce(lambda rest, k: F.when(F.col("kind") == k, valid(k, F.col("match"))).otherwise(rest), KINDS, F.lit(False))
    return placed.where(F.col("kind") != "other").where(ok).select("doc_id", "rk", "kind", "start", "end")


def shape(core: Column) -> Column:
    """Digits as 9, runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), r"\p{L}++", "a")


def instances(placed: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, rk, copies, start, end, instance, patterns, seed) of instances without the marks at their
    ends: hashes of the token and of its patterns; seed is the kind of a base span it touches, or secret."""
    bare = F.regexp_replace("match", HEAD, "")
    core = F.regexp_replace(bare, TAIL, "")
    start = F.col("start") + F.char_length("match") - F.char_length(bare)
    shaped = F.when(F.col("context.left").isNotNull(), F.xxhash64(F.lit("shape"), F.col("context.left"), shape(core)))
    spelt = F.when(F.substring(core, 1, 4).rlike("[A-Za-z]"), F.xxhash64(F.lit("spelling"), F.substring(core, 1, 4), F.char_length(core)))
    tokens = placed.where(F.col("kind") == "other").select(
        "doc_id", "rk", "copies", start.alias("start"), (start + F.char_length(core)).alias("end"), F.xxhash64(F.lower(core)).alias("instance"),
        F.array_distinct(F.array_compact(F.array("context.before", "context.around", shaped, spelt))).alias("patterns"),
        F.when(F.col("context.declared") & core.rlike(KEY), F.lit(SECRET)).alias("key"), F.lit(None).cast("string").alias("kind"),
    ).where(F.col("end") > F.col("start"))
    both = tokens.unionByName(base, allowMissingColumns=True)
    own = Window.partitionBy("doc_id", "rk").orderBy("start", F.col("kind").isNull(), "end")
    base_end = F.when(F.col("kind").isNotNull(), F.struct("end", "kind"))
    base_start = F.when(F.col("kind").isNotNull(), F.struct("start", "kind"))
    last = F.max(base_end).over(own.rowsBetween(Window.unboundedPreceding, 0))
    following = Window.partitionBy("doc_id", "rk").orderBy(F.col("start").desc(), F.col("kind").isNotNull(), F.col("end").desc())
    nxt = F.min(base_start).over(following.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"hf_last": last, "hf_next": nxt}).where(F.col("kind").isNull())
    seed = F.when(F.col("hf_last.end") > F.col("start"), F.col("hf_last.kind")).when(F.col("hf_next.start") < F.col("end"), F.col("hf_next.kind")).otherwise(F.col("key"))
    return both.select("doc_id", "rk", "copies", "start", "end", "instance", "patterns", seed.alias("seed"))


def bitmap(patterns: DataFrame) -> Column:
    """The hashes' lowest bits as an array of 2^BITS words: a literal of fixed size, however many patterns there are."""
    word = F.shiftright("pattern", 6).bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pattern").bitwiseAND(F.lit(63)).cast("int"))
    found = {r[0]: r[1] for r in patterns.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect()}  # 2^BITS rows at most
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(1 << BITS))), ",").cast("array<bigint>")


def context_counts(docs: DataFrame, patterns: DataFrame, text: str = "text", share: int = SHARES[-1]) -> DataFrame:
    """(pattern, total): how often each pattern of words alone occurs around a piece of any kind, in `share` of 256 parts
    of the texts. A task sums its own before they are shuffled."""
    bits = bitmap(patterns)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs if share == SHARES[-1] else docs.where(F.pmod(F.xxhash64(body), F.lit(SHARES[-1])) < share)
    words = docs.select(pieces(body).alias("w"))
    one = lambda w, i: F.array(*before_after(w, F.get("w", i + 1), F.get("w", i + 2)))
    every = F.flatten(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), one))
    wanted = F.filter(every, lambda h: F.call_function("shiftright", F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return words.select(F.explode(wanted).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("total"))


def corpus_totals(docs: DataFrame, sums: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, total) of the patterns that occur at most n / ACCEPT times in the corpus. sums: pattern, n (how often
    instances stand there). A pattern over that in some of the texts is over it in all of them."""
    for share in SHARES:
        found = sums.join(context_counts(docs, sums, text, share), "pattern", "left")
        kept = materialise(found.select("pattern", "n", F.greatest("n", F.coalesce("total", F.lit(0))).alias("total")).where(F.col("n") >= ACCEPT * F.col("total")))
        sums = kept.select("pattern", "n")
    return kept.select("pattern", "total")


def bootstrap(tokens: DataFrame, docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of instances that patterns with a confidence of ACCEPT or more give away and that are no
    seeds, and of declared keys."""
    each = tokens.select("instance", "copies", "seed", F.explode("patterns").alias("pattern"))
    pairs = materialise(each.groupBy("pattern", "instance").agg(F.sum("copies").alias("n"), F.max("seed").alias("seed")))
    sums = materialise(pairs.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where(F.col("kinds") >= LEAST_SEEDS))
    edges = materialise(pairs.drop("seed").join(corpus_totals(docs, sums, text), "pattern"))
    seeds = tokens.where(F.col("seed").isNotNull()).groupBy("instance").agg(F.max(F.struct(F.col("seed") != SECRET, "seed")).alias("s"))
    seeds = materialise(seeds.select("instance", F.col("s.seed").alias("kind"), F.lit(1.0).alias("score")))
    scores = seeds
    for _ in range(rounds):
        scored = edges.join(scores, "instance")
        mass = scored.groupBy("pattern", "kind", "total").agg(F.sum(F.col("score") * F.col("n")).alias("mass"), F.count("*").alias("support"))
        best = mass.groupBy("pattern", "total").agg(F.max(F.struct("mass", "kind")).alias("best"), F.sum("support").alias("support"))
        sure = best.where(F.col("support") >= LEAST_SEEDS).select("pattern", "support", F.col("best.kind").alias("kind"), F.col("best.mass").alias("mass"))
        own = edges.join(sure, "pattern").join(scores.select("instance", F.col("kind").alias("own_kind"), F.col("score").alias("own")), "instance", "left")
        mine = F.col("own").isNotNull()
        rest = F.col("mass") - F.when(mine & (F.col("own_kind") == F.col("kind")), F.col("own") * F.col("n")).otherwise(0.0)
        others = F.col("total") - F.when(mine, F.col("n")).otherwise(0)
        sure = own.where(F.col("support") - mine.cast("int") >= LEAST_SEEDS).where(others > 0).select("instance", "kind", (rest / others).alias("conf")).where(F.col("conf") >= ACCEPT)
        found = materialise(sure.groupBy("instance").agg(F.max(F.struct("conf", "kind")).alias("best")).select("instance", F.col("best.kind").alias("kind"), F.col("best.conf").alias("score")).join(seeds, "instance", "left_anti"))
        scores = seeds.unionByName(found)
    return found.unionByName(seeds.where(F.col("kind") == SECRET))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rk, base, spans), one row for each row of docs; base and spans are arrays of (rank, kind, start,
    end), sorted; rank is the kind's place in KINDS, with secret last."""
    found = materialise(find_matches(docs, doc_id, text))
    placed = materialise(place(found))
    base = base_spans(placed)
    tokens = materialise(instances(placed, base))
    accepted = bootstrap(tokens, docs, text)
    more = tokens.where(F.col("seed").isNull() | (F.col("seed") == SECRET)).join(accepted, "instance").select("doc_id", "rk", "kind", "start", "end", F.lit(False).alias("is_base"))
    both = base.withColumn("is_base", F.lit(True)).unionByName(more)
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind")).cast("int")
    span = F.struct(rank.alias("rank"), "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spans = both.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    spans = spans.withColumnRenamed("doc_id", "hf_id").withColumnRenamed("rk", "hf_rk")
    some, none = found.where(F.size("found") > 0).select("doc_id", "rk"), found.where(F.size("found") == 0).select("doc_id", "rk")
    some = some.join(spans, (F.col("rk") == F.col("hf_rk")) & F.col("doc_id").eqNullSafe(F.col("hf_id")), "left")
    empty = F.array().cast("array<struct<rank:int,kind:string,start:bigint,end:bigint>>")
    some = some.select("doc_id", "rk", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))
    return some.unionByName(none.select("doc_id", "rk", empty.alias("base"), empty.alias("spans")))


def is_kind(kind: str):
    return lambda span: span["kind"] == kind


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in square brackets; spans that overlap are replaced together,
    with the first one's kind. Rows without spans are left as they are. n_chars, if there, follows the text."""
    spans = find_pii(docs, doc_id, text).where(F.size("spans") > 0).dropDuplicates(["doc_id", "rk"])
    spans = spans.select("doc_id", "rk", F.explode("spans").alias("s")).select("doc_id", "rk", "s.*")
    own = Window.partitionBy("doc_id", "rk").orderBy("start", F.col("end").desc(), "rank")
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("upto", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    spans = spans.withColumn("part", F.sum((F.col("start") >= F.col("upto")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "rk", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", (-F.col("end")).alias("e"), "rank", "kind")).alias("first"), F.min("upto").alias("upto"))
    one = F.struct("part", "start", "end", F.col("upto").cast("int").alias("upto"), F.col("first.kind").alias("kind"))
    cuts = spans.groupBy(F.col("doc_id").alias("hf_id"), F.col("rk").alias("hf_rk")).agg(F.array_sort(F.collect_list(one)).alias("hf_cuts"))
    body = F.col(text)
    pieces = F.transform("hf_cuts", lambda s: F.concat(F.substring(body, s["upto"] + 1, (s["start"] - s["upto"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(body, F.element_at("hf_cuts", -1)["end"].cast("int") + 1, F.char_length(body))
    new = F.when(F.col("hf_cuts").isNotNull(), F.concat(F.concat_ws("", pieces), rest)).otherwise(body)
    key = row_key(F.col(doc_id), F.col(text))
    out = docs.join(cuts, (key == F.col("hf_rk")) & F.col(doc_id).eqNullSafe(F.col("hf_id")), "left").withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("hf_cuts").isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
