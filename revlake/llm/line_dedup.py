"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as sequences of words (runs between blanks). Lines of at least `min_words` words are near when one word
inserted, deleted or replaced turns one into the other; shorter lines only when equal. For every line all variants
with one word deleted are emitted as hashed keys, variants that are equal are joined, the edit distance of the joined lines is
verified on their words, and of near lines the earliest (doc_id, line number) stays.

A variant's key is the XOR of hashes of (word, position), so all n variants of a line cost O(n): running XORs give every
prefix and suffix. Replacing word i leaves equal variants at the same i; an insertion leaves a variant equal to the whole
shorter line. Groups of equal variants are reduced to their earliest line, never to pairs.

Scale: equal lines are first folded to their earliest occurrence (two 64-bit hashes, map-side combining, no text shuffled), so a
line that every document repeats costs one row per task. Variants are only emitted for lines that can have a partner: one
edit leaves at least half of the words as a common prefix or suffix, so a line none of whose two anchors (hashes of the
first and last h words, h the power of two at or below half its length) occurs in another line has none. Texts are shuffled by
document, once to fetch those lines and once to rebuild the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _half(n: Column) -> Column:
    """Greatest power of two at or below (n - 1) / 2, for n >= 3."""
    return F.pow(F.lit(2), F.floor(F.log2((n - 1) / 2))).cast("int")


def _prefix(h: Column) -> Column:
    return F.xxhash64(F.lit("prefix"), h, F.call_function("substring_index", F.col("line"), F.lit(" "), h))


def _suffix(h: Column) -> Column:
    return F.xxhash64(F.lit("suffix"), h, F.call_function("substring_index", F.col("line"), F.lit(" "), -h))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, th (hash of the text, so that repeated ids with other texts stay apart) and text."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _order(prefix: str = "") -> Column:
    """Sort key of a line's place: doc_id (null last), text hash, line number."""
    return F.struct(F.col(f"{prefix}doc").isNull().alias("none"), F.col(f"{prefix}doc").alias("doc"), F.col(f"{prefix}th").alias("th"), F.col(f"{prefix}pos").alias("pos"))


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """One row per distinct nonblank line: its hashes, place of first occurrence, words, and its anchors."""
    lines = _keyed(docs, id_col, text_col).select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where("trim(line) != ''")
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", n.cast("int"))
    near = F.col("n") >= min_words
    h, g = _half(F.col("n")), _half(F.col("n") - 1)
    anchors = {
        "p1": F.when(near, _prefix(h)),
        "s1": F.when(near, _suffix(h)),
        # the partner may be one word shorter and so have shorter anchors
        "p2": F.when(near & (F.col("n") > min_words) & (g != h), _prefix(g)),
        "s2": F.when(near & (F.col("n") > min_words) & (g != h), _suffix(g)),
    }
    return (
        lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), _order().alias("place"), "n", *(c.alias(k) for k, c in anchors.items()))
        .groupBy("h1", "h2")
        .agg(F.min("place").alias("place"), *(F.max(c).alias(c) for c in ("n", "p1", "s1", "p2", "s2")))
    )


def _candidates(distinct: DataFrame) -> DataFrame:
    """Lines that share an anchor with a line of as many words, of one fewer or of one more, and where their edit can be.

    After a shared prefix of w words the edit is at word w or later, before a shared suffix earlier than word n - w; per kind
    of partner `after` and `before` bound the words whose deletion can make equal variants.
    """
    h, g = _half(F.col("n")), _half(F.col("n") - 1)
    kinds = F.array(*(F.struct(F.col(c).alias("key"), F.lit(c[0]).alias("side"), (h if c[1] == "1" else g).alias("words")) for c in ("p1", "s1", "p2", "s2")))
    rows = distinct.where("p1 is not null").select("h1", "h2", "n", F.explode(kinds).alias("a")).where("a.key is not null").select("h1", "h2", "n", "a.key", "a.side", "a.words")
    sizes = rows.groupBy("key", "n").agg(F.count("*").alias("lines"))
    partner = lambda n, kind: F.struct(n.cast("int").alias("n"), F.lit(kind).alias("kind"))
    partners = sizes.select("key", F.explode(F.array_compact(F.array(F.when(F.col("lines") > 1, partner(F.col("n"), "same")), partner(F.col("n") + 1, "shorter"), partner(F.col("n") - 1, "longer")))).alias("p")).select("key", "p.n", "p.kind").groupBy("key", "n").agg(F.collect_set("kind").alias("kinds"))
    after = lambda kind: F.coalesce(F.min(F.when((F.col("side") == "p") & F.array_contains("kinds", kind), F.col("words"))), F.first("n")).alias(f"after_{kind}")
    before = lambda kind: F.coalesce(F.max(F.when((F.col("side") == "s") & F.array_contains("kinds", kind), F.col("n") - F.col("words"))), F.lit(0)).alias(f"before_{kind}")
    found = rows.join(partners, ["key", "n"]).groupBy("h1", "h2").agg(after("same"), before("same"), after("shorter"), before("shorter"), F.max(F.array_contains("kinds", "longer")).alias("longer"))
    return found.join(distinct.select("h1", "h2", "place", "n"), ["h1", "h2"])


BOUNDS = ["after_same", "before_same", "after_shorter", "before_shorter", "longer"]


def _with_text(candidates: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    wanted = candidates.groupBy(F.col("place.doc").alias("doc"), F.col("place.th").alias("th")).agg(F.collect_list(F.struct("h1", "h2", "place", "n", *BOUNDS)).alias("wanted"))
    texts = _keyed(docs, id_col, text_col).where("text is not null").withColumnsRenamed({"doc": "d", "th": "t"})
    found = wanted.join(texts, wanted["doc"].eqNullSafe(texts["d"]) & (wanted["th"] == texts["t"]))
    found = found.select("wanted", F.split("text", "\n", -1).alias("lines")).select(F.explode("wanted").alias("w"), "lines")
    return found.select("w.*", F.get("lines", F.col("w.place.pos")).alias("line")).dropDuplicates(["h1", "h2"])


def _variants(lines: DataFrame) -> DataFrame:
    """(h1, h2, key, short) of each line: with one word deleted, as a line of n words and as one of n - 1, and whole."""
    words = lines.repartition(F.col("h1"), F.col("h2")).select("h1", "h2", "n", *BOUNDS, F.posexplode(F.split("line", " ", -1)).alias("i", "w"))
    by = "partition by h1, h2"
    words = words.selectExpr("h1", "h2", "n", *BOUNDS, "i", "xxhash64(w, i) g", "xxhash64(w, i - 1) s")
    words = words.selectExpr(
        "h1", "h2", "n", *BOUNDS, "i", "g",
        f"bit_xor(g) over ({by}) whole",
        f"bit_xor(g) over ({by} order by i rows between unbounded preceding and current row) ^ g left",
        f"bit_xor(s) over ({by}) ^ bit_xor(s) over ({by} order by i rows between unbounded preceding and current row) right",
    )
    keys = F.expr("""array_compact(array(
        if(i >= after_same or i < before_same, struct(xxhash64('replace', n, i, whole ^ g) as key, false as short), null),
        if(i >= after_shorter or i < before_shorter, struct(xxhash64('insert', n - 1, left ^ right) as key, false as short), null),
        if(i = 0 and longer, struct(xxhash64('insert', n, whole) as key, true as short), null)))""")
    return words.select("h1", "h2", F.explode(keys).alias("k")).select("h1", "h2", "k.key", "k.short")


def near_duplicates(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of distinct lines that have an earlier line within one word edit."""
    lines = materialize(_with_text(_candidates(distinct), docs, id_col, text_col), release=True)
    variants = materialize(_variants(lines), release=True)
    # Keys of more than one line; the insert keys among them must have a whole line, which is at most one.
    shared = variants.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    rows = variants.join(shared, "key").join(lines.select("h1", "h2", "place"), ["h1", "h2"])
    line = F.struct("place", "h1", "h2")
    groups = rows.groupBy("key").agg(F.min(F.when(F.col("short"), line)).alias("whole"), F.min(F.when(~F.col("short"), line)).alias("cut"))
    # Lines of one replace key are all near each other; of an insert key each is near the whole line. The rest fails the check.
    first = F.when(F.col("short") | F.col("whole").isNull(), F.col("cut")).otherwise(F.col("whole"))
    pairs = rows.join(groups, "key").select("h1", "h2", "place", first.alias("first")).where("first.place < place").select("h1", "h2", F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2")).distinct()
    texts = lines.select("h1", "h2", F.split("line", " ", -1).alias("a"))
    firsts = lines.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.split("line", " ", -1).alias("b"))
    return pairs.join(texts, ["h1", "h2"]).join(firsts, ["f1", "f2"]).where(within_one_edit(F.col("a"), F.col("b"))).select("h1", "h2").distinct()


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal or one word inserted, deleted or replaced apart."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    differs = F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x != y)
    at = F.array_position(differs, True).cast("int")  # 1-based, 0 if there is no difference
    rest = lambda x, start: F.slice(x, start, F.size(x))
    same = F.size(short) == F.size(long)
    return F.when(at == 0, F.size(long) - F.size(short) <= 1).when(same, rest(short, at + 1) == rest(long, at + 1)).otherwise((F.size(long) - F.size(short) == 1) & (rest(short, at) == rest(long, at + 1)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """row (struct of all columns of docs, whatever their names), n_lines, dropped (line numbers from 0) and deduped_text.

    Every nonblank line that has an equal or near earlier line anywhere is dropped; blank lines stay. Earlier means a smaller
    doc_id (null last), then text hash, then line number. A null text stays null with no lines. Rows with the same id and text
    get the same result; equal ids with other texts are other documents. Empty tables give an empty result.
    """
    distinct = materialize(distinct_lines(docs, id_col, text_col, min_words), release=True)
    near = materialize(near_duplicates(distinct, docs, id_col, text_col), release=True)
    kept = distinct.join(near, ["h1", "h2"], "left_anti")
    places = kept.groupBy(F.col("place.doc").alias("doc"), F.col("place.th").alias("th")).agg(F.collect_list("place.pos").alias("kept"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("hash"))  # the text is shuffled once, within row
    joined = rows.join(places, rows["row"][id_col].eqNullSafe(places["doc"]) & (rows["hash"] == places["th"]), "left").withColumn("text", F.col("row")[text_col])
    # A column of its own, used several times, so that the optimizer keeps it apart and a lambda does not split again.
    joined, lines = joined.withColumn("lines", F.split("text", "\n", -1)), F.col("lines")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), (F.trim(x) != "").alias("full")))
    full = F.transform(F.filter(numbered, lambda s: s["full"]), lambda s: s["i"])
    dropped = F.when(lines.isNotNull(), F.array_sort(F.array_except(full, F.coalesce("kept", F.array().cast("array<int>")))))
    marked = joined.withColumn("dropped", dropped).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)))
    rest = F.when(F.size("dropped") == 0, F.col("text")).when(F.size("dropped") == F.col("n_lines"), F.lit("")).otherwise(_without(lines, F.col("dropped")))
    return marked.select("row", "n_lines", "dropped", F.when(F.col("text").isNotNull(), rest).alias("deduped_text"))


def _without(lines: Column, dropped: Column) -> Column:
    """Lines whose numbers are not in dropped, joined again; array_except over (number) keeps it linear."""
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
