"""Benchmark decontamination by a distributed positional inverted index.

Test items are cut into windows of consecutive words.  Document frequencies of the items' words
over the whole corpus order each window's words from the rarest.  The index stores the
positional postings (term, document, position, words around) of the two rarest words of every
window; a phrase match starts from the rarest word's list, is intersected with the second
rarest word's list after both are adjusted by their offsets in the item, and what is left is
compared word by word.  A proximity match needs all words of a window within ``WINDOW - 1``
words of its rarest word, in any order.

All of it is DataFrame operations.  Rows are positions with at most ``WINDOW - 1`` words on
either side, never a whole text, so long items and documents cost what their words cost.  The
items' vocabulary and anchors are broadcast only if their counted size is within
``BROADCAST_BYTES``; otherwise the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.plans.staging import BROADCAST_BYTES, stage

WINDOW = 10
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII; only A-Z change case."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # lower() is fast, and right for ASCII alone
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAPS), "")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of columns in which null equals null."""
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


def bounded(table: DataFrame, text: str) -> DataFrame:
    """``table`` (staged), marked for broadcast if its rows and its ``text`` column are small."""
    n, size = table.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return F.broadcast(table) if (size or 0) + 256 * n <= BROADCAST_BYTES else table


def around(w: Column, i: Column, n: Column | int) -> tuple[Column, Column]:
    """The up to ``n`` words of ``w`` before and after place ``i`` (from 0), the nearest first."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.reverse(F.slice(w, F.greatest(F.lit(1), i - n + 1), F.least(i, n))), F.slice(w, i + 2, n)


def anchors(items: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``items`` (rid, item_id, w) the places of the rarest and second rarest word
    of every window: rid, item_id, m (words of a window), rank (1, 2), ipos, term, left and right
    (up to m - 1 item words on either side, the nearest first), and starts (the windows, by the
    number of their words before the anchor)."""
    w, n = F.col("w"), F.size("w")
    m = F.least(n, F.lit(window))

    def place(x: Column, i: Column) -> Column:
        left, right = around(w, i, m - 1)
        return F.struct(i.alias("ipos"), x.alias("term"), left.alias("left"), right.alias("right"))

    placed = items.where(n > 0).select("rid", "item_id", m.alias("m"), n.alias("n"), F.inline(F.transform(w, place)))
    placed = stage(placed.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), "placed")
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("m") + 1), F.least(F.col("ipos"), F.col("n") - F.col("m")))
    each = placed.select("rid", "ipos", "m", "df", F.explode(starts).alias("at"))
    rarest = Window.partitionBy("rid", "at").orderBy("df", "ipos")
    # A window of one word has one list, which stands for both.
    rank = F.when(F.col("m") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array("rank"))
    ranked = each.withColumn("rank", F.row_number().over(rarest)).where("rank <= 2").withColumn("rank", F.explode(rank))
    ranked = ranked.groupBy("rid", "ipos", "rank").agg(F.sort_array(F.collect_set(F.col("ipos") - F.col("at"))).alias("starts"))
    return ranked.join(placed.drop("df", "n"), ["rid", "ipos"]).select("rid", "item_id", "m", "rank", "ipos", "term", "left", "right", "starts")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, w): id and text are the key of a row, since an id may stand on several
    texts; rows that repeat both have the same matches."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("w"))


def index(docs: DataFrame, terms: DataFrame, near: int = WINDOW - 1, together: bool = True) -> DataFrame:
    """Postings of ``terms`` (term, first): term, first, doc_id, text_hash, pos and, where first,
    the ``near`` words on either side, the nearest first.

    ``together`` says that the terms are broadcast: then contexts are cut where a term is met.
    Otherwise places are joined without their texts, and each text meets its places once.
    """
    rows = keyed(docs)
    if together:
        before, after = around(F.col("w"), F.col("pos"), near)
        placed = rows.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "term")).join(terms, "term")
        return placed.select("term", "first", "doc_id", "text_hash", "pos", F.when(F.col("first"), before).alias("before"), F.when(F.col("first"), after).alias("after"))
    places = rows.select("doc_id", "text_hash", F.posexplode("w").alias("pos", "term")).join(terms, "term").distinct()
    places = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("term", "first", "pos")).alias("places"))
    places = places.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
    found = rows.join(places, rows["doc_id"].eqNullSafe(places["own_id"]) & (rows["text_hash"] == places["own_hash"]))

    def place(x: Column) -> Column:
        before, after = around(F.col("w"), x["pos"], near)
        return F.struct(x["term"].alias("term"), x["first"].alias("first"), x["pos"].alias("pos"), F.when(x["first"], before).alias("before"), F.when(x["first"], after).alias("after"))

    return found.select("doc_id", "text_hash", F.inline(F.transform("places", place))).select("term", "first", "doc_id", "text_hash", "pos", "before", "after")


def agreeing(a: Column, b: Column) -> Column:
    """The length of the common prefix of two arrays."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def prepare(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The staged index of the corpus for these items, and the items' anchors."""
    items = stage(benchmark.select(F.monotonically_increasing_id().alias("rid"), "item_id", words(F.col("text")).alias("w")), "items")
    vocabulary = bounded(stage(items.select(F.explode("w").alias("term")).distinct(), "vocabulary"), "term")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    frequency = tokens.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    found = stage(anchors(items, stage(frequency, "frequency"), window), "anchors")
    terms = stage(found.groupBy("term").agg((F.min("rank") == 1).alias("first")), "terms")
    n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    return stage(index(docs, bounded(terms, "term"), window - 1, (size or 0) + 256 * n <= BROADCAST_BYTES), "postings"), found


def phrases(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Exact matches: doc_id, text_hash, item_id, start, end (first and last document word of a run
    that consists of whole windows of the item)."""
    near = bounded(found.drop("starts"), "term")
    first = postings.where("first").join(near.where("rank = 1").drop("rank"), "term")
    first = first.select("doc_id", "text_hash", "rid", "item_id", "m", "pos", (F.col("pos") - F.col("ipos")).alias("shift"), agreeing(F.col("before"), F.col("left")).alias("l"), agreeing(F.col("after"), F.col("right")).alias("r"))
    second = postings.join(near.where("rank = 2").select("term", "rid", "ipos"), "term").select("doc_id", "text_hash", "rid", (F.col("pos") - F.col("ipos")).alias("shift"))
    both = first.join(second, same(first, second, "doc_id", "text_hash", "rid", "shift"), "left_semi")
    return both.where("l + r + 1 >= m").select("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end")).distinct()


def proximity(postings: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id and pos of words that are the rarest of a window of the item and
    around which all the window's words stand within the index's context, whatever their order."""
    near = bounded(found, "term")
    joined = postings.where("first").join(near.where("rank = 1"), "term")
    there = F.array_union(F.array("term"), F.array_union("before", "after"))
    window = lambda k: F.concat(F.slice("left", 1, k), F.slice("right", 1, F.col("m") - 1 - k))
    fits = F.exists("starts", lambda k: F.size(F.array_except(window(k), F.col("there"))) == 0)
    return joined.withColumn("there", there).where(fits).select("doc_id", "text_hash", "item_id", "pos").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids as
    strings), contaminated and n_near (items with proximity matches).

    Null and empty texts have no words and no hits; items without words match nothing.  Rows are
    told apart by doc_id and text: one id on several texts has the hits of each, repeated rows
    have the same.  Copies of an item are items of their own; rows of one item_id count as one
    item.  Of equally rare words the first of a window is its anchor.  Empty tables give no rows
    or no hits.  Very long texts and items are handled word by word.  Other columns are ignored.
    """
    postings, found = prepare(docs, benchmark, window)
    spans, near = phrases(postings, found), proximity(postings, found)
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"])))
    matched = spans.select("doc_id", "text_hash", F.struct("start", "end").alias("span"), F.col("item_id").cast("string").alias("item"), F.lit(None).cast("string").alias("near"))
    matched = matched.unionByName(near.select("doc_id", "text_hash", F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("string").alias("item"), F.col("item_id").cast("string").alias("near")).distinct())
    hits = (
        matched.groupBy("doc_id", "text_hash")
        .agg(F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("item")).alias("items"), F.size(F.collect_set("near")).cast("long").alias("n_near"))
        .select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"), "items", "n_near")
    )
    counted = keyed(docs).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit, n_near = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_near"))
    same_row = counted["doc_id"].eqNullSafe(hits["hit_id"]) & (counted["text_hash"] == hits["hit_hash"])
    return counted.join(hits, same_row, "left").select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), n_near.alias("n_near")
    )


ORACLE_SQL = r"""
WITH it AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM iw),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
dg AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM dp),
hit AS (SELECT doc_id, i, m, item_id FROM dg JOIN win USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
tf AS (SELECT t, count(*) AS df FROM (SELECT unnest(w) AS t FROM dw) GROUP BY t),
iword AS (SELECT item_id, m, i, p, w[p] AS t, w[i:i + m - 1] AS win FROM (SELECT item_id, w, m, i, unnest(range(i, i + m)) AS p FROM iw)),
rare AS (SELECT item_id, m, win, t FROM (SELECT *, row_number() OVER (PARTITION BY item_id, i ORDER BY coalesce(df, 0), p) AS r FROM iword LEFT JOIN tf USING (t)) WHERE r = 1),
post AS (SELECT doc_id, w[p] AS t, w[greatest(1, p - 9):p + 9] AS ctx FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw) WHERE w[p] IN (SELECT t FROM rare)),
close AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_near FROM post JOIN rare USING (t) WHERE list_has_all(ctx, win) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN close USING (doc_id)
"""
