"""Secret scan with multipart credential linking, as DataFrame operations.

Strong patterns (``assign``, ``access``, ``hex``) are always reported.  Weak candidates - an
access identifier, a secret or an endpoint that alone says little - are reported only when the
complementary parts stand in the same scope: an identifier with a secret, a secret with an
identifier, an endpoint with both.  Strong spans serve as parts too.  The link is an interval
semi-join by start offset within a document: a range frame counts the complements within
``SCOPE`` code points, so no pairs are made however many parts a document has.

One pass over the texts extracts the lengths of matches and of the gaps between them; offsets
are their running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.plans.staging import BROADCAST_ROWS, stage

SCOPE = 240  #: code points between the starts of parts that belong together

#: Kind, pattern, the group that must be long enough, and its least length; in order of report.
#: For ``access`` and ``hex`` the least length is in the pattern: a run that is too short holds no
#: match that is long enough, so leaving it out early changes no match.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"""AKIA[A-Z0-9]{16,}""", 0, 20),
    ("hex", r"""[0-9a-f]{24,}""", 0, 24),
    ("identifier", r"""(?i:\b(access_?key_?id|client_?id|account_?id|user_?name|user_?id|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    ("secret_part", r"""(?i:\b(secret_key|secret_?access_?key|client_?secret|private_?key|auth_?key|pass_?phrase|pwd))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#%^&*-]+)""", 2, 6),
    ("endpoint", r"""(?i:\b(https?|ftp|jdbc:[a-z]+|mongodb|postgresql|postgres|mysql|redis|amqp))://[A-Za-z0-9._~:/?#@!&*+,;=%-]+""", 0, 10),
]
BASE = [kind for kind, *_ in KINDS[:3]]
IDENTIFIERS, SECRETS = ("access", "identifier"), ("assign", "hex", "secret_part")

def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """An array of (kind, k, gap, len, ok): leftmost non-overlapping matches, the code points
    since the match before, and whether the match counts."""
    pattern_ = F.lit(pattern)
    whole = F.regexp_extract_all(text, pattern_, F.lit(0))
    tested = F.regexp_extract_all(text, pattern_, F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    each = F.transform(
        F.arrays_zip(whole.alias("m"), tested.alias("t"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("len"), (F.char_length(x["t"]) >= least).alias("ok")),
    )
    return F.when(text.rlike(pattern), each)


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged rows (rid, doc_id, text_hash) and the spans (rid, kind, rank, start, end) of all
    kinds, weak ones included."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:string,k:int,gap:int,len:int,ok:boolean>>")
    found = F.concat(*[F.coalesce(matches(F.col("t"), *kind), none) for kind in KINDS])
    rows = stage(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("t")).select("rid", "doc_id", F.xxhash64("t").alias("text_hash"), found.alias("found")),
        "scanned",
    )
    so_far = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("rid", "kind").orderBy("k"))
    rank = F.array_position(F.array(*[F.lit(kind) for kind, *_ in KINDS]), F.col("kind"))
    spans = rows.select("rid", F.inline("found")).withColumn("end", so_far).where("ok").select("rid", "kind", rank.alias("rank"), (F.col("end") - F.col("len")).alias("start"), "end")
    return rows.drop("found"), spans


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong spans, and weak ones whose complements start within ``scope``."""
    near = Window.partitionBy("rid").orderBy("start").rangeBetween(-scope, scope)
    some = lambda kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    judged = spans.withColumn("with_id", some(IDENTIFIERS)).withColumn("with_secret", some(SECRETS))
    keep = (
        F.col("kind").isin(*BASE)
        | ((F.col("kind") == "identifier") & F.col("with_secret"))
        | ((F.col("kind") == "secret_part") & F.col("with_id"))
        | ((F.col("kind") == "endpoint") & F.col("with_id") & F.col("with_secret"))
    )
    return judged.where(keep).select("rid", "kind", "rank", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash and spans, an array of (start, rank, end, kind)
    in order; offsets in code points, end exclusive.

    Null and empty texts have no spans.  Repeated rows are scanned apart and alike.  Other
    columns are ignored, and an empty table gives no rows.
    """
    rows, spans = parts(docs)
    by_row = linked(spans, scope).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    return rows.join(by_row, "rid", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` and n_chars brought up to date.

    Overlapping spans count as one.  All columns and rows stay; rows are told apart by doc_id
    and text, so equal rows are treated alike.
    """
    found = scan(docs, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    each = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.inline("spans"))
    order = Window.partitionBy("__id", "__hash").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = each.withColumn("__before", before).withColumn("__run", F.sum((F.coalesce("__before", F.lit(-1)) < F.col("start")).cast("int")).over(order)).groupBy("__id", "__hash", "__run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    cuts = stage(merged.groupBy("__id", "__hash").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("__cuts")), "cuts")
    n, size = cuts.agg(F.count("*"), F.sum(F.size("__cuts"))).first()
    if n <= BROADCAST_ROWS // 8 and 16 * (size or 0) + 32 * n <= 32 << 20:
        cuts = F.broadcast(cuts)
    text, c = F.col("text"), F.col("__cuts")
    ends = lambda i: F.when(i > 0, F.element_at(c, i)["e"]).otherwise(0)  # noqa: E731  of the span before
    kept = F.transform(c, lambda x, i: F.concat(F.substring(text, (ends(i) + 1).cast("int"), (x["s"] - ends(i)).cast("int")), F.lit(mark)))
    last = F.element_at(c, -1)["e"]
    new = F.concat(F.concat_ws("", kept), F.substring(text, (last + 1).cast("int"), F.char_length(text)))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == cuts["__hash"]), "left")
    updated = {"text": F.when(c.isNull(), text).otherwise(new)}
    if "n_chars" in docs.columns:
        shorter = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"] - len(mark))
        updated["n_chars"] = F.when(c.isNull(), F.col("n_chars")).otherwise((F.char_length(text) - shorter).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[updated[x].alias(x) if x in updated else docs[x] for x in docs.columns])


def _oracle() -> str:
    """The same rows in DuckDB, kind by kind."""
    quoted = lambda s: s.replace("'", "''")
    each = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS, 1):
        p = quoted({"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(kind, pattern))
        each.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(m) + 1)) AS k, m, t, g, {least} AS least FROM "
            f"(SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS t, regexp_split_to_array(text, '{p}') AS g FROM d)"
        )
    names = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
    near = f"OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)"
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
each AS ({" UNION ALL ".join(each)}),
lens AS (SELECT doc_id, kind, rank, k, length(m[k]) AS n, length(t[k]) >= least AS ok, length(g[k]) AS gap FROM each),
ends AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY k)::BIGINT AS stop FROM lens),
part AS (SELECT doc_id, kind, rank, stop - n AS start, stop FROM ends WHERE ok),
near AS (SELECT *, bool_or(kind IN ({names(IDENTIFIERS)})) {near} AS with_id, bool_or(kind IN ({names(SECRETS)})) {near} AS with_secret FROM part),
kept AS (SELECT * FROM near WHERE kind IN ({names(BASE)}) OR (kind = 'identifier' AND with_secret) OR (kind = 'secret_part' AND with_id) OR (kind = 'endpoint' AND with_id AND with_secret)),
total AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  {line} FILTER (kind IN ({names(BASE)})) AS base, {line} AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN total USING (doc_id)
"""


ORACLE_SQL = _oracle()
