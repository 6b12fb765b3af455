"""Queries of the archive engine over the driver's tables, with the DuckDB SQL of each."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions.cipher import key_of
from satchel.functions.udfs import decrypt, encode_with, encrypt, huffman_decode, huffman_encode, key_column
from satchel.operators import archive, blocks, manifest, statistics
from satchel.plans import modes
from satchel.plans.staging import new_path, ship, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PASSWORD = "password"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").cast("binary").alias("raw"))


BYTES = """b AS (SELECT doc_id, lang, source, ('0x' || substr(h, 2 * i + 1, 2))::INT AS byte FROM
  (SELECT doc_id, lang, source, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)))) AS i FROM documents))"""
COUNTS = f"{BYTES}, c AS (SELECT doc_id, byte, count(*) AS freq FROM b GROUP BY ALL)"
# Merge the two least weights until one is left; a lone symbol takes a bit each time.
BITS = f"""WITH RECURSIVE {COUNTS},
s AS (SELECT doc_id, list(freq ORDER BY freq) AS l, count(*)::BIGINT AS symbols, sum(freq)::BIGINT AS n FROM c GROUP BY doc_id),
m(doc_id, l, bits) AS (SELECT doc_id, l, 0::BIGINT FROM s
  UNION ALL SELECT doc_id, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM m WHERE len(l) > 1),
bits AS (SELECT s.doc_id, symbols, n, CASE WHEN symbols = 1 THEN n ELSE bits END AS bits FROM m JOIN s USING (doc_id) WHERE len(m.l) = 1)"""


@query(f"WITH {COUNTS} SELECT doc_id, byte, freq FROM c")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(texts(spark, sf_dir), ["doc_id"])


@query(f"WITH {BYTES} SELECT lang, byte, count(*) AS freq FROM b GROUP BY ALL")
def byte_histogram_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(texts(spark, sf_dir), ["lang"])


@query(f"WITH {COUNTS} SELECT doc_id, count(DISTINCT byte) AS symbols FROM c GROUP BY doc_id")
def distinct_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_histogram(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("byte").alias("symbols"))


@query(f"{BITS} SELECT doc_id, bits FROM bits")
def huffman_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.block_sizes(byte_histogram(spark, sf_dir), ["doc_id"]).select("doc_id", "bits")


SIZES = f"{BITS} SELECT doc_id, 4 * symbols - 1 AS metadata_bytes, 1 + (bits + 7) // 8 AS payload_bytes FROM bits"


@query(SIZES)
def huffman_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.block_sizes(byte_histogram(spark, sf_dir), ["doc_id"]).select("doc_id", "metadata_bytes", "payload_bytes")


@query(SIZES)
def huffman_encode_actual_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = texts(spark, sf_dir).where(F.octet_length("raw") > 0).select("doc_id", huffman_encode(F.col("raw")).alias("e"))
    return done.select("doc_id", F.octet_length("e.metadata").cast("long").alias("metadata_bytes"), F.octet_length("e.payload").cast("long").alias("payload_bytes"))


LENGTHS = f"""WITH RECURSIVE {BYTES}, g AS (SELECT byte, count(*)::BIGINT AS freq FROM b GROUP BY byte),
f(l) AS (SELECT list({{'freq': freq, 'least': byte, 'symbols': [{{'byte': byte, 'freq': freq, 'len': 0}}]}} ORDER BY freq, byte) FROM g
  UNION ALL SELECT list_sort(list_append(l[3:], {{'freq': l[1].freq + l[2].freq, 'least': least(l[1].least, l[2].least),
    'symbols': list_transform(l[1].symbols || l[2].symbols, lambda s: {{'byte': s.byte, 'freq': s.freq, 'len': s.len + 1}})}})) FROM f WHERE len(l) > 1),
codes AS (SELECT s.byte AS byte, s.freq AS freq, greatest(s.len, 1) AS code_len FROM (SELECT unnest(l[1].symbols) AS s FROM f WHERE len(l) = 1))"""


@query(f"{LENGTHS} SELECT byte, freq, code_len FROM codes")
def huffman_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.code_lengths(statistics.histogram(texts(spark, sf_dir), []))


@query(f"{LENGTHS} SELECT min(code_len) AS min_len, max(code_len) AS max_len, sum(code_len)::BIGINT AS total_len, count(*) AS symbols FROM codes")
def code_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.code_statistics(huffman_code_lengths(spark, sf_dir))


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def huffman_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = texts(spark, sf_dir).where(F.octet_length("raw") > 0).select("doc_id", huffman_encode(F.col("raw")).alias("e"), F.octet_length("raw").alias("n"))
    return done.select("doc_id", huffman_decode(F.col("e.metadata"), F.col("e.payload"), F.col("n")).cast("string").alias("text"))


@query(
    f"""{BITS} SELECT source, sum(n)::BIGINT AS raw_bytes, sum(4 * symbols + (bits + 7) // 8)::BIGINT AS stored_bytes,
  (1000 * sum(4 * symbols + (bits + 7) // 8) // sum(n))::BIGINT AS permille FROM bits JOIN documents USING (doc_id) GROUP BY source"""
)
def compression_permille_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).where(F.octet_length("raw") > 0).withColumn("e", huffman_encode(F.col("raw")))
    stored = F.sum(F.octet_length("e.metadata") + F.octet_length("e.payload"))
    raw = F.sum(F.octet_length("raw"))
    return docs.groupBy("source").agg(raw.alias("raw_bytes"), stored.alias("stored_bytes"), F.floor(1000 * stored / raw).cast("long").alias("permille"))


@query("SELECT doc_id, '00' || array_to_string(list_transform(range(0, 8), lambda k: printf('%02x', (octet_length(encode(text)) >> (8 * k)) & 255)), '') AS metadata FROM documents WHERE text <> ''")
def null_codec_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = texts(spark, sf_dir).where(F.octet_length("raw") > 0).select("doc_id", encode_with(modes.Null)("raw").alias("e"))
    return done.select("doc_id", F.lower(F.hex("e.metadata")).alias("metadata"))


@query(
    """SELECT doc_id, block_no, hex(encode(text)[block_no * 4096 + 1:least(block_no * 4096 + 4096, octet_length(encode(text)))]) AS raw FROM
  (SELECT doc_id, text, unnest(range(0, (octet_length(encode(text)) + 4095) // 4096)) AS block_no FROM documents WHERE text <> '')"""
)
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.split_blocks(texts(spark, sf_dir), ["doc_id"], "raw", 4096).withColumn("raw", F.hex("raw"))


@query("SELECT doc_id, ((octet_length(encode(text)) + 8388607) // 8388608)::BIGINT AS n_blocks FROM documents")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", blocks.block_count(F.octet_length("raw").cast("long")).alias("n_blocks"))


@query("SELECT n_nationkey, substr(sha256(n_name), 1, 32) AS key FROM nation")
def derive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.hex(key_column(F.col("n_name")))).alias("key"))


def fixed_iv(key: str) -> Column:
    return F.unhex(F.md5(F.col(key).cast("string").cast("binary")))


@query("SELECT doc_id, text FROM documents")
def cipher_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = key_of(PASSWORD)
    sealed = texts(spark, sf_dir).select("doc_id", encrypt(F.col("raw"), key, fixed_iv("doc_id")).alias("sealed"))
    return sealed.select("doc_id", decrypt(F.col("sealed"), key).cast("string").alias("text"))


@query()
def cipher_ciphertext(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("r_name").cast("binary")
    return table(spark, sf_dir, "region").select("r_regionkey", F.hex(encrypt(raw, key_of(PASSWORD), fixed_iv("r_regionkey"))).alias("sealed"))


def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the URL without its scheme, and a name for what ends in a folder."""
    path = F.concat(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://|/+$", ""), r"/+", "/"), F.lit("/page-"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("size"))


TREE = """f AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://|/+$', '', 'g'), '/+', '/', 'g') || '/page-' || page_id AS path, octet_length(encode(html)) AS size FROM pages),
p AS (SELECT path, string_split(path, '/') AS parts, size, 'file' AS kind FROM f),
dirs AS (SELECT DISTINCT parts[1:k] AS parts FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM p)),
n AS (SELECT path, parts, kind, size FROM p UNION ALL SELECT array_to_string(parts, '/'), parts, 'dir', 0 FROM dirs),
kids AS (SELECT parts[1:len(parts) - 1] AS up, count(*) AS c FROM n GROUP BY 1),
m AS (SELECT 0 AS entry_ord, '' AS path, 'out' AS name, 0 AS depth, 'root' AS kind, 0 AS size, (SELECT count(*) FROM n WHERE len(parts) = 1) AS child_count, [] AS parts
  UNION ALL SELECT row_number() OVER (ORDER BY len(n.parts), n.parts), n.path, n.parts[len(n.parts)], len(n.parts), n.kind, n.size, CASE WHEN n.kind = 'dir' THEN coalesce(c, 0) ELSE 0 END, n.parts
  FROM n LEFT JOIN kids ON kids.up = n.parts),
l AS (SELECT *, octet_length(encode(name)) + CASE WHEN kind = 'file' THEN 21 ELSE 9 END AS entry_bytes FROM m)"""


def url_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(manifest.ordered(manifest.tree(url_files(spark, sf_dir)), "out"), "manifest")


@query(f"WITH {TREE} SELECT entry_ord::BIGINT AS entry_ord, path, name, depth::INT AS depth, kind, size::BIGINT AS size, child_count::BIGINT AS child_count FROM m")
def manifest_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_manifest(spark, sf_dir).select("entry_ord", "path", "name", "depth", "kind", "size", "child_count")


@query(f"WITH {TREE} SELECT m.entry_ord::BIGINT AS entry_ord, u.entry_ord::BIGINT AS parent_ord, m.path FROM m LEFT JOIN m u ON m.depth > 0 AND u.kind <> 'file' AND u.parts = m.parts[1:len(m.parts) - 1] AND (u.depth > 0 OR m.depth = 1)")
def parent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and paths found again from order, names and child counts alone."""
    entries = url_manifest(spark, sf_dir).select("entry_ord", "kind", "name", "child_count")
    owners = stage(manifest.parents(entries), "owners")
    named = entries.withColumn("name", F.when(F.col("kind") == "root", F.lit("")).otherwise(F.col("name")))
    paths = manifest.full_paths(named, owners).withColumn("path", F.regexp_replace("path", "^/", ""))
    return owners.join(paths, "entry_ord").select("entry_ord", "parent_ord", "path")


@query(f"WITH {TREE} SELECT entry_ord::BIGINT AS entry_ord, entry_bytes::BIGINT AS entry_bytes, (sum(entry_bytes) OVER (ORDER BY entry_ord) - entry_bytes)::BIGINT AS entry_offset FROM l")
def entry_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.layout(url_manifest(spark, sf_dir)).select("entry_ord", "entry_bytes", F.col("entry_offset").cast("long").alias("entry_offset"))


FOLD = f"""WITH RECURSIVE {TREE}, r AS (SELECT max(entry_ord) FILTER (depth <= 1) AS roots FROM l),
w(entry_ord, dir_block, filled) AS (SELECT entry_ord, 0, entry_bytes FROM l WHERE entry_ord = 0
  UNION ALL SELECT l.entry_ord, w.dir_block + (w.filled >= 16384 AND w.entry_ord > roots)::INT,
    l.entry_bytes + CASE WHEN w.filled >= 16384 AND w.entry_ord > roots THEN 0 ELSE w.filled END FROM w JOIN l ON l.entry_ord = w.entry_ord + 1, r)"""


@query(f"{FOLD} SELECT dir_block::BIGINT AS dir_block, count(*) AS entries, min(entry_ord)::BIGINT AS first_entry FROM w GROUP BY dir_block")
def directory_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.blocks_of_directory(url_manifest(spark, sf_dir)).groupBy("dir_block").agg(F.count("*").alias("entries"), F.min("entry_ord").alias("first_entry"))


@query(f"{FOLD} SELECT (23 + (SELECT sum(entry_bytes) FROM l) + 25 * (SELECT max(dir_block) + 1 FROM w))::BIGINT AS directory_offset")
def data_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = url_manifest(spark, sf_dir)
    return manifest.data_offset(entries, manifest.blocks_of_directory(entries))


@query("SELECT DISTINCT regexp_replace(url, '/+$', '') AS path FROM pages")
def dedupe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.clean_paths(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query("SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 3 = 0)")
def restore_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restore that skips existing files writes, were the files of every third page there."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url").distinct(), "url", "left_anti").select("page_id")


@query("SELECT range::INT AS mode_id, CASE range WHEN 0 THEN 'HuffmanAES' WHEN 1 THEN 'HuffmanOnly' WHEN 2 THEN 'AESOnly' WHEN 3 THEN 'PackOnly' END AS mode, range IN (0, 2) AS needs_password FROM range(0, 10)")
def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(10).select(F.col("id").cast("int").alias("mode_id"))
    return ids.select("mode_id", modes.dispatch(F.col("mode_id")).alias("mode"), F.col("mode_id").isin(*[m.mode_id for m in modes.MODES.values() if m.cipher != "null"]).alias("needs_password"))


@query("SELECT page_id, lower(url) LIKE '%.sy' AS is_archive, regexp_replace(string_split(url, '/')[-1], '(?i)\\.sy$', '') AS logical_root FROM pages")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", manifest.is_archive(F.col("url")).alias("is_archive"), manifest.logical_root(F.col("url")).alias("logical_root"))


def packed(spark: SparkSession, sf_dir: str, mode: int) -> tuple[str, str | None]:
    """Write the documents as files of one archive."""
    password = PASSWORD if mode in (0, 2) else None
    docs = texts(spark, sf_dir).select(F.format_string("doc/%08d", "doc_id").alias("path"), "raw")
    path = new_path(spark, f"mode{mode}").removeprefix("file://") + ".sy"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    archive.write_archive(archive.pieces(docs, None, "out", mode, password), path)
    return path, password


def unpacked(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    path, password = packed(spark, sf_dir, mode)
    return texts_of(archive.table(spark, path, "blocks", password))


def texts_of(found: DataFrame) -> DataFrame:
    """(doc_id, text) of the blocks (path, block_no, raw) of archived documents.

    Bytes are joined as they are: a character may stand across two blocks.
    """
    ordered = F.sort_array(F.collect_list(F.struct("block_no", "raw")))
    text = F.array_join(F.transform(ordered, lambda b: b["raw"].cast("string")), "")
    doc_id = F.regexp_extract("path", "^doc/(.*)$", 1).cast("long")
    return found.groupBy("path").agg(text.alias("text")).select(doc_id.alias("doc_id"), "text")


def _round_trips() -> None:
    for mode, name in ((3, "pack"), (1, "huffman"), (0, "huffman_cipher"), (2, "cipher")):

        def f(spark: SparkSession, sf_dir: str, mode: int = mode) -> DataFrame:
            return unpacked(spark, sf_dir, mode)

        f.__name__ = f"archive_roundtrip_{name}"
        query("SELECT doc_id, text FROM documents WHERE text <> ''")(f)


_round_trips()


@query(
    f"""{BITS} SELECT 'doc/' || printf('%08d', doc_id) AS path, n AS size, 4 * symbols + (bits + 7) // 8 AS stored FROM bits"""
)
def archive_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from an archive's directory against the size laws."""
    path, password = packed(spark, sf_dir, 1)
    return archive.table(spark, path, "entries", password).where("kind = 'file'").select("path", "size", "stored")


NATIONS = """f AS (SELECT 'world/' || r_name || '/' || n_name AS path, repeat(n_name || ' ', n_nationkey * 500) AS text FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def nation_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder tree of the nations (25 rows at every scale): a folder for each region, an empty
    one beside them, and a file for each nation, the first one empty; the path of its root."""
    base = new_path(spark, "tree").removeprefix("file://")
    names = {r.r_regionkey: r.r_name for r in table(spark, sf_dir, "region").collect()}
    os.makedirs(f"{base}/world/nowhere")
    for r in table(spark, sf_dir, "nation").collect():
        os.makedirs(folder := f"{base}/world/{names[r.n_regionkey]}", exist_ok=True)
        with open(f"{folder}/{r.n_name}", "w") as f:
            f.write(f"{r.n_name} " * (r.n_nationkey * 500))
    return f"{base}/world"


@query(
    f"""WITH {NATIONS} SELECT path, octet_length(encode(text))::BIGINT AS size, 'file' AS kind FROM f
  UNION ALL SELECT 'world/' || r_name, 0, 'dir' FROM region UNION ALL SELECT 'world', 0, 'dir' UNION ALL SELECT 'world/nowhere', 0, 'dir'"""
)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders below a root, the empty one included; a root that is given twice is read once."""
    root = nation_tree(spark, sf_dir)
    files, folders = archive.scan(spark, [root, root])
    return files.select("path", "size", F.lit("file").alias("kind")).unionByName(folders.select("path", F.lit(0).cast("long").alias("size"), F.lit("dir").alias("kind")))


@query(
    f"""WITH {NATIONS} SELECT path, block_no::BIGINT AS block_no, hex(encode(text)[block_no * 4096 + 1:least(block_no * 4096 + 4096, octet_length(encode(text)))]) AS raw FROM
  (SELECT path, text, unnest(range(0, (octet_length(encode(text)) + 4095) // 4096)) AS block_no FROM f WHERE text <> '')"""
)
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read block by block."""
    files, _ = archive.scan(spark, [nation_tree(spark, sf_dir)])
    return archive.file_blocks(files, 4096).withColumn("raw", F.hex("raw"))


def restored(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """The files of an encrypted archive after it was restored beside itself, one file of every
    region (that of the least name) being there already with other bytes."""
    root = nation_tree(spark, sf_dir)
    base = os.path.dirname(root)
    archive.compress(spark, [root], f"{base}/out.sy", 0, PASSWORD, block_size=4096)
    for folder in os.scandir(root):
        if inside := sorted(os.listdir(folder.path)):
            os.makedirs(at := f"{base}/out/world/{folder.name}")
            with open(f"{at}/{inside[0]}", "w") as f:
                f.write("old")
    written = archive.restore(spark, f"{base}/out.sy", None, PASSWORD, policy, 4096).withColumn("written", F.lit(True))
    files, folders = archive.scan(spark, [f"{base}/out/world"])
    if folders.where("path = 'world/nowhere'").count() != 1:
        raise AssertionError("the empty folder was not restored")
    blocks = archive.file_blocks(files, 1 << 20).select("path", F.col("raw").cast("string").alias("text"))
    found = files.select("path").join(blocks, "path", "left").join(written.select("path", "written"), "path", "left")
    return found.select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("written", F.lit(False)).alias("written"))


@query(f"WITH {NATIONS} SELECT path, text, true AS written FROM f")
def file_roundtrip_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(spark, sf_dir, "overwrite")


@query(
    f"""WITH {NATIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY string_split(path, '/')[2] ORDER BY path) = 1 AS there FROM f)
  SELECT path, CASE WHEN there THEN 'old' ELSE text END AS text, NOT there AS written FROM o"""
)
def file_roundtrip_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(spark, sf_dir, "skip")


@query(
    # Entries of 12 bytes for the root and the folder and of 29 for each file; a block of the
    # directory ends with its 565th file, the one that brings it to 16 KiB.
    """SELECT 3735928559::BIGINT AS magic1, 3::SMALLINT AS strategy, 0::SMALLINT AS version, 19::SMALLINT AS header_offset,
  (19 + 25 * greatest((count(*) + 564) // 565, 1) + 24 + 29 * count(*) + 4)::BIGINT AS directory_offset, 3735928559::BIGINT AS magic2 FROM documents"""
)
def archive_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = packed(spark, sf_dir, 3)
    return archive.table(spark, path, "header").drop("archive")
