"""Archives end to end: golden container, round trips, directory quirks, and refusals."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from satchel.functions import formats
from satchel.functions.formats import Entry
from satchel.operators import archive, blocks, manifest, queries, statistics
from satchel.plans.ordering import number_rows, running_sum
from satchel.sources.archives import directory

GOLDEN = "efbeadde0300135600000000000000efbeadde" + "32" + "00" * 24 + "3303000000" + "6f7574" + "01000000" + "3105000000" + "612e747874" + "0500000000000000" + "0e00000000000000" + "efbeadde" + "320900000000000000" + "000500000000000000" + "320500000000000000" + "68656c6c6f"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "r"
    for d in ("d/deep/x", "e", "empty/a", "empty/b", "empty/c"):
        (root / d).mkdir(parents=True)
    files = {"r/f": b"", "r/one": b"a", "r/eight": b"z" * 8, "r/d/x": b"xx" * 1000, "r/d/deep/ü日本": bytes(range(256)) * 40, "a.txt": b"hello"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    return tmp_path, files


def test_golden_container(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    archive.compress(spark, [str(tmp_path / "a.txt")], str(tmp_path / "out.sy"), 3)
    assert (tmp_path / "out.sy").read_bytes().hex() == GOLDEN


@pytest.mark.parametrize("mode,password", [(0, "pw"), (1, None), (2, "pw"), (3, None)])
def test_round_trip(spark, tree, mode, password):
    base, files = tree
    path, out = str(base / "m.sy"), str(base / "out")
    archive.compress(spark, [str(base / "r"), str(base / "a.txt")], path, mode, password)
    row = archive.inspect(spark, path).first()
    assert (row.mode_id, row.needs_password) == (mode, password is not None)
    assert archive.restore(spark, path, out, password).count() == len(files)
    assert all(open(f"{out}/m/{name}", "rb").read() == raw for name, raw in files.items())
    assert all(os.path.isdir(f"{out}/m/r/{d}") for d in ("d/deep/x", "e", "empty/a", "empty/b", "empty/c"))
    ivs = {bytes(r.iv) for r in archive.table(spark, path, "entries", password).select("iv").collect()}
    assert (formats.NO_IV in ivs) == (password is None)
    with pytest.raises(FileExistsError):
        archive.compress(spark, [str(base / "r")], path, mode, password)


def test_policies(spark, tree):
    base, files = tree
    path, out = str(base / "m.sy"), str(base / "out")
    archive.compress(spark, [str(base / "r"), str(base / "a.txt")], path, 1)
    os.makedirs(f"{out}/m")
    with open(f"{out}/m/a.txt", "wb") as f:
        f.write(b"old")
    with pytest.raises(FileExistsError):
        archive.restore(spark, path, out)
    assert archive.restore(spark, path, out, policy="skip").count() == len(files) - 1
    assert open(f"{out}/m/a.txt", "rb").read() == b"old"
    assert archive.restore(spark, path, out, policy="overwrite").count() == len(files)
    assert open(f"{out}/m/a.txt", "rb").read() == b"hello"


def test_several_blocks_and_one_path(spark, tmp_path):
    raw = os.urandom(10_001)
    df = spark.createDataFrame([("a/x", raw), ("b", b"bb"), ("c", None)], "path string, raw binary")
    path = str(tmp_path / "x.sy")
    archive.write_archive(archive.pieces(df, None, "out", 1, block_size=4096), path)
    rows = archive.table(spark, path, "blocks", block_size=4096).where("path = 'a/x'").orderBy("block_no").collect()
    assert [r.block_no for r in rows] == [0, 1, 2] and b"".join(bytes(r.raw) for r in rows) == raw
    assert {r.path: r.size for r in archive.table(spark, path, "entries").where("kind = 'file'").collect()} == {"a/x": 10_001, "b": 2, "c": 0}


def test_documents_of_several_blocks(spark, tmp_path):
    """Texts longer than a block, characters across blocks, and ids of more than eight digits."""
    rows = [(1, "aé日" * (3 << 19)), (123_456_789, "long id"), (1_234_567_890_123, "x"), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["archive_roundtrip_pack"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in rows if t} and len(got) == 3


def test_many_folders(spark, tmp_path):
    """First directory blocks without files, and blocks that end next to empty folders."""
    names = [f"d{k:04d}" for k in range(1300)]
    df = spark.createDataFrame([(f"r/{n}/f", b"x") for n in names[::2]], "path string, raw binary")
    folders = spark.createDataFrame([(f"r/{n}",) for n in names[1::2]], "path string")
    path = str(tmp_path / "x.sy")
    archive.write_archive(archive.pieces(df, folders, "out", 3), path)
    found = archive.table(spark, path, "entries").collect()
    assert max(r.dir_block for r in found) >= 1
    assert {r.path for r in found} == {"out", "r"} | {f"r/{n}" for n in names} | {f"r/{n}/f" for n in names[::2]}
    assert archive.table(spark, path, "blocks").count() == 650


def test_links(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "real").write_bytes(b"x")
    os.symlink(root / "real", root / "live")
    os.mkfifo(root / "pipe")
    files, folders = archive.scan(spark, [str(root)])
    assert {r.path for r in files.collect()} == {"r/real", "r/live"} and folders.count() == 1
    os.symlink(root / "nothing", root / "dead")
    with pytest.raises(formats.ArchiveError):
        archive.scan(spark, [str(root)])
    with pytest.raises(Exception):
        archive.scan(spark, [str(tmp_path / "missing")])


@pytest.mark.parametrize("at", ["r", "r/in"])
def test_links_to_folders(spark, tmp_path, at):
    """They are refused, at the root and below, and not left out in silence."""
    for d in ("r/in", "other"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "other/f").write_bytes(b"x")
    os.symlink(tmp_path / "other", tmp_path / at / "link")
    with pytest.raises(formats.ArchiveError):
        archive.scan(spark, [str(tmp_path / "r")])


def container(entries, data=b""):
    body = b"".join(e.pack() for e in entries)
    return formats.pack_header(3, 19 + 25 + len(body) + 4) + formats.pack_separator(0) + body + formats.MAGIC.to_bytes(4, "little") + data


@pytest.mark.parametrize(
    "entries",
    [
        [Entry("root", "o", 1), Entry("file", "../x", size=0)], [Entry("root", "o", 1), Entry("file", "/x", size=0)], [Entry("root", "o", 1), Entry("dir", "..", 0)],
        [Entry("root", "o", 2), Entry("file", "x")], [Entry("root", "o", 0), Entry("file", "x")], [Entry("root", "o", 1), Entry("dir", "d", 1)], [Entry("root", "o", 1), Entry("root", "p", 0)],
    ],
)
def test_bad_directories(tmp_path, entries):
    path = tmp_path / "x.sy"
    path.write_bytes(container(entries))
    with pytest.raises(formats.ArchiveError):
        directory(str(path), None)


def test_truncated(spark, tmp_path):
    whole = bytes.fromhex(GOLDEN)
    for cut in (10, 40, len(whole) - 2):
        (tmp_path / "x.sy").write_bytes(whole[:cut])
        with pytest.raises(Exception):
            archive.table(spark, str(tmp_path / "x.sy"), "blocks").collect()
    (tmp_path / "x.sy").write_bytes(whole[:4] + b"\x09" + whole[5:])
    with pytest.raises(Exception):
        archive.inspect(spark, str(tmp_path / "x.sy")).collect()


def test_wrong_password(spark, tree):
    base, _ = tree
    archive.compress(spark, [str(base / "r")], str(base / "m.sy"), 0, "right")
    with pytest.raises(Exception):
        archive.table(spark, str(base / "m.sy"), "entries", "wrong").collect()


def test_tree_refusals(spark):
    frame = lambda *paths: spark.createDataFrame([(p, 1) for p in paths], "path string, size long")
    for bad in (("a/../b",), ("/a",), ("a//b",), ("a", "a/b"), ("C:x",)):
        with pytest.raises(Exception):
            manifest.tree(frame(*bad)).collect()
    assert manifest.tree(frame("a/b", "c")).count() == 3


def test_parents_of_empty_folders(spark):
    df = spark.createDataFrame([("r/d/x", 1), ("r/f", 2)], "path string, size long")
    folders = spark.createDataFrame([("r/e",), ("r/a",)], "path string")
    entries = manifest.ordered(manifest.tree(df, folders), "out")
    names = {r.entry_ord: r.path for r in entries.collect()}
    assert [names[k] for k in sorted(names)] == ["", "r", "r/a", "r/d", "r/e", "r/f", "r/d/x"]
    owners = {r.entry_ord: r.parent_ord for r in manifest.parents(entries).collect()}
    assert owners == {0: None, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 3}


def test_numbering(spark):
    df = spark.range(1000).selectExpr("999 - id AS v").repartition(7)
    got = {r.v: r.ord for r in number_rows(df, F.col("v"), start=5).collect()}
    assert got == {v: v + 5 for v in range(1000)}
    sums = running_sum(df, "v", F.col("v"), "s", width=64).collect()
    assert all(r.s == r.v * (r.v - 1) // 2 for r in sums)


def test_clean_paths(spark):
    df = spark.createDataFrame([(" 'a/b/' ",), ("a/b",), ('"c"',), ("",)], "path string")
    assert sorted(r.path for r in manifest.clean_paths(df).collect()) == ["a/b", "c"]


def test_blocks_and_statistics(spark):
    df = spark.createDataFrame([(1, b""), (2, b"a" * 10), (3, None), (4, bytes(range(256)))], "id long, raw binary")
    assert [(r.id, r.block_no, len(r.raw)) for r in blocks.split_blocks(df, ["id"], "raw", 4).where("id = 2").orderBy("block_no").collect()] == [(2, 0, 4), (2, 1, 4), (2, 2, 2)]
    sizes = {r.id: (r.symbols, r.bits, r.metadata_bytes, r.payload_bytes) for r in statistics.block_sizes(statistics.histogram(df, ["id"]), ["id"]).collect()}
    assert sizes == {2: (1, 10, 3, 3), 4: (256, 2048, 1023, 257)}
    lengths = statistics.code_lengths(statistics.histogram(spark.createDataFrame([(b"abracadabra",)], "raw binary"), []))
    assert {chr(r.byte): r.code_len for r in lengths.collect()} == {"a": 1, "r": 2, "b": 3, "c": 4, "d": 4}
    assert struct.calcsize("<Q") == 8


def test_files_are_read_block_by_block(spark, tmp_path):
    """Ranged reads; what a file gains after the scan is left out, and a loss is an error."""
    raw = os.urandom(10_001)
    (tmp_path / "f").write_bytes(raw)
    files, _ = archive.scan(spark, [str(tmp_path / "f")])
    with open(tmp_path / "f", "ab") as f:
        f.write(b"more" * 5000)
    got = archive.file_blocks(files, 4096).orderBy("block_no").collect()
    assert [len(r.raw) for r in got] == [4096, 4096, 1809] and b"".join(bytes(r.raw) for r in got) == raw
    (tmp_path / "f").write_bytes(raw[:5000])
    with pytest.raises(Exception, match="shorter"):
        archive.file_blocks(files, 4096).collect()


def test_long_files_are_split(spark, tmp_path, monkeypatch):
    """A file above the partition size is read by several partitions, also encrypted."""
    from satchel.sources import archives

    raw = os.urandom(50_000) + b"x" * 50_000
    (tmp_path / "f").write_bytes(raw)
    (tmp_path / "g").write_bytes(b"small")
    path = str(tmp_path / "x.sy")
    archive.compress(spark, [str(tmp_path / "f"), str(tmp_path / "g")], path, 0, "pw", block_size=4096)
    monkeypatch.setattr(archives, "PART_BYTES", 10_000)
    reader = archives.ArchiveReader("blocks", [path], "pw", 4096)
    parts = reader.partitions()
    assert len(parts) > 4
    got = sorted((full, no, bytes(b)) for p in parts for _, _, no, full, b in reader.read(p))
    assert b"".join(b for full, _, b in got if full == "f") == raw and [b for full, _, b in got if full == "g"] == [b"small"]
    rows = archive.table(spark, path, "blocks", "pw", 4096).where("path = 'f'").orderBy("block_no").collect()
    assert b"".join(bytes(r.raw) for r in rows) == raw


def test_sparse_file(spark, tmp_path):
    """A file of many blocks goes through in blocks; memory does not grow with it."""
    with open(tmp_path / "f", "wb") as f:
        f.truncate(160 << 20)
        f.seek(100 << 20)
        f.write(b"middle")
    path = str(tmp_path / "x.sy")
    archive.compress(spark, [str(tmp_path / "f")], path, 3)
    assert archive.restore(spark, path).count() == 1  # beside the archive
    with open(tmp_path / "x" / "f", "rb") as f:
        f.seek(100 << 20)
        assert f.read(6) == b"middle" and os.path.getsize(f.name) == 160 << 20


def test_own_cipher_and_version(spark, tmp_path):
    from satchel.plans import modes

    class Flip:
        key_of = staticmethod(lambda password: bytes([len(password)]))
        encrypt_many = staticmethod(lambda parts, key, ivs: [bytes(b ^ key[0] for b in p) for p in parts])
        decrypt = staticmethod(lambda data, key: bytes(b ^ key[0] for b in data[16:]))

    with pytest.raises(ValueError):
        modes.register_cipher("rows", Flip)
    modes.register_cipher("flip", Flip)
    modes.register_mode(200, "Flipped", "huffman", cipher="flip")
    (tmp_path / "a").write_bytes(b"hello" * 100)
    path = str(tmp_path / "x.sy")
    archive.compress(spark, [str(tmp_path / "a")], path, "Flipped", "secret")
    assert bytes(archive.table(spark, path, "blocks", "secret").first().raw) == b"hello" * 100
    assert archive.inspect(spark, path).first().mode == "Flipped"
    with pytest.raises(formats.ArchiveError):
        archive.compress(spark, [str(tmp_path / "a")], str(tmp_path / "y.sy"), 1, version=7)
    del modes.MODES[200]


def test_strict_dispatch(spark):
    from satchel.plans import modes

    ids = spark.range(4).select(F.col("id").cast("int").alias("i"))
    assert [r.m for r in ids.select(modes.dispatch(F.col("i"), strict=True).alias("m")).collect()] == ["HuffmanAES", "HuffmanOnly", "AESOnly", "PackOnly"]
    with pytest.raises(Exception, match="unknown mode"):
        spark.range(99, 100).select(modes.dispatch(F.col("id").cast("int"), strict=True)).collect()


def test_mapped_progress():
    from satchel.plans.progress import mapped

    told = []
    report = mapped(lambda percent, label: told.append((percent, label)) or len(told) < 4, 20, 95, every_s=60)
    assert all(report(p, "x") is True for p in (0, 1, 2, 50, 51, 100))
    assert [round(p, 2) for p, _ in told] == [20.0, 57.5, 95.0] and told[0][1] == "x"
