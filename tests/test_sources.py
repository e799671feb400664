"""Binary readers on bytes that the tests write themselves."""

import json
import struct
import zlib

import pyarrow as pa
import pytest

from lexloom.errors import BadFormatError, KeyTooLongError, MissingFieldError, UnknownIndexPartError
from lexloom.fields import Field
from lexloom.sources import btree, bulk_tree, keyfile, parameters, streams, tables
from lexloom.sources.streams import Cursor, big_vbyte, signed_vbyte, vbyte

NUMBERS = [0, 0xF, 0xEF, 0xBEEF, 0xDBEEF, 0xADBEEF, 0xEADBEEF, 0xDEADBEEF, 1 << 40]


@pytest.mark.parametrize("n", NUMBERS)
def test_integers(n):
    assert Cursor(vbyte(n)).vbyte() == n
    assert Cursor(big_vbyte(n)).big_vbyte() == n
    assert Cursor(signed_vbyte(-n)).signed_vbyte() == -n and Cursor(signed_vbyte(n)).signed_vbyte() == n
    if n < 1 << 36:
        assert keyfile.decode_int(keyfile.encode_int(n)) == n


def test_cut_short():
    for read in (Cursor(b"\x01").vbyte, Cursor(b"\x81").big_vbyte, lambda: Cursor(b"abc").number(">I")):
        with pytest.raises(BadFormatError):
            read()
    with pytest.raises(BadFormatError):
        streams.text(b"\xff")


def test_key_order():
    keys = [keyfile.encode_int(n) for n in sorted(NUMBERS[:-1])]
    assert keys == sorted(keys)


def write_btree(path, items, reader, per_block=3, **manifest):
    """items: sorted (key, value)."""
    data, directory = b"", b""
    for k in range(0, len(items), per_block):
        block = items[k : k + per_block]
        values = b"".join(v for _, v in block)
        left, last, head = len(values), b"", struct.pack(">Q", len(block))
        for j, (key, value) in enumerate(block):
            left -= len(value)
            if j == 0:
                head += vbyte(len(key)) + key + vbyte(left)
            else:
                common = next((i for i, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
                head += vbyte(common) + vbyte(len(key)) + key[common:] + vbyte(left)
            last = key
        directory += vbyte(len(block[0][0])) + block[0][0] + vbyte(len(data)) + vbyte(len(head))
        data += head + values
    vocabulary = struct.pack(">I", 1) + b"\0" + directory
    about = json.dumps({"readerClass": f"some.package.{reader}", "blockSize": 32, **manifest}).encode()
    path.write_bytes(data + vocabulary + about + struct.pack(">QQIQ", len(data), len(data) + len(vocabulary), 32, btree.MAGIC))


def postings_value(docs, inline=None, skips=False):
    """docs: (doc_id, positions)."""
    d = c = p = b""
    last = 0
    for doc, positions in docs:
        d += vbyte(doc - last)
        c += vbyte(len(positions))
        gaps = b"".join(vbyte(b - a) for a, b in zip([0, *positions], positions, strict=False))
        p += (vbyte(len(gaps)) if inline is not None and len(positions) > inline else b"") + gaps
        last = doc
    options = btree.HAS_MAX | (btree.HAS_INLINING if inline is not None else 0) | (btree.HAS_SKIPS if skips else 0)
    head = vbyte(options) + (vbyte(inline) if inline is not None else b"") + vbyte(len(docs)) + vbyte(sum(len(x) for _, x in docs)) + vbyte(max(len(x) for _, x in docs))
    head += b"".join(map(vbyte, (5, 5, 1))) if skips else b""
    return head + b"".join(vbyte(len(x)) for x in (d, c, p)) + (vbyte(0) * 2 if skips else b"") + d + c + p


DOCS = [(3, [0, 2, 9]), (7, [1]), (300, [5, 6, 7, 1000])]


@pytest.mark.parametrize("inline,skips", [(None, False), (2, False), (0, True)])
def test_postings(inline, skips):
    value = postings_value(DOCS, inline, skips)
    df, cf, found = btree.read_postings(value)
    assert (df, cf) == (3, 8) and [(p.doc_id, list(p.positions)) for p in found] == DOCS
    assert [(p.doc_id, p.tf) for p in btree.read_postings(value, "Counts")[2]] == [(3, 3), (7, 1), (300, 4)]
    assert [p.doc_id for p in btree.read_postings(value, "Docs")[2]] == [3, 7, 300]


def test_btree(tmp_path):
    items = [(k.encode(), b"v" * n) for n, k in enumerate(sorted(["alpha", "alphabet", "alps", "beta", "bet", "betting", "zoo", "zoos", "été"], key=str.encode))]
    write_btree(tmp_path / "postings", items, "PositionIndexReader")
    tree = btree.BTree(tmp_path / "postings")
    assert list(tree.items()) == items and tree.keys() == [k.decode() for k, _ in items] and tree.part == "positions"
    assert all(tree.find(k) == v for k, v in items)
    assert [tree.find(x) for x in ("", "aaa", "alph", "betty", "zzz")] == [None] * 5
    assert btree.is_btree(tmp_path / "postings")
    (tmp_path / "other").write_bytes(b"x" * 100)
    assert not btree.is_btree(tmp_path / "other") and not btree.is_btree(tmp_path / "absent")
    with pytest.raises(BadFormatError):
        btree.BTree(tmp_path / "other")
    with pytest.raises(UnknownIndexPartError):
        btree.part_of("some.OtherReader")


def test_split_values(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "0").write_bytes(b"firstsecond" + struct.pack(">Q", btree.VALUE_MAGIC))
    write_btree(folder / "split.keys", [(b"a", struct.pack(">IQQ", 0, 0, 5)), (b"b", struct.pack(">IQQ", 0, 5, 6))], "CorpusReader")
    tree = btree.BTree(folder)
    assert (tree.find("a"), tree.find("b"), tree.find("c")) == (b"first", b"second", None)


def stored(text, metadata):
    s = lambda x: struct.pack(">I", len(x.encode())) + x.encode()
    body = struct.pack(">IIQ", 0, len(text.encode()) + 4, 1) + s("name") + struct.pack(">I", len(metadata)) + b"".join(s(k) + s(v) for k, v in metadata) + s(text)
    packed = pa.compress(body, "snappy", asbytes=True)
    return btree.SNAPPY_STREAM + struct.pack(">I", len(packed)) + packed


def lengths_value(first, values):
    return struct.pack(">QQQdQQQQ", len(values), sum(v > 0 for v in values), sum(values), sum(values) / len(values), max(values), min(values), first, first + len(values) - 1) + struct.pack(f">{len(values)}I", *values)


def index_folder(path):
    path.mkdir()
    write_btree(path / "lengths", [(b"document", lengths_value(0, [4, 0, 7]))], "DiskLengthsReader")
    write_btree(path / "names", [(struct.pack(">Q", k), f"d{k}".encode()) for k in range(3)], "DiskNameReader")
    write_btree(path / "names.reverse", [(f"d{k}".encode(), struct.pack(">Q", k)) for k in range(3)], "DiskNameReverseReader")
    write_btree(path / "corpus", [(struct.pack(">Q", 0), stored("body é", [("k", "v"), ("k", "w")]))], "CorpusReader")
    write_btree(path / "postings", [(b"the", postings_value(DOCS))], "PositionIndexReader")
    write_btree(path / "field.krovetz.title", [(b"the", postings_value(DOCS))], "PositionIndexReader", stemmer="some.KrovetzStemmer")
    (path / "notes.txt").write_text("no index")


def test_index_folder(tmp_path):
    index_folder(tmp_path / "i")
    i = btree.open_folder(tmp_path / "i")
    assert set(i.postings) == {Field(), Field("title", "krovetz")}
    table = btree.read_lengths(i.lengths.find("document"))
    assert (table.collection_length, table.count(0), table.count(2), table.count(9)) == (11, 4, 7, 0)
    assert i.names_reverse.name_to_id() == {"d0": 0, "d1": 1, "d2": 2}
    assert btree.read_document(i.corpus.find(struct.pack(">Q", 0))) == btree.CorpusDocument((("k", "v"), ("k", "w")), "body é")
    with pytest.raises(BadFormatError):
        i.names.name_to_id()
    with pytest.raises(BadFormatError):
        btree.read_document(b"plain")
    (tmp_path / "i" / "names").unlink()
    with pytest.raises(BadFormatError, match="names"):
        btree.open_folder(tmp_path / "i")


def test_stemmer_of_a_part_has_to_agree(tmp_path):
    index_folder(tmp_path / "i")
    write_btree(tmp_path / "i" / "postings.porter", [(b"a", b"")], "PositionIndexReader", stemmer="some.KrovetzStemmer")
    with pytest.raises(BadFormatError, match="stemmer"):
        btree.open_folder(tmp_path / "i")


def write_keyfile(path, items, prefix=b"", inline=64, split=None, far=()):
    """Leaves of at most ``split`` entries under one index block; ``far`` entries lie outside of their block."""
    split = split or max(1, len(items))
    leaves = [items[k : k + split] for k in range(0, len(items), split)] or [[]]
    null = struct.pack(">HQ", 127, 0)

    def block(entries, level, following):
        space = bytearray(keyfile.BLOCK - keyfile.HEADER)
        end = len(space) - len(prefix)
        space[end:] = prefix
        for k, (key, rest) in enumerate(entries):
            raw = big_vbyte(len(key) - len(prefix)) + key[len(prefix) :] + rest
            end -= len(raw)
            space[end : end + len(raw)] = raw
            struct.pack_into(">H", space, 2 * k, end)
        return struct.pack(">HHBBBB", len(entries), 0, 0, len(prefix), 0, level) + following + null + bytes(space)

    first = 2 if len(leaves) > 1 else 1
    body, tail = b"", b""
    start = (first + len(leaves)) * keyfile.BLOCK
    for k, leaf in enumerate(leaves):
        entries = []
        for key, value in leaf:
            if len(value) > inline:
                at = start + len(tail)
                entries.append((key, big_vbyte(len(value)) + big_vbyte(at // keyfile.UNIT << 1)))
                tail += value + b"\0" * (-len(value) % keyfile.UNIT)
            else:
                entries.append((key, big_vbyte(len(value)) + value))
        body += block(entries, 0, struct.pack(">HQ", 0, first + k + 1) if k + 1 < len(leaves) else null)
    root = block([(leaf[-1][0], big_vbyte(first + k << 1)) for k, leaf in enumerate(leaves)], 1, null) if len(leaves) > 1 else b""
    head = struct.pack(">IIII", 0, 7, 0, 1) + struct.pack(">III", 1 if root else 0, 0, 0) + struct.pack(">II", keyfile.MARKER, 1)
    table = lambda cells: b"".join(struct.pack(">HQ", 0, cells[level]) + null * 2 if level in cells else null * 3 for level in range(32))
    head += table({}) + table({0: first, **({1: 1} if root else {})}) + table({1: first + len(leaves) - 1} if root else {})
    head += struct.pack(">Q", 0) + b"\0" * 8 * 127 + struct.pack(">I", inline)
    path.write_bytes(head.ljust(keyfile.BLOCK, b"\0") + root + body + tail)


@pytest.mark.parametrize("prefix,split", [(b"", None), (b"w", None), (b"", 7)])
def test_keyfile(tmp_path, prefix, split):
    items = [(f"w{k:03d}".encode(), (str(k) * (40 if k % 5 == 0 else 1)).encode()) for k in range(40)]
    write_keyfile(tmp_path / "k", items, prefix, 30, split)
    f = keyfile.Keyfile(tmp_path / "k")
    assert f.count() == 40 and list(f.items()) == items and f.keys() == [k for k, _ in items]
    assert all(f.lookup(k) == v for k, v in items)
    assert [f.lookup(x) for x in ("", "a", "w", "w0005", "zz", "w999")] == [None] * 6
    with pytest.raises(KeyTooLongError):
        f.lookup(b"x" * 513)


def test_bad_keyfiles(tmp_path):
    write_keyfile(tmp_path / "k", [(b"a", b"1")])
    good = (tmp_path / "k").read_bytes()
    for at, value in ((0, 1), (4, 6), (28, 1), (32, 0)):
        bad = bytearray(good)
        struct.pack_into(">I", bad, at, value)
        (tmp_path / "b").write_bytes(bad)
        with pytest.raises(BadFormatError):
            keyfile.Keyfile(tmp_path / "b")


def document(fields):
    body, table = b"", b""
    for key, value in fields:
        table += struct.pack("<II", len(body), len(body) + len(key) + 1)
        body += key.encode() + b"\0" + value
    return body + table + struct.pack("<I", len(fields))


def test_compressed_collection(tmp_path):
    word = lambda n: struct.pack("<I", n)
    docs = [document([("#TEXT#", b"<b>hello</b>\0"), ("#CONTENT#", word(3)), ("#CONTENTLENGTH#", word(5)), ("docno", b"D1\0"), ("#POSITIONS#", b"\x01")]), document([("docno", b"D2\0")])]
    storage, offsets = b"", []
    for d in docs:
        offsets.append(len(storage))
        storage += zlib.compress(d)
    (tmp_path / "storage").write_bytes(storage)
    write_keyfile(tmp_path / "lookup", [(keyfile.encode_int(k + 1), struct.pack("<Q", o)) for k, o in enumerate(offsets)])
    c = keyfile.CompressedCollection(tmp_path)
    one, two = c.read(1), c.read(2)
    assert (one.get_text(), one.get_content(), one.positions, one.metadata) == ("<b>hello</b>", "hello", b"\x01", (("docno", b"D1\0"),))
    assert c.read(3) is None and [d for d, _ in c.items()] == [1, 2]
    for missing in (two.get_text, two.get_content):
        with pytest.raises(MissingFieldError):
            missing()
    with pytest.raises(BadFormatError):
        c.read(0)
    with pytest.raises(BadFormatError):
        keyfile.decode_document(document([("#TEXT#", b"x\0"), ("#CONTENT#", word(0))]))


def write_bulk_tree(path, leaves):
    def block(entries, leaf):
        data = bytearray(bulk_tree.BLOCK)
        struct.pack_into("<H", data, 0, len(entries) | (0x8000 if leaf else 0))
        at = 2
        for k, (key, value) in enumerate(entries):
            data[at : at + len(key)] = key
            data[at + len(key) : at + len(key) + len(value)] = value
            struct.pack_into("<HH", data, bulk_tree.BLOCK - 4 * (k + 1), at + len(key), at + len(key) + len(value))
            at += len(key) + len(value)
        return bytes(data)

    blocks = [block(x, True) for x in leaves]
    if len(leaves) > 1:
        blocks.append(block([(x[0][0], struct.pack("<I", k)) for k, x in enumerate(leaves)], False))
    path.write_bytes(b"".join(blocks))


@pytest.mark.parametrize("split", [100, 9])
def test_bulk_tree(tmp_path, split):
    words = sorted({f"key{k * 37 % 100:02d}".encode() for k in range(60)})
    items = [(w, str(len(w)).encode()) for w in words]
    write_bulk_tree(tmp_path / "t", [items[k : k + split] for k in range(0, len(items), split)])
    t = bulk_tree.BulkTree(tmp_path / "t")
    assert bulk_tree.is_maybe_bulk_tree(tmp_path / "t") and list(t.items()) == items
    assert all(t.find(k) == v for k, v in items) and t.find("absent") is None and t.find("zzz") is None
    (tmp_path / "bad").write_bytes(b"x")
    assert not bulk_tree.is_maybe_bulk_tree(tmp_path / "bad")
    with pytest.raises(BadFormatError):
        bulk_tree.BulkTree(tmp_path / "bad")


def test_term_data():
    value = b"".join(map(vbyte, (179, 5, 1717, 19, 100, 3, 79, 2)))
    assert bulk_tree.read_term_data(value, 2) == bulk_tree.TermData(179, 5, 1717, 19, ((100, 3), (79, 2)))


def test_parameters():
    p = parameters.parse("<parameters><indexes><index>a</index><index>b</index></indexes><stats><n> 6 </n><m>7</m></stats><one><x>1</x></one></parameters>")
    assert parameters.get(p, "indexes") == ["a", "b"] and parameters.get(p, "stats", "n") == "6" and parameters.get(p, "one") == ["1"] and parameters.get(p, "nope", "x") is None
    for bad in ("<other/>", "<parameters><a/><b/><a/></parameters>", "no xml"):
        with pytest.raises(BadFormatError):
            parameters.parse(bad)


def test_data_source(spark, tmp_path):
    tables.register(spark)
    index_folder(tmp_path / "i")
    read = lambda kind, path: spark.read.format("lexloom").option("kind", kind).option("blocksPerPartition", 1).load(str(path))
    assert {(r.term, r.doc_id, tuple(r.positions)) for r in read("postings", tmp_path / "i" / "postings").collect()} == {("the", d, tuple(p)) for d, p in DOCS}
    assert {(r.doc_id, r.length) for r in read("lengths", tmp_path / "i" / "lengths").collect()} == {(0, 4), (1, 0), (2, 7)}
    assert read("names", tmp_path / "i" / "names").where("name = 'd1'").first().doc_id == 1
    assert read("corpus", tmp_path / "i" / "corpus").first().metadata[1].value == "w"
    write_keyfile(tmp_path / "k", [(b"a", b"1"), (b"b", b"2")])
    assert {bytes(r.key): bytes(r.value) for r in read("keyfile", tmp_path / "k").collect()} == {b"a": b"1", b"b": b"2"}
