import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverine.errors import InvalidData, VerificationFailure
from quiverine.operators import attributes as A
from quiverine.operators.index import IndexBuilder
from quiverine.operators.vectors import from_block
from quiverine.sources import interchange, messages

# Messages as the format's definition spells them.
SPELLED = [
    ("attribute_value", {"string_value": "string", "uint64_value": None}, b"\x0a\x06string"),
    ("attribute_value", {"string_value": None, "uint64_value": 0}, b"\x10\x00"),
    ("attribute_value", {"string_value": None, "uint64_value": 300}, b"\x10\xac\x02"),
    ("uuid", {"upper": 1, "lower": 0x0102030405060708}, b"\x09\x01\0\0\0\0\0\0\0\x11\x08\x07\x06\x05\x04\x03\x02\x01"),
    ("encoded_vector_set", {"vector_size": 3, "data": [1, 2, 300]}, b"\x08\x03\x52\x04\x01\x02\xac\x02"),
    ("vector_set", {"vector_size": 2, "data": [0.0, 1.0]}, b"\x08\x02\x52\x08\0\0\0\0\0\0\x80\x3f"),
]


@pytest.mark.parametrize(("kind", "message", "data"), SPELLED)
def test_messages_as_spelled(kind, message, data):
    assert messages.dump(kind, message) == data
    back = messages.parse(kind, data)
    for name, value in message.items():
        assert (list(back[name]) if isinstance(value, list) else back[name]) == value


def test_numbers_of_all_lengths():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**32 - 1], np.uint64)
    assert messages.read_varints(messages.write_varints(values)).tolist() == values.tolist()
    assert messages.write_varints(values) == b"".join(messages.write_varint(int(v)) for v in values)
    for v in (0, 5, 2**64 - 1):
        assert messages.read_varint(messages.write_varint(v), 0)[0] == v


def test_cut_messages_and_unknown_fields():
    data = messages.dump("database", {"vector_size": 8, "partition_ids": ["a", ""], "attribute_names": ["n"]})
    assert messages.parse("database", data + b"\xa0\x06\x05" + b"\xaa\x06\x02xy")["partition_ids"] == ["a", ""]
    for end in range(1, len(data)):
        try:
            messages.parse("database", data[:end])
        except InvalidData:
            pass
    with pytest.raises(InvalidData):
        messages.parse("database", data[:-1])


def test_compressed_files_must_be_whole():
    data = zlib.compress(b"content")
    assert interchange.inflate(data) == b"content"
    for bad in (data[:-2], data + b"x", b"plain"):
        with pytest.raises(InvalidData):
            interchange.inflate(bad)


def test_ids_in_halves():
    text = "a1a2a3a4-b1b2-c1c2-d1d2-d3d4d5d6d7d8"
    assert interchange.uuid_of(text) == {"upper": 0xA1A2A3A4B1B2C1C2, "lower": 0xD1D2D3D4D5D6D7D8}
    assert interchange.text_of(interchange.uuid_of(text)) == text
    with pytest.raises(InvalidData):
        interchange.text_of(None)


def test_an_index_comes_back(spark, tmp_path):
    rows = np.random.default_rng(1).normal(size=(120, 8)).astype(np.float32).astype(float)
    index = IndexBuilder(4, 2, 8, rounds=5).build(from_block(spark, rows, 8), "vec_ord", "vec")
    index.centroids, index.books = (x.astype(np.float32).astype(float) for x in (index.centroids, index.books))
    index = index.set_attribute_at(0, "n", (1 << 64) - 1).set_attribute_at(1, "s", "").set_attribute_at(2, "n", 0)
    folder = str(tmp_path / "messages")
    name = interchange.export(index, folder)
    assert interchange.find_header(spark, folder) == name
    back = interchange.load(spark, folder)
    assert back.names() == ["n", "s"]
    key = lambda i: sorted(tuple(map(str, (r["partition_index"], r["vector_index"], r["vector_id"], r["codes"]))) for r in i.encoded.collect())
    assert key(back) == key(index)
    assert [tuple(r) for r in back.query(rows[0], 7, 2).collect()] == [tuple(r) for r in index.query(rows[0], 7, 2).collect()]
    assert back.search(rows[0], 7, 2) == index.search(rows[0], 7, 2)
    near = back.probed(rows[0], 2)
    files = {Path(f).name.removesuffix(".binpb") for f in back.query(rows[0], 7, 2).inputFiles()}
    assert files == {back.head["partition_ids"][p] for p in near}  # and no others
    for r in back.search(rows[0], 120, 4):
        assert back.get_attribute(r.vector_id, "n", r.partition_index) == index.get_attribute(r.vector_id, "n")
    ids = {r["vec_ord"]: r["vector_id"] for r in index.encoded.collect()}
    assert [back.get_attribute(ids[k], n) for k, n in ((0, "n"), (1, "s"), (2, "n"), (3, "n"))] == [(1 << 64) - 1, "", 0, None]
    parts = {"codebooks": lambda i: i.search(rows[0], 1, 4), "partitions": lambda i: i.query(rows[0], 1, 4).collect(), "attributes": lambda i: i.attributes().collect()}
    for where, ask in parts.items():
        for victim in sorted((tmp_path / "messages" / where).glob("*.binpb")):
            whole = victim.read_bytes()
            victim.write_bytes(whole[:-1] + bytes([whole[-1] ^ 0x7F]))
            crc = victim.with_name(f".{victim.name}.crc")
            for _ in range(2):  # with the file system's checksum, and without
                with pytest.raises(VerificationFailure):
                    ask(interchange.load(spark, folder))
                crc.unlink(missing_ok=True)
            victim.write_bytes(whole)


def test_names_that_sources_hide(spark, tmp_path):
    """A digest may begin with an underscore."""
    rows = np.random.default_rng(2).normal(size=(300, 4))
    index = IndexBuilder(60, 2, 4, rounds=3).build(from_block(spark, rows, 4), "vec_ord", "vec")
    index = index.set_attributes(index.rows().select("vec_ord", A.number_value(F.col("vec_ord")).alias("value")), "n")
    folder = str(tmp_path / "messages")
    interchange.export(index, folder)
    back = interchange.load(spark, folder)
    names = [*back.head["partition_ids"], *back.head["attributes_log_ids"]]
    assert any(n.startswith("_") for n in names)
    assert back.num_vectors == 300
    found = back.with_attribute(back.rows(), "n").join(index.rows().select("vector_id", "vec_ord"), "vector_id")
    assert {(r["vec_ord"], int(r["value"]["uint64_value"])) for r in found.collect()} == {(k, k) for k in range(300)}
