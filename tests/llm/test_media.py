import hashlib
import io
import tarfile
import zlib

from quire.llm import common, media
from quire.llm.common import local_file, work_path

from .helpers import docs, hard


def padded(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 or (64 if not b else 0))


def test_images_give_their_payload_back():
    for payload in (bytes(64), bytes(range(256)), b"x" * 64000):
        image = media.encode(payload)
        assert media.decode(image) == payload and media.header(image[: media.HEADER]) == (len(payload), 1, 8)


def test_hard_rows(spark):
    ids, texts = hard()
    texts[2], texts[3] = "a", "a\0"
    got = media.media_columns(docs(spark, texts, ids), work_path(spark, "m")).collect()
    expected = []
    for i, t in zip(ids, texts):
        p = padded(t)
        image = media.encode(p)
        expected.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(p), len(p)))
    rows = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.width) for r in got]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert media.media_columns(docs(spark, []), work_path(spark, "m")).collect() == []


def test_each_payload_is_stored_once_in_a_readable_tar(spark):
    texts = ["same"] * 20 + ["other", None, ""]
    folder = work_path(spark, "m")
    rows = media.media_columns(docs(spark, texts), folder).collect()
    assert len({(r.shard, r.offset) for r in rows}) == 3
    names = []
    for shard in {r.shard for r in rows}:
        fs, inner = local_file(shard)
        with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(inner).read())) as tar:
            for x in tar.getmembers():
                names.append(x.name[3:-4])
                assert hashlib.sha256(media.decode(tar.extractfile(x).read())).hexdigest() == names[-1]
    assert sorted(names) == sorted({r.digest for r in rows})


def test_metadata_needs_the_header_alone(spark):
    folder = work_path(spark, "m")
    df = docs(spark, ["abc" * 100]).selectExpr("'d' AS digest", "cast(repeat('x', 128) AS binary) AS payload")
    manifest = media.store(df, folder)
    row = manifest.first()
    fs, inner = local_file(row.shard)
    data = bytearray(fs.open_input_file(inner).read())
    data[row.offset + media.HEADER :] = bytes(len(data) - row.offset - media.HEADER)
    with fs.open_output_stream(inner) as out:
        out.write(bytes(data))
    assert media.filled(manifest, whole=False).first()[4:] == (128, 1, 8)


def test_without_a_broadcast_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT", 2)
    test_hard_rows(spark)
    test_each_payload_is_stored_once_in_a_readable_tar(spark)
