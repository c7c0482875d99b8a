import hashlib

from quire.llm import common, warc
from quire.llm.common import work_path


def archive(n=6, size=3000):
    members = [warc.member(warc.record(k, f"http://x/{k}", bytes([65 + k]) * size, hashlib.sha1(bytes([65 + k]) * size).hexdigest())) for k in range(n)]
    places = [0]
    for x in members:
        places.append(places[-1] + len(x))
    return b"".join(members), places


def salvaged(tmp_path, data):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    return [(a, a + n if inner is None else None, record and record.headers["warc-record-id"], why) for a, inner, n, record, why in warc.salvage(str(path))]


def test_damage_loses_only_the_record_it_hits(tmp_path):
    data, at = archive()
    broken = bytearray(data)
    broken[at[2] + 40 : at[2] + 60] = b"\0" * 20
    found = salvaged(tmp_path, bytes(broken))
    assert [x[2] for x in found] == ["<urn:page:0>", "<urn:page:1>", None, "<urn:page:3>", "<urn:page:4>", "<urn:page:5>"]
    assert found[2][:2] == (at[2], at[3]) and found[2][3]


def test_junk_between_records_and_a_cut_end_are_gaps(tmp_path):
    data, at = archive()
    found = salvaged(tmp_path, b"junk \x1f\x8b\x08 WARC/1.1 no" + data[: at[3]] + b"\x1f\x8b\x08\x00" + data[at[3] : at[5] + 30])
    assert [x[2] for x in found] == [None, *(f"<urn:page:{k}>" for k in range(3)), None, "<urn:page:3>", "<urn:page:4>", None]


def test_plain_records_are_read_and_a_wrong_digest_is_a_gap(tmp_path):
    plain = [warc.record(k, None, b"p" * 50, "d") for k in range(3)]
    bad = plain[1].replace(b"ppp", b"qpp", 1)
    assert [x[2] for x in salvaged(tmp_path, plain[0] + bad + plain[2])] == ["<urn:page:0>", None, "<urn:page:2>"]
    assert salvaged(tmp_path, b"") == [] and salvaged(tmp_path, b"nothing here") == [(0, 12, None, "no version line or no end of headers")]


def test_every_single_byte_flip_keeps_the_other_records(tmp_path):
    data, at = archive(3, 200)
    for k in range(at[1], at[2], 7):
        flipped = bytearray(data)
        flipped[k] ^= 0xFF
        ids = [x[2] for x in salvaged(tmp_path, bytes(flipped))]
        assert "<urn:page:0>" in ids and "<urn:page:2>" in ids


def test_hard_rows(spark):
    big = "é" * 600
    pages = [(1, "u", big, 1), (2, "u\r\nX: y", big, 2), (3, None, "small", 3), (4, "u", "small", 4), (5, "u", None, 5), (6, "u", "", 6), (None, "u", big, 7), (9, "u", "z" * 1000, 8), (9, "u", "z" * 1000, 9), (8, "u", "z" * 1000, 9), (10, "u", "y" * 200_000, 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest int")
    found = warc.read_archives(warc.write_archives(df, work_path(spark, "w"))).select("page", "payload_bytes", "payload_digest", "kind", "refers_to").collect()
    digest = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    largest = {}
    for i, _, h, _ in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(i, largest.get(h, 0))
    expected = []
    for i, _, h, _ in pages:
        owner = largest.get(h)
        again = owner is not None and owner != i
        expected.append((None if i is None else str(i), len((h or "").encode()), digest(h), "revisit" if again else "response", str(owner) if again else None))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert warc.read_archives(warc.write_archives(df.limit(0), work_path(spark, "w"))).collect() == []


def test_small_shards_hold_the_same(spark):
    df = spark.createDataFrame([(k, "u", f"page {k} " * 300) for k in range(40)], "page_id bigint, url string, html string")
    files = warc.write_archives(df, work_path(spark, "w"), shard=2000)
    assert files.count() > 4 and files.agg({"n_records": "sum"}).first()[0] == 40
    assert {r.page for r in warc.read_archives(files).collect()} == {str(k) for k in range(40)}


def test_members_of_several_records(tmp_path):
    parts = [warc.record(k, None, bytes([65 + k]) * 100, "d") for k in range(4)]
    ids = lambda data: [x[2] for x in salvaged(tmp_path, data)]
    whole = [f"<urn:page:{k}>" for k in range(4)]
    assert ids(warc.member(b"".join(parts))) == whole
    bad = parts[1].replace(b"BBB", b"BXB", 1)
    assert ids(warc.member(parts[0] + bad + b"junk WARC/1.1 " + parts[2]) + warc.member(parts[3])) == [whole[0], None, *whole[2:]]
    cut = warc.member(b"".join(parts) + bytes(range(256)) * 4000)[:-2000]  # what was proven before the cut stays
    assert [x for x in ids(cut) if x] == whole and None in ids(cut)
    bare = [x.replace(b"WARC-Block-Digest", b"Other") for x in parts]
    assert ids(warc.member(b"".join(bare))) == whole and ids(warc.member(b"".join(bare))[:-5]) == [None]


def test_records_and_headers_of_any_size(tmp_path):
    payload = bytes(range(256)) * 50_000
    big = warc.record(1, None, payload, hashlib.sha1(payload).hexdigest())
    long = big.replace(b"\r\nContent-Type", b"\r\nX-Long: " + b"y" * 300_000 + b"\r\nContent-Type", 1)
    for data in (big, warc.member(big), long, warc.member(long)):
        (tmp_path / "a").write_bytes(data)
        [(_, _, _, record, why)] = warc.salvage(str(tmp_path / "a"))
        assert (record.payload_bytes, record.payload_digest, why) == (len(payload), hashlib.sha1(payload).hexdigest(), "")


def test_without_a_broadcast_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT", 2)
    test_hard_rows(spark)
