"""Archives that mix plain records and gzip bytes, and members that are cut."""

import gzip

from loomgraph.llm import warc


def records(*payloads):
    return [warc.record(i, "u", p, warc._sha1(p), i, "2024-01-01T00:00:00Z") for i, p in enumerate(payloads)]


def pages(data):
    return [x["page_id"] for _, _, x in warc.salvage(data) if isinstance(x, dict)]


def test_plain_archive_with_gzip_bytes_in_a_payload():
    made = records(b"a", gzip.compress(b"inner"), b"\x1f\x8b\x08 by chance", b"d")
    assert pages(b"".join(made)) == [0, 1, 2, 3]
    assert pages(made[0] + made[1][:-20] + made[3]) == [0, 3]


def test_plain_records_between_members_and_in_gaps():
    made = records(b"a", b"b", b"c", b"d")
    assert pages(warc.member(made[0]) + made[1] + warc.member(made[2]) + b"junk\n" + made[3]) == [0, 1, 2, 3]


def test_whole_records_of_a_broken_member():
    made = records(b"a" * 100, bytes(range(256)) * 20, b"c")
    packed = warc.member(b"".join(made))
    assert pages(packed[:-12])[:2] == [0, 1]
    found = list(warc.salvage(packed[:-12] + warc.member(made[2])))
    assert sum(isinstance(x, str) for _, _, x in found) >= 1 and found[-1][2]["page_id"] == 2
