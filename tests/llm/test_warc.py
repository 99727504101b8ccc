import base64
import gzip
import hashlib
import pathlib
import random

from maskwright.llm import warc
from maskwright.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, shard int, digest string"
ROWS = [
    (1, "http://a/1", "same", 1, "x"), (7, "http://a/7", "same", 1, "x"), (3, None, "same", 1, "x"), (4, "http://a b/4", "é" * 50, 1, "x"),
    (5, "u", None, 1, "x"), (6, "u", "", None, None), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n", 1, "x"), (9, "u", "long " * 200_000, 1, "x"),
    (None, "n", "no id", 1, "x"), (10, "r", "again", 1, "x"), (10, "r", "again", 1, "x"), (11, "r", "again 2", 1, "x"), (11, "r", "other", 1, "x"),
]


def brute(rows, least=0):
    groups = {}
    for i, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = max((i for i in ids if i is not None), default=None)
        dup = len(ids) > 1 and len(data) >= least
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i))):
            response = not dup or (i == top and i not in sorted(ids, key=lambda i: (i is not None, i))[:k])
            out.append((i, len(data), digest, "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == brute(ROWS)
    assert sorted(map(tuple, warc.round_trip(pages, 6).collect()), key=str) == brute(ROWS, 6)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files_are_the_same_whatever_the_partitions(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * (i % 37), 0, "") for i in range(400)]
    seen = []
    for parts in (1, 5):
        folder = shared_dir(spark, "warc-test")
        manifest = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(parts), folder, shard_bytes=20_000, file_bytes=3_000)
        files = sorted(pathlib.Path(folder.removeprefix("file://")).iterdir())
        assert [f.name for f in files if f.suffix == ".tmp"] == []
        assert sorted(r.path for r in manifest.collect()) == [f"file://{f}" for f in files]
        assert {r.path.rpartition("/")[2]: r.sha256 for r in manifest.collect()} == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in files}
        assert manifest.agg({"records": "sum"}).first()[0] == 400 and len(files) > 10
        seen.append({f.name: f.read_bytes() for f in files})
    assert seen[0] == seen[1]
    ids = []
    for name in sorted(seen[0]):
        text = gzip.decompress(seen[0][name]).decode()
        ids += [int(x.split("\r\n")[0]) for x in text.split("X-Page-Id: ")[1:]]
    assert ids == sorted(ids)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.read(warc.write(pages, shared_dir(spark, "warc-test"))).where("record_type = 'response'").collect()
    want = {(i, hashlib.sha1((h or "").encode()).digest()): (h or "").encode() for i, _, h, *_ in ROWS}
    for r in got:
        assert bytes(r.payload) == want[r.page_id, base64.b32decode(r.payload_digest)]
        assert r.page_id != 4 or r.url == "http://ab/4"


def test_shards_are_even_and_files_roll_whatever_the_ids(spark):
    rng = random.Random(4)
    page = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(i, "u", page(4000)) for i in range(200)]
    rows += [(2**62, "far", page(4000)), (-(2**63), "low", page(4000))]  # outliers
    rows += [(77, f"u{i}", page(4000)) for i in range(150)]  # one id in a third of the rows
    rows += [(None, "n", page(4000)) for _ in range(100)]  # none
    rows += [(5000 + i % 2, "same", "s" * 9000) for i in range(300)]  # a payload and few ids in many rows
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write(pages, folder, shard_bytes=100_000, file_bytes=20_000)
    by_shard = {}
    for r in manifest.collect():
        by_shard.setdefault(r.shard, []).append(r.bytes)
    total = 452 * 4600 + 9600 + 299 * 600
    assert abs(len(by_shard) - total / 100_000) <= 2
    # Letters at random shrink to about half; revisits to less.
    assert all(len(files) > 1 and max(files) <= 20_000 + 3_000 for n, files in by_shard.items() if n < max(by_shard) - 4)
    assert max(map(sum, by_shard.values())) <= 1.2 * 100_000
    got = sorted(map(tuple, warc.read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute([(i, u, h) for i, u, h in rows])


def test_sizes_follow_the_table():
    assert warc.SHARD_BYTES[0] // warc.FILES < warc.SHARD_BYTES[0] and warc.SHARD_BYTES[1] // warc.FILES == 10**9
