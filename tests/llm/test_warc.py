import hashlib

import pytest
import zstandard

from ridelens.llm import warc as W

BIG = "x" * 150 + "é"
PAGES = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (1, "http://a/3", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""),
         (None, "u", BIG), (None, "u", "lone " * 50), (7, "bad\r\nurl: x", "line\r\n\r\nWARC/1.1\r\n" * 30), (3, "http://a/2", BIG)]
PAGES += [(100 + i, "u", f"page {i % 40} " * 60) for i in range(300)]


def expected():
    raw = [(p, (h or "").encode()) for p, _, h in PAGES]
    out = []
    for p, b in raw:
        first = min((q for q, c in raw if c == b and q is not None), default=None) if len(b) >= 100 else None
        refers = first if first is not None and p != first else None
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def index(spark):
    return W.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), frame=5000, bundle=2000)


def test_round_trip(index):
    assert sorted([tuple(r) for r in W.read_records(index).collect()], key=str) == expected()


def test_lookup_by_id_reads_single_records(index):
    got = W.read_records(index.filter("page_id in (3, 7)"), payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(3, BIG.encode())] * 2 + [(7, ("line\r\n\r\nWARC/1.1\r\n" * 30).encode())]


def test_bundles_are_plain_zstandard_and_frames_are_independent(index):
    rows = index.collect()
    for path in {r.path for r in rows}:
        raw = open(path.removeprefix("file:").replace("//", "/"), "rb").read()
        whole = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True): r.read(1 << 20), b""))
        fs, inner = W.pafs.FileSystem.from_uri(path)
        frames = W.read_seek_table(fs.open_input_file(inner))
        assert sum(f[2] for f in frames) == len(whole)
        assert len(frames) > 1 or len(whole) < 7000
        mine = sorted((r.frame, r.offset, r.length) for r in rows if r.path == path)
        assert sum(n for _, _, n in mine) == len(whole)


def test_empty_table(spark):
    index = W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and W.read_records(index).count() == 0


def test_schemes_of_folders(tmp_path):
    assert W.open_fs(str(tmp_path))[1] == str(tmp_path) and W.open_fs(f"file://{tmp_path}")[1] == str(tmp_path)
    assert W.open_fs(f"file:{tmp_path}")[1] == str(tmp_path)
    for scheme in ("dbfs", "wasbs"):
        with pytest.raises(ValueError, match="no file system"):
            W.open_fs(f"{scheme}://x/y")
