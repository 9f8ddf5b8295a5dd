import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest

from lettermill.llm import packing
from lettermill.llm.packing import Bm25, fill, pack
from lettermill.llm.warczip import _store, archived, data_start, directory, index_line, parse, read_packages, record


def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [("wort %d und noch ein Satz, here is more text. " % i) * (i % 90) for i in range(300)] + [None, "", "<|endoftext|> x <|endoftext|>", "日本語 emoji 🤦🏼‍♂️ \x00", "lang " * 9000, "gleich " * 30, "gleich " * 30]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "ohne id", "x")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, start string"), shard=64).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of_doc, of_sequence = {}, {}
    for r in got:
        of_doc.setdefault(r.doc_id, []).append(r)
        of_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(of_doc) == len(rows)
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(of_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for s in of_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        short += at < 1024
    assert short <= 12  # one for each index shard
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours_fill_the_window():
    rnd = np.random.default_rng(2)
    bags = [rnd.integers(100 * (k % 4), 100 * (k % 4) + 60, 40) for k in range(40)]
    index = Bm25(bags)
    seed, n = bags[0], len(bags)
    df = {t: sum(t in b for b in bags) for t in set(seed.tolist())}
    rare = sorted((t for t in df if df[t] > 1), key=lambda t: (-np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)), t))[:24]
    mean = np.mean([len(b) for b in bags])
    want = [sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * (tf := int((b == t).sum())) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in rare if t in b) for b in bags]
    assert np.allclose(index.scores(seed), want)
    sequences = list(fill(bags, 100))
    assert sum(b - a for s in sequences for _, a, b in s) == sum(map(len, bags)) and all(sum(b - a for _, a, b in s) == 100 for s in sequences[:-1])
    assert np.mean([len({i % 4 for i, _, _ in s}) == 1 for s in sequences]) > 0.6


def test_neighbours_from_the_whole_table(spark):
    """Documents of 40 subjects, dealt over a table of ten index shards, share windows; df and mean length are the table's."""
    rnd = np.random.default_rng(5)
    words = [[f"{a}{k}{b}" for a in "bdfgklmn" for b in "aeiou"] for k in range(40)]
    texts = [(i, " ".join(rnd.choice(words[i % 40], 12))) for i in range(640)]
    got = pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), window=512, shard=64).collect()
    assert sorted({r.doc_id for r in got}) == list(range(640))
    of_sequence = {}
    for r in got:
        of_sequence.setdefault(r.sequence_id, []).append(r.doc_id % 40)
    assert np.mean([max(s.count(k) for k in s) / len(s) for s in of_sequence.values()]) > 0.6
    bags = [rnd.integers(0, 30, 20) for _ in range(6)]
    df = np.full(30, 500)
    index = Bm25(bags[:3], (1000, 40.0, df))
    want = [sum(np.log1p(500.5 / 500.5) * (tf := int((b == t).sum())) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 20 / 40)) for t in set(bags[0].tolist()) if sum(t in x for x in bags[:3]) > 1) for b in bags[:3]]
    assert np.allclose(index.scores(bags[0]), want)


def test_all_terms_of_a_seed_count():
    """A neighbour that shares 30 terms with the seed, none of them among its 24 rarest, comes before longer remainders that share none."""
    near, far, other = np.arange(24), np.arange(24, 54), np.arange(200, 251)
    bags = [np.arange(54), near, far, far, far, other, other]
    n, mean = len(bags), np.mean([len(b) for b in bags])
    df = [sum(t in b for b in bags) for t in range(54)]
    want = [sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in range(54) if t in b) for b in bags]
    assert np.allclose(Bm25(bags).scores(bags[0], None), want) and min(want[:5]) > 0
    assert [i for i, _, _ in next(fill(bags, 108))] == [0, 1, 2]


def test_packages_with_zip64():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open(zipfile.ZipInfo("archive/é.warc"), "w", force_zip64=True) as m:
            m.write(b"x" * 1000)
        z.writestr("indexes/i", b"abc", compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK is no end"
    members = directory(raw, len(raw.getvalue()))
    m = members["archive/é.warc"]
    start = data_start(raw, m)
    assert m.size == 1000 and raw.getvalue()[start : start + 1000] == b"x" * 1000
    with pytest.raises(ValueError):
        data_start(raw, members["indexes/i"])
    with pytest.raises(ValueError):
        directory(io.BytesIO(b"nothing"), 7)
    # more members than a plain directory can count
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(65_600):
            z.writestr(str(i), b"")
    found = directory(many, len(many.getvalue()))
    assert len(found) == 65_600 and found["65599"].header > 0


def test_directories_at_their_limits():
    # as many members as a plain directory can count, and a comment with the end record's own signature
    for n, comment in ((65_535, b""), (3, b"PK\x05\x06" + b"x" * 30), (2, b"x" * 40 + b"PK\x05\x06" + b"\0" * 18)):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for i in range(n):
                z.writestr(str(i), b"")
            z.comment = comment
        assert len(directory(raw, len(raw.getvalue()))) == n
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"x")
    locked = bytearray(raw.getvalue())
    locked[locked.rfind(b"PK\x01\x02") + 8] |= 1
    raw = io.BytesIO(bytes(locked))
    with pytest.raises(ValueError, match="encrypted"):
        data_start(raw, directory(raw, len(locked))["a"])


def test_every_archive_of_a_package(spark, tmp_path):
    """Two archives with indexes of their own, one that no index names, and one that is named in part."""
    import json

    def made(i):
        body = f"seite {i} ".encode() * 30
        return record("response", i, "http://a.example/x y", body, hashlib.sha256(body).hexdigest(), None)

    with zipfile.ZipFile(tmp_path / "p.wacz", "w") as z:
        i = 0
        for name, known in (("a", 3), ("b", 2), ("c", 0), ("d", 1)):
            data, lines = b"", []
            for k in range(3):
                raw = made(i)
                if k < known:
                    lines.append("key 1970 " + json.dumps({"filename": f"{name}.warc.gz", "offset": str(len(data)), "length": len(raw)}))
                data, i = data + raw, i + 1
            z.writestr(f"archive/{name}.warc.gz", data)
            if lines:
                z.writestr(f"indexes/{name}.cdxj", "\n".join(lines))
    got = read_packages(spark, spark.createDataFrame([(str(tmp_path / "p.wacz"),)], "path string")).collect()
    assert sorted((r.page_id, r.payload) for r in got) == [(i, f"seite {i} " * 30) for i in range(12)]
    assert index_line("http://Www.a.example/B c", "d", 5, 7).split(" ")[:2] == ["example,a,www)/b%20c", "19700101000000"]
    with pytest.raises(ValueError, match="scheme viewfs"):
        _store("viewfs://store/x")


def test_record_round_trip():
    r = parse(record("response", 3, "http://a b", "é\r\n\r\n".encode(), hashlib.sha256("é\r\n\r\n".encode()).hexdigest(), None))
    assert r["payload"] == "é\r\n\r\n".encode() and r["length"] == 6
    r = parse(record("revisit", 4, None, b"x" * 200, "d", 3))
    assert r["payload"] is None and r["length"] == 200 and r["fields"]["WARC-Refers-To"] == "<urn:page:3>"


def test_archived(spark):
    long = "<p>" + "é" * 60
    rows = [(5, "u", long, 1), (3, None, long, 1), (9, "u", long, 1), (1, "u", "kurz", 1), (2, "u", "kurz", 1), (4, "u", None, 1), (6, "u", "", 1), (None, "u", long, 1), (7, "u", "y" * 400_000, 1), (3, None, long, 1)]
    got = archived(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        again = html == long and r.page_id not in (3, None)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 3, None) if again else ("response", None, html))
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_runs_of_white_space(spark):
    """Two megabytes of blanks, line ends and tabs: the ids of the tokenizer file, each in exactly one piece."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [c * 2_000_000 for c in (" ", "\n", "\t")] + ["Wort " + " " * 9_999 + "x", "a" + "\u2003" * 12_000 + "b", "kurz"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packages_made_elsewhere(spark, tmp_path):
    """Records of all types, ids that are no pages, chunked bodies, digests of other hashes, plain archives and upper-case names."""
    import base64
    import gzip

    def made(kind, number, block, more=(), content="application/http; msgtype=response", version="WARC/1.0"):
        head = [version, f"warc-type:{kind}", f"WARC-Record-ID: <urn:uuid:{number:08}-0000-4000-8000-000000000000>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    sha1 = lambda body: "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    body, binary = b"hallo " * 50, bytes(range(256))
    chunked = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n" + b"64;x=1\r\n" + body[:100] + b"\r\n" + b"c8\r\n" + body[100:] + b"\r\n0\r\n\r\n"
    records = [
        made("warcinfo", 1, b"software: x\r\n", content="application/warc-fields"),
        made("request", 2, b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n", content="application/http; msgtype=request"),
        made("response", 3, chunked, ["WARC-Target-URI: http://a.example/", sha1(body)]),
        made("response", 4, b"HTTP/1.0 200 OK\r\nServer: y\r\n\r\n" + binary, [sha1(binary)]),
        made("revisit", 5, b"HTTP/1.1 304 Not Modified\r\n\r\n", [sha1(body), "WARC-Refers-To: <urn:uuid:00000003-0000-4000-8000-000000000000>"]),
        made("metadata", 6, b"a: b", content="text/plain"), made("response", 7, b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nabc", ["WARC-Truncated: length", "WARC-Payload-Digest: sha1:AAAA"]),
    ]
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("archive/", b"")
        z.writestr("archive/one.WARC.GZ", b"".join(map(gzip.compress, records)))
        z.writestr("archive/two.warc", b"".join(records))
        z.writestr("indexes/index.cdxj", '!meta 0 {"format": "cdxj"}\n CDX N b a\nkey 2024 ' + '{"filename": "archive/two.warc", "offset": 0, "length": "%d"}' % len(records[0]))
        z.writestr("datapackage.json", b"{}")
    read = lambda name: read_packages(spark, spark.createDataFrame([(str(tmp_path / name),)], "path string")).collect()
    got = sorted(read("a.wacz"), key=lambda r: r.record_id)
    assert [r.record_type for r in got[::2]] == [r.record_type for r in got[1::2]] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "response"]
    for one, two in zip(got[::2], got[1::2], strict=True):
        assert one == two and one.page_id is None and one.refers_to is None
    info, asked, page, raw, again, about, short = got[::2]
    assert (info.payload, asked.payload, about.payload, short.payload) == ("software: x\r\n", "", "a: b", "abc")
    assert (page.payload, page.payload_bytes, page.payload_digest, page.url) == (body.decode(), 300, hashlib.sha256(body).hexdigest(), "http://a.example/")
    assert raw.payload == binary.decode("utf-8", "replace") and raw.payload_bytes == 256 and raw.payload_digest == hashlib.sha256(binary).hexdigest()
    assert again.payload is None and again.payload_bytes is None and again.refers_to_id == page.record_id and again.payload_digest.startswith("sha1:")
    for name, what in (("archive/readme.txt", "archive/readme.txt is no archive"), ("archive/x.warc", "does not match its digest")):
        bad = made("response", 8, b"HTTP/1.1 200 OK\r\n\r\nother", [sha1(body)])
        with zipfile.ZipFile(tmp_path / "b.wacz", "w") as z:
            z.writestr(name, bad)
        with pytest.raises(Exception, match=what):
            read("b.wacz")
    with zipfile.ZipFile(tmp_path / "c.wacz", "w") as z:
        z.writestr("archive/x.warc", records[0][:-30])
    with pytest.raises(Exception, match="ends"):
        read("c.wacz")


def test_repeated_terms_count_once():
    held = packing._added(np.zeros(0, np.int64), np.array([3, 1, 3, 3], "<u4"))
    assert packing._added(held, np.array([1, 5, 5], "<u4")).tolist() == [0, 2, 0, 1, 0, 1]
