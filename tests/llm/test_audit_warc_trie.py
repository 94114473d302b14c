"""Filter audit, WARC archives and prefix trie against brute force, with nulls, ties, repeats, clashing names and empty tables."""

import base64
import hashlib
import io
import random
import re
import struct
import zlib
from itertools import permutations

import pytest
import zstandard
from pyspark.sql import functions as F

from quillgraph.llm import filter_audit, prefix_trie, warc

# --------------------------------------------------------------------------- filter audit


def _fails(rows):
    """Letters that each (doc_id, text) fails, by the contract's words."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x in rows):
            bad.add("E")
        out.append(bad)
    return out


def _audit(rows, parts, labels):
    fails, out = _fails(rows), {}
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for part in set(parts):
        mine = [(rows[k][0], fails[k]) for k in range(len(rows)) if parts[k] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(here)
                failing = sum(f in x[1] for x in mine)
                alone = sum(x[1] == {f} for x in mine)
                marked = [sum(i in s for i, _ in here if i is not None) for s in (good, toxic)]
                out[part, order, step] = [len(left), len(here), failing - len(here), alone, *marked]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return out


def _words(n, seed, alphabet="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(6)) + str(k) for k in range(n))


AUDIT_ROWS = [
    (5, _words(120, 1)), (3, _words(120, 1)), (9, _words(120, 1) + " "), (9, _words(120, 1) + " "), (10, _words(120, 1) + " "),
    (1, None), (2, ""), (None, ""), (None, _words(120, 1)), (4, "A B C"), (6, "x " * 300), (7, _words(100, 2) + " #"),
    (8, _words(99, 3) + "　tail"), (11, _words(150, 4, "ABCDEF")), (12, "é" * 90 + "A" * 10), (13, "é" * 89 + "A" * 10), (14, _words(130, 5)),
]
AUDIT_PARTS = ["en", "en", None, "de", "en", None, "en", "en", "", "de", "de", "en", "en", "de", "fr", "fr", "fr"]
AUDIT_LABELS = [(5, 1, 0), (3, 1, 1), (9, 0, 1), (9, 1, None), (2, None, 1), (4, 1, 1), (99, 1, 1), (None, 1, 1), (14, 1, 0)]


def _audited(spark, rows, parts, labels, **options):
    full = [(i, t, p, 1, "x", 7) for (i, t), p in zip(rows, parts)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, mask int, first string, part int")
    masks = filter_audit.masked(docs, **options)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(3))
    found = filter_audit.audit(filter_audit.mask_counts(masks, said))
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in found.collect()}


def test_audit_equals_all_orders_counted(spark):
    want = _audit(AUDIT_ROWS, [p or "" for p in AUDIT_PARTS], AUDIT_LABELS)
    assert _audited(spark, AUDIT_ROWS, AUDIT_PARTS, AUDIT_LABELS) == want
    assert {p for p, _, _ in want} == {"en", "", "de", "fr"} and len(want) == 4 * 600


def test_audit_of_heavy_copies_and_of_nothing(spark):
    rows = [(i, "same text") for i in range(1, 300)] + [(i, _words(110, i)) for i in range(300, 320)]
    parts = ["en" if i % 3 else "de" for i in range(len(rows))]
    assert _audited(spark, rows, parts, [(7, 1, 1)], heavy_share=10) == _audit(rows, parts, [(7, 1, 1)])
    assert _audited(spark, [], [], []) == {}


def test_texts_of_many_millions_of_characters(spark):
    """A hundred times the capitals of a text of 30 million passes what an int holds."""
    rows = spark.range(1).select(F.repeat(F.lit("A"), 30_000_000).alias("t"))
    fails = {k: v.alias(k) for k, v in filter_audit.local_failures(F.col("t")).items()}
    assert rows.select(*fails.values()).head().asDict() == {"A": True, "B": False, "C": True, "D": False}


def test_polynomial_corners_and_integral_are_exact():
    r = random.Random(5)
    counts = {m: r.randrange(10**15) for m in range(32)}
    p = filter_audit.RemovalPolynomial(counts, 5)
    for s in range(32):
        assert p.corner(s) == sum(c for m, c in counts.items() if m & s)
    for i in range(5):
        by_size = sum(120 * c // m.bit_count() for m, c in counts.items() if m >> i & 1)
        assert p.shapley(i) * 120 == by_size
    assert sum(p.shapley(i) for i in range(5)) == p.corner(31)


# --------------------------------------------------------------------------- archives


def _archive(records):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


def _page(i, payload=b"<p>x</p>", refers=None):
    digest = warc.base32_sha1(payload)
    return warc.page_record(i, f"http://h/{i}", payload, digest, len(payload), refers and warc.record_id(refers, digest))


def test_archive_has_a_dictionary_frame_and_one_frame_a_record():
    pages = [f"<html><body><p>{_words(40, k)}</p></body></html>".encode() for k in range(800)]
    data = _archive([warc.info_record()] + [_page(k, p) for k, p in enumerate(pages)])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    rest, seen = data[8 + size :], 0
    while rest:  # the library's own frame ends agree with those walked by block headers
        frame = reader.decompressobj()
        assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, seen = frame.unused_data, seen + 1
    assert seen == 801
    read = list(warc.read_archive(io.BytesIO(data)))
    assert [r.kind for r in read] == ["warcinfo"] + ["response"] * 800
    assert [r.payload for r in read[1:]] == pages
    assert len(data) < sum(map(len, pages)) * 0.8


def test_archives_without_dictionary_and_with_a_plain_one():
    few = _archive([_page(1), _page(2, b""), _page(None, "é\r\n\r\n".encode())])
    assert few[:4] == struct.pack("<I", warc.FRAME)
    assert [(warc.page_of(r.headers["warc-record-id"]), r.payload) for r in warc.read_archive(io.BytesIO(few))] == [(1, b"<p>x</p>"), (2, b""), (None, "é\r\n\r\n".encode())]
    samples = [_page(k, _words(60, k).encode()) for k in range(600)]
    trained = warc.train(samples)
    plain = struct.pack("<II", warc.SKIPPABLE, len(trained)) + trained
    frames = zstandard.ZstdCompressor(write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained))
    data = plain + b"".join(frames.compress(s) for s in samples)
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 600
    assert list(warc.read_archive(io.BytesIO(b""))) == []


class _Pieces(io.BytesIO):
    """A stream that gives at most so many bytes at a time."""

    def __init__(self, data: bytes, most: int):
        super().__init__(data)
        self.most = most

    def read(self, n: int = -1) -> bytes:
        return super().read(self.most if n < 0 else min(n, self.most))


@pytest.mark.parametrize("most", [1, 5, 7, 64])
def test_frames_may_begin_anywhere_in_a_piece(most):
    data = _archive([_page(k, b"x" * k) for k in range(40)])
    assert [warc.page_of(r.headers["warc-record-id"]) for r in warc.read_archive(_Pieces(data, most))] == list(range(40))


def test_broken_archives_are_refused():
    good = _archive([_page(1), _page(2)])
    whole = zstandard.ZstdCompressor(write_checksum=True)
    record = _page(1)
    bad = {
        "cut off": good[:-3],
        "flipped byte": good[:60] + bytes([good[60] ^ 1]) + good[61:],
        "no frame": good + b"tail",
        "two records in one frame": whole.compress(record + record),
        "wrong length": whole.compress(record.replace(b"Content-Length: 8\r\n\r\n", b"Content-Length: 9\r\n\r\n")),
        "longer block": whole.compress(record[:-4] + b"!\r\n\r\n"),
        "other payload": whole.compress(record.replace(b"<p>x</p>", b"<p>y</p>")),
        "no version": whole.compress(record[4:]),
        "no id": whole.compress(record.replace(b"WARC-Record-ID", b"WARC-Record-NO")),
        "repeated header": whole.compress(record.replace(b"WARC-Date", b"WARC-Type")),
        "no checksum": zstandard.ZstdCompressor(write_checksum=False).compress(record),
        "revisit of nothing": whole.compress(record.replace(b"WARC-Type: response", b"WARC-Type: revisit")),
        "no dictionary": struct.pack("<II", warc.SKIPPABLE, 4) + b"oops" + good,
    }
    for what, data in bad.items():
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(io.BytesIO(data)))
            pytest.fail(what)


def test_urls_stay_in_one_line():
    record = warc.parse(warc.page_record(3, "http://h/a b\r\nX: y", b"", warc.base32_sha1(b""), 0, None))
    assert record.headers["warc-target-uri"] == "http://h/a%20b%0D%0AX:%20y" and "x" not in record.headers


PAGES = [
    (1, "u1", "same"), (7, "u7", "same"), (3, None, "same"), (7, "u7", "same"), (2, "u2", None), (4, "u4", ""), (None, "u", "only"), (None, "u", "only"),
    (None, "v", "same"), (5, "u5", "é" * 50_000), (6, "u6", "single"), (-3, "u", "\x00\r\n\r\nWARC/1.1"),
]


def _warc_rows(pages, least=0):
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        last = max((x for x in groups[h or ""] if x is not None), default=None)
        again = i != last and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"most_groups": 0}, {"min_bytes": 5}, {"archive_bytes": 1}])
def test_pages_come_back(spark, options):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn("digest", F.lit("d"))
    found = warc.round_trip(pages, **options).drop("url", "payload")
    assert sorted((tuple(r) for r in found.collect()), key=str) == _warc_rows(PAGES, options.get("min_bytes", 0))


def test_payloads_come_back_and_no_pages_give_no_rows(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_originals(pages), f"file://{tmp_path}").collect()
    read = warc.read_archives(spark.createDataFrame(archives, warc.ARCHIVES)).collect()
    want = {(i, h or "") for i, _, h in PAGES if (i, h) in {(7, "same"), (4, ""), (None, "only"), (5, "é" * 50_000), (6, "single"), (-3, PAGES[-1][2])}}
    assert {(r.page_id, bytes(r.payload).decode()) for r in read if r.record_type == "response"} == want
    assert all(r.payload is None and r.payload_bytes == 4 for r in read if r.record_type == "revisit" and r.page_id in (1, 3))
    assert warc.round_trip(pages.limit(0)).collect() == []
    short = [(a.path, a.n_records + 1, a.n_bytes) for a in archives]
    with pytest.raises(Exception, match="records instead of"):
        warc.read_archives(spark.createDataFrame(short, warc.ARCHIVES)).collect()


# --------------------------------------------------------------------------- prefix trie


def _trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(lender, [])[:h] + own[c][h:]
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        yield node
        for child in children.get(node, []):
            yield from below(child)

    out = []
    for node, own_members in members.items():
        sub = list(below(node))
        saved = sum((len(members[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) for u in sub if u)
        ends = ",".join(str(c) for c in sorted(own_members) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(u not in children for u in sub)
        out.append((min(own_members), len(node), parent, len(own_members), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "k", "a", "owner"):
        table = table.withColumn(name, F.lit("clash"))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table).collect()), key=str)


def _talk(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-45, 130), n):
        for t in range(r.randrange(1, 6)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "a  b c\n d", "　 x"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    rows = _talk(seed)
    assert _found(spark, rows) == _trie(rows)


def test_trie_of_ties_repeats_nulls_and_lone_rows(spark):
    rows = [(20, 0, "u", "hi"), (20, 0, "u", "hi"), (None, 0, "u", "hi"), (21, 1, "b", "x"), (21, 1, "a", "y"), (21, None, "z", "first"), (47, 5, None, None), (60, 2, "ab", "c"), (80, 2, "a", "bc")]
    assert _found(spark, rows) == _trie(rows)
    assert _found(spark, [(None, 0, "u", "hi")]) == [] == _found(spark, [])


def test_trie_with_a_hot_path_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAVY_SHARE", 50)
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 4000, 2) for t in range(4)] + _talk(4, 20)
    assert _found(spark, rows) == _trie(rows)


def test_lists_of_ids_are_cut_and_joined_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    nodes = [(1, 5, 5)] * 300 + [(1, 5, 6)] + [(2, 0, 0)] * 11
    ids = [*range(300), -1, *range(11)]
    batches = [pa.record_batch([pa.array(c[s : s + 7], pa.int64()) for c in (*zip(*nodes), ids)], names=[*prefix_trie.NODE, "conv_id"]) for s in range(0, len(ids), 7)]
    pieces = list(prefix_trie.join_ids(iter(batches)))
    assert sum(p.num_rows for p in pieces) > 40
    found = [tuple(r.values()) for b in prefix_trie.hash_ids(iter(pieces)) for r in b.to_pylist()]
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert found == [(1, 5, 5, sha(range(300))), (1, 5, 6, sha([-1])), (2, 0, 0, sha(range(11)))]
