"""The ten operators against plain versions, on small tables with nulls, empty and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from larchgraph.llm import components, jpeg, line_dedup, media, mixing, near_dedup, packing, pairwise_quality, quality_rules, queries, sharding, token_counts, url_filter
from tests import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, score string, kept string, body string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def docs(spark, texts, ids=None, sources=None):
    rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else "s"), 1, *["x"] * 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " \n\t", "one", "a b c", "A b C", "x\n\nx", "word " * 3000, "ünï çödé\x1cx", "same text here now", "same text here now", "<|endoftext|> a <|startoftext|>", "日本語 テキスト", "a" * 5000]


def odd(spark):
    ids = [*range(len(ODD) - 1), None]
    return docs(spark, ODD, ids, [None, *["s", "t", "é"] * 5][: len(ODD)])


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.read_back(media.text_media(odd(spark))).collect()}
    for i, t in zip([*range(len(ODD) - 1), None], ODD):
        body = (t or "").encode()
        payload = body + bytes(-len(body) % 64 or (0 if body else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[9]["media_sha256"] == got[10]["media_sha256"] and got[9]["feature"] == got[10]["feature"]
    assert media.read_back(media.text_media(docs(spark, []))).count() == 0


def test_jpeg_random_payloads_and_damage():
    rng = np.random.default_rng(3)
    payloads = [media.padded(rng.integers(0, 256, n, np.uint8).tobytes()) for n in (1, 64, 65, 5000, 64 * 129)] + [bytes(64 * 9)]
    blobs = media.to_media(payloads)
    assert [b for _, _, b in media.from_media(blobs)] == payloads
    hurt = [None, b"", b"no image", blobs[3][:300], blobs[3][: len(blobs[3]) // 2], blobs[3]]
    status = [im.status for im, _, _ in jpeg.decode(hurt)]
    assert status == ["null", "not jpeg", "not jpeg", "damaged", "damaged", "ok"]


def test_jpeg_thumbnail_is_the_dc_plane():
    blocks = np.zeros((6, 64), np.int32)
    blocks[:, 0] = [-512, -8, 0, 8, 80, 512]
    [(im, thumb, coef)] = jpeg.decode(jpeg.encode([blocks], [b""]), whole=True)
    assert (im.width, im.height, thumb.tolist()) == (48, 8, [[64, 127, 128, 129, 138, 192]])
    assert (coef == blocks).all()


def test_jpeg_colour_with_subsampling():
    """A 4:2:0 image with one MCU and no restart intervals, written by hand from the fixed tables."""
    bits = ""
    dc = {s: (c, n) for s, c, n in jpeg.canonical(*jpeg.DC_TABLE)}
    ac = {s: (c, n) for s, c, n in jpeg.canonical(*jpeg.AC_TABLE)}
    for diff in (40, 8, -16, 0, 5, -5):  # four luminance blocks, then two of colour
        size = abs(diff).bit_length()
        c, n = dc[size]
        bits += f"{c:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
        c, n = ac[0]
        bits += f"{c:0{n}b}"
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    tables = b"".join(bytes([k, *c, *s]) for k, (c, s) in ((0, jpeg.DC_TABLE), (0x10, jpeg.AC_TABLE)))
    seg = jpeg._segment
    frame = bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    blob = b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, frame) + seg(0xC4, tables) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    [(im, thumb, _)] = jpeg.decode([blob])
    assert im.status == "ok" and thumb.tolist() == [[168, 176], [160, 160]]


def plain_dc(blob):
    """The quantised DC values of a grey baseline image, bit by bit."""
    at, tables, interval = 2, {}, 0
    while True:
        kind, n = blob[at + 1], int.from_bytes(blob[at + 2 : at + 4], "big")
        body, at = blob[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC4:
            while body:
                counts, symbols = body[1:17], body[17 : 17 + sum(body[1:17])]
                code, table, left = 0, {}, list(symbols)
                for length, m in enumerate(counts, 1):
                    for _ in range(m):
                        table[length, code] = left.pop(0)
                        code += 1
                    code <<= 1
                tables[body[0]], body = table, body[17 + len(symbols) :]
        elif kind == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xDA:
            break
    parts = re.split(rb"\xff[\xd0-\xd7]", blob[at:-2].replace(b"\xff\x00", b"\xff\x00\x00")) if interval else [blob[at:-2]]
    out, total = [], (width + 7) // 8 * ((height + 7) // 8)
    for part in parts:
        data = part.replace(b"\xff\x00\x00", b"\xff")
        bits, p, dc = "".join(f"{b:08b}" for b in data), 0, 0

        def symbol(table):
            nonlocal p
            code = length = 0
            while (length, code) not in table:
                code, length, p = code << 1 | int(bits[p]), length + 1, p + 1
            return table[length, code]

        def value(size):
            nonlocal p
            if not size:
                return 0
            raw, p = int(bits[p : p + size], 2), p + size
            return raw if raw >> (size - 1) else raw - (1 << size) + 1

        for _ in range(min(interval or total, total - len(out))):
            dc += value(symbol(tables[0]))
            out.append(dc)
            k = 1
            while k < 64:
                s = symbol(tables[16])
                if not s & 15 and s >> 4 < 15:
                    break
                k += (s >> 4) + 1
                value(s & 15)
    return out, width, height


def test_jpeg_against_a_plain_decoder():
    rng = np.random.default_rng(9)
    payloads = [media.padded(x) for x in (b"", b"abc" * 50, "ünï".encode() * 400, rng.integers(0, 256, 3000, np.uint8).tobytes(), bytes([255] * 700))]
    for blob, (im, thumb, _) in zip(media.to_media(payloads), jpeg.decode(media.to_media(payloads)), strict=True):
        dc, width, height = plain_dc(blob)
        pixels = np.clip(np.rint(np.array(dc) / 8) + 128, 0, 255).astype(np.uint8).reshape(height // 8, width // 8)
        assert (im.width, im.height) == (width, height) and (thumb == pixels).all()


def test_jpeg_slices_do_not_show(monkeypatch):
    rng = np.random.default_rng(4)
    payloads = [media.padded(rng.integers(0, 256, n, np.uint8).tobytes()) for n in (1, 700, 20_000, 3, 64 * 16, 9000)]
    want = media.to_media(payloads)
    monkeypatch.setattr(jpeg, "SLICE_BLOCKS", 16)
    monkeypatch.setattr(jpeg, "SLICE_BYTES", 500)
    assert media.to_media(payloads) == want
    assert [b for _, _, b in media.from_media(want)] == payloads


def test_media_of_a_very_long_text_in_little_memory():
    """20 MB of text within 1 GB, in a process of its own."""
    code = """
import resource, sys
sys.path.insert(0, {root!r})
from larchgraph.llm import media
body = ("long text with a few words, " * 750_000).encode()
resource.setrlimit(resource.RLIMIT_AS, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024 + (3 << 30), -1))
payload = media.padded(body)
assert media.from_media(media.to_media([payload]))[0][2] == payload
print(len(body), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code.format(root=str(Path(__file__).resolve().parents[2]))], capture_output=True, text=True, timeout=300, check=True)
    size, used = map(int, out.stdout.split())
    assert size > 20_000_000 and used < 1000


def grey_scan(diffs):
    """A scan of blocks that have DC differences alone, in the fixed tables."""
    dc = {s: (c, n) for s, c, n in jpeg.canonical(*jpeg.DC_TABLE)}
    c0, n0 = next((c, n) for s, c, n in jpeg.canonical(*jpeg.AC_TABLE) if s == 0)
    bits = ""
    for diff in diffs:
        size = abs(diff).bit_length()
        c, n = dc[size]
        bits += f"{c:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + f"{c0:0{n0}b}"
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def colour_image(sampling, *scans):
    tables = b"".join(bytes([k, *c, *s]) for k, (c, s) in ((0, jpeg.DC_TABLE), (0x10, jpeg.AC_TABLE)))
    seg = jpeg._segment
    frame = bytes([8, 0, 16, 0, 24, 3, 1, sampling, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, frame) + seg(0xC4, tables)
    return head + b"".join(seg(0xDA, bytes([len(ids), *[x for i in ids for x in (i, 0)], 0, 63, 0])) + grey_scan(diffs) for ids, diffs in scans) + b"\xff\xd9"


def test_jpeg_with_a_scan_for_each_component():
    """24 x 16 pixels, 4:2:0: luminance has 3 x 2 blocks in its own scan, before or after the others."""
    light, blue, red = ([1], [8, 8, 8, 8, 8, 8]), ([2], [1, 1]), ([3], [2, 2])
    for scans in ((light, blue, red), (blue, red, light)):
        [(im, thumb, _)] = jpeg.decode([colour_image(0x22, *scans)])
        assert im.status == "ok" and thumb.tolist() == [[136, 144, 152], [160, 168, 176]]
    assert [im.status for im, _, _ in jpeg.decode([colour_image(0x22, blue, red)])] == ["damaged"]


@pytest.mark.parametrize("sampling", [0x00, 0x20, 0x02, 0x51, 0xFF])
def test_jpeg_with_bad_sampling(sampling):
    blob = colour_image(sampling, ([1, 2, 3], [0] * 12))
    assert [im.status for im, _, _ in jpeg.decode([blob, blob[:-9]])] == ["damaged"] * 2


def test_jpeg_headers_that_lie():
    blob = bytearray(colour_image(0x22, ([1], [0] * 6)))
    at = blob.index(b"\xff\xc0") + 5
    blob[at : at + 4] = b"\xea\x60\xea\x60"
    assert jpeg.decode([bytes(blob)])[0][0].status == "damaged"
    rng = np.random.default_rng(1)
    whole = media.to_media([media.padded(b"some text " * 30)])[0]
    for _ in range(300):  # any bytes give a status
        hurt = bytearray(whole)
        for i in rng.integers(0, len(hurt), 4):
            hurt[i] = rng.integers(0, 256)
        assert jpeg.decode([bytes(hurt)])[0][0].status in ("ok", "damaged", "not baseline", "not jpeg")


def test_thumbnails_of_a_column(spark):
    df = media.text_media(docs(spark, ["abc", "b" * 300])).select("doc_id", "media").union(spark.createDataFrame([(9, None), (10, bytearray(b"zz"))], "doc_id bigint, media binary"))
    got = {r["doc_id"]: r for r in media.thumbnails(df, "doc_id", "media").collect()}
    assert (got[0]["width"], got[0]["status"], got[9]["status"], got[10]["status"], got[10]["thumb_hash"]) == (8, "ok", "null", "not jpeg", None)


def rule_of(url, rules=url_filter.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0].translate(LOWER)
    path = re.split(r"[?#]", rest[len(host) :])[0]
    best = max((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: (len(r.name), r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://NET/x", "https://a.net", "https://a.net/?q", "http://example.net/en/1", "http://m.example.net/en/", "http://xexample.net/en/a", "http://b.example.com/de/7?x#y", "x://o.org/fr/a", "http://h.org#f", "http://internet/x", "a://b://c.net/d"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(99, urls[6])], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls) + 1
    for i, u in [*enumerate(urls), (99, urls[6])]:
        host, path, rule, _ = rule_of(u)
        assert got[i] == (host, path, rule), u
    assert url_filter.judge(pages.limit(0)).count() == 0


def plain_verdicts(urls, rules):
    """The tree by plain loops: (template, purity, verdict) of each url."""
    depth = max([4, *(len([x for x in r.path.split("/") if x]) + 1 for r in rules)])

    def shape(x):
        stem, ending = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", x).groups()
        if re.fullmatch("[0-9]+", stem):
            stem = "{n}"
        elif re.search("[0-9]", stem) and re.fullmatch("[0-9A-Fa-f-]{8,}", stem):
            stem = "{hex}"
        elif len(re.findall("[0-9]", stem)) >= 3 or len(stem) > 40:
            stem = "{mix}"
        return stem + (ending or "")

    pages = []
    for u in urls:
        host, path, _, verdict = rule_of(u, rules)
        seg = [x for x in path.split("/") if x]
        seg = [shape(x) for x in seg[:depth]] + (["**"] if len(seg) > depth else [])
        pages.append([host, seg, verdict, ""])
    for level in range(depth + 1):
        parents = defaultdict(lambda: defaultdict(list))
        for p in pages:
            parents[p[0], p[3]][p[1][level] if level < len(p[1]) else ""].append(p)
        for kinds in parents.values():
            total, branch = sum(map(len, kinds.values())), defaultdict(list)
            for seg, own in kinds.items():
                branch["*" if seg and len(kinds) > 20 and len(own) < total * 0.05 else seg] += own
            stat = {}
            for seg, own in branch.items():
                b, m = sum(p[2] == "block" for p in own), sum(p[2] is not None for p in own)
                stat[seg] = (b, m, sum(max(len(p[1]) - level - 1, 0) for p in own) / len(own))
            known = sorted((x for x in branch if stat[x][1]), key=lambda x: (stat[x][0] / stat[x][1], x))
            groups, last = {}, None
            for x in known:
                b, m, _ = stat[x]
                if last is not None:
                    lb, lm, _ = stat[last]
                    pooled = (b + lb + 1) / (m + lm + 2)
                    apart = abs(b / m - lb / lm) > 2 * (pooled * (1 - pooled) * (1 / m + 1 / lm)) ** 0.5
                    groups[x] = groups[last] + apart
                else:
                    groups[x] = 1
                last = x
            for x in branch:
                if not stat[x][1] and known:
                    groups[x] = groups[min(known, key=lambda k: (abs(stat[k][2] - stat[x][2]), -stat[k][1], k))]
            for x, own in branch.items():
                members = [y for y in branch if groups.get(y) == groups.get(x)] if x in groups else [x]
                name = "/~" + min(members) if len(members) > 1 else "/" + x if x else ""
                for p in own:
                    p.append(name)
        for p in pages:
            p[3] += p.pop()
    count = defaultdict(lambda: [0, 0])
    for host, _, verdict, template in pages:
        count[host, template][0] += verdict == "block"
        count[host, template][1] += verdict is not None
    out = []
    for host, _, verdict, template in pages:
        b, m = count[host, template]
        purity = (b + 2) / (m + 4)
        out.append((template, round(purity, 9), verdict or ("block" if purity >= 0.8 else "allow")))
    return out


def judged(spark, urls, rules=url_filter.RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rows = {r["page_id"]: (r["template"], round(r["purity"], 9), r["verdict"]) for r in url_filter.judge(pages, rules=rules).collect()}
    return [rows[i] for i in range(len(urls))]


def test_url_tree_against_plain(spark):
    """Every verdict, template and purity of the given pages, and of paths of many forms."""
    given = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = plain_verdicts(given, url_filter.RULES)
    assert judged(spark, given) == want
    free = [w[2] for u, w in zip(given, want, strict=True) if rule_of(u)[3] is None]
    assert "block" in free and "allow" in free  # labels reach pages that no rule fits
    rng = random.Random(3)
    rules = (url_filter.Rule("block", "h.com", "/a/b/c/d/e/"), url_filter.Rule("allow", "h.com", "/a/b/c/d/f/"), url_filter.Rule("block", "h.com", "/q"), url_filter.Rule("allow", "h.com", "/r/x"))
    words = ["a", "b", "c", "d", "e", "f", "q", "r", "x", "17", "a1b2c3", "deadbeef01", "p.html", *(f"slug-{chr(97 + i)}" for i in range(26))]
    urls = [f"http://{rng.choice(['h.com', 'm.h.com', 'o.org'])}/" + "/".join(["a/b/c/d/" + rng.choice("efg")] * rng.randint(0, 1) + rng.choices(words, k=rng.randint(0, 5))) for _ in range(1500)] + [None, "", "x"]
    assert judged(spark, urls, rules) == plain_verdicts(urls, rules)


def test_url_templates(spark):
    """Slugs are generalised, and unlabelled slugs share their verdict."""
    rules = (url_filter.Rule("block", "h.com", "/ads/a"), url_filter.Rule("allow", "h.com", "/news/a"))
    urls = [f"http://h.com/ads/{x}{i}" for x in "ab" for i in ("slug", "thing", "word")] * 4 + [f"http://h.com/news/{a}{b}x" for a in "abcdef" for b in "ghijklm"] * 2
    rows = dict(zip(urls, judged(spark, urls, rules), strict=True))
    assert {t for u, (t, _, _) in rows.items() if "/news/" in u} == {"/news/*"}
    assert {v for u, (_, _, v) in rows.items() if "/news/" in u} == {"allow"}
    assert {v for u, (_, _, v) in rows.items() if "/ads/" in u} == {"block"}


def test_url_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://h.com/a", "x"), (1, "http://h.com/a", "y"), (None, None, None)], "page_id bigint, url string, template string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == 3 and all(r["verdict"] == "allow" for r in rows) and url_filter.deep_enough(url_filter.RULES) == 4


def test_sharding_laws(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("shard"), F.lit(1).alias("slot"))
    got = sharding.numbered(sharding.shards(df, "doc_id", sharding.layout(40), sharding.layout(41)), "shard", ["doc_id"], "slot").collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 40 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.3 * min(map(len, by.values()))


def plain_place(key, tree):
    """The shard of a key by the law of the descent, with numbers from the same hash."""

    def u(use, number):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        for x in (use, number):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return ((h >> 11) + 0.5) / 2**53

    time = lambda use, number, rate: -math.log(u(use, number)) / rate
    best = None
    for region in sorted({s.region for s in tree if s.weight}):
        own = [s for s in tree if s.region == region]
        racks = defaultdict(list)
        for s in own:
            racks[s.rack].append(s)
        t = time(sharding.REGION, region, sum(s.room for s in own))
        rack = min(racks, key=lambda k: time(sharding.RACK, k, sum(s.room for s in racks[k]))) if len(racks) > 1 else min(racks)
        at = min(racks[rack], key=lambda s: time(sharding.PLACE, s.shard, s.room))
        found = [(t, at.shard)]
        if at.weight < at.room and u(sharding.ACCEPT, at.shard) >= at.weight / at.room:
            found = [(t + time(sharding.AGAIN, s.shard, min(s.weight, s.room)), s.shard) for s in own if s.weight]
        found += [(time(sharding.BEYOND, s.shard, s.weight - s.room), s.shard) for s in own if s.weight > s.room]
        best = min(found) if best is None else min(best, min(found))
    return best[1]


ODD_TREE = [sharding.Shard(0, 0, 0, 2.5), sharding.Shard(0, 0, 1, 0.3), sharding.Shard(0, 1, 2, 0.0), sharding.Shard(1, 2, 3, 1.5, 1.5), sharding.Shard(1, 3, 4, 4.0, 2.0), sharding.Shard(2, 4, 5, 0.0), sharding.Shard(3, 5, 6, 1.0)]


@pytest.mark.parametrize("tree", [sharding.layout(40), sharding.layout(41), sharding.layout(3), ODD_TREE], ids=["40", "41", "3", "odd"])
def test_sharding_against_plain(spark, tree):
    rows = sharding.shards(spark.range(3000).select(F.concat(F.lit("ké"), "id").alias("k")), "k", tree).collect()
    assert all(r["shard"] == plain_place(r["k"], tree) for r in rows)
    weight = {s.shard: s.weight for s in tree}
    got = Counter(r["shard"] for r in rows)
    for shard, w in weight.items():
        want = 3000 * w / sum(weight.values())
        assert abs(got[shard] - want) <= 5 * want**0.5


@pytest.mark.parametrize("n", [1, 4, 10, 13, 40, 44])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    rows = sharding.shards(spark.range(4000).withColumnRenamed("id", "k"), "k", sharding.layout(n), sharding.layout(n + 1)).collect()
    assert all(r["grown_shard"] in (r["shard"], n) for r in rows) and any(r["grown_shard"] == n for r in rows)


@pytest.mark.parametrize("weight", [0.0, 0.4, 3.0])
def test_sharding_weight_change_stays_in_its_shard(spark, weight):
    tree = sharding.layout(20)
    other = [s._replace(weight=weight) if s.shard == 7 else s for s in tree]
    rows = sharding.shards(spark.range(5000).withColumnRenamed("id", "k"), "k", tree, other).collect()
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert moved and all(7 in (r["grown_shard"], r["shard"]) and (r["grown_shard"] == 7) == (weight > 1) for r in moved)
    share = sum(r["grown_shard"] == 7 for r in rows) / len(rows)
    assert abs(share - weight / (19 + weight)) < 0.03
    for bad in ([], sharding.layout(3)[:1] + [sharding.Shard(0, 0, 1, -1.0)], [sharding.Shard(0, 0, 0, 0.0)]):
        with pytest.raises(ValueError):
            sharding.place(F.col("k"), bad)


def test_op3_rows(spark):
    """Sizes, checksums and slots of the smallest table, by plain counting."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_sharding(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 16, zlib.crc32(body), "key")
        assert (r["shard"], r["grown_shard"]) == tuple(plain_place(str(r["doc_id"]), sharding.layout(n)) for n in (40, 41))
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_numbers_of_odd_rows(spark):
    """Repeated rows, null groups and clashing names keep every column and get gapless numbers."""
    df = spark.createDataFrame([(i % 3 or None, i // 4, "x", "y") for i in range(40)], "by int, k int, part string, row string").withColumn("slot", F.lit("old"))
    rows = sharding.numbered(df, "by", ["k"], "slot", rows=10**7).collect()
    assert {(r["part"], r["row"]) for r in rows} == {("x", "y")} and len(rows) == 40
    for by in (None, 1, 2):
        own = sorted(r["slot"] for r in rows if r["by"] == by)
        assert own == list(range(len(own)))
    empty = sharding.shards(docs(spark, []), "doc_id", sharding.layout(4), sharding.layout(5))
    assert empty.count() == 0 and sharding.numbered(empty, "shard", ["doc_id"], "slot").count() == 0


def test_odd_rows_through_sharding_and_mixing(spark):
    df = odd(spark)
    placed = sharding.numbered(sharding.shards(df.withColumn("size", sharding.sizes()), "doc_id", sharding.layout(4)), "shard", ["doc_id", "size"], "slot")
    assert placed.count() == len(ODD)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(ODD)
    for r in mixed:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
    for s in {r["source"] for r in mixed}:
        own = [r for r in mixed if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_targets(spark):
    df = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert abs(sum(got.values()) - 1.5 * 1610) < 1e-6 and got["a"] == 200 and got["c"] == 20
    # None has weight 5 again: it is capped at 1000, and b takes what is left
    assert got[None] == 1000 and abs(got["b"] - (1.5 * 1610 - 1220)) < 1e-6


def test_curriculum_order(spark):
    df = docs(spark, ["w " * (10 + i % 7) for i in range(120)], sources=["a" if i % 3 else "b" for i in range(120)])
    rows = mixing.curriculum(mixing.mix(df)).collect()
    at = [r["position"] for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    mean = lambda s: np.mean([r["position"] for r in rows if r["source"] == s])
    assert mean("a") < mean("b")  # a's tilt is early


def test_mixing_rows_come_from_the_curriculum(spark):
    """op7's rows stand in training order, and every copy, cut ones too, lies on the cumulative demand."""
    df = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text", "source")
    plain = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    got = queries.op7_mixing(spark, SF).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {i: r["taken"] for i, r in plain.items()}

    def first(doc_id):
        r = plain[doc_id]
        if not r["taken"]:
            return 2.0
        tilt = mixing.TILTS[r["_schedule"]]
        x = min(1.0, (r["start"] + min(r["size"], round(r["target"]) - r["start"]) / 2) / r["target"])
        lo, hi = 0.0, 1.0
        for _ in range(60):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if t + tilt * t * (1 - t) < x else (lo, t)
        return lo

    at = [first(r["doc_id"]) for r in got]
    assert len(set(at)) > 50 and all(a <= b + 1e-9 for a, b in itertools.pairwise(at))


def test_exact_curriculum_of_odd_rows(spark):
    df = odd(spark).unionByName(docs(spark, ["", "", "two words", "two words"], [77, 77, 78, 78], ["s", "s", "t", "t"]))
    mixed = mixing.mix(df)
    cols = ("doc_id", "size", "source_size", "target", "taken")
    assert collected(mixing.dealt(mixed), *cols) == collected(mixed, *cols)
    assert mixing.dealt(mixing.mix(docs(spark, []))).count() == 0


def test_mixing_keeps_the_callers_columns(spark):
    names = ("order", "tie", "bucket", "upto", "before", "_copies", "of_source")
    df = spark.createDataFrame([(f"k{i}", "two words", "s", *names) for i in range(9)], f"k string, text string, source string, {', '.join(f'{n} string' for n in names)}")
    mixed = mixing.mix(df, key="k")
    rows = mixing.curriculum(mixed, key="k").collect()
    assert len(rows) == 14 and {tuple(r[n] for n in names) for r in rows} == {names}
    assert mixing.dealt(mixed, key="k").count() == 9


def test_mixing_does_not_depend_on_buckets(spark):
    df = docs(spark, ["w " * (i % 9) for i in range(200)], sources=["a" if i % 3 else "b" for i in range(200)])
    cols = ("doc_id", "start", "taken")
    assert collected(mixing.mix(df, buckets=3), *cols) == collected(mixing.mix(df, buckets=5000), *cols)


def sets_of(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def components_of(sets, ids, percent):
    parent = dict(zip(ids, ids))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def copies(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    texts = []
    for _ in range(n // 12):
        base = rng.choices(vocabulary, k=rng.randint(20, 150))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5, 9))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_all_pairs(spark, width):
    texts = copies(480) + [None, "", "one two", "one TWO", "one two three four", "  \t"]
    got = near_dedup.near_duplicates(docs(spark, texts), width=width).collect()
    sets = sets_of(texts, width)
    want = components_of(sets, list(range(len(texts))), 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_parts_of_a_large_region(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 40)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(own))
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets_of(texts, 4), list(range(300)), 80)


def isolated_pairs(n, pairs):
    """A family of texts of mutual similarity about 0.7, with pairs of about 0.8 and no chain."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]

    def own(words, changes, fresh):
        out = list(words)
        for at in rng.sample(range(0, 400, 4), changes):
            out[at] = f"{fresh}x{at}"
        return out

    texts = [own(base, 17, f"a{k}") for k in range(n)]
    for k in range(pairs):
        texts.append(own(texts[k], 10, f"b{k}"))
    return [" ".join(t) for t in texts]


def test_isolated_pairs_in_a_large_region(spark, monkeypatch):
    """No link is lost in a region above the limit, where no chain repairs it."""
    monkeypatch.setattr(near_dedup, "REGION", 40)
    texts = isolated_pairs(260, 130)
    want = components_of(sets_of(texts, 4), list(range(len(texts))), 80)
    assert max(Counter(want.values()).values()) == 2 and len(set(want.values())) == 260
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_between_bands_of_size(spark, monkeypatch, percent):
    """Around every border of 100 * small = percent * large, each pair with an end outside the
    largest component meets, and each class meets hubs of its band and of those around it."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    ids = list(range(1, 90))
    members = near_dedup._sized(spark.createDataFrame([(i, 0, i) for i in ids], "rep bigint, region bigint, n_shingles bigint"), percent).cache()
    band = {r["rep"]: r["band"] for r in members.collect()}
    joined = set(range(30, 50))
    links = spark.createDataFrame([(30, i) for i in joined] + [(1, i) for i in range(2, 9)], "a bigint, b bigint")

    def met(parts):
        by, pairs = defaultdict(list), set()
        for r in parts.collect():
            by[r["part"]].append((r["rep"], r["side"]))
        for rows in by.values():
            assert sum(side for _, side in rows) <= 12  # blocks are cut by hash
            pairs |= {tuple(sorted((x, y))) for x, a in rows for y, b in rows if a == 0 and b == 1}
        return pairs

    second = met(near_dedup._second_parts(members, links))
    assert all((x, y) in second for x, y in itertools.combinations(ids, 2) if 100 * x >= percent * y and not {x, y} <= joined)
    first = met(near_dedup._first_parts(members))
    assert all(any(tuple(sorted((x, y))) in first for y in ids if abs(band[x] - band[y]) <= 1) for x in ids)


def test_a_region_far_above_the_limit(spark, monkeypatch):
    """A hundred times what one task decides: one large group, and texts that hubs do not reach."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(440):
        own = list(base)
        for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 4, 8))):
            own[rng.randrange(100)] = f"v{k}"
        texts.append(" ".join(own))
    want = components_of(sets_of(texts, 4), list(range(len(texts))), 80)
    sizes = Counter(want.values())
    assert len(set(texts)) > 400 and max(sizes.values()) > 250 and len(sizes) > 5
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def framed(n, pairs):
    """Texts that share a frame of 280 of 400 words, too little for a link; the first have a near copy."""
    rng = random.Random(12)
    frame = [f"f{i}" for i in range(280)]
    texts = [frame + [f"d{k}w{i}" for i in range(120)] for k in range(n)]
    for k in range(pairs):
        own = list(texts[k])
        for at in rng.sample(range(0, 400, 8), 5):
            own[at] = f"p{k}x{at}"
        texts.append(own)
    return [" ".join(t) for t in texts]


def test_a_crowd_in_one_frame_falls_apart(spark, monkeypatch):
    """A large region below the threshold is refined to its planted pairs; nothing is left for blocks."""
    monkeypatch.setattr(near_dedup, "REGION", 40)
    seen = []
    refined = near_dedup._refined

    def told(members, *rest):
        out = refined(members, *rest)
        seen.append((members.filter("large").count(), out.count(), out.groupBy("region").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(near_dedup, "_refined", told)
    texts = framed(600, 60)
    got = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets_of(texts, 4), list(range(len(texts))), 80)
    # a few texts agree too little with the others to be in the large region; their pairs are regions already
    assert len(seen) == 1
    before, left, most = seen[0]
    assert before > 500 and 100 < left <= 120 and most == 2


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_refined_regions_hold_all_links(spark, percent):
    """Every pair of at least the similarity is in one refined region, and who is alone is in none."""
    rng = random.Random(percent)
    texts = []
    for k in range(40):
        base = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(10, 80))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                own[rng.randrange(len(own))] = f"z{rng.randrange(50)}"
            texts.append(" ".join(own))
    sets = sets_of(texts, 4)
    rows = spark.createDataFrame([(i, 0, len(s), True) for i, s in enumerate(sets)], "rep bigint, region bigint, n_shingles bigint, large boolean")
    both = spark.createDataFrame(list(enumerate(texts)), "rep bigint, text string")
    region = {r["rep"]: r["region"] for r in near_dedup._refined(rows, both, 4, percent).collect()}
    linked = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert len(linked) > 40 and all(region[i] == region[j] for i, j in linked)
    assert min(Counter(region.values()).values()) > 1


def test_hashes_of_words_do_not_depend_on_runs(monkeypatch):
    texts = pa.array(["one two  three four five six", "x" * 300 + " tail of it", "", None, "a b"])
    h, n = near_dedup.shingles(texts, 4)
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    again, m = near_dedup.shingles(texts, 4)
    sliced, k = near_dedup._by_slices(pa.chunked_array([texts]), 4)
    assert (h == again).all() and (h == sliced).all() and (n == m).all() and (n == k).all()


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark).union(docs(spark, ["same text here now"], [9]))).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert len(got) == len(ODD) + 1 and by[10] == {9} and by[9] == {9} and by[5] == {4} and by[None] == {None}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_components_of_few_edges_are_finished_in_one_task(spark, monkeypatch):
    """As of near-duplicates: few edges take one write and no round; more take rounds until few are left."""
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (201, 200), (202, 201)]
    df = spark.createDataFrame([(None if a is None else f"{a:03}", f"{b:03}") for a, b in edges], "a string, b string").repartition(3)
    written, plain = [], components.stored
    monkeypatch.setattr(components, "stored", lambda x: written.append(1) or plain(x))
    want = {f"{i:03}": "000" for i in range(41)} | {f"{100 + i}": "100" for i in range(30)} | {f"{i}": "200" for i in (200, 201, 202)}
    for limit, most in ((71, 1), (70, 99)):
        written.clear()
        got = components.components(df, in_task=limit).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want) and 1 <= len(written) <= most
    assert components.components(df.limit(0), in_task=70).count() == 0


def test_quality_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 30 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def plain_features(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n_words, chars, symbols, dup, repeats = measures(t)
    n, chars = max(n_words, 1), max(chars, 1)
    stops = sum(x.translate(LOWER) in quality_rules.STOP_WORDS for x in w)
    return [
        min(symbols / n, 3), sum("A" <= c <= "Z" for c in t) / chars, min(t.count("!") / n, 3), min(t.count("|") / n, 1), sum("0" <= c <= "9" for c in t) / chars, repeats / n,
        dup / max(len(lines), 1), stops / n, min(sum(map(len, w)) / n / 10, 3), min(math.log1p(n_words / max(len(lines), 1)) / 5, 3), float(n_words < 10), math.log1p(n_words) / 10,
    ]


def test_quality_features_against_plain(spark):
    texts = ODD + ["A!! b| c1\nA!! b| c1\n\nthe the THE", " ".join("abc"[i % 3] for i in range(50))]
    rows = pairwise_quality.features(docs(spark, texts)).collect()
    assert len(pairwise_quality.FEATURES) == 12
    for r in rows:
        assert np.allclose(r["_features"], plain_features(texts[r["doc_id"]]), atol=1e-12), texts[r["doc_id"]]


def test_op5_rows_against_plain(spark):
    """Features, fit and cut by plain numpy: gradient descent on the pairs' logistic loss."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = sorted(i for i in labels if labels[i] in (0, 1) and zlib.crc32(str(i).encode()) % 5 and i in texts)
    x, y = np.array([plain_features(texts[i]) for i in known]), np.array([labels[i] for i in known])
    rng = np.random.default_rng(5)
    good, bad = x[y == 1], x[y == 0]
    d = good[rng.integers(len(good), size=60_000)] - bad[rng.integers(len(bad), size=60_000)]
    weights, _ = pairwise_quality.fit(x, y)
    slope = d.T @ (1 / (1 + np.exp(-d @ weights)) - 1) / len(d) + 1e-3 * weights
    assert np.abs(slope).max() < 1e-6  # the loss is convex: this is its minimum
    ranked = np.sort(x @ weights)
    k = int((y == 0).sum())
    cut = (ranked[k - 1] + ranked[k]) / 2
    for r in queries.op5_quality_classifier(spark, SF).collect():
        utility = np.clip(np.dot(plain_features(texts[r["doc_id"]]), weights) - cut + math.log(0.3 / 0.7), -30, 30)
        score = 1 / (1 + math.exp(-utility))
        assert abs(score - r["score"]) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_classifier_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    none = docs(spark, []).select("doc_id", "text")
    assert pairwise_quality.scored(none, pairwise_quality.learn(none, labels)).count() == 0
    some = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    assert pairwise_quality.scored(none, pairwise_quality.learn(none, some)).count() == 0


def test_quality_classifier_without_both_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, quality int")
    model = pairwise_quality.learn(odd(spark).select("doc_id", "text"), labels)
    rows = pairwise_quality.scored(odd(spark), model).collect()
    assert len(rows) == len(ODD) and {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}


def test_quality_cut_covers_all_labelled_rows(spark, monkeypatch):
    """The cut has the whole labels' share of bad rows, however few rows the weights are fitted on."""
    rng = np.random.default_rng(8)
    texts = [" ".join("!!" if rng.random() < (0.3 if i % 7 == 0 else 0.2) else rng.choice(["the", "word", "of", "longer"]) for _ in range(30)) for i in range(350)]
    df = docs(spark, texts).select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(350)], "doc_id bigint, quality int")
    weights, cut = pairwise_quality.learn(df, labels, sample=20)
    monkeypatch.setattr(pairwise_quality, "BROADCAST", 0)
    merged = pairwise_quality.learn(df, labels, sample=20)
    assert np.array_equal(merged[0], weights) and merged[1] == cut
    rows = pairwise_quality.features(df).filter(~pairwise_quality.held_out("doc_id")).collect()
    utility = np.array([sum(x * w for x, w in zip(r["_features"], weights.tolist())) for r in rows])
    want = pairwise_quality._cut(utility, np.array([int(r["doc_id"] % 7 != 0) for r in rows]))
    assert np.any(weights) and abs(cut - want) < 1e-9


def test_ranked_values(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(size=300)] + [0.25] * 50 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "u double")
    for k in (1, 100, 200, 352):
        assert pairwise_quality._ranked(df, k) == sorted(values)[k - 1]


def test_pairwise_fit_ranks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.1 * rng.normal(size=400) > 0.4).astype(int)
    w, cut = pairwise_quality.fit(x, y)
    assert ((x @ w > cut) == (y == 1)).mean() > 0.95 and (x @ w <= cut).sum() == (y == 0).sum()


def check_packed(rows, texts, window=2048):
    library = packing_library()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= window
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r["start"])
        at = 0
        for r in own:
            piece = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(piece, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    return seq


def packing_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))


def test_packing(spark):
    texts = dict(zip([*range(len(ODD) - 1), None], ODD))
    rows = packing.pack(odd(spark), queries.tokenizer("word_bpe_49k.json"), len(ODD)).collect()
    check_packed(rows, texts)
    assert packing.pack(docs(spark, []), queries.tokenizer("word_bpe_49k.json"), 0).count() == 0


def test_packing_of_the_smallest_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_packing(spark, SF).collect()
    seq = check_packed(rows, texts)
    total = sum(r["length"] for r in rows)
    assert len(seq) <= total // 2048 + 2


def test_packing_in_training_order(spark, tmp_path):
    """Groups are consecutive documents of the written order, and sequence ids rise with it."""
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices("ab cd ef gh".split(), k=rng.randint(0, 700))) for i in range(300)}
    order = sorted(texts, key=lambda i: zlib.crc32(b"%d" % i))
    at = {i: k for k, i in enumerate(order)}
    spark.createDataFrame([(i, texts[i], at[i]) for i in texts], "doc_id bigint, text string, at int").orderBy("at").drop("at").write.parquet(str(tmp_path / "t"))
    rows = packing.pack_in_order(spark.read.parquet(str(tmp_path / "t")), queries.tokenizer("word_bpe_49k.json"), group=40).collect()
    check_packed(rows, texts)
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"] >> 32].append(at[r["doc_id"]])
    groups = [spans[g] for g in sorted(spans)]
    assert len(groups) >= 8 and all(max(a) < min(b) for a, b in itertools.pairwise(groups)) and all(len(set(g)) <= 40 for g in groups)


def test_best_fit_is_tightest_first():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500)
    got = packing.best_fit(lengths, 64)
    left, want = [], []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [(x, i) for i, x in enumerate(left) if x >= lengths[k]]
        if fits:
            i = min(fits)[1]
        else:
            left.append(64)
            i = len(left) - 1
        left[i] -= lengths[k]
        want.append(left[i])
    assert len(set(got[0].tolist())) == len(left)
    assert sorted(np.bincount(got[0], lengths)) == sorted(64 - np.array(left))


@pytest.mark.parametrize("batch", [1, 10_000])
def test_token_counts_equal_the_library(spark, batch):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [t for t in ODD] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    texts += ["  x\u00a0\u2003y \u3000z", "don't I'LL 12ab\r\n\r\n  \t end ", "aaaa" * 50, "é" * 301, "<|endoftext|>" * 3, "\n \n", "😀 a😀"]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    arr = pa.array(texts)
    got = [x for i in range(0, len(texts), batch) for x in token_counts.count(arr.slice(i, batch), path).tolist()]
    assert got == want


def test_token_count_rows(spark):
    rows = {r["doc_id"]: r for r in token_counts.token_counts(odd(spark), queries.tokenizer("byte_bpe_50k.json")).collect()}
    assert len(rows) == len(ODD) and (rows[0]["n_tokens"], rows[0]["n_bytes"]) == (0, 0) and rows[7]["over_limit"]
    assert token_counts.token_counts(docs(spark, []), queries.tokenizer("byte_bpe_50k.json")).count() == 0


def drop_lines(rows, min_docs, min_chars, keep):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    seen, first = defaultdict(set), {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            k = key(x)
            seen[k].add(i)
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for p, x in enumerate(own) if len(k := key(x)) < min_chars or len(seen[k]) < min_docs or keep == "first" and first[k] == (i, p)]
        out.append((i, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("keep", "min_docs", "min_chars"), [("none", 3, 1), ("first", 3, 1), ("none", 10, 4), ("first", 2, 1)])
def test_line_dedup_against_plain(spark, keep, min_docs, min_chars):
    rng = random.Random(2)
    pool = ["", "Cookie notice", " cookie NOTICE\t", "menu", "x", "é line", *[f"line {i}" for i in range(60)]]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 12)) + ["hot line"] * rng.randint(0, 2)) for _ in range(300)] + [None, ""]
    got = line_dedup.cleaned(docs(spark, texts), min_docs, min_chars, keep)
    assert collected(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(drop_lines(list(enumerate(texts)), min_docs, min_chars, keep), key=repr)


@pytest.mark.parametrize("rows", [3, 50, 100_000])
@pytest.mark.parametrize("held", [5, 100_000])
def test_line_stream_in_batches(monkeypatch, rows, held):
    """However a sorted partition is batched, lines told to drop and the open ones are the same."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = random.Random(rows)
    lines = sorted({(k, 0, rng.randrange(6 if k % 3 else 40), rng.randrange(30), 0) for k in range(12) for _ in range(rng.choice((1, 4, 60)))}, key=lambda r: r[:4])
    t = pa.table({n: pa.array([r[i] for r in lines], pa.int32() if n == "pos" else pa.int64()) for i, n in enumerate(("h1", "h2", "doc", "pos", "body"))})
    t = t.select(["h1", "h2", "doc", "body", "pos"])
    out = pa.Table.from_batches(list(line_dedup._stream(5)(iter(t.to_batches(rows))))).to_pylist()
    docs_of, first = defaultdict(set), {}
    for k, _, d, p, _ in lines:
        docs_of[k].add(d)
        first[k] = min(first.get(k, (d, p)), (d, p))
    counted = {r["h1"]: r for r in out if r["kind"] == line_dedup.COUNT}
    ends = {lines[0][0], lines[-1][0]}
    assert ends <= set(counted) and (held == 5 or ends == set(counted))
    assert all(len(docs_of[k]) == r["n_docs"] and (r["doc"], r["pos"]) == first[k] for k, r in counted.items())
    dropped = {(r["h1"], r["doc"], r["pos"], r["first"]) for r in out if r["kind"] == line_dedup.DROP}
    opened = {(r["h1"], r["doc"], r["pos"]) for r in out if r["kind"] == line_dedup.OPEN}
    told = {x[:3] for x in dropped} | opened
    for k, _, d, p, _ in lines:
        often = len(docs_of[k]) >= 5
        assert ((k, d, p) in told) == (often or k in counted and (k, d, p) in opened or k in ends), (k, d, p)
        if (k, d, p) in {x[:3] for x in dropped}:
            assert often and (k, d, p, first[k] == (d, p)) in dropped
    assert len(told) == len(dropped) + len(opened) and lines[0][0] not in {x[0] for x in dropped}


def test_line_stream_holds_little():
    """One key over many batches passes through: no more than a few batches are held."""
    held = []

    def batches():
        for i in range(300):
            held.append(pa.total_allocated_bytes())
            n = 10_000
            yield pa.record_batch({"h1": np.full(n, 7), "h2": np.full(n, 7), "doc": np.arange(i * n, (i + 1) * n), "body": np.zeros(n, np.int64), "pos": np.zeros(n, np.int32)})

    assert sum(b.num_rows for b in line_dedup._stream(10)(batches())) == 3_000_001
    assert max(held) - held[0] < 20_000_000


def test_line_dedup_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([(i, "x\nhot", "a", "b", "c", "d") for i in range(4)], "doc_id int, text string, doc string, body string, bitmap string, own_body string")
    rows = line_dedup.cleaned(df, 3).collect()
    assert {(r["doc"], r["body"], r["bitmap"], r["own_body"], r["text"], r["n_dropped"]) for r in rows} == {("a", "b", "c", "d", "", 2)}


def test_line_dedup_odd_rows(spark):
    df = odd(spark).union(docs(spark, ["same text here now", "other"], [9, 9]))
    rows = line_dedup.cleaned(df, 2).collect()
    assert len(rows) == len(ODD) + 2
    assert {r["n_dropped"] for r in rows if r["doc_id"] in (9, 10) and r["text"] != "other"} == {1}
    assert line_dedup.cleaned(docs(spark, []), 2).count() == 0
    with pytest.raises(ValueError):
        line_dedup.duplicates(df, 2, keep="some")


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    own = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(inside)


def test_quality_rules_against_plain(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choices("abcd", k=k)) for k in (2, 3, 4, 5, 9, 60, 200)] + ["a b c a b c", "x#y *$\nx#y *$\n\n"]
    df = docs(spark, texts).withColumn("n_words", F.lit("clash"))
    rows = quality_rules.judge(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_filter_on_a_verdict_stays_linear(spark):
    """The optimiser moves the filter below; bound values are still computed once."""
    df = docs(spark, [" ".join(random.Random(1).choices("abcdefgh", k=60_000))])
    assert quality_rules.judge(df).filter("kept or not kept").select("doc_id").count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert oracle.compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) == ""



def test_line_dedup_tells_rows_of_one_id_apart(spark):
    """A document is a key and a text: null and repeated ids count as often as their texts differ."""
    for ids in ([7] * 12, [None] * 12, list(range(12)), [1, 2] * 6):
        df = docs(spark, [f"shared\nown {i}" for i in range(12)], ids)
        assert {(r["n_lines"], r["n_dropped"]) for r in line_dedup.cleaned(df, 10).collect()} == {(2, 1)}
    same = docs(spark, ["shared\nown"] * 12, [7] * 12)
    assert {(r["n_lines"], r["n_dropped"]) for r in line_dedup.cleaned(same, 10).collect()} == {(2, 0)}


def test_packing_spreads_repeated_rows_and_skips_full_windows(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    long = "stone river house green " * 3000
    texts = ["a few words here"] * 300 + [long] * 40 + [None]
    df = docs(spark, texts, [1] * 300 + [2] * 40 + [3])
    rows = packing.pack(df, path, len(texts), group=50).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in rows if r["doc_id"] == 1)
    assert len(groups) == 7 and max(groups.values()) < 120
    full = [r for r in rows if r["length"] == packing.WINDOW]
    assert len(full) == 40 * (len([r for r in rows if r["doc_id"] == 2]) // 40 - 1) and len({r["sequence_id"] for r in full}) == len(full)
    other = {r["sequence_id"] for r in rows if r["length"] < packing.WINDOW}
    assert not other & {r["sequence_id"] for r in full} and all(r["offset"] == 0 for r in full)


def test_groups_in_order_do_not_wrap(spark, tmp_path):
    path = queries.tokenizer("word_bpe_49k.json")
    spark.range(5000).selectExpr("id as doc_id", "'one two' as text").repartition(1).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/a")
    rows = packing.pack_in_order(spark.read.parquet(f"{tmp_path}/a"), path, group=2).collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) == 2500
    assert all((r["sequence_id"] >> 32) == r["doc_id"] // 2 for r in rows)


def test_quality_features_keep_the_callers_columns(spark):
    df = docs(spark, ["The stone and the river.", None]).withColumn("n_words", F.lit("mine")).withColumn("_qr_w", F.lit(7)).withColumn("_own_0", F.lit(8))
    rows = pairwise_quality.scored(df, (np.ones(len(pairwise_quality.FEATURES)), 0.1)).collect()
    assert {(r["n_words"], r["_qr_w"], r["_own_0"]) for r in rows} == {("mine", 7, 8)}
