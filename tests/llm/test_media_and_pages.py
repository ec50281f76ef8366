"""FLAC round trips, page texts, URL rules."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidloom.llm import flac, pages, urlfilter


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=300), st.integers(1, 2500).map(lambda n: bytes(n)), st.integers(1, 2500).map(lambda n: random.Random(n).randbytes(n))), min_size=1, max_size=5))
def test_streams_come_back(payloads):
    for payload, (info, samples) in zip(payloads, flac.decode(flac.encode(payloads)), strict=True):
        assert (samples[0] + 128).astype(np.uint8).tobytes() == payload
        assert info["samples"] == len(payload)


def tone(n=5000):
    return bytes((128 + 100 * np.sin(np.arange(n) / 17)).astype(np.uint8))


def test_both_decoders_agree_and_seek():
    stream = flac.encode([tone()])[0]
    (info, samples), at, parts = flac.decode([stream])[0], flac.read_header(stream)["frames"], []
    while at < len(stream):
        _, own, at = flac.read_frame(stream, at, info)
        parts.append(own[0])
    assert (np.concatenate(parts) == samples[0]).all()
    first, own = flac.seek(stream, 3000)
    assert first <= 3000 < first + own.shape[1] and (own[0] == samples[0][first : first + own.shape[1]]).all()
    assert len(stream) < 0.5 * 5000


@pytest.mark.parametrize("place", ["header", "body", "md5"])
def test_damage_is_found(place):
    stream = bytearray(flac.encode([tone()])[0])
    begin = flac.read_header(bytes(stream))["frames"]
    stream[{"header": begin + 4, "body": begin + 40, "md5": 8 + 20}[place]] ^= 1
    with pytest.raises(flac.Damaged):
        flac.decode([bytes(stream)])


def bits_of(*fields):
    text = "".join(format(v & ((1 << n) - 1), f"0{n}b") if n else "" for v, n in fields)
    return text


def rice(value, k):
    folded = value << 1 ^ value >> 63
    return "0" * (folded >> k) + "1" + (format(folded & ((1 << k) - 1), f"0{k}b") if k else "")


def hand_made(samples, subframe, channels=1, form=0):
    """A stream of one frame of 16-bit samples whose subframes are given as bits."""
    body = subframe + "0" * (-len(subframe) % 8)
    head = bytes([0xFF, 0xF8, 0x60, form << 4 | 0x08, 0, len(samples[0]) - 1])
    frame = head + bytes([flac.crc8(head)]) + int(body, 2).to_bytes(len(body) // 8, "big")
    frame += int(flac.crc16([frame])[0]).to_bytes(2, "big")
    raw = np.stack(samples).T.astype("<i2").tobytes()
    packed = 44100 << 44 | (channels - 1) << 41 | 15 << 36 | len(samples[0])
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80\x00\x00\x22" + info + frame


def test_linear_prediction_partitions_and_escapes():
    x = [100, 210, 330, 445, 540, 660, 770, 900]
    coefficients, shift = (3, -1), 1
    residual = [x[i] - ((coefficients[0] * x[i - 1] + coefficients[1] * x[i - 2]) >> shift) for i in range(2, 8)]
    own = bits_of((0, 1), (32 + 1, 6), (0, 1), (x[0], 16), (x[1], 16), (4 - 1, 4), (shift, 5), (coefficients[0], 4), (coefficients[1], 4))
    own += bits_of((1, 2), (1, 4), (6, 5)) + "".join(rice(r, 6) for r in residual[:2]) + bits_of((31, 5), (12, 5), *((r, 12) for r in residual[2:]))
    assert flac.decode([hand_made([np.array(x)], own)])[0][1][0].tolist() == x


def test_stereo_and_wasted_bits():
    left, right = np.array([8, 16, 24, 40]), np.array([4, 12, 28, 36])
    own = bits_of((0, 1), (1, 6), (1, 1)) + "01" + bits_of(*((int(v) >> 2, 14) for v in left))
    side = left - right
    own += bits_of((0, 1), (1, 6), (0, 1), *((int(v), 17) for v in side))
    info, samples = flac.decode([hand_made([left, right], own, channels=2, form=8)])[0]
    assert (samples == np.stack([left, right])).all() and info["channels"] == 2


@pytest.mark.parametrize("number", [0, 127, 128, 2047, 2048, 65535, 65536, (1 << 21) - 1, 1 << 21, 1 << 26, (1 << 31) - 1])
def test_frame_numbers(number):
    packed = flac._utf8(number)
    assert flac._read_utf8(packed + b"x", 0) == (number, len(packed))


def slow_decode(stream):
    """Samples of a mono stream, bit by bit from the format's description; nothing of the module is used."""
    at, last = 4, False
    while not last:
        last, size = stream[at] >> 7, int.from_bytes(stream[at + 1 : at + 4], "big")
        if not stream[at] & 127:
            block, total = int.from_bytes(stream[at + 4 : at + 6], "big"), int.from_bytes(stream[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + size
    bits, place, out = "".join(f"{b:08b}" for b in stream), 8 * at, []

    def take(n, signed=False):
        nonlocal place
        value = int(bits[place : place + n] or "0", 2)
        place += n
        return value - (1 << n) if signed and n and value >> (n - 1) else value

    def unary():
        nonlocal place
        n = bits.index("1", place) - place
        place += n + 1
        return n

    while len(out) < total:
        assert take(15) == 0b111111111111100 and take(1) == 0 and take(4) == 7 and take(12) == 2
        ones = bits.index("0", place) - place
        place += 8 * max(1, ones)
        size = take(16) + 1
        assert size == min(block, total - len(out))
        take(8), take(1)
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            own = [take(8, True)] * size
        elif kind == 1:
            own = [take(8, True) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            own = [take(8, True) for _ in range(order)]
            shift, weights = 0, [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if kind < 32 else ()
            if kind >= 32:
                precision, shift = take(4) + 1, take(5, True)
                weights = [take(precision, True) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            for _ in range(size - order):
                folded = unary() << k | take(k)
                own.append((sum(w * own[-1 - i] for i, w in enumerate(weights)) >> shift) + (folded >> 1 ^ -(folded & 1)))
        out += own
        place += -place % 8 + 16
    return bytes(x + 128 for x in out)


@pytest.mark.parametrize("size", [1, 63, 64, 1023, 1025, 5000, 132_000])
def test_against_a_slow_decoder(size):
    """Text, a tone and noise, so that linear and fixed predictors, verbatim and constant frames come up."""
    r = random.Random(size)
    prose = " ".join(r.choice(["the", "of", "words", "and", "sentence"]) for _ in range(size))[: size // 3]
    payload = (prose.encode() + tone(size // 3) + r.randbytes(size // 6) + bytes(size))[:size]
    stream = flac.encode([payload])[0]
    assert slow_decode(stream) == payload == (flac.decode([stream])[0][1][0] + 128).astype(np.uint8).tobytes()


def test_linear_frames_are_made():
    stream = flac.encode([tone(4096)])[0]
    info = flac.read_header(stream)
    head = flac._frame_header(stream, info["frames"], info)
    assert stream[head["body"]] >= 0x40 and len(stream) < 2000


@pytest.mark.parametrize("size", [131_072, 140_000, 3_000_000])
def test_long_payloads(size):
    payload = (b"some words of a very long text, and a number " + str(size).encode()) * (size // 40)
    assert (flac.decode(flac.encode([payload[:size]]))[0][1][0] + 128).astype(np.uint8).tobytes() == payload[:size]


def test_media_columns(spark):
    texts = ["", None, "abc", "abc", "é" * 700, "x " * 40_000, "long text " * 14_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    found = {r["doc_id"]: r for r in flac.round_trip(frame).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert found[2]["media_sha256"] == found[3]["media_sha256"] and found[0]["feature"] == found[1]["feature"]
    stored = flac.store(frame.drop("media"))
    blocks = flac.pcm_blocks(stored).where("doc_id = 4").orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [0, 1024] and sum(b["samples"] for b in blocks) == 1408
    assert flac.round_trip(frame.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; {n}</h1><p>One<br>two   <b>three</b><p>Four&nbsp;{n}<ul><li>a<li>b</ul><form>f</form><aside>side</aside>
<div class="ad">Buy</div><section id="comments"><p>nice</p></section></article><footer>&copy; us</footer></body></html>"""


def test_article_text():
    assert pages.wrap([PAGE.replace("{n}", "7")]) == ["Title & 7\nOne two three\nFour 7\na\nb"]


def test_a_banner_inside_the_article_is_template():
    """The wrapper alone tells an unlabelled banner that a host repeats inside its articles from what they say."""
    page = "<html><body><article><h1>Head {n}</h1><p>Read all of our stories on your phone.</p>{more}<p>Text number {n} of a page, and what it says in a good many words, so that a banner is a small part of it all, as banners are wont to be.</p></article></body></html>"
    made = [page.replace("{more}", f"<div><p>extra {i}</p></div>" if i % 2 else "").replace("{n}", str(i)) for i in range(6)]
    texts = [f"Head {i}\n" + f"extra {i}\n" * (i % 2) + f"Text number {i} of a page, and what it says in a good many words, so that a banner is a small part of it all, as banners are wont to be." for i in range(6)]
    assert pages.wrap(made) == texts and pages.wrap(made[::-1]) == texts[::-1]
    assert "on your phone" in pages.wrap(made[:1])[0]


def test_versions_of_one_text_keep_it():
    page = "<html><body><article><h1>Head</h1><p>The same long text on all of these pages, word for word.</p><p>{n}</p></article></body></html>"
    assert all("word for word" in x for x in pages.wrap([page.replace("{n}", str(i)) for i in range(6)]))


def test_names_that_only_sound_like_roles():
    page = '<html><body><article><div class="article-header"><h1>Title</h1><span>by me</span></div><h2 id="discussion">Discussion</h2><p>We discuss.</p></article></body></html>'
    assert pages.wrap([page]) == ["Title\nDiscussion\nWe discuss."]


def test_unmarked_pages_use_the_wrapper():
    page = '<html><body><div><p>Our shop since 1990, call us any time you like</p></div><div id="x"><h2>Head {n}</h2><p>Text number {n} of a page</p></div><div><p>Terms and addresses of our many branches</p></div></body></html>'
    found = pages.wrap([page.replace("{n}", str(i)) for i in range(10)])
    assert found == [f"Head {i}\nText number {i} of a page" for i in range(10)]


def test_copies_are_no_template():
    assert pages.wrap([PAGE] * 20) == [pages.wrap([PAGE])[0]] * 20


@pytest.mark.parametrize("page", ["", "plain", "<p", "a < b", "<div " * 2000, "<div>" * 3000 + "deep", "<p>a<p>b</div></div>", "<script>never closed", "<!-- open"])
def test_broken_pages_are_read(page):
    assert isinstance(pages.wrap([page])[0], str)


def tree(label, *children):
    return label, tuple(children)


def test_simple_tree_matching_is_the_largest():
    a = tree("r", tree("a", tree("x"), tree("y")), tree("b"), tree("c", tree("z")))
    b = tree("r", tree("b"), tree("a", tree("y")), tree("c", tree("z"), tree("w")))
    assert pages.matching(a, b)[0] == 5  # r, a with y, c with z
    assert pages.matching(a, a)[0] == 7
    assert pages.matching(a, tree("q"))[0] == 0


def test_page_table(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{n}", str(i)), 1) for i in range(150)] + [(200, None, None, 1), (201, "no scheme", "", 1), (201, "no scheme", "", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = pages.main_text(frame).collect()
    assert len(found) == 153
    for r in found:
        assert r["text"] == ("" if r["page_id"] >= 200 else f"Title & {r['page_id']}\nOne two three\nFour {r['page_id']}\na\nb") and r["n_chars"] == len(r["text"])
    assert pages.main_text(frame.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_url(url, entries):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in entries if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    parts = ["http", "://", "a.example.org", "EXAMPLE.ORG", "x.com", "notexample.org", "/es/", "/en/1", "/en/12", "/fr/", "/de/", "?q=/es/", "#/", "", "org", "é"]
    r = random.Random(5)
    urls = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(400)] + [f"https://{h}{p}" for h in ("a.example.org", "x.com", "y.net", "casino.net") for p in parts] + [None, "", "://"]
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    rules = spark.createDataFrame([*RULES, RULES[0]], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://casino.net",), (None,)], "url string")
    found = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urlfilter.judged(frame, rules, listed).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u, RULES)
        assert found[i] == (host, path, rule, verdict or ("block" if host.rstrip(":") == "casino.net" else "allow")), u
    assert urlfilter.judged(frame.limit(0), rules, listed).count() == 0
    assert {x["verdict"] for x in urlfilter.judged(frame, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_listed_urls_are_canonical(spark):
    listed = spark.createDataFrame([("HTTP://user@www.lists.net:8080//bad/dir",), ("x://one.net./page?q#f",)], "url string")
    hits = ["https://lists.net/bad/dir", "a://WWW.lists.net:1/bad//dir/", "a://sub.lists.net/bad/dir/more?x=/", "a://u@one.net/page", "a://one.net/page/x"]
    misses = ["a://lists.net/bad/directory", "a://lists.net/bad", "a://notlists.net/bad/dir", "a://one.net/pages", "a://one.net", "lists.net/bad/dir"]
    frame = spark.createDataFrame([*((u, "block") for u in hits), *((u, "allow") for u in misses)], "url string, page_id string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert all(r["verdict"] == r["page_id"] for r in urlfilter.judged(frame, rules, listed).collect())


def test_bloom_filter_passes_all_listed(spark):
    listed = spark.range(3000).selectExpr("concat('k', id) as key")
    words, n = urlfilter.build(listed, "key")
    assert urlfilter.possible(listed, "key", urlfilter.table(words), n).count() == 3000
    others = spark.range(20_000).selectExpr("concat('other', id) as key")
    assert urlfilter.possible(others, "key", urlfilter.table(words), n).count() < 400


def test_payloads():
    assert [len(x) for x in flac.payloads(pa.array(["", None, "a" * 64, "a" * 65]))] == [64, 64, 64, 128]
